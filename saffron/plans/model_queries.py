"""Queries over models: fits from sums, compiled scorers, rollouts and backtests, with their metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..models import compiled, demand, forecast, risk
from ..sources.shared import kept
from . import queries as base
from .queries import longs, union
from .tables import Domain

QUERIES: dict[str, base.Query] = {}
#: Bounds of the splits.
HOURS, WEEKS = ("2024-01-20", "2024-01-25"), ("2000-01-01", "2000-10-01")
ORIGINS = ["1999-06-30", "2000-06-30", "2000-12-31"]
ENTITY = ["restaurant_id", "category_id"]


def query(f):
    QUERIES[f.__name__] = lambda spark, sf_dir: f(Domain(spark, sf_dir))
    return f


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to so many digits: sums of doubles depend on the order in which parts arrive."""
    return df.select(*(F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


@query
def demand_model(d: Domain) -> DataFrame:
    """The three learners compared, the chosen one refit and tested beside the week before.

    Errors are given where SQL can repeat them: of the linear model, fit from sums, on either
    split and of the week before. ``demand_ensembles`` gives those of the ML library.
    """
    panel = kept(base.hourly_facts_panel(d), "hourly-facts")
    told = rounded(demand.fit_sums(panel, "event_type", "hour", "orders", *HOURS)[1])
    fitted = demand.fit(panel, "event_type", "hour", "orders", *HOURS)
    name = F.when((F.col("split") == "test") & (F.col("name") == fitted.chosen), "chosen").otherwise(F.col("name")).alias("name")
    learned = fitted.report.select(name, "split", F.col("n").alias("_n"), (F.col("rmse").isNotNull() & F.col("mae").isNotNull()).alias("has_errors"))
    rows = told.join(learned, ["name", "split"], "full")
    return rows.select("name", "split", F.coalesce("n", "_n").alias("n"), "rmse", "mae", "r2", F.coalesce("has_errors", F.col("rmse").isNotNull() & F.col("mae").isNotNull()).alias("has_errors"))


@query
def demand_coefficients(d: Domain) -> DataFrame:
    model, _ = demand.fit_sums(base.hourly_facts_panel(d), "event_type", "hour", "orders", *HOURS)
    return rounded(d.spark.createDataFrame(model.rows(), "name string, coefficient double"))


@query
def demand_ensembles(d: Domain) -> DataFrame:
    """Errors of the linear model, forest and boosted trees of the ML library, of the one chosen, and of the week before."""
    fitted = demand.fit(base.hourly_facts_panel(d), "event_type", "hour", "orders", *HOURS)
    return rounded(fitted.report.withColumn("chosen", F.col("name") == fitted.chosen))


def risk_panel(d: Domain) -> DataFrame:
    week = F.to_date(F.date_trunc("week", F.col("order_datetime"))).alias("week")
    sales = base.sold(d).groupBy(*ENTITY, week).agg(F.sum("quantity").alias("demand"))
    return base.weekly_panel(d).join(sales, [*ENTITY, "week"], "left").fillna(0, ["demand"])


@query
def wastage_risk_model(d: Domain) -> DataFrame:
    """The weekly wastage-risk model, fit by Newton steps over sums: threshold, confusion counts, rates and AUC of either split."""
    return rounded(risk.fit_sums(risk_panel(d), ENTITY, "week", "waste", "demand", *WEEKS)[1])


@query
def wastage_risk_ensembles(d: Domain) -> DataFrame:
    """Metrics of the three classifiers of the ML library, and of the chosen one on the test weeks."""
    fitted = risk.fit(risk_panel(d), ENTITY, "week", "waste", "demand", *WEEKS)
    return rounded(fitted.report.withColumn("chosen", F.col("name") == fitted.chosen))


@query
def disengagement_model(d: Domain) -> DataFrame:
    """The later months' customers, those of them disengaged, and how well a model of the earlier months tells them."""
    return rounded(risk.disengagement_model(base.disengagement_labels(d))[1])


@query
def compiled_scores(d: Domain) -> DataFrame:
    """(model, split, rows, differing): rows whose compiled score isn't that of the fitted pipeline."""
    at = F.col("hour")
    split = F.when(at < F.lit(HOURS[0]).cast("timestamp_ntz"), "train").when(at < F.lit(HOURS[1]).cast("timestamp_ntz"), "validation").otherwise("test")
    rows = kept(demand.features(base.hourly_facts_panel(d), "event_type", "hour", "orders").withColumn("split", split), "hours")
    out = []
    for name, estimator in demand.estimators("orders").items():
        model = demand.pipeline("event_type", demand.feature_names("orders"), estimator).fit(rows.where("split = 'train'"))
        scored = compiled.compiled(model).score(model.transform(rows).withColumnRenamed("prediction", "_own"), "_compiled")
        off = F.abs(F.col("_own") - F.col("_compiled")) > 1e-9 * F.greatest(F.lit(1.0), F.abs("_own"))
        out.append(scored.groupBy(F.lit(name).alias("model"), "split").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.coalesce(off, F.lit(True))).alias("differing")))
    return union(out)


@query
def one_row_scores(d: Domain) -> DataFrame:
    """The last hour of each of the first five event types, scored row by row as a service would."""
    panel = base.hourly_facts_panel(d)
    scorer = demand.fit_sums(panel, "event_type", "hour", "orders", *HOURS)[0].scorer()
    rows = demand.features(panel, "event_type", "hour", "orders")
    last = rows.join(F.broadcast(rows.agg(F.max("hour").alias("hour"))), "hour").orderBy("event_type").limit(5).collect()
    told = [(r["event_type"], r["hour"], scorer.one(d.spark, r.asDict())) for r in last]
    return rounded(d.spark.createDataFrame(told, "event_type string, hour timestamp_ntz, prediction double"))


@query
def daily_rollout(d: Domain) -> DataFrame:
    """28 days ahead of each channel: the model's recursive predictions beside the repeated week."""
    panel = forecast.daily_panel(base.channel_days(d))
    out = forecast.rollout(panel, forecast.fit_linear(forecast.training(panel)), 28)
    return rounded(longs(out.select("entity", "day", "horizon_day", "prediction", "baseline"), "horizon_day"))


@query
def rising_rollout(d: Domain) -> DataFrame:
    """The recursion alone: each day is the one before it plus one."""
    out = forecast.rollout(forecast.daily_panel(base.channel_days(d)), lambda lag, day: lag[1] + 1, 28)
    return longs(out.select("entity", "day", "horizon_day", "prediction"), "horizon_day")


@query
def forecast_coefficients(d: Domain) -> DataFrame:
    """(origin, name, coefficient) of the models of all origins, from one scan."""
    found = forecast.fit_origins(forecast.daily_panel(base.channel_days(d)), ORIGINS)
    return rounded(d.spark.createDataFrame([(o, *r) for o, m in found.items() for r in m.rows()], "origin string, name string, coefficient double"))


@query
def backtest_errors(d: Domain) -> DataFrame:
    """Rolling origins: errors of the model and of the repeated week at each horizon."""
    return rounded(longs(forecast.backtest(forecast.daily_panel(base.channel_days(d)), ORIGINS), "horizon"))
