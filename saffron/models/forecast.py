"""Daily forecasts: lag features, recursive rollout inside the row, rolling-origin backtests.

The model is a ridge regression from sums of products; those of all origins of a backtest
come from one scan, and all origins roll out in one job. The rollout unfolds step by step in one higher-order expression per entity: each
step reads its lags from an array of the last values and appends its prediction.
No step needs a join, a job or a trip through Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import Weekday, weekday
from ..operators import panels
from .linear import Linear, linear, linear_by_origin

LAGS = (1, 7, 28)
HISTORY = max(LAGS)
MOST_DAYS = 28
FEATURES = [*(f"units_lag_{k}" for k in LAGS), "dow", "month"]
#: A prediction from lag values by length, and the day.
Predict = Callable[[dict[int, Column], Column], Column]


def daily_panel(facts: DataFrame) -> DataFrame:
    """(entity, day, units) for every day; an absent day is zero, a repeated one an error."""
    return panels.dense(panels.check_unique(facts, ["entity"], "day"), ["entity"], "day", "1 day", ["units"])


def training(panel: DataFrame) -> DataFrame:
    rows = panels.lags(panel.withColumn("units", F.col("units").cast("double")), ["entity"], "day", "units", LAGS)
    day = F.col("day")
    return rows.withColumns({"dow": weekday(day, Weekday.MONDAY_0).cast("double"), "month": F.month(day).cast("double")}).where(f"units_lag_{HISTORY} is not null")


def step_of(intercept: Column, coefficient: dict[str, Column]) -> Predict:
    """A linear model as a step of the rollout, its numbers given as columns."""

    def predict(lag: dict[int, Column], day: Column) -> Column:
        out = intercept
        for k in LAGS:
            out = out + coefficient[f"units_lag_{k}"] * lag[k]
        return out + coefficient["dow"] * weekday(day, Weekday.MONDAY_0) + coefficient["month"] * F.month(day)

    return predict


def fit_linear(rows: DataFrame) -> Predict:
    """A linear model of all rows as a Column expression, usable inside the rollout."""
    model = linear(rows, FEATURES, "units")
    return step_of(F.lit(model.intercept), {n: F.lit(c) for n, c in zip(model.names, model.coefficients, strict=True)})


def fit_origins(panel: DataFrame, origins: list[str]) -> dict[str, Linear]:
    """A model for each origin from the days up to it, from one scan of the panel."""
    return linear_by_origin(training(panel), FEATURES, "units", "day", origins)


def naive(lag: dict[int, Column], day: Column) -> Column:
    return lag[7]


def rollout(panel: DataFrame, predict: Predict, days: int, origin: Column | None = None, origins: DataFrame | None = None) -> DataFrame:
    """(entity, day, horizon_day, prediction, baseline): ``days`` steps after each entity's last day.

    Predictions aren't below zero and become the lags of later steps; the baseline
    repeats the last week. Entities with under 28 days of history raise when run.
    ``origin`` is the last day to use; ``origins``, a table of few rows, holds several in
    ``_last`` (which the result then carries) with what ``predict`` needs for each.
    """
    if not 1 <= days <= MOST_DAYS:
        raise ValueError(f"the horizon must be between 1 and {MOST_DAYS} days")
    if origins is None:
        last = panel.agg(F.max("day").alias("_last")) if origin is None else panel.sparkSession.range(1).select(origin.cast("date").alias("_last"))
    else:
        last = origins
    near = panel.join(F.broadcast(last), (F.col("day") <= F.col("_last")) & (F.col("day") > F.date_sub("_last", HISTORY)))
    # At most 28 values for each entity and origin.
    history = near.groupBy("entity", *last.columns).agg(F.transform(F.array_sort(F.collect_list(F.struct("day", F.col("units").cast("double").alias("units")))), lambda x: x["units"]).alias("_past"))
    history = history.withColumn("_past", F.when(F.size("_past") == HISTORY, F.col("_past")).otherwise(F.raise_error(F.lit(f"an entity has under {HISTORY} days of history"))))

    def steps(model: Predict) -> Column:
        def one(past: Column, k: Column) -> Column:
            lag = {n: F.element_at(past, -n) for n in LAGS}
            return F.concat(past, F.array(F.greatest(F.lit(0.0), model(lag, F.date_add("_last", k)))))

        return F.slice(F.aggregate(F.sequence(F.lit(1), F.lit(days)), F.col("_past"), one), HISTORY + 1, days)

    rows = history.select("entity", "_last", F.arrays_zip(steps(predict).alias("prediction"), steps(naive).alias("baseline")).alias("_x"))
    out = rows.select("entity", "_last", F.posexplode("_x").alias("_at", "_v"))
    told = ["_last"] if origins is not None else []
    return out.select(*told, "entity", F.date_add("_last", F.col("_at") + 1).alias("day"), (F.col("_at") + 1).alias("horizon_day"), F.col("_v.prediction").alias("prediction"), F.col("_v.baseline").alias("baseline"))


def backtest(panel: DataFrame, origins: list[str], horizons: tuple[int, ...] = (7, 14, 28)) -> DataFrame:
    """(origin, horizon, n, mae, rmse, naive_mae, naive_rmse): each origin is fit on days up to it only.

    One scan fits all origins, and one job rolls them out and compares; origins are given
    one by one, so their models are a table of few rows.
    """
    models = fit_origins(panel, origins)
    table = [(o, m.intercept, *m.coefficients) for o, m in models.items()]
    known = panel.sparkSession.createDataFrame(table, "origin string, intercept double, " + ", ".join(f"`c_{n}` double" for n in FEATURES))
    known = known.withColumn("_last", F.col("origin").cast("date")).drop("origin")
    step = step_of(F.col("intercept"), {n: F.col(f"c_{n}") for n in FEATURES})
    made = rollout(panel, step, max(horizons), origins=known).join(panel.select("entity", "day", "units"), ["entity", "day"])
    spread = made.withColumn("horizon", F.explode(F.filter(F.array(*map(F.lit, horizons)), lambda h: h >= F.col("horizon_day"))))
    err, base = F.col("units") - F.col("prediction"), F.col("units") - F.col("baseline")
    return spread.groupBy(F.col("_last").alias("origin"), "horizon").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"), F.avg(F.abs(base)).alias("naive_mae"), F.sqrt(F.avg(base * base)).alias("naive_rmse"),
    )


def select(forecasts: DataFrame, level: str, entity: str, horizon: int) -> DataFrame:
    """A served forecast: one level and entity, one of the horizons offered."""
    if horizon not in (7, 14, 28):
        raise ValueError("horizon must be 7, 14 or 28")
    return forecasts.where((F.col("level") == level) & (F.col("entity") == entity) & (F.col("horizon_day") <= horizon)).orderBy("day")
