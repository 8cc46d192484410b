"""Models from sums and compiled scorers against plain algebra, the ML library and another engine."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from saffron.models import compiled, demand, evaluate, forecast, linear, risk
from saffron.plans import queries as base
from saffron.plans.tables import Domain

SF = "/root/testdata/sf0.01"


def points(n=400, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = rng.randint(0, 9), rng.gauss(0, 3)
        y = 2 + 0.5 * a - 1.5 * b + rng.gauss(0, 1)
        rows.append((i, float(a), b, 4.0, y, int(y + rng.gauss(0, 2) > 3), f"2026-01-{i % 28 + 1:02d}"))
    return rows


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(points(), "id int, a double, b double, same double, y double, label int, day string").withColumn("day", F.col("day").cast("date")).persist()


def plain_ridge(x, y, penalty):
    """Closed form; a constant column gets no coefficient."""
    moving = [j for j in range(x.shape[1]) if x[:, j].std() > 0]
    mean_x, mean_y = x[:, moving].mean(axis=0), y.mean()
    c = (x[:, moving] - mean_x).T @ (x[:, moving] - mean_x)
    beta = np.zeros(x.shape[1])
    beta[moving] = np.linalg.solve(c + penalty * np.diag(np.diag(c)), (x[:, moving] - mean_x).T @ (y - mean_y))
    return mean_y - x.mean(axis=0) @ beta, beta


def test_linear_against_closed_form_and_library(spark, frame):
    rows = points()
    x, y = np.array([[r[1], r[2], r[3]] for r in rows]), np.array([r[4] for r in rows])
    for penalty in (0.0, 0.001, 0.5):
        got = linear.linear(frame, ["a", "b", "same"], "y", penalty)
        want = plain_ridge(x, y, penalty)
        assert np.allclose([got.intercept, *got.coefficients], [want[0], *want[1]], atol=1e-8)
    own = linear.linear(frame, ["a", "b"], "y", 0.0)
    other = LinearRegression(featuresCol="x", labelCol="y", solver="normal").fit(VectorAssembler(inputCols=["a", "b"], outputCol="x").transform(frame))
    assert np.allclose([own.intercept, *own.coefficients], [other.intercept, *other.coefficients], atol=1e-8)
    nulls = frame.unionByName(frame.limit(5).withColumn("a", F.lit(None).cast("double")))
    assert np.allclose(linear.linear(nulls, ["a", "b"], "y", 0.0).coefficients, own.coefficients)
    assert linear.linear(frame.limit(0), ["a", "b"], "y").coefficients == (0.0, 0.0)
    predicted = {r["id"]: r["p"] for r in frame.select("id", own.column().alias("p")).collect()}
    assert all(math.isclose(predicted[r[0]], own.intercept + own.coefficients[0] * r[1] + own.coefficients[1] * r[2]) for r in rows)


def test_models_of_all_origins_equal_models_one_by_one(frame):
    origins = ["2026-01-20", "2026-01-05", "2025-12-31", "2026-03-01"]
    got = linear.linear_by_origin(frame, ["a", "b"], "y", "day", origins)
    assert list(got) == sorted(origins)
    for o, model in got.items():
        want = linear.linear(frame.where(F.col("day") <= F.lit(o).cast("date")), ["a", "b"], "y")
        assert np.allclose([model.intercept, *model.coefficients], [want.intercept, *want.coefficients])
    assert linear.linear_by_origin(frame, ["a"], "y", "day", []) == {}


def test_logistic_against_library(frame):
    weight = F.when(F.col("label") == 1, 2.0).otherwise(1.0)
    own = linear.logistic(frame, ["a", "b", "same"], "label", weight, penalty=0.0)
    x = VectorAssembler(inputCols=["a", "b"], outputCol="x").transform(frame.withColumn("w", weight))
    other = LogisticRegression(featuresCol="x", labelCol="label", weightCol="w", maxIter=200, tol=1e-12).fit(x)
    assert np.allclose([own.intercept, *own.coefficients[:2]], [other.intercept, *other.coefficients], atol=1e-5) and abs(own.coefficients[2]) < 1e-9
    assert linear.logistic(frame.limit(0), ["a"], "label").coefficients == (0.0,)
    far = frame.withColumn("b", F.col("b") * 1e6)
    assert all(0 <= r["p"] <= 1 for r in far.select(own.column().alias("p")).collect())


def test_auc_against_all_pairs(spark):
    rng = random.Random(2)
    rows = [(rng.randint(0, 12) / 10, rng.randint(0, 1)) for _ in range(300)]
    pos, neg = [p for p, y in rows if y], [p for p, y in rows if not y]
    want = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    scored = spark.createDataFrame(rows, "probability_positive double, label int").repartition(5)
    assert math.isclose(evaluate.roc_auc(scored).first()["roc_auc"], want)
    assert evaluate.roc_auc(scored.where("label = 1")).first()["roc_auc"] is None


def test_backtest_equals_origins_one_by_one(spark):
    panel = forecast.daily_panel(base.channel_days(Domain(spark, SF))).persist()
    origins = ["1999-06-30", "2000-12-31"]
    got = {(str(r["origin"]), r["horizon"]): r for r in forecast.backtest(panel, origins, (7, 28)).collect()}
    units = {(r["entity"], r["day"]): r["units"] for r in panel.collect()}
    for o in origins:
        day = F.lit(o).cast("date")
        model = forecast.fit_linear(forecast.training(panel.where(F.col("day") <= day)))
        made = forecast.rollout(panel, model, 28, day).collect()
        for h in (7, 28):
            errors = [units[r["entity"], r["day"]] - r["prediction"] for r in made if r["horizon_day"] <= h]
            base_errors = [units[r["entity"], r["day"]] - r["baseline"] for r in made if r["horizon_day"] <= h]
            r = got[o, h]
            assert r["n"] == len(errors) and math.isclose(r["mae"], np.mean(np.abs(errors))) and math.isclose(r["rmse"], np.sqrt(np.mean(np.square(errors))))
            assert math.isclose(r["naive_mae"], np.mean(np.abs(base_errors)))
    assert len(got) == 4


# ------------------------------------------------------------------ compiled


def both_engines(model, rows, sql, own):
    """The largest difference of the compiled score from ``own``, in Spark and in DuckDB."""
    data = rows.select(*own[1:], F.expr(own[0]).alias("_own")) if len(own) > 1 else rows
    table = data.toPandas()  # noqa: F841
    con = duckdb.connect()
    con.register("t", data.toArrow())
    here = np.array([r["s"] for r in data.select(compiled.Scorer(sql, ()).column().alias("s")).collect()])
    there = np.array([x for (x,) in con.execute(f"SELECT {sql} FROM t").fetchall()])
    want = np.array([r["_own"] for r in data.collect()])
    scale = np.maximum(1, np.abs(want))
    return np.max(np.abs(here - want) / scale), np.max(np.abs(there - want) / scale)


def test_compiled_regressions_in_both_engines(spark):
    rows = demand.features(base.hourly_facts_panel(Domain(spark, SF)), "event_type", "hour", "orders").persist()
    names = demand.feature_names("orders")
    rows = rows.withColumn("orders_lag_24", F.when(F.col("hour_of_day") != 5, F.col("orders_lag_24")))  # some to impute
    train = rows.where(F.col("hour") < F.lit("2024-01-20").cast("timestamp_ntz")).where("event_type <> 'purchase'")  # one type is never seen
    for name, est in demand.estimators("orders").items():
        model = demand.pipeline("event_type", names, est).fit(train)
        scorer = compiled.compiled(model)
        assert set(scorer.columns) == {"event_type", *names}
        data = model.transform(rows).select("event_type", *names, F.col("prediction").alias("_own")).persist()
        assert data.where("event_type = 'purchase'").count() > 0
        assert max(both_engines(model, data, scorer.sql, ["_own"])) < 1e-9, name
        one = data.where("orders_lag_24 is not null").first().asDict()
        assert math.isclose(scorer.one(spark, one), one["_own"], rel_tol=1e-9)
        missing = data.where("orders_lag_24 is null").first().asDict()
        assert math.isclose(scorer.one(spark, missing), missing["_own"], rel_tol=1e-9)


def test_models_from_sums_in_both_engines(spark, frame):
    for model in (linear.linear(frame, ["a", "b", "same"], "y"), linear.logistic(frame, ["a", "b"], "label")):
        own = frame.select("a", "b", "same", model.column().alias("_own")).persist()
        assert max(both_engines(model, own, model.scorer().sql, ["_own"])) < 1e-12
        row = own.first().asDict()
        assert math.isclose(model.scorer().one(spark, row), row["_own"])


def test_compiled_classifiers_in_both_engines(spark):
    rng = random.Random(4)
    rows = [(f"p{rng.randint(0, 4)}", "it's" if rng.random() < 0.3 else "b\"q\\n", rng.gauss(0, 2), float(rng.randint(0, 5))) for _ in range(600)]
    data = spark.createDataFrame(rows, "place string, kind string, x double, n double")
    data = data.withColumn("label", ((F.col("x") + F.col("n") + F.when(F.col("place") == "p1", 3).otherwise(0)) > 3).cast("int")).withColumn("weight", F.lit(1.0)).persist()
    stages = [StringIndexer(inputCols=["place", "kind"], outputCols=["_p", "_k"], handleInvalid="keep"), OneHotEncoder(inputCols=["_p", "_k"], outputCols=["_pv", "_kv"], handleInvalid="keep"), VectorAssembler(inputCols=["_pv", "_kv", "x", "n"], outputCol="features")]
    for name, est in risk.estimators().items():
        model = Pipeline(stages=[*stages, est]).fit(data)
        own = model.transform(data).select("place", "kind", "x", "n", vector_to_array("probability")[1].alias("_own")).persist()
        assert max(both_engines(model, own, compiled.compiled(model).sql, ["_own"])) < 1e-9, name
    with pytest.raises(TypeError, match="no expression"):
        compiled.compiled(Pipeline(stages=stages).fit(data))


def test_demand_model_compares_all_learners(spark):
    """Not the linear one alone: all three on validation, the chosen one and the week before on test."""
    from saffron.plans.model_queries import QUERIES

    rows = {(r["name"], r["split"]): r for r in QUERIES["demand_model"](spark, SF).collect()}
    assert set(rows) == {("linear", "validation"), ("forest", "validation"), ("boosted", "validation"), ("linear", "test"), ("chosen", "test"), ("seasonal_naive", "test")}
    assert all(r["has_errors"] and r["n"] > 0 for r in rows.values()) and rows["linear", "validation"]["rmse"] > 0
