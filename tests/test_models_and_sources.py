"""Forecasts, models, the generator, sinks and the stream."""

from datetime import date, timedelta

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from saffron.models import demand, evaluate, forecast
from saffron.operators import quality
from saffron.sources import generator, sinks
from saffron.streaming import hourly


def history(spark, days=28, first=0):
    return spark.createDataFrame([("a", date(2026, 1, 5) + timedelta(i), float(i + first)) for i in range(days)], "entity string, day date, units double")


def test_rollout_feeds_its_own_predictions(spark):
    rows = forecast.rollout(history(spark), lambda lag, day: lag[1] + 1, 14).orderBy("day").collect()
    assert [r["prediction"] for r in rows] == [float(x) for x in range(28, 42)]
    assert [r["baseline"] for r in rows] == [float(21 + i % 7) for i in range(14)]
    assert rows[0]["day"] == date(2026, 2, 2)
    down = forecast.rollout(history(spark), lambda lag, day: lag[1] - 100, 2).collect()
    assert {r["prediction"] for r in down} == {0.0}


def test_rollout_errors(spark):
    with pytest.raises(ValueError, match="horizon"):
        forecast.rollout(history(spark), forecast.naive, 29)
    with pytest.raises(Exception, match="under 28 days"):
        forecast.rollout(history(spark, 20), forecast.naive, 7).collect()
    with pytest.raises(ValueError, match="horizon"):
        forecast.select(history(spark), "item", "a", 5)


def test_backtest_beats_nothing_but_runs(spark):
    rows = spark.createDataFrame([(e, date(2026, 1, 1) + timedelta(i), float(10 + i % 7)) for e in "ab" for i in range(90)], "entity string, day date, units double")
    got = forecast.backtest(forecast.daily_panel(rows), ["2026-02-20"], (7, 14)).collect()
    assert {(r["horizon"], r["n"]) for r in got} == {(7, 14), (14, 28)} and all(r["naive_mae"] == 0 for r in got)


def test_threshold_sweep(spark):
    rows = spark.createDataFrame([(0.05, 0), (0.5, 1), (0.5, 0), (0.96, 1), (0.2, 0)], "probability_positive double, label int")
    got = {round(r["threshold"], 2): r for r in evaluate.threshold_sweep(rows).collect()}
    assert len(got) == 19
    for t, r in got.items():
        want = [sum(1 for p, y in ((0.05, 0), (0.5, 1), (0.5, 0), (0.96, 1), (0.2, 0)) if (p >= t - 1e-12) == hit and y == lab) for hit, lab in ((True, 1), (True, 0), (False, 1), (False, 0))]
        assert [r["tp"], r["fp"], r["fn"], r["tn"]] == want
    assert evaluate.best_threshold(evaluate.threshold_sweep(rows)).first()["recall"] == 1.0


def test_demand_features_leak_nothing():
    assert not set(demand.feature_names("orders")) & set(demand.NEVER_FEATURES)


def test_model_reload(spark, tmp_path):
    rows = spark.createDataFrame([(float(i), 2.0 * i) for i in range(20)], "x double, y double")
    model = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="features"), LinearRegression(labelCol="y")]).fit(rows)
    loaded = sinks.save_model(model, f"file://{tmp_path}/model", rows)
    assert loaded.transform(rows.where("x = 3")).first()["prediction"] == pytest.approx(6.0, abs=1e-6)


def test_generated_tables_pass_validation_and_defects_are_found(spark):
    clean = generator.generate(spark, generator.Size(customers=50, orders=120, ratings=40, stock=30, waste=30, prices=20, items=30, promotions=10, restaurants=5))
    dirty, manifest = generator.inject(clean, seed=3)
    declared = {(r["table"], r["issue"]): r["rows"] for r in manifest.collect()}
    as_text = {n: df.select(*(F.col(c).cast("string").alias(c) for c in df.columns)) for n, df in clean.items() if n in ("customers", "restaurants", "menu_categories", "menu_items", "promotions", "orders")}
    done = quality.validate_all(as_text, lambda df, name: df)
    assert done["orders"].accounting()["quarantined"] == 0
    assert clean["orders"].count() == 120 and generator.generate(spark, generator.Size(orders=120, customers=50))["orders"].count() == 120
    missing = dirty["customers"].where("city is null").select("customer_id").distinct().count()
    assert missing == declared["customers", "missing_city"]
    again = generator.reconcile(manifest, manifest.withColumn("rows", F.col("rows")))
    assert again.where("delta <> 0").count() == 0


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b"), (1, "a")], "k int, v string")
    root = f"file://{tmp_path}/out"
    assert sinks.write_once(rows, root, "v1", "t", ["k"]).count() == 2
    with pytest.raises(Exception, match="already exists"):
        sinks.write_once(rows, root, "v1", "t")
    with pytest.raises(ValueError, match="version"):
        sinks.write_once(rows, root, "one", "t")
    with pytest.raises(sinks.ReadBackError, match="unique"):
        sinks.write_once(rows.unionByName(rows), root, "v2", "t", ["k"])
    sinks.export_csv(rows, f"{root}/csv", ["k"], single_file=True)
    assert [r["k"] for r in spark.read.option("header", True).csv(f"{root}/csv").collect()] == ["1", "2"]
    manifest = spark.createDataFrame(sinks.export_parquet(rows, f"{root}/mart").collect())
    assert sinks.verify_bundle(spark, f"{root}/mart", manifest).count() == 0
    sinks.overwrite(rows.where("k = 1"), f"{root}/mart")
    assert {r["fault"] for r in sinks.verify_bundle(spark, f"{root}/mart", manifest).collect()} & {"missing", "unknown"}
    sinks.write_evidence(spark, f"{root}/evidence", {"rows": "2"})
    assert spark.read.json(f"{root}/evidence").first()["rows"] == "2"
    assert len(sinks.preview(rows, 1)) == 1
    with pytest.raises(ValueError, match="personal"):
        sinks.refuse_personal_columns(rows.withColumnRenamed("v", "customer_name"))


def test_stream_closes_hours_behind_the_watermark(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2026-01-01 00:10:00"), ("a", "2026-01-01 00:50:00"), ("a", "2026-01-01 01:05:00"), ("b", "2026-01-01 01:20:00")], "event_type string, t string").select("event_type", F.col("t").cast("timestamp").alias("ts"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    counts = hourly.hourly_counts(hourly.source(spark, f"{tmp_path}/in", "*.parquet", rows))
    hourly.write(counts, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = {(r["event_type"], str(r["hour"])): r["orders"] for r in spark.read.schema(counts.schema).parquet(f"{tmp_path}/out").collect()}
    assert got == {("a", "2026-01-01 00:00:00"): 2}
