"""Hourly demand: regressions on a dense panel, chosen on validation, refit and tested.

``fit`` compares three learners of the ML library; ``fit_sums`` is the linear one from
sums of products alone, one scan for the fit and one for the refit.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.times import Weekday, is_weekend, weekday
from ..operators import panels
from ..sources.shared import kept
from .evaluate import regression_metrics
from .linear import Linear, linear

SEED = 42
LAGS = (1, 24, 168)
NEVER_FEATURES = ("is_churned", "final_amount", "order_status", "rating")


def features(panel: DataFrame, entity: str, at: str, value: str) -> DataFrame:
    """Lags and calendar of each hour; hours without the longest lag drop out."""
    rows = panels.lags(panel, [entity], at, value, LAGS)
    t = F.col(at)
    rows = rows.withColumns({
        "hour_of_day": F.hour(t).cast("double"), "weekday": weekday(t, Weekday.SUNDAY_0).cast("double"), "month": F.month(t).cast("double"), "weekend": is_weekend(t).cast("double"),
        **{f"{value}_lag_{k}": F.col(f"{value}_lag_{k}").cast("double") for k in LAGS}, value: F.col(value).cast("double"),
    })
    return rows.where(F.col(f"{value}_lag_{max(LAGS)}").isNotNull())


def feature_names(value: str) -> list[str]:
    names = [*(f"{value}_lag_{k}" for k in LAGS), "hour_of_day", "weekday", "month", "weekend"]
    if leak := [n for n in names if n in NEVER_FEATURES]:
        raise ValueError(f"leaking features: {leak}")
    return names


def estimators(label: str) -> dict:
    shared = {"featuresCol": "features", "labelCol": label}
    return {
        "linear": LinearRegression(maxIter=50, regParam=0.05, **shared),
        "forest": RandomForestRegressor(numTrees=40, maxDepth=8, featureSubsetStrategy="sqrt", seed=SEED, **shared),
        "boosted": GBTRegressor(maxIter=30, maxDepth=5, stepSize=0.08, seed=SEED, **shared),
    }


def pipeline(entity: str, numeric: list[str], estimator) -> Pipeline:
    return Pipeline(stages=[
        StringIndexer(inputCol=entity, outputCol="_index", handleInvalid="keep"), OneHotEncoder(inputCols=["_index"], outputCols=["_hot"], handleInvalid="keep"),
        Imputer(inputCols=numeric, outputCols=[f"_{n}" for n in numeric], strategy="median"), VectorAssembler(inputCols=["_hot", *(f"_{n}" for n in numeric)], outputCol="features"), estimator,
    ])


@dataclass(frozen=True)
class Fitted:
    model: PipelineModel
    chosen: str
    report: DataFrame  # name, split, n, rmse, mae, r2
    predictions: DataFrame


def fit(panel: DataFrame, entity: str, at: str, value: str, train_before: str, test_from: str) -> Fitted:
    """Fit all, choose by validation error, refit on train and validation, and test beside the week before."""
    rows = features(panel, entity, at, value).persist()
    try:
        train, valid, test = panels.split_by_time(rows, at, train_before, test_from)
        names, reports, errors = feature_names(value), [], {}
        label = lambda df, name, split: df.select(F.lit(name).alias("name"), F.lit(split).alias("split"), "n", "rmse", "mae", "r2")
        for name, est in estimators(value).items():
            got = label(regression_metrics(pipeline(entity, names, est).fit(train).transform(valid), value), name, "validation").first()
            errors[name] = got["mae"]
            reports.append(got)
        chosen = min(errors, key=lambda n: (errors[n], n))
        model = pipeline(entity, names, estimators(value)[chosen]).fit(train.unionByName(valid))
        scored = model.transform(test).select(entity, at, value, "prediction", F.col(f"{value}_lag_168").alias("naive")).persist()
        reports.append(label(regression_metrics(scored, value), chosen, "test").first())
        reports.append(label(regression_metrics(scored, value, "naive"), "seasonal_naive", "test").first())
        report = panel.sparkSession.createDataFrame(reports, "name string, split string, n long, rmse double, mae double, r2 double")
        return Fitted(model, chosen, report, scored)
    finally:
        rows.unpersist()


def fit_sums(panel: DataFrame, entity: str, at: str, value: str, train_before: str, test_from: str) -> tuple[Linear, DataFrame]:
    """A linear model of lags and calendar, and its report (name, split, n, rmse, mae, r2) beside the week before."""
    rows = kept(features(panel, entity, at, value), "hours")
    train, valid, test = panels.split_by_time(rows, at, train_before, test_from)
    names = feature_names(value)
    first, model = linear(train, names, value), linear(train.unionByName(valid), names, value)
    told = lambda df, name, split: regression_metrics(df, value).select(F.lit(name).alias("name"), F.lit(split).alias("split"), "n", "rmse", "mae", "r2")
    parts = [told(valid.withColumn("prediction", first.column()), "linear", "validation"), told(test.withColumn("prediction", model.column()), "linear", "test")]
    return model, parts[0].unionByName(parts[1]).unionByName(told(test.withColumn("prediction", F.col(f"{value}_lag_168")), "seasonal_naive", "test"))
