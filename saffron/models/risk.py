"""Weekly wastage risk: classifiers of a costly next week, with a threshold chosen on validation.

``fit`` compares three learners of the ML library; ``fit_sums`` is a logistic regression
from sums of products alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import panels
from ..operators.ranges import quantiles
from ..sources.shared import kept
from .evaluate import best_threshold, roc_auc, threshold_sweep, with_rates
from .linear import Linear, logistic

SEED = 42


def features(panel: DataFrame, entity: list[str], at: str, waste: str, demand: str) -> DataFrame:
    """Past waste and demand only; the target is the next week's waste."""
    rows = panel.withColumns({c: F.col(c).cast("double") for c in (waste, demand)})
    for c in (waste, demand):
        rows = panels.past_means(panels.lags(rows, entity, at, c, (1,)), entity, at, c, (4, 12))
    rows = panels.next_value(rows, entity, at, waste, "next_waste")
    target = F.date_add(at, 7)
    return rows.withColumns({"target_week": target, "target_month": F.month(target).cast("double"), "target_weekofyear": F.weekofyear(target).cast("double")}).where(f"{waste}_lag_1 is not null")


def numeric(waste: str, demand: str) -> list[str]:
    return [f"{c}_{x}" for c in (waste, demand) for x in ("lag_1", "mean_prev_4", "mean_prev_12")] + ["target_month", "target_weekofyear"]


def labelled(rows: DataFrame, train_before: str) -> DataFrame:
    """Label 1 from the 75th percentile of positive waste in the training weeks on; exact."""
    known = rows.where((F.col("target_week") < F.lit(train_before).cast("date")) & (F.col("next_waste") > 0)).select("next_waste")
    cut = quantiles(known, [], "next_waste", 0.75, "cut").agg(F.max("cut").alias("cut"))  # one row, null without training weeks
    return rows.crossJoin(F.broadcast(cut)).withColumn("label", F.coalesce((F.col("next_waste") >= F.col("cut")).cast("int"), F.lit(0)))


def balance(rows: DataFrame) -> float:
    """Weight of a row of label 1, so that both labels weigh the same."""
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(counts) < 2:
        raise ValueError(f"the rows to learn from hold one class only: {counts}")
    return counts[0] / counts[1]


def confusion(scored: DataFrame, hit: Column) -> DataFrame:
    """One row: tp, fp, fn, tn and rates."""
    pos = F.col("label") == 1
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).cast("long")
    return with_rates(scored.agg(n(hit & pos).alias("tp"), n(hit & ~pos).alias("fp"), n(~hit & pos).alias("fn"), n(~hit & ~pos).alias("tn")))


def fit_sums(panel: DataFrame, entity: list[str], at: str, waste: str, demand: str, train_before: str, test_from: str) -> tuple[Linear, DataFrame]:
    """A balanced logistic regression of past waste and demand, and its report of either split.

    (split, threshold, tp, fp, fn, tn, accuracy, precision, recall, f1, roc_auc); the
    threshold is chosen on validation, the model then refit on train and validation.
    """
    rows = kept(labelled(features(panel, entity, at, waste, demand), train_before).fillna(0.0, numeric(waste, demand)), "weeks")
    train, valid, test = panels.split_by_time(rows, "target_week", train_before, test_from)
    names, parts, threshold, model = numeric(waste, demand), [], None, None
    for split, known, unseen in (("validation", train, valid), ("test", train.unionByName(valid), test)):
        model = logistic(known, names, "label", F.when(F.col("label") == 1, balance(train)).otherwise(1.0))
        scored = kept(unseen.select("label", model.column().alias("probability_positive")), f"scored-{split}")
        if threshold is None:
            threshold = best_threshold(threshold_sweep(scored)).first()["threshold"]
        told = confusion(scored, F.col("probability_positive") >= threshold).crossJoin(F.broadcast(roc_auc(scored)))
        parts.append(told.select(F.lit(split).alias("split"), F.lit(float(threshold)).alias("threshold"), "*"))
    return model, parts[0].unionByName(parts[1])


def estimators() -> dict:
    shared = {"featuresCol": "features", "labelCol": "label", "weightCol": "weight"}
    return {
        "logistic": LogisticRegression(maxIter=30, regParam=0.05, **shared),
        "forest": RandomForestClassifier(numTrees=15, maxDepth=6, featureSubsetStrategy="sqrt", seed=SEED, **shared),
        "boosted": GBTClassifier(maxIter=10, maxDepth=2, stepSize=0.1, subsamplingRate=0.8, seed=SEED, **shared),
    }


@dataclass(frozen=True)
class Fitted:
    model: PipelineModel
    chosen: str
    threshold: float
    report: DataFrame


def fit(panel: DataFrame, entity: list[str], at: str, waste: str, demand: str, train_before: str, test_from: str) -> Fitted:
    rows = labelled(features(panel, entity, at, waste, demand), train_before).persist()
    try:
        train, valid, test = panels.split_by_time(rows, "target_week", train_before, test_from)
        up = balance(train)
        weigh = lambda df: df.withColumn("weight", F.when(F.col("label") == 1, up).otherwise(1.0))
        stages = [*(StringIndexer(inputCol=e, outputCol=f"_{e}_i", handleInvalid="keep") for e in entity), OneHotEncoder(inputCols=[f"_{e}_i" for e in entity], outputCols=[f"_{e}_v" for e in entity], handleInvalid="keep"), VectorAssembler(inputCols=[*(f"_{e}_v" for e in entity), *numeric(waste, demand)], outputCol="features", handleInvalid="keep")]
        auc = lambda df, m: float(BinaryClassificationEvaluator(labelCol="label", metricName=m).evaluate(df))
        score = lambda model, df: model.transform(df).withColumn("probability_positive", vector_to_array("probability")[1])
        found, reports = {}, []
        for name, est in estimators().items():
            scored = score(Pipeline(stages=[*stages, est]).fit(weigh(train)), valid).persist()
            best = best_threshold(threshold_sweep(scored)).first()
            found[name] = (auc(scored, "areaUnderPR"), best["f1"], best["threshold"])
            reports.append((name, "validation", best["threshold"], best["precision"], best["recall"], best["f1"], found[name][0], auc(scored, "areaUnderROC")))
            scored.unpersist()
        chosen = max(found, key=lambda n: (found[n][:2], n))
        threshold = found[chosen][2]
        model = Pipeline(stages=[*stages, estimators()[chosen]]).fit(weigh(train.unionByName(valid)))
        scored = score(model, test).persist()
        counted = confusion(scored, F.col("probability_positive") >= threshold).first()
        reports.append((chosen, "test", threshold, counted["precision"], counted["recall"], counted["f1"], auc(scored, "areaUnderPR"), auc(scored, "areaUnderROC")))
        scored.unpersist()
        report = panel.sparkSession.createDataFrame(reports, "name string, split string, threshold double, precision double, recall double, f1 double, pr_auc double, roc_auc double")
        return Fitted(model, chosen, threshold, report)
    finally:
        rows.unpersist()


ACTIVITY = ["orders", "spend", "visit_days", "promo_share", "category_count"]


def disengagement_model(labels: DataFrame, split: float = 0.75) -> tuple[Linear, DataFrame]:
    """A balanced logistic regression on customer-months, and one row on the months after ``split`` of all rows.

    (n, positives, tp, fp, fn, tn, accuracy, precision, recall, f1, roc_auc).
    """
    rows = kept(labels.select("month", "label", *(F.col(c).cast("double").alias(c) for c in ACTIVITY)), "customer-months")
    cut = quantiles(rows, [], "month", split, "cut")
    marked = rows.crossJoin(F.broadcast(cut)).withColumn("late", F.col("month") > F.col("cut"))
    early = marked.where("not late")
    rate = early.agg(F.avg("label").alias("r")).first()["r"] or 0.5
    rate = min(max(rate, 1e-6), 1 - 1e-6)
    model = logistic(early, ACTIVITY, "label", F.when(F.col("label") == 1, 0.5 / rate).otherwise(0.5 / (1 - rate)))
    scored = kept(marked.where("late").select("label", model.column().alias("probability_positive")), "scored-months")
    told = confusion(scored, F.col("probability_positive") >= 0.5).crossJoin(F.broadcast(roc_auc(scored)))
    return model, told.select((F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("n"), (F.col("tp") + F.col("fn")).alias("positives"), "*")
