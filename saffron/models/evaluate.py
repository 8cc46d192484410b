"""Evaluation of classifiers and regressions by aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranges import running


def _safe(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def with_rates(counts: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1 of columns tp, fp, fn, tn; zero where undefined."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    rows = counts.withColumns({"accuracy": _safe(tp + tn, tp + fp + fn + tn), "precision": _safe(tp, tp + fp), "recall": _safe(tp, tp + fn)})
    return rows.withColumn("f1", _safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def threshold_sweep(scored: DataFrame, probability: str = "probability_positive", label: str = "label", steps: int = 19) -> DataFrame:
    """Confusion counts and rates at 0.05, 0.10, ... 0.95, in one pass over the rows.

    Each row adds to the bucket of the last threshold that it reaches; counts at a
    threshold are then sums over the few buckets from it on.
    """
    n = steps + 1
    bucket = F.least(F.lit(steps), F.floor(F.col(probability) * n + 1e-9)).cast("int")
    per = scored.groupBy(bucket.alias("bucket")).agg(F.sum((F.col(label) == 1).cast("long")).alias("pos"), F.sum((F.col(label) == 0).cast("long")).alias("neg"))
    at = scored.sparkSession.range(1, n).select(F.col("id").cast("int").alias("step"))
    reach = F.col("bucket") >= F.col("step")
    total = lambda c, cond: F.sum(F.when(cond, F.col(c)).otherwise(0))
    counts = at.crossJoin(per).groupBy("step").agg(total("pos", reach).alias("tp"), total("neg", reach).alias("fp"), total("pos", ~reach).alias("fn"), total("neg", ~reach).alias("tn"))  # at most n by n rows
    return with_rates(counts).withColumn("threshold", F.col("step") / n).drop("step")


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The one row of best F1, then recall, then precision, then the lowest threshold."""
    return sweep.orderBy(F.desc("f1"), F.desc("recall"), F.desc("precision"), F.asc("threshold")).limit(1)


def roc_auc(scored: DataFrame, probability: str = "probability_positive", label: str = "label") -> DataFrame:
    """One row: the share of pairs of a positive and a negative row that the score puts in order, ties by half. Exact.

    Scores are counted first; how many negatives lie below each comes from counts of
    ranges. Null without rows of both labels.
    """
    n = lambda y: F.count_if(F.col(label) == y)
    counts = scored.groupBy(F.col(probability).alias("_score")).agg(n(1).alias("_pos"), n(0).alias("_neg"))
    placed = running(counts, ["_score"], {"_below": "_neg"}, "scores")
    above = F.sum(F.col("_pos") * (2 * F.col("_below") + F.col("_neg")))  # twice the pairs in order
    return placed.agg(F.try_divide(above, 2 * F.sum("_pos") * F.sum("_neg")).alias("roc_auc"))


def regression_metrics(rows: DataFrame, actual: str, predicted: str = "prediction") -> DataFrame:
    """One row: n, rmse, mae, r2."""
    err = F.col(actual) - F.col(predicted)
    return rows.agg(F.count(err).alias("n"), F.sqrt(F.avg(err * err)).alias("rmse"), F.avg(F.abs(err)).alias("mae"), (1 - F.try_divide(F.sum(err * err), F.nullif(F.var_pop(actual) * F.count(actual), F.lit(0.0)))).alias("r2"))
