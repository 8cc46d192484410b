"""Bounded samples of labelled documents, which classifiers share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .durable import durable


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, usable: Column, per_class: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict[int, int]]:
    """(id, h, label, text) of at most ``per_class`` documents of labels 0 and 1, and the counts of labelled documents.

    Only ids that stand in both tables count, each once: an id with several texts gives
    the one of smallest hash, an id with several labels the most frequent one (1 on a
    tie). Of each class the ids of smallest hash are taken, so reruns agree. The
    sample's ids (a bounded number) are broadcast; texts stay on the executors.
    """
    own = F.col(id_col).cast("long")
    votes = labels.where(usable & own.isNotNull() & F.col(label).isin(0, 1)).groupBy(own.alias("id")).agg(F.avg(F.col(label).cast("double")).alias("share"))
    texts = documents.where(own.isNotNull()).select(own.alias("id"), F.col(text_col).cast("string").alias("text"))
    found = texts.select("id", F.xxhash64("text").alias("text_hash")).join(votes, "id").groupBy("id").agg(F.min("text_hash").alias("text_hash"), F.max(F.when(F.col("share") >= 0.5, 1).otherwise(0)).alias("label"))
    known = durable(found.withColumn("h", F.xxhash64("id")), "known")
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    picked = [tuple(r) for y in (0, 1) for r in known.where(F.col("label") == y).orderBy("h", "id").limit(per_class).select("id", "text_hash", "label", "h").collect()]
    chosen = documents.sparkSession.createDataFrame(picked, "id long, text_hash long, label int, h long")
    copies = texts.withColumn("text_hash", F.xxhash64("text")).join(F.broadcast(chosen), ["id", "text_hash"])
    return copies.groupBy("id", "h", "label").agg(F.min("text").alias("text")), counts
