"""The training-data pipeline: five stages over ``documents``.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read
again as the next stage's docs. All but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from saffron.llm import bpe, exact, mixing, near, toxicity
from saffron.llm.durable import durable, release
from saffron.llm.queries import fold, read
from saffron.llm.ship import ship


def clean_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the toxicity classifier rejects; learn from labels outside its held-out fold."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, read(spark, sf_dir, "labels"), fold(5) != 0))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document of smallest id stays."""
    return exact.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at 0.8 the document of smallest id stays."""
    return near.drop_near_copies(docs, words=5, share=80)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut or repeat the sources to their target weights."""
    return mixing.mixed(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what the mix holds."""
    return bpe.encode_documents(docs)


def prepared(stage):
    """The stage, after workers can run it."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [(name, prepared(f)) for name, f in (("toxicity", clean_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("mixing", mix_stage), ("bpe", token_stage))]

#: Training a classifier, minimum hashes and merges have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def write(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Run the pipeline, write its rows as Parquet to ``path``, and delete the stages' tables."""
    run(spark, sf_dir).write.parquet(path)
    release(spark)
