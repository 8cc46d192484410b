"""One query for each operator of this subpackage, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, bpe, exact, infill, language, media, mixing, near, pii, preference, shards, toxicity
from . import quality as quality_votes
from .ship import ship

Query = Callable[[SparkSession, str], DataFrame]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(n: int, id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(read(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(read(spark, sf_dir, "documents"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    reference = language.learn(documents.where(fold(3) != 1))
    found = language.languages(documents, reference)
    return found.select("doc_id", (fold(3) == 1).alias("held_out"), "lang_pred", "score")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(read(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    model = quality_votes.train(documents, read(spark, sf_dir, "labels"), fold(3) != 1)
    return quality_votes.quality(documents, model).select("doc_id", (fold(3) == 1).alias("held_out"), "score", "predicted")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(read(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    model = toxicity.train(documents, read(spark, sf_dir, "labels"), fold(5) != 0)
    return toxicity.toxicity(documents, model).select("doc_id", (fold(5) == 0).alias("held_out"), "score", "predicted")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_groups(read(spark, sf_dir, "documents"), words=2, share=80)


def op10_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.preference_turns(preference.counterparts(read(spark, sf_dir, "conversations")))


def op10_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.pair_digests(op10_preference(spark, sf_dir))


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.infill_digests(infill.fill_in_middle(read(spark, sf_dir, "documents")))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.alignment(read(spark, sf_dir, "documents"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.sharded(read(spark, sf_dir, "documents"), shards.SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def shipped(query: Query) -> Query:
    """The query, after workers can import this package."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Query] = {f.__name__: shipped(f) for f in (op1_media, op2_pii, op3_language, op4_bpe, op5_mixing, op6_quality, op7_exact_dedup, op8_toxicity, op9_near_dedup, op10_preference, op10_preference_pairs, op11_infill, op12_alignment, op13_sharding)}
