"""Exact deduplication against immutable snapshots.

Texts are equal when identical after each run of white space became one space. A
snapshot is a table of exact buckets (digest, smallest id, rows) with a static
binary-fuse filter for each shard of its digests; ``save_snapshot`` and
``load_snapshot`` keep it for later batches. Digests of a new batch are grouped by
themselves and screened by the filters. Positives join the snapshot's exact buckets;
what the filters turn away is new. Every row of a bucket with several rows is then
compared byte by byte with the bucket's text.

Defined results: a null text counts as empty; repeated rows are copies of each
other; of equal texts the row of the smallest doc_id stays (a null doc_id counts
as larger than any other); an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fuse
from .durable import durable
from .skew import HOT, join_groups

#: Distinct digests, of a snapshot or of a batch, for each filter shard.
SHARD = 50_000
#: Up to so many digests of buckets with several rows, their filter (at most 25 MB) is broadcast; beyond, rows are joined.
FILTER_KEYS = 20_000_000
HEAD = np.dtype([("key", "<u8"), ("shard", ">u4")])


@dataclass
class Snapshot:
    """Buckets (digest, keep_id, group_size) and filters (shard, filter) of ``shards`` shards."""

    buckets: DataFrame
    filters: DataFrame
    shards: int


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


def shards(groups: DataFrame, n: int) -> DataFrame:
    return groups.withColumn("shard", F.pmod(F.conv(F.substring(F.hex("digest"), 17, 8), 16, 10).cast("long"), F.lit(n)).cast("int"))


def build_filters(groups: DataFrame, n: int) -> DataFrame:
    """(shard, filter) of distinct digests dealt over ``n`` shards."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = np.frombuffer(b"".join(x[:8] for x in pdf["digest"]), "<u8")
        return pd.DataFrame({"shard": pdf["shard"].iloc[:1].to_numpy(), "filter": [fuse.build(keys)]})

    return shards(groups, n).select("shard", "digest").groupBy("shard").applyInPandas(run, "shard int, filter binary")


def snapshot_of(buckets: DataFrame, expected_batch: int = 0) -> Snapshot:
    """A snapshot of distinct buckets; a batch of ``expected_batch`` digests gets shards of about SHARD of them, too."""
    n = max(1, -(-max(buckets.count(), expected_batch) // SHARD))
    return Snapshot(buckets, durable(build_filters(buckets, n), "filters"), n)


def save_snapshot(snapshot: Snapshot, path: str) -> None:
    """Write a snapshot's buckets, filters and number of shards below ``path``, which must not exist."""
    snapshot.buckets.write.parquet(f"{path}/buckets")
    snapshot.filters.withColumn("shards", F.lit(snapshot.shards)).write.parquet(f"{path}/filters")
    snapshot.buckets.sparkSession.range(1).select(F.lit(snapshot.shards).alias("shards")).coalesce(1).write.parquet(f"{path}/shards")


def load_snapshot(spark: SparkSession, path: str) -> Snapshot:
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    return Snapshot(read("buckets"), read("filters").select("shard", "filter"), read("shards").first()["shards"])


def screen(batch: DataFrame, snapshot: Snapshot) -> DataFrame:
    """Add ``maybe``: whether the snapshot's filter may hold the digest.

    Digests meet the filter of their shard in pieces of about SHARD, however large
    the batch is: each filter is sent to as many places as its shard has pieces.
    """
    columns = [c for c in batch.columns if c != "maybe"]
    schema = ", ".join(f"`{c}` {t}" for c, t in batch.select(*columns).dtypes) + ", maybe boolean"
    pieces = max(1, -(-batch.count() // (SHARD * snapshot.shards)))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = left[columns].copy()
        keys = np.frombuffer(b"".join(x[:8] for x in left["digest"]), "<u8")
        out["maybe"] = fuse.may_hold(right["filter"].iloc[0], keys) if len(right) else False
        return out

    placed = shards(batch, snapshot.shards).withColumn("piece", F.pmod(F.xxhash64("digest"), F.lit(pieces)).cast("int"))
    filters = snapshot.filters.withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))
    return placed.groupBy("shard", "piece").cogroup(filters.groupBy("shard", "piece")).applyInPandas(run, schema)


def buckets_of(rows: DataFrame) -> DataFrame:
    """Buckets of rows (doc_id, digest)."""
    return rows.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))


def merge_batch(snapshot: Snapshot, batch: DataFrame) -> DataFrame:
    """Buckets of a snapshot and a batch's buckets together."""
    screened = durable(screen(batch, snapshot), "screened")
    new = screened.where(~F.col("maybe")).drop("maybe")
    maybe = screened.where("maybe").drop("maybe")
    known = snapshot.buckets.join(maybe.select("digest", F.col("keep_id").alias("_id"), F.col("group_size").alias("_n")), "digest", "full_outer")
    known = known.select("digest", F.least("keep_id", "_id").alias("keep_id"), (F.coalesce("group_size", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("group_size"))
    return known.unionByName(new)


def _filter_column(several: DataFrame, n_several: int, n_rows: int):
    """A function of a digest column: may it be in ``several``; None where the filter is too large to broadcast.

    Buckets with several rows are at most half as many as rows, so it never holds all documents.
    """
    if n_several > FILTER_KEYS or 2 * n_several > n_rows:
        return None
    spark = several.sparkSession
    parts = max(1, -(-n_several // SHARD))
    by_shard = spark.sparkContext.broadcast({r["shard"]: bytes(r["filter"]) for r in build_filters(several, parts).collect()})

    @F.pandas_udf("boolean")
    def maybe(digests: pd.Series) -> pd.Series:
        tables = by_shard.value
        heads = np.frombuffer(b"".join(x[:12] for x in digests), HEAD)
        shard, out = heads["shard"].astype(np.int64) % parts, np.zeros(len(heads), bool)
        for s in np.unique(shard):
            if (table := tables.get(int(s))) is not None:
                out[shard == s] = fuse.may_hold(table, heads["key"][shard == s])
        return pd.Series(out)

    return maybe


def _differing(documents: DataFrame, several: DataFrame, n_rows: int, n_several: int, id_col: str, text_col: str) -> DataFrame:
    """Rows (doc_id, digest, text) whose bytes differ from their bucket's text."""
    text = F.col(text_col)
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), normalised(text).alias("text"), digest(text).alias("digest"))
    maybe = _filter_column(several, n_several, n_rows)
    # Normalised and written once: the bucket's text and its members are taken from there.
    rows = durable((rows if maybe is None else rows.where(maybe("digest"))).withColumn("row", F.monotonically_increasing_id()), "copies")
    # A bucket over a HOT-th of all rows is compared in several places.
    places = F.ceil(F.col("group_size") * HOT / F.lit(max(1, n_rows))).cast("int")
    sized = several.select("digest", "keep_id", places.alias("places"))
    hot = sized.where("places > 1").select("digest", "places")
    member = rows.join(F.broadcast(hot), "digest", "left")
    member = member.withColumn("place", F.when(F.col("places") > 1, F.pmod(F.xxhash64("row"), F.col("places"))).otherwise(0).cast("int")).drop("places")
    kept = rows.join(sized, (rows["digest"] == sized["digest"]) & rows["doc_id"].eqNullSafe(sized["keep_id"])).select(rows["digest"], "places", F.col("text").alias("kept_text"))
    kept = kept.groupBy("digest").agg(F.first("places").alias("places"), F.min("kept_text").alias("kept_text"))
    kept = kept.select("digest", "kept_text", F.explode(F.sequence(F.lit(0), F.col("places") - 1)).alias("place"))
    return member.join(kept, ["digest", "place"]).where("text <> kept_text").select("doc_id", "digest", "text")


def exact_groups(documents: DataFrame, in_snapshot: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of each row.

    ``in_snapshot`` tells the rows of the immutable snapshot from the new batch;
    by default a hash of the id puts about half of the rows on either side.
    """
    own = F.col(id_col).cast("long")
    in_snapshot = F.coalesce(F.pmod(F.crc32(own.cast("string").cast("binary")), F.lit(2)) == 0, F.lit(False)) if in_snapshot is None else in_snapshot
    rows = durable(documents.select(own.alias("doc_id"), digest(F.col(text_col)).alias("digest"), in_snapshot.alias("old")), "digests")
    batch = durable(buckets_of(rows.where(~F.col("old"))), "batch")
    snapshot = snapshot_of(durable(buckets_of(rows.where("old")), "snapshot"), batch.count())
    buckets = durable(merge_batch(snapshot, batch), "buckets")
    several = buckets.where("group_size > 1")
    n_rows, n_several = rows.count(), several.count()
    placed = join_groups(rows.drop("old"), several, "digest", "group_size", n_rows, "left")
    odd = durable(_differing(documents, several, n_rows, n_several, id_col, text_col), "differing")
    if not odd.isEmpty():
        # Equal digests of different texts: such rows form buckets of their own bytes.
        own_bucket = odd.groupBy("digest", "text").agg(F.min("doc_id").alias("_id"), F.count("*").alias("_n"))
        moved = odd.join(own_bucket, ["digest", "text"]).select("doc_id", "digest", F.col("_id").alias("keep_id"), F.col("_n").alias("group_size"))
        lost = odd.groupBy("digest").agg(F.count("*").alias("_lost"))
        stay = placed.join(odd.select("doc_id", "digest").distinct(), ["doc_id", "digest"], "left_anti").join(lost, "digest", "left")
        placed = stay.withColumn("group_size", F.col("group_size") - F.coalesce("_lost", F.lit(0))).drop("_lost").unionByName(moved)
    keep = F.when(F.col("group_size") > 1, F.col("keep_id")).otherwise(F.col("doc_id"))
    return placed.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), keep.eqNullSafe(F.col("doc_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without exact copies, with the input's columns.

    A row goes if its bucket keeps another id; of rows that repeat the kept id with
    an equal text, one stays. Only texts that the filter of buckets with several
    rows lets through are shuffled.
    """
    every = durable(exact_groups(documents, None, id_col, text_col), "groups")
    groups = every.where("group_size > 1")
    gone = groups.where("not kept").select(F.unhex("text_sha256").alias("_digest"), F.col("doc_id").alias("_id")).distinct()
    several = durable(groups.select(F.unhex("text_sha256").alias("digest")).distinct(), "several")
    n = several.count()
    # The input's columns travel as one, so that none of them clashes with those added.
    rows = documents.select(F.struct("*").alias("_row"), digest(F.col(text_col)).alias("_digest"), F.col(id_col).cast("long").alias("_id"))
    if not n:
        return documents
    maybe = _filter_column(several, n, every.count())
    if maybe is None:
        sure, unsure = None, rows
    else:
        sure, unsure = rows.where(~maybe("_digest")), rows.where(maybe("_digest"))
    once = unsure.dropDuplicates(["_digest", "_id"])
    kept = once.join(gone, (once["_digest"] == gone["_digest"]) & once["_id"].eqNullSafe(gone["_id"]), "left_anti")
    return (kept if sure is None else sure.unionByName(kept)).select("_row.*")
