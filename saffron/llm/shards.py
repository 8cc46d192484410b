"""Sharding by best-fit-decreasing bin packing.

Equal texts form a group that no shard boundary divides. Groups enter in the order of
their bytes, largest first, each into the shard with the tightest remaining room
that still takes it; shards stand in a balanced tree by remaining room. Groups of
equal bytes are alike to the packing, so it runs over the counts of each size: a
tight shard takes as many of a size as fit before the next is asked, which is what
packing them one by one gives. Only these counts reach the driver: with k different
sizes the texts hold at least k squared / 2 bytes, so there are at most 250,000
counts for 30 GB and 14 million for 100 TB. The packing gives runs of groups, in the sorted
order, and every group finds its run by its place in that order, from distributed
prefix sums.

With ``capacity`` the shards are as few as the method finds; without, their number is
given and the smallest capacity is taken at which the method needs no more.

Defined results: a null text has no bytes and is equal to the empty one; a row counts
one byte more than its text; repeated rows are a group; a group larger than the
capacity has a shard alone; rows of null ids come last in their shard; other columns
are left out; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import durable
from .mixing import prefix_sums
from .skew import join_groups

SHARDS = 8


class Rooms:
    """Shards by remaining room: a treap, which hashed priorities keep balanced.

    A node is [key, priority, left, right]; keys are (room, shard), so of shards
    with the same room the first one comes first.
    """

    def __init__(self) -> None:
        self.root = None

    def _split(self, node, key):
        """Nodes below ``key``, and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            node[3], high = self._split(node[3], key)
            return node, high
        low, node[2] = self._split(node[2], key)
        return low, node

    def _join(self, low, high):
        if low is None or high is None:
            return high if low is None else low
        if low[1] > high[1]:
            low[3] = self._join(low[3], high)
            return low
        high[2] = self._join(low, high[2])
        return high

    def add(self, room: int, shard: int) -> None:
        low, high = self._split(self.root, (room, shard))
        node = [(room, shard), zlib.crc32(shard.to_bytes(8, "little")), None, None]
        self.root = self._join(self._join(low, node), high)

    def take(self, least: int) -> tuple[int, int] | None:
        """Remove and return the tightest (room, shard) of at least ``least``."""
        low, high = self._split(self.root, (least, -1))
        path, node = None, high
        while node is not None and node[2] is not None:
            path, node = node, node[2]
        if path is not None:
            path[2] = node[3]
        elif node is not None:
            high = node[3]
        self.root = self._join(low, high)
        return node and node[0]


def pack(counts: Iterable[tuple[int, int]], capacity: int, most: int | None = None) -> tuple[list[tuple[int, int, int, int]], int] | None:
    """Runs (size, start, stop, shard) of groups in decreasing order, and how many shards they fill.

    ``counts`` are (size, groups) of different sizes of at least 1. None if more than
    ``most`` shards are needed.
    """
    rooms, runs, shards, at = Rooms(), [], 0, 0
    for size, left in sorted(counts, reverse=True):
        while left:
            room, shard = rooms.take(size) or (max(capacity, size), shards)
            if shard == shards:
                shards += 1
                if most is not None and shards > most:
                    return None
            n = min(left, room // size)
            runs.append((size, at, at + n, shard))
            rooms.add(room - n * size, shard)
            at, left = at + n, left - n
    return runs, shards


def least_capacity(counts: list[tuple[int, int]], shards: int) -> int:
    """The smallest capacity, by bisection, at which the packing needs at most ``shards``."""
    total, largest = sum(s * n for s, n in counts), max((s for s, _ in counts), default=1)
    low = max(-(-total // shards), largest, 1)
    step, high = 0, low
    while pack(counts, high, shards) is None:
        low, step = high + 1, max(1, 2 * step)
        high = low + step
    while low < high:
        middle = (low + high) // 2
        if pack(counts, middle, shards) is None:
            low = middle + 1
        else:
            high = middle
    return high


def sharded(documents: DataFrame, shards: int = SHARDS, capacity: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, digest, shard, slot) of each document; ``slot`` numbers a shard's rows from 0."""
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.unhex(F.sha2(raw, 256)).alias("digest"), F.lit(1).cast("long").alias("_one"))
    rows = durable(rows, "sized")
    groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("copies")).withColumn("_one", F.lit(1).cast("long"))
    groups = durable(prefix_sums(groups, [F.col("bytes").desc(), F.col("digest").asc()], {"place": "_one"}, "groups"), "placed-groups")
    found = groups.groupBy("bytes").agg(F.count(F.lit(1)).alias("n")).toArrow()
    counts = list(zip(found["bytes"].to_pylist(), found["n"].to_pylist(), strict=True))
    runs, _ = pack(counts, capacity or least_capacity(counts, shards))
    spark = documents.sparkSession
    table = pa.Table.from_arrays([pa.array(x, pa.int64()) for x in (zip(*runs, strict=True) if runs else [[]] * 4)], names=["bytes", "start", "stop", "shard"])
    of_size = spark.createDataFrame(table).groupBy("bytes").agg(F.sum(F.col("stop") - F.col("start")).alias("n"), F.collect_list(F.struct("start", "stop", "shard")).alias("runs"))
    with_runs = join_groups(groups.select("digest", "bytes", "copies", "place"), of_size, "bytes", "n", sum(n for _, n in counts))
    here = F.filter("runs", lambda r: (r["start"] <= F.col("place")) & (F.col("place") < r["stop"]))
    homes = durable(with_runs.select("digest", "copies", F.element_at(here, 1)["shard"].cast("int").alias("shard")), "homes")
    housed = join_groups(rows, homes.select("digest", "copies", "shard"), "digest", "copies", rows.count()).withColumn("_tie", F.monotonically_increasing_id())
    order = [F.col("shard").asc(), F.col("doc_id").asc_nulls_last(), F.col("digest").asc(), F.col("_tie").asc()]
    numbered = prefix_sums(housed, order, {"_at": "_one"}, "housed")
    # One row a shard.
    sizes = housed.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
    first = prefix_sums(sizes, [F.col("shard").asc()], {"_first": "n"}, "shards")
    return join_groups(numbered, first, "shard", "n", rows.count()).select("doc_id", "size", "text_crc32", "digest", "shard", (F.col("_at") - F.col("_first")).cast("long").alias("slot"))
