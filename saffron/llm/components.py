"""Connected components of a link table.

Each partition first contracts its own links: of a path or group inside it only
stars around the smallest id remain. What still spans partitions is solved by
rounds of shuffles over all links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import durable

#: Links that one task contracts; up to so many are solved without rounds.
LINKS_A_TASK = 200_000


def smallest_reached(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of some links, and for each the smallest id that it reaches through them."""
    ids, place = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = place[: len(left)], place[len(left) :]
    top = np.arange(len(ids))
    while True:
        before = top.copy()
        low = np.minimum(top[a], top[b])
        np.minimum.at(top, top[a], low)  # roots of both ends, then the ends themselves
        np.minimum.at(top, top[b], low)
        while not np.array_equal(top, top[top]):
            top = top[top]
        if np.array_equal(top, before):
            return ids, ids[top]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, comp) of the links (a, b) of one partition, of which LINKS_A_TASK are held at a time."""
    held: list[pa.RecordBatch] = []

    def out() -> pa.RecordBatch:
        left, right = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in (0, 1))
        held.clear()
        ids, comp = smallest_reached(left, right)
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(comp)], names=["id", "comp"])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            if sum(b.num_rows for b in held) >= LINKS_A_TASK:
                yield out()
    if held:
        yield out()


def components(links: DataFrame) -> DataFrame:
    """(id, comp) for every id of the links (a, b): the smallest id that it reaches.

    Each round takes the smallest label among neighbours, then the label of that
    label, so labels travel twice as far each time; rounds end when none changes.
    """
    links = durable(links.select("a", "b"), "links")
    n = links.count()
    stars = links.coalesce(max(1, n // LINKS_A_TASK)).mapInArrow(_contracted, "id long, comp long")
    if n < LINKS_A_TASK:  # one task held all links at once, so its labels are final
        return durable(stars, "labels")
    stars = durable(stars, "stars")
    edges = durable(stars.select(F.col("id").alias("u"), F.col("comp").alias("v")).unionByName(stars.select(F.col("comp").alias("u"), F.col("id").alias("v"))).where("u <> v").distinct(), "edges")
    labels = durable(stars.groupBy("id").agg(F.min("comp").alias("comp")), "labels")
    while True:
        near = edges.join(labels, edges["v"] == labels["id"]).select(F.col("u").alias("id"), "comp")
        old = labels.select("id", "comp", F.col("comp").alias("old"))
        least = old.unionByName(near.withColumn("old", F.lit(None).cast("long"))).groupBy("id").agg(F.min("comp").alias("comp"), F.min("old").alias("old"))
        least = durable(least, "least")
        above = least.select(F.col("id").alias("_up"), F.col("comp").alias("_top"))
        after = durable(least.join(above, least["comp"] == above["_up"]).select("id", "old", F.least("comp", "_top").alias("comp")), "labels")
        labels = after.select("id", "comp")
        if after.where("comp <> old").isEmpty():
            return labels
