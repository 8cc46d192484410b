"""Broadcast filters of document ids, so that joins on ids move few texts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import fuse

#: Ids for each filter shard, and ids up to which a filter is broadcast (about 1.2 bytes each, 25 MB at most).
SHARD = 200_003
MOST = 20_000_000


def id_filter(ids: DataFrame, column: str, n: int, total: int):
    """A function of an id column: may the id be among the ``n`` ids; None where the filter is too large.

    It is used for at most MOST ids and half of ``total`` documents: beyond that it would
    keep most rows anyway, and fingerprints of all documents stay off the driver.
    """
    if n > MOST or 2 * n > total:
        return None
    parts = 2 * (n // SHARD // 2) + 1

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": pdf["shard"].iloc[:1].to_numpy(), "filter": [fuse.build(pdf["id"].to_numpy(np.int64).view(np.uint64))]})

    sharded = ids.where(F.col(column).isNotNull()).select(F.pmod(F.col(column), F.lit(parts)).cast("int").alias("shard"), F.col(column).alias("id"))
    built = sharded.groupBy("shard").applyInPandas(run, "shard int, filter binary")
    by_shard = ids.sparkSession.sparkContext.broadcast({r["shard"]: bytes(r["filter"]) for r in built.collect()})

    @F.pandas_udf("boolean")
    def maybe(column: pd.Series) -> pd.Series:
        out = np.zeros(len(column), bool)
        there = column.notna().to_numpy()
        keys = column[there].to_numpy(np.int64)
        shard, found = keys % parts, np.zeros(len(keys), bool)
        for s in np.unique(shard):
            if (table := by_shard.value.get(int(s))) is not None:
                found[shard == s] = fuse.may_hold(table, keys[shard == s].view(np.uint64))
        out[there] = found
        return pd.Series(out)

    return maybe


def without_ids(documents: DataFrame, ids: DataFrame, n: int, total: int, id_col: str = "doc_id") -> DataFrame:
    """Documents whose id is not in the one column of ``ids``; rows that the filter clears stay where they are."""
    gone = ids.toDF("_gone")
    maybe = id_filter(gone, "_gone", n, total)
    drop = lambda rows: rows.join(gone, rows[id_col].cast("long") == gone["_gone"], "left_anti")
    if maybe is None:
        return drop(documents)
    may = maybe(F.col(id_col).cast("long"))
    return documents.where(~may).unionByName(drop(documents.where(may)))
