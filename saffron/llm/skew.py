"""Joins with a table of group sizes, where one group may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fewer than so many groups hold more than a HOT-th of all rows.
HOT = 1000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``groups``, which has one row for each key and the number of rows of it.

    Groups of over a HOT-th of ``total`` rows are fewer than HOT: they are broadcast,
    so their rows stay where they are. The other groups' rows are shuffled.
    """
    values = [c for c in groups.columns if c != key]
    large = F.col(size) > total / HOT
    hot = groups.where(large).select(F.col(key), *(F.col(c).alias(f"_hot_{c}") for c in values))
    marked = rows.join(F.broadcast(hot), key, "left")
    here = marked.where(F.col(f"_hot_{size}").isNotNull()).select(*rows.columns, *(F.col(f"_hot_{c}").alias(c) for c in values))
    rest = marked.where(F.col(f"_hot_{size}").isNull()).select(*rows.columns)
    return rest.join(groups.where(~large), key, how).select(*rows.columns, *values).unionByName(here)
