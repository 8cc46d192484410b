"""Expansion of a table to an exact number of rows with unique prefixed keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranges import cuts_below


def expand(df: DataFrame, key: str, target: int, rows: int | None = None, prefix: str = "X") -> DataFrame:
    """The source and as many copies as reach ``target`` rows; copy k's keys start with prefix, k and a dash.

    The last copy may be partial: it takes the rows of smallest key, found range by
    range. Copies are unfolded inside the row, so only that choice needs a shuffle.
    """
    if key not in df.columns:
        raise ValueError(f"{key} is no column")
    n = df.count() if rows is None else rows
    if target < n or not n:
        raise ValueError("the target is below the number of rows")
    whole, part = divmod(target, n)
    name = F.col(key).cast("string")
    copies = df.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(whole - 1))))
    out = copies.withColumn(key, F.when(F.col("_k") == 0, name).otherwise(F.concat(F.lit(prefix), F.col("_k").cast("string"), F.lit("-"), name))).drop("_k")
    if part:
        last = smallest(df, key, part).withColumn(key, F.concat(F.lit(f"{prefix}{whole}-"), name))
        out = out.unionByName(last)
    return out


def smallest(df: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` rows of smallest key, without one task that sorts or passes them all.

    The key at which the count is reached lies in one range of keys; ranges before it
    are taken whole, and only rows of that range are numbered.
    """
    ranges = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # As many keys as there are ranges, from a sample of bounded size.
    some = df.select(key).orderBy(F.xxhash64(key), key).limit(100 * ranges).agg(F.array_sort(F.collect_list(key)).alias("_all"))
    cuts = some.select(F.transform(F.sequence(F.lit(1), F.lit(ranges - 1)), lambda i: F.get("_all", F.floor(i * F.size("_all") / ranges).cast("int"))).alias("_cuts"))
    dealt = df.crossJoin(F.broadcast(cuts)).withColumn("_range", cuts_below(F.col("_cuts"), F.col(key), ranges - 1)).drop("_cuts")
    counts = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before")  # one row for each range
    placed = dealt.join(F.broadcast(counts.select("_range", "_n", before)), "_range").where(F.col("_before") < n)
    sure = placed.where(F.col("_before") + F.col("_n") <= n)
    partly = placed.where(F.col("_before") + F.col("_n") > n).withColumn("_at", F.row_number().over(Window.partitionBy("_range").orderBy(key)))
    return sure.select(*df.columns).unionByName(partly.where(F.col("_at") <= n - F.col("_before")).select(*df.columns))


def group_totals(lines: DataFrame, by: str, quantity: str, amount: str) -> DataFrame:
    """Rows, quantity and amount of each group: the scale aggregate."""
    from ..functions.numbers import fixed_sum

    return lines.groupBy(by).agg(F.count(F.lit(1)).alias("lines"), F.sum(quantity).cast("long").alias("quantity"), fixed_sum(amount).alias("amount"))
