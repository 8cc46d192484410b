"""Global tiles without one task holding all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import cuts_below


def ntile_over(n: int, rank: Column, total: Column) -> Column:
    """NTILE(n) of the ``rank``-th (from 1) of ``total`` rows: the first total mod n tiles hold one more."""
    small, extra = F.floor(total / n), total % n
    big_rows = extra * (small + 1)
    at = rank - 1
    return (F.when(at < big_rows, F.floor(at / (small + 1))).otherwise(extra + F.floor(F.try_divide(at - big_rows, small))) + 1).cast("int")


#: Rows of smallest hash whose ties cut a frequent value's rows into parts.
TIES = 2000


def global_ntiles(df: DataFrame, n: int, tie: str, wanted: dict[str, tuple[str, bool]], ranges: int | None = None) -> DataFrame:
    """Add, for each new column, NTILE(n) over all rows by (value, tie); ``wanted`` maps it to (value, descending).

    Cut points of the values (approximate percentiles: rows of bounded length, from
    one pass for all of them) deal rows into ordered ranges; a value that several cut
    points share is dealt further by ``tie``. Counts of ranges, again from one pass,
    give each its first rank, so no range grows with a value's frequency.
    """
    ranges = ranges or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kinds, at = dict(df.dtypes), [i / ranges for i in range(1, ranges)]
    cuts = df.agg(*(F.coalesce(F.percentile_approx(v, at, 10_000), F.array().cast(f"array<{kinds[v]}>")).alias(f"_cuts_{o}") for o, (v, _) in wanted.items()))
    # One row of at most ``ranges`` cut points of the tie, from a sample of bounded size.
    some = df.select(tie).where(F.col(tie).isNotNull()).orderBy(F.xxhash64(tie), tie).limit(TIES).agg(F.array_sort(F.collect_list(tie)).alias("_all"))
    every = F.transform(F.sequence(F.lit(1), F.lit(ranges - 1)), lambda i: F.get("_all", F.floor(i * F.size("_all") / ranges).cast("int")))
    dealt = df.crossJoin(F.broadcast(cuts)).crossJoin(F.broadcast(some.select(every.alias("_ties"))))
    below = lambda cuts, x, equal=False: cuts_below(F.col(cuts), F.col(x), ranges - 1, equal)
    for o, (v, _) in wanted.items():
        same = below(f"_cuts_{o}", v, True) - below(f"_cuts_{o}", v)
        # Ranges between cut points have even numbers, those of one value odd ones.
        number = F.when(F.col(v).isNull(), -1).otherwise(2 * below(f"_cuts_{o}", v) + F.when(same > 0, same * 2 - 1).otherwise(0))
        parts = F.when(F.col(v).isNull(), ranges).when(same > 1, same + 1).otherwise(1)
        dealt = dealt.withColumn(f"_range_{o}", number).withColumn(f"_part_{o}", F.floor(below("_ties", tie) * parts / ranges).cast("int"))
    dealt = dealt.drop("_ties", *(f"_cuts_{o}" for o in wanted))
    spread = dealt.select(F.explode(F.array(*(F.struct(F.lit(o).alias("of"), F.lit(down).alias("down"), F.col(f"_range_{o}").alias("range"), F.col(f"_part_{o}").alias("part")) for o, (_, down) in wanted.items()))).alias("x"))
    counts = spread.groupBy("x.of", "x.down", "x.range", "x.part").agg(F.count(F.lit(1)).alias("n"))
    # At most a few times ``ranges`` rows for each column wanted.
    by = Window.partitionBy("of").orderBy(F.when(F.col("down"), -F.col("range")).otherwise(F.col("range")), "part")
    starts = counts.select("of", "range", "part", (F.sum("n").over(by) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy("of")).alias("total"))
    for o, (v, down) in wanted.items():
        own = starts.where(F.col("of") == o).select(F.col("range").alias(f"_range_{o}"), F.col("part").alias(f"_part_{o}"), F.col("before").alias(f"_before_{o}"), F.col("total").alias(f"_total_{o}"))
        inside = Window.partitionBy(f"_range_{o}", f"_part_{o}").orderBy(F.desc(v) if down else F.asc(v), F.asc(tie))
        dealt = dealt.withColumn(f"_in_{o}", F.row_number().over(inside)).join(F.broadcast(own), [f"_range_{o}", f"_part_{o}"])
    return dealt.select(*df.columns, *(ntile_over(n, F.col(f"_before_{o}") + F.col(f"_in_{o}"), F.col(f"_total_{o}")).alias(o) for o in wanted))


def global_ntile(df: DataFrame, n: int, value: str, tie: str, out: str, descending: bool = False, ranges: int | None = None) -> DataFrame:
    """Add NTILE(n) over all rows by (value, tie), computed range by range."""
    return global_ntiles(df, n, tie, {out: (value, descending)}, ranges)


def top_value(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """The most frequent value of each key; of equally frequent ones the smallest, null last."""
    counts = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("_n"))
    best = F.min_by(value, F.struct((-F.col("_n")).alias("n"), F.col(value).isNull().alias("null"), F.col(value).alias("v")))
    return counts.groupBy(key).agg(best.alias(out))


def latest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, by an aggregation that needs no sort."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*key, "_row.*").select(*df.columns)


def top_n(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)
