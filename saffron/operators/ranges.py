"""Orders over all rows without one task holding them: running sums, places and exact order statistics.

Rows are dealt into ordered ranges, totals of ranges tell what stands before each,
and a window inside a range does the rest. Nothing grows with the size of a group, so a
group may hold all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import kept

#: Groups up to which their table of a few numbers is broadcast.
BROADCAST_GROUPS = 100_000
#: Rows up to which a partition is sorted or hashed in memory.
PARTITION_ROWS = 500_000


def cuts_below(cuts: Column, x: Column, n: int, equal: bool = False) -> Column:
    """How many of at most ``n`` ascending cut points are below ``x``, or with ``equal`` not above it; by halves, since this runs for each row."""
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(n.bit_length()))))

    def step(at: Column, by: Column) -> Column:
        cut = F.get(cuts, at + by - 1)
        return F.when(cut <= x if equal else cut < x, at + by).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


def running(df: DataFrame, order: list[str | Column], sums: dict[str, str], name: str = "ranges") -> DataFrame:
    """Add, for each new column, the sum of an existing whole number over the rows before in ``order``.

    ``order`` must tell all rows apart, or equal rows must be alike. The ranges are
    written once, so a lost executor can't deal the same rows differently.
    """
    ranged = kept(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), name)
    totals = ranged.groupBy("_range").agg(*(F.sum(c).alias(f"_{n}") for n, c in sums.items()))
    # One row a range: bounded by the number of partitions.
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_range", *(F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in sums))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumns({n: F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()})
    return summed.join(F.broadcast(starts), "_range").select(*df.columns, *((F.col(n) + F.col(f"_{n}")).cast("long").alias(n) for n in sums))


def small(df: DataFrame, limit: int | None = None) -> DataFrame:
    """A table of groups, broadcast if it was counted to be small; Spark splits skewed sides of the other join."""
    return F.broadcast(df) if df.count() <= (BROADCAST_GROUPS if limit is None else limit) else df


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` of so many rows shuffled by ``keys``: into a number of partitions that follows them where it exceeds the cores, as in ``spread``."""
    n = -(-rows // PARTITION_ROWS)
    return df.repartition(n, *keys) if n > df.sparkSession.sparkContext.defaultParallelism else df.repartition(*keys)


def spread(rows: int, key: str | list[str], *tables: DataFrame) -> tuple[DataFrame, ...]:
    """``tables`` that are joined or grouped by ``key``, dealt alike into partitions of PARTITION_ROWS of the largest one's ``rows``.

    Spark joins partitions of few bytes, which may hold many narrow rows, until the cores have one each; so a
    task's sort and hash table grow with the input. No more partitions than cores: it may choose.
    """
    n = -(-rows // PARTITION_ROWS)
    keys = [key] if isinstance(key, str) else key
    return tuple(t.repartition(n, *keys) for t in tables) if n > tables[0].sparkSession.sparkContext.defaultParallelism else tables


def running_by(df: DataFrame, by: list[str], order: list[str | Column], sums: dict[str, str], name: str = "ranges") -> DataFrame:
    """``running`` inside each group of ``by``; adds each sum over the whole group as ``<name>_all``."""
    if not by:
        out = running(df, order, sums, name)
        return out.crossJoin(F.broadcast(df.agg(*(F.sum(c).alias(f"{n}_all") for n, c in sums.items()))))
    out = kept(running(df, [*by, *order], sums, name), f"{name}-summed")
    groups = kept(out.groupBy(*by).agg(*(F.min(n).alias(f"_{n}") for n in sums), *(F.sum(c).alias(f"{n}_all") for n, c in sums.items())), f"{name}-groups")
    keys = [F.col(b).eqNullSafe(F.col(f"_by_{b}")) for b in by]
    joined = out.join(small(groups.withColumnsRenamed({b: f"_by_{b}" for b in by})), keys)
    return joined.select(*df.columns, *((F.col(n) - F.col(f"_{n}")).alias(n) for n in sums), *(f"{n}_all" for n in sums))


def sums_up_to(facts: DataFrame, asks: DataFrame, by: list[str], at: str, value: str, out: str) -> DataFrame:
    """``asks`` with the sum of ``value`` over the facts of their group up to ``at``, plus a number that is the same for the group.

    So differences between asks of a group are sums over the time between them. Facts
    and asks are put in one order and summed in ranges: rows grow with facts and asks, not
    with pairs of them, and a group may hold all rows.
    """
    rest = [c for c in asks.columns if c not in (*by, at)]
    row = lambda df, asked: df.select(*by, at, F.lit(asked).alias("_asked"), (F.lit(0).cast("long") if asked else F.col(value).cast("long")).alias("_value"), *((F.col(c) if asked else F.lit(None).cast(asks.schema[c].dataType)).alias(c) for c in rest))
    whole = running(row(facts, False).unionByName(row(asks, True)), [*by, at, "_asked"], {out: "_value"}, "sums-up-to")
    return whole.where("_asked").select(*asks.columns, out)


def value_counts(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, value, n, before, n_all): how often each value stands in its group, and how many rows lie below it."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    return running_by(counts, by, [value], {"before": "n"}, "values").withColumnRenamed("before_all", "n_all")


def quantiles(df: DataFrame, by: list[str], value: str, share: float, out: str) -> DataFrame:
    """(by, out): the smallest value that at least ``share`` of a group's values don't exceed. Exact.

    Values are counted first, then ranges of values: the one that holds the wanted place
    gives it. No group is sorted or gathered.
    """
    placed = value_counts(df, by, value)
    wanted = F.greatest(F.lit(1), F.ceil(F.lit(share) * F.col("n_all")))
    found = placed.where((F.col("before") < wanted) & (wanted <= F.col("before") + F.col("n")))
    return found.select(*by, F.col(value).alias(out))


def every_nth(df: DataFrame, order: list[str], k: int, by: list[str]) -> DataFrame:
    """k rows spread evenly over each group of ``by`` in ``order``: the first and last with those between.

    Places come from counts of ranges; no window spans a group.
    """
    rows = running_by(df.withColumn("_one", F.lit(1).cast("long")), by, order, {"_at": "_one"}, "spread")
    n = F.col("_at_all")
    slot = lambda at: F.floor(at * (k - 1) / F.greatest(n - 1, F.lit(1)))
    return rows.where((n <= k) | (F.col("_at") == 0) | (slot(F.col("_at")) > slot(F.col("_at") - 1))).select(*df.columns)


def counted_tiles(df: DataFrame, n: int, value: str, tie: str, out: str, descending: bool = False) -> DataFrame:
    """Add NTILE(n) over all rows by (value, tie), from counts of values instead of sorted rows.

    A value whose rows all fall into one tile gives it to them by a join. At most n - 1
    values stand across a border; only their rows get a place, in the order of ``tie``.
    """
    from .ranking import ntile_over

    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("_n")).withColumn("_null", F.col(value).isNull())
    order = [F.desc_nulls_last(value) if descending else F.asc_nulls_first(value)]
    values = running(counts, order, {"_before": "_n"}, "tile-values")
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    values = values.crossJoin(F.broadcast(total)).withColumns({"_first": ntile_over(n, F.col("_before") + 1, F.col("_total")), "_last": ntile_over(n, F.col("_before") + F.col("_n"), F.col("_total"))})
    values = kept(values.withColumnRenamed(value, "_value").drop("_null"), "tiles")
    rows = df.join(small(values), F.col(value).eqNullSafe(F.col("_value")))
    whole = rows.where("_first = _last").select(*df.columns, F.col("_first").alias(out))
    split = rows.where("_first < _last").select(*df.columns, "_before", "_total", F.lit(1).cast("long").alias("_one"))
    placed = running_by(split, [value], [tie], {"_at": "_one"}, "tile-borders")
    return whole.unionByName(placed.select(*df.columns, ntile_over(n, F.col("_before") + F.col("_at") + 1, F.col("_total")).alias(out)))
