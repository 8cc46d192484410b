"""Totals of sales at several grains from one pass, with each group's share of its parent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import fixed
from ..sources.shared import kept
from .ranges import small

#: Grains by name, and the grain whose groups each one parts.
GRAINS: dict[str, tuple[tuple[str, ...], str | None]] = {
    "all": ((), None), "category": (("category_id",), "all"), "item": (("category_id", "menu_item_id"), "category"), "place": (("restaurant_id",), "all"),
    "place and category": (("restaurant_id", "category_id"), "place"), "month": (("month",), "all"), "place and month": (("restaurant_id", "month"), "place"),
}
DIMENSIONS = ("category_id", "menu_item_id", "restaurant_id", "month")
#: Decimal places at which money is summed.
DIGITS = 4


def sales_rollup(lines: DataFrame, grains: dict[str, tuple[tuple[str, ...], str | None]] | None = None) -> DataFrame:
    """(grain, dimensions, lines, units, revenue, revenue_share) of all grains, from one scan of the lines.

    Money is summed in whole numbers, so every grain adds up to the same total. A share
    is of the parent grain's group; null where that has no revenue. A line without a
    value of a dimension forms a group of its own, apart from totals over it.
    """
    grains = GRAINS if grains is None else grains
    columns = [F.col(c) for c in DIMENSIONS]
    sets = [[F.col(c) for c in cols] for cols, _ in grains.values()]
    bits = {name: sum(1 << (len(DIMENSIONS) - 1 - i) for i, c in enumerate(DIMENSIONS) if c not in cols) for name, (cols, _) in grains.items()}
    amounts = lines.select(*DIMENSIONS, F.col("quantity").cast("long").alias("quantity"), fixed(F.col("net_revenue"), DIGITS).alias("_money"))
    totals = amounts.groupingSets(sets, *columns).agg(F.grouping_id(*columns).cast("int").alias("_gid"), F.count(F.lit(1)).alias("lines"), F.sum("quantity").alias("units"), F.sum("_money").alias("_money"))
    totals = kept(totals, "rollup")
    out = None
    for name, (_, parent) in grains.items():
        own = totals.where(F.col("_gid") == bits[name])
        if parent is None:
            part = own.withColumn("_of", F.col("_money"))
        else:
            keys = grains[parent][0]
            above = totals.where(F.col("_gid") == bits[parent]).select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_money").alias("_of"))
            part = own.join(small(above), [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left") if keys else own.crossJoin(F.broadcast(above))
        told = part.select(F.lit(name).alias("grain"), *DIMENSIONS, "lines", "units", (F.col("_money") / float(10**DIGITS)).alias("revenue"), F.try_divide("_money", "_of").alias("revenue_share"))
        out = told if out is None else out.unionByName(told)
    return out
