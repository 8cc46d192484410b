"""Wastage by dimension and the ranking of historical burden."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import fixed_sum, share
from ..functions.times import month
from .ranges import cuts_below


def valid_waste(wastage: DataFrame) -> DataFrame:
    return wastage.where((F.col("quantity_wasted") >= 0) & (F.col("wastage_cost") >= 0))


def sums() -> list:
    return [fixed_sum("quantity_wasted").alias("quantity_wasted"), fixed_sum("wastage_cost", 4).alias("wastage_cost"), F.count(F.lit(1)).alias("records")]


def dimensions(wastage: DataFrame, menu: DataFrame, categories: DataFrame, restaurants: DataFrame) -> DataFrame:
    """One flat grouping by place, item, category, month, weekday and reason."""
    named = menu.select("menu_item_id", "item_name", "category_id").join(categories.select("category_id", "category_name"), "category_id", "left")
    rows = valid_waste(wastage).join(named, "menu_item_id", "left").join(restaurants.select("restaurant_id", "restaurant_name", "city"), "restaurant_id", "left")
    day = F.col("wastage_date")
    return rows.groupBy("restaurant_id", "restaurant_name", "city", "menu_item_id", "item_name", "category_name", month(day).alias("waste_month"), F.date_format(day, "EEEE").alias("weekday"), "reason").agg(*sums())


def ranking(wastage: DataFrame) -> DataFrame:
    """Dense rank of (restaurant, item) by cost, descending.

    Costs are few compared with rows, but may be many; equal costs are ranked by a
    distributed prefix: ranges of costs, each ranked by itself, offset by the number
    of distinct costs in the ranges above.
    """
    totals = valid_waste(wastage).groupBy("restaurant_id", "menu_item_id").agg(*sums())
    return dense_rank_desc(totals, "wastage_cost", "risk_rank")


def dense_rank_desc(df: DataFrame, value: str, out: str, ranges: int | None = None) -> DataFrame:
    ranges = ranges or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = df.agg(F.coalesce(F.percentile_approx(value, [i / ranges for i in range(1, ranges)], 10_000), F.array().cast("array<double>")).alias("_cuts"))
    dealt = df.crossJoin(F.broadcast(cuts)).withColumn("_range", cuts_below(F.col("_cuts"), F.col(value), ranges - 1)).drop("_cuts")
    counts = dealt.groupBy("_range").agg(F.countDistinct(value).alias("_n"))
    above = F.sum("_n").over(Window.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1))  # at most ``ranges`` rows
    starts = counts.select("_range", F.coalesce(above, F.lit(0)).alias("_above"))
    inside = F.dense_rank().over(Window.partitionBy("_range").orderBy(F.desc(value)))
    return dealt.withColumn("_in", inside).join(F.broadcast(starts), "_range").withColumn(out, (F.col("_above") + F.col("_in")).cast("long")).drop("_range", "_in", "_above")


def shares(wastage: DataFrame, by: str) -> DataFrame:
    """Cost by one dimension and its share of all."""
    rows = valid_waste(wastage).groupBy(by).agg(*sums())
    return rows.withColumn("cost_share", share(F.col("wastage_cost")))
