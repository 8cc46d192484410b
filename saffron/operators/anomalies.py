"""Robust anomalies: distance from the median in units of the median absolute deviation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import fixed_avg
from ..functions.times import hour_of_week
from ..sources.shared import kept
from .ranges import quantiles, small
from .reports import completed

#: The median absolute deviation times this estimates a standard deviation.
MAD_SCALE = 1.4826


def robust_outliers(df: DataFrame, by: list[str], value: str, limit: float = 3.0) -> DataFrame:
    """Rows further than ``limit`` robust deviations from their group's median.

    Medians are exact (the lower one of two), selected by counts of value ranges, so no
    group has to be sorted or gathered. Groups without deviation have no outliers.
    """
    rows = kept(df, "measured")
    mid = kept(quantiles(rows, by, value, 0.5, "median"), "medians")
    off = rows.join(small(mid), by).withColumn("_off", F.abs(F.col(value) - F.col("median")))
    spread = kept(quantiles(off, by, "_off", 0.5, "mad").where("mad > 0"), "deviations")
    return off.join(small(spread), by).where(F.col("_off") > limit * MAD_SCALE * F.col("mad")).drop("_off")


def rating_anomalies(ratings: DataFrame, least: int = 30) -> DataFrame:
    """Days of a restaurant with at least ``least`` ratings whose mean stands out."""
    daily = ratings.groupBy("restaurant_id", F.to_date("rating_date").alias("event_date")).agg(fixed_avg("rating", 4).alias("mean_rating"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return robust_outliers(daily, ["restaurant_id"], "mean_rating")


def sales_anomalies(orders: DataFrame) -> DataFrame:
    """Hours whose number of orders stands out among the same hours of the week; hours without orders don't count."""
    at = F.date_trunc("hour", F.col("order_datetime")).cast("timestamp_ntz")
    hourly = completed(orders).groupBy("restaurant_id", at.alias("hour_start")).agg(F.countDistinct("order_id").alias("orders"))
    return robust_outliers(hourly.withColumn("hour_of_week", hour_of_week(F.col("hour_start"))), ["restaurant_id", "hour_of_week"], "orders")
