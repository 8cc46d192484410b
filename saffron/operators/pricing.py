"""Price events and the demand before and after them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranges import sums_up_to


def daily_units(net: DataFrame) -> DataFrame:
    return net.groupBy("restaurant_id", "menu_item_id", F.to_date("order_datetime").alias("order_date")).agg(F.sum("quantity").cast("long").alias("units"))


def price_sensitivity(net: DataFrame, prices: DataFrame, days: int = 30) -> DataFrame:
    """Observational arc elasticity of each price event at its item and restaurant.

    Each event asks three times for the units of its item and restaurant sold up to a
    day: before its window, before the change, at the end of the window. Differences are
    the units on either side, so events are never paired with days. Equal events count
    once. Events without units on both sides drop out; an elasticity that can't be
    computed counts as low sensitivity.
    """
    key = ["menu_item_id", "restaurant_id"]
    names = [*key, "old_price", "new_price", "effective_from"]
    events = prices.where((F.col("old_price") > 0) & (F.col("new_price") > 0)).select(*names).dropna().distinct()
    units = daily_units(net).dropna()
    ends = F.array(*(F.struct(F.lit(i).alias("nth"), F.date_add("effective_from", n).alias("order_date")) for i, n in enumerate((-days - 1, -1, days - 1))))
    asks = events.withColumn("_ask", F.explode(ends)).select(*names, "_ask.nth", "_ask.order_date")
    told = sums_up_to(units, asks, key, "order_date", "units", "sold")
    sold = lambda i: F.max(F.when(F.col("nth") == i, F.col("sold")))
    sums = told.groupBy(*names).agg((sold(1) - sold(0)).alias("pre_units"), (sold(2) - sold(1)).alias("post_units"))
    price = (F.col("new_price") - F.col("old_price")) / F.col("old_price")
    demand = (F.col("post_units") - F.col("pre_units")) / F.col("pre_units")
    out = sums.where("pre_units > 0 and post_units > 0").withColumns({"price_change_pct": price, "demand_change_pct": demand})
    out = out.withColumn("arc_elasticity", F.when(F.col("price_change_pct") != 0, F.try_divide("demand_change_pct", "price_change_pct")))
    size = F.abs("arc_elasticity")
    return out.withColumn("sensitivity", F.when(size >= 1, "Highly Price Sensitive").when(size >= 0.5, "Moderately Price Sensitive").otherwise("Low Price Sensitivity"))
