"""Feature marts over the domain's tables; each function gives one mart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import fixed_avg, fixed_sum, sum_if
from ..functions.times import Weekday, in_last_days, is_weekend, month, week, weekday
from .customers import repeat_buyers, visits
from .economics import FINE
from .wastage import valid_waste


def catalog(menu: DataFrame, categories: DataFrame) -> DataFrame:
    return menu.join(categories.select("category_id", "category_name"), "category_id")


def lines(net: DataFrame) -> DataFrame:
    """Net lines (unclear ones kept with null revenue) with calendar and promotion marks."""
    at = F.col("order_datetime")
    return net.where(at.isNotNull()).withColumns({"day": F.to_date(at), "month": month(at), "weekend": is_weekend(at), "promoted": F.col("promotion_id").isNotNull()})


def members(sold: DataFrame) -> DataFrame:
    """Distinct (order, item, customer, category): several lines of an item count once."""
    return sold.select("order_id", "menu_item_id", "customer_id", "category_id").distinct()


def as_of_day(orders: DataFrame) -> DataFrame:
    """One row: the last day of completed orders."""
    return visits(orders).agg(F.max("day").alias("as_of"))


def linked_ratings(ratings: DataFrame, orders: DataFrame, as_of: DataFrame) -> DataFrame:
    """Ratings of 1 to 5, not after ``as_of``, with their order and marks of what doesn't fit it."""
    known = ratings.crossJoin(F.broadcast(as_of)).where(F.col("rating").between(1, 5) & (F.col("rating_date") <= F.col("as_of"))).drop("as_of")
    own = visits(orders).select("order_id", F.col("customer_id").alias("_customer"), F.col("restaurant_id").alias("_restaurant"), "day", "promoted")
    rows = known.join(own, "order_id")
    wrong = (F.col("customer_id") != F.col("_customer")) | (F.col("restaurant_id") != F.col("_restaurant"))
    return rows.withColumns({"identity_mismatch": wrong, "before_purchase": F.col("rating_date") < F.col("day")}).drop("_customer", "_restaurant")


def rating_events(linked: DataFrame) -> DataFrame:
    return linked.select("rating_id", "order_id", "customer_id", "restaurant_id", "rating", "food_rating", "rating_date", "day", "promoted", "identity_mismatch", "before_purchase")


def item_ratings(linked: DataFrame, member_rows: DataFrame) -> DataFrame:
    """Valid ratings at each item of their order."""
    return linked.where(~F.col("identity_mismatch") & ~F.col("before_purchase")).join(member_rows.select("order_id", "menu_item_id").distinct(), "order_id")


def rating_context(rated: DataFrame) -> DataFrame:
    return rated.groupBy("menu_item_id", "restaurant_id", month(F.col("rating_date")).alias("month"), "promoted").agg(fixed_avg("food_rating", 4).alias("order_associated_rating"), F.count("food_rating").alias("rating_count"))


def menu_features(menu_rows: DataFrame, sold: DataFrame, rated: DataFrame, wastage: DataFrame, as_of: DataFrame) -> DataFrame:
    """One row for each catalogue item: sales, promotion, weekend, recency, buyers, ratings and waste."""
    dated = sold.crossJoin(F.broadcast(as_of))
    q, end = F.col("quantity"), F.col("as_of")
    item = dated.groupBy("menu_item_id").agg(
        F.sum(q).cast("long").alias("units"), F.countDistinct("order_id").alias("orders"), fixed_sum("net_revenue", FINE).alias("revenue"), fixed_sum("estimated_cost", FINE).alias("cost"),
        fixed_sum("margin", FINE).alias("margin"), fixed_sum("line_total").alias("gross_revenue"), fixed_sum(q * F.col("unit_price")).alias("list_revenue"),
        F.countDistinct(F.when(F.col("promoted"), F.col("order_id"))).alias("promo_orders"), fixed_sum(F.when(F.col("promoted"), F.col("net_revenue")).otherwise(0.0), FINE).alias("promo_revenue"),
        sum_if(F.col("weekend"), q).alias("weekend_units"), F.min("day").alias("first_sale"), F.max("day").alias("last_sale"),
        sum_if(in_last_days(F.col("day"), end, 90), q).alias("units_recent_90d"), sum_if(in_last_days(F.col("day"), end, 90, 90), q).alias("units_previous_90d"),
        sum_if(F.col("net_revenue").isNull()).alias("unclear_revenue_lines"), sum_if(F.col("estimated_cost").isNull()).alias("unclear_cost_lines"),
    )
    when = F.col("rating_date")
    scores = rated.crossJoin(F.broadcast(as_of)).groupBy("menu_item_id").agg(
        fixed_avg("food_rating", 4).alias("order_associated_rating"), F.count("food_rating").alias("rated_orders"),
        fixed_avg(F.when(in_last_days(when, end, 90), F.col("food_rating")), 4).alias("rating_recent_90d"), fixed_avg(F.when(in_last_days(when, end, 90, 90), F.col("food_rating")), 4).alias("rating_previous_90d"),
    )
    waste = valid_waste(wastage).crossJoin(F.broadcast(as_of)).where(F.col("wastage_date") <= end).groupBy("menu_item_id").agg(fixed_sum("quantity_wasted").alias("waste_units"), fixed_sum("wastage_cost", FINE).alias("waste_cost"))
    out = menu_rows
    for part in (item, repeat_buyers(members(sold)), scores, waste):
        out = out.join(part, "menu_item_id", "left")
    return out


def daily_item_location(sold: DataFrame) -> DataFrame:
    q = F.col("quantity")
    return sold.groupBy("restaurant_id", "menu_item_id", "category_id", "day").agg(
        F.sum(q).cast("long").alias("units"), F.countDistinct("order_id").alias("orders"), fixed_sum("net_revenue", FINE).alias("revenue"), fixed_sum("margin", FINE).alias("margin"),
        fixed_sum("estimated_cost", FINE).alias("cost"), sum_if(F.col("promoted"), q).alias("promo_units"), fixed_sum(q * F.col("unit_price")).alias("list_value"), F.countDistinct("customer_id").alias("buyers"),
    )


def daily_demand(daily: DataFrame) -> DataFrame:
    """Units of each item, category and location by day, in one table; each row unfolds into its three levels."""
    levels = F.array(*(F.struct(F.lit(n).alias("level"), F.col(c).cast("string").alias("entity")) for n, c in (("item", "menu_item_id"), ("category", "category_id"), ("location", "restaurant_id"))))
    return daily.select(F.explode(levels).alias("x"), "day", "units").groupBy("x.level", "x.entity", "day").agg(F.sum("units").cast("long").alias("units"))


def location_menu(daily: DataFrame) -> DataFrame:
    return daily.groupBy("restaurant_id", "menu_item_id").agg(F.sum("units").cast("long").alias("units"), *(fixed_sum(c, FINE).alias(c) for c in ("revenue", "margin", "cost")))


def peak_periods(orders: DataFrame) -> DataFrame:
    return visits(orders).groupBy("restaurant_id", "ordering_channel", "month", "weekday", "hour").agg(F.count(F.lit(1)).alias("orders"), fixed_sum("final_amount").alias("revenue"))


def order_history(orders: DataFrame) -> DataFrame:
    return visits(orders).select("order_id", "customer_id", "restaurant_id", "promotion_id", "order_datetime", "day", "month", "ordering_channel", "final_amount", "subtotal", "discount_amount")


def wastage_daily(wastage: DataFrame, as_of: DataFrame) -> DataFrame:
    rows = valid_waste(wastage).crossJoin(F.broadcast(as_of)).where(F.col("wastage_date") <= F.col("as_of"))
    return rows.groupBy("restaurant_id", "menu_item_id", F.col("wastage_date").alias("day")).agg(fixed_sum("quantity_wasted").alias("waste_units"), fixed_sum("wastage_cost", FINE).alias("waste_cost"))


def wastage_reasons(wastage: DataFrame) -> DataFrame:
    return valid_waste(wastage).groupBy("restaurant_id", "menu_item_id", "reason").agg(fixed_sum("quantity_wasted").alias("waste_units"), fixed_sum("wastage_cost", FINE).alias("waste_cost"))


def aligned(daily: DataFrame, wasted: DataFrame) -> DataFrame:
    """Demand and waste of each place, item and day; a side that lacks it is zero."""
    measures = ["units", "orders", "promo_units", "revenue", "margin", "waste_units", "waste_cost"]
    both = daily.drop("category_id", "cost", "list_value", "buyers").join(wasted, ["restaurant_id", "menu_item_id", "day"], "full")
    return both.fillna(0, measures).select("restaurant_id", "menu_item_id", "day", *measures)


def weekly_operations(aligned_rows: DataFrame) -> DataFrame:
    whole = [F.sum(c).cast("long").alias(c) for c in ("units", "orders", "promo_units")]
    return aligned_rows.groupBy("restaurant_id", "menu_item_id", week(F.col("day")).alias("week")).agg(*whole, *(fixed_sum(c, FINE).alias(c) for c in ("revenue", "margin", "waste_units", "waste_cost")))


def wastage_inventory_alignment(wasted: DataFrame, inventory: DataFrame, daily: DataFrame) -> DataFrame:
    """Waste with the day's stock snapshots and demand; quantities prepared are not recorded and stay null."""
    key = ["restaurant_id", "menu_item_id", "day"]
    stock = inventory.groupBy("restaurant_id", "menu_item_id", F.col("record_date").alias("day")).agg(
        *(F.sum(c).cast("long").alias(f"snapshot_{n}") for c, n in (("stock_used", "stock_used"), ("opening_stock", "opening"), ("stock_received", "received"), ("closing_stock", "closing")))
    )
    return wasted.join(stock, key, "left").join(daily.select(*key, "units", "promo_units"), key, "left").withColumn("preparation_quantity", F.lit(None).cast("double"))


def weekday_names(orders: DataFrame) -> DataFrame:
    """Orders by weekday under each encoding in use, so that a reader can tell them apart."""
    at = F.col("order_datetime")
    return visits(orders).groupBy(*(weekday(at, e).alias(e.name.lower()) for e in Weekday), F.date_format(at, "EEEE").alias("name")).agg(F.count(F.lit(1)).alias("orders"))
