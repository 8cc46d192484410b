"""Keyed comparison of two results within tolerances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ComparisonError(ValueError):
    """The two sides can't be compared."""


def compare(left: DataFrame, right: DataFrame, keys: list[str], tolerances: dict[str, float], exact: list[str] = []) -> DataFrame:  # noqa: B006
    """(keys, metric, left, right, delta, status, passed), one row for each key and metric.

    Status: missing_left, missing_right, both_null, one_null, within, beyond, same or
    different. Keys must be unique on either side, and both must hold all metrics.
    """
    metrics = [*tolerances, *exact]
    for side in (left, right):
        if lack := [c for c in [*keys, *metrics] if c not in side.columns]:
            raise ComparisonError(f"columns missing: {lack}")
        if not side.groupBy(*keys).count().where("count > 1").isEmpty():
            raise ComparisonError(f"{keys} is not unique")
    pick = lambda df, tag: df.select(*keys, *(F.col(m).alias(f"{m}_{tag}") for m in metrics), F.lit(True).alias(f"_in_{tag}"))
    both = pick(left, "l").join(pick(right, "r"), keys, "full")
    cells = F.array(*(
        F.struct(F.lit(m).alias("metric"), F.col(f"{m}_l").cast("double").alias("left"), F.col(f"{m}_r").cast("double").alias("right"),
                 F.lit(None).cast("string").alias("left_text"), F.lit(None).cast("string").alias("right_text"), F.lit(float(tol)).alias("tolerance"))
        for m, tol in tolerances.items()
    ), *(
        F.struct(F.lit(m).alias("metric"), F.lit(None).cast("double").alias("left"), F.lit(None).cast("double").alias("right"),
                 F.col(f"{m}_l").cast("string").alias("left_text"), F.col(f"{m}_r").cast("string").alias("right_text"), F.lit(None).cast("double").alias("tolerance"))
        for m in exact
    ))
    rows = both.select(*keys, "_in_l", "_in_r", F.explode(cells).alias("c")).select(*keys, "_in_l", "_in_r", "c.*")
    number = F.col("tolerance").isNotNull()
    no_left, no_right = F.when(number, F.col("left").isNull()).otherwise(F.col("left_text").isNull()), F.when(number, F.col("right").isNull()).otherwise(F.col("right_text").isNull())
    delta = F.abs(F.col("left") - F.col("right"))
    status = (
        F.when(F.col("_in_l").isNull(), "missing_left").when(F.col("_in_r").isNull(), "missing_right")
        .when(no_left & no_right, "both_null").when(no_left | no_right, "one_null")
        .when(number, F.when(delta <= F.col("tolerance"), "within").otherwise("beyond"))
        .otherwise(F.when(F.col("left_text") == F.col("right_text"), "same").otherwise("different"))
    )
    out = rows.withColumns({"delta": delta, "status": status})
    return out.withColumn("passed", F.col("status").isin("both_null", "within", "same")).select(*keys, "metric", "left", "right", "left_text", "right_text", "delta", "status", "passed")


def delta_summary(compared: DataFrame, near: float = 0.01) -> DataFrame:
    """For each metric: rows compared, exact, near, largest and mean difference, failures."""
    return compared.groupBy("metric").agg(
        F.count("delta").alias("compared"), F.sum((F.col("delta") <= 1e-8).cast("long")).alias("exact"), F.sum((F.col("delta") <= near).cast("long")).alias("near"),
        F.max("delta").alias("max_delta"), F.avg("delta").alias("mean_delta"), F.sum((~F.col("passed")).cast("long")).alias("failed"),
    )


def error_summary(rows: DataFrame, actual: str, predicted: str, within: tuple[float, ...] = (0.5, 1.0, 2.0)) -> DataFrame:
    """One row: mae, rmse, r2, median, p90 and largest error, and shares of errors within bounds."""
    err = F.abs(F.col(actual) - F.col(predicted))
    square = (F.col(actual) - F.col(predicted)) * (F.col(actual) - F.col(predicted))
    return rows.agg(
        F.count(err).alias("n"), F.avg(err).alias("mae"), F.sqrt(F.avg(square)).alias("rmse"), (1 - F.sum(square) / F.nullif(F.var_pop(actual) * F.count(actual), F.lit(0.0))).alias("r2"),
        F.percentile(err, F.lit(0.5)).alias("median_error"), F.percentile(err, F.lit(0.9)).alias("p90_error"), F.max(err).alias("max_error"),
        *(F.avg((err <= w).cast("double")).alias(f"within_{str(w).replace('.', '_')}") for w in within),
    )


def support_lift_recheck(pairs: DataFrame) -> DataFrame:
    """One row: largest difference of support and lift from what their counts give."""
    support = F.col("pair_count") / F.col("basket_count")
    lift = F.col("pair_count") * F.col("basket_count") / (F.col("count_a") * F.col("count_b"))
    return pairs.agg(F.max(F.abs(F.col("support") - support)).alias("max_support_error"), F.max(F.abs(F.col("lift") - lift)).alias("max_lift_error"))


# Keys and tolerances of the standing reports.
REPORT_SPECS: dict[str, tuple[list[str], dict[str, float]]] = {
    "menu_item_performance": (["menu_item_id"], {"order_count": 0, "units_sold": 0, "gross_sales": 0.01, "avg_unit_price": 0.01}),
    "category_performance": (["category_name"], {"order_count": 0, "units_sold": 0, "gross_sales": 0.01, "avg_line_value": 0.01}),
    "restaurant_performance": (["restaurant_id"], {"order_count": 0, "revenue": 0.01, "avg_order_value": 0.01}),
    "channel_performance": (["ordering_channel"], {"orders": 0, "avg_order_value": 0.01, "completed_revenue": 0.01}),
    "promotion_effectiveness": (["promotion_id"], {"used_orders": 0, "avg_subtotal": 0.01, "avg_discount": 0.01, "final_revenue": 0.01}),
    "monthly_demand": (["order_month"], {"total_orders": 0, "completed_orders": 0, "completed_revenue": 0.01}),
    "weekday_peak_hour": (["weekday", "hour_of_day"], {"orders": 0, "avg_order_value": 0.01}),
    "customer_segment_behavior": (["customer_segment"], {"customers": 0, "total_orders": 0, "avg_order_value": 0.01, "revenue": 0.01}),
    "restaurant_ratings": (["restaurant_id"], {"rating_count": 0, "avg_rating": 0.001, "avg_food_rating": 0.001, "avg_service_rating": 0.001}),
    "wastage_by_reason": (["reason"], {"records": 0, "quantity_wasted": 0.01, "wastage_cost": 0.01}),
    "pricing_changes": (["change_reason"], {"changes": 0, "avg_price_change": 0.01, "avg_percent_change": 0.01}),
    "inventory_status": (["stock_status"], {"observations": 0, "avg_closing_stock": 0.01}),
}


def compare_report(name: str, left: DataFrame, right: DataFrame) -> DataFrame:
    """A standing report from two engines or versions, under its keys and tolerances."""
    keys, tolerances = REPORT_SPECS[name]
    return compare(left, right, keys, tolerances)
