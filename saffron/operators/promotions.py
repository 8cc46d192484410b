"""Promotions against orders without one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import fixed_avg, fixed_sum
from .economics import FINE
from .reports import completed


def promotion_traps(net: DataFrame, orders: DataFrame, promotions: DataFrame) -> DataFrame:
    """Promotions whose orders are worth more but earn less than orders without promotion.

    The baseline is one row, joined without a trip through the driver.
    """
    per_order = net.groupBy("order_id").agg((fixed_sum("net_revenue", FINE) - fixed_sum("estimated_cost", FINE)).alias("order_margin"))
    done = completed(orders).select("order_id", "customer_id", "promotion_id", "final_amount")
    used = done.where("promotion_id is not null").join(per_order, "order_id", "left").groupBy("promotion_id").agg(
        F.countDistinct("order_id").alias("orders"), F.countDistinct("customer_id").alias("customers"), fixed_avg("final_amount").alias("avg_order_value"),
        fixed_sum("final_amount").alias("revenue"), fixed_avg("order_margin", FINE).alias("avg_estimated_margin"),
    )
    base = done.where("promotion_id is null").join(per_order, "order_id").agg(
        F.countDistinct("order_id").alias("baseline_orders"), fixed_avg("final_amount").alias("baseline_aov"), fixed_avg("order_margin", FINE).alias("baseline_margin"),
    )
    trap = (F.col("avg_order_value") > F.col("baseline_aov")) & (F.col("avg_estimated_margin") < F.col("baseline_margin"))
    rows = used.join(promotions.select("promotion_id", "promotion_name"), "promotion_id", "left").crossJoin(F.broadcast(base))
    return rows.withColumn("trap_signal", F.coalesce(trap, F.lit(False)))
