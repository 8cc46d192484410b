"""The domain's tables as views on the benchmark's star schema.

Each function is the DataFrame form of the common table expression of the same
name in ``oracle.PREFIX``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Domain:
    """Tables of one directory, under the names and columns of the domain."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def orders(self) -> DataFrame:
        c, key = F.col, F.col("o_orderkey")
        status = F.when(c("o_orderstatus") == "F", "Completed").when(c("o_orderstatus") == "O", "Cancelled").otherwise("Refunded")
        discount = F.when(key % 50 != 0, (key % 10).cast("double"))
        return self.raw("orders").select(
            key.alias("order_id"), c("o_custkey").alias("customer_id"), (c("o_custkey") % 25).alias("restaurant_id"), F.when(key % 2 == 0, key % 8).alias("promotion_id"),
            F.expr("o_orderdate + make_dt_interval(0, int(o_orderkey % 24))").alias("order_datetime"), c("o_orderpriority").alias("ordering_channel"), status.alias("order_status"),
            c("o_totalprice").alias("subtotal"), discount.alias("discount_amount"), (c("o_totalprice") - F.coalesce(discount, F.lit(0.0))).alias("final_amount"),
        )

    @property
    def items(self) -> DataFrame:
        c = F.col
        return self.raw("lineitem").select(
            (c("l_orderkey") * 10 + c("l_linenumber")).alias("order_item_id"), c("l_orderkey").alias("order_id"), c("l_partkey").alias("menu_item_id"), c("l_quantity").cast("int").alias("quantity"),
            (c("l_extendedprice") / c("l_quantity")).alias("unit_price"), F.lit(0.0).alias("item_discount"), c("l_extendedprice").alias("line_total"),
        )

    @property
    def menu(self) -> DataFrame:
        c, key = F.col, F.col("p_partkey")
        return self.raw("part").select(
            key.alias("menu_item_id"), c("p_type").alias("category_id"), c("p_name").alias("item_name"), c("p_retailprice").alias("base_price"),
            F.when(key % 40 != 0, c("p_retailprice") * (0.5 + (key % 7) / 10.0)).alias("cost_price"), F.expr("date_sub(date'2001-08-01', int(p_partkey % 400))").alias("launch_date"),
        )

    @property
    def categories(self) -> DataFrame:
        return self.raw("part").select(F.col("p_type").alias("category_id"), F.concat(F.lit("Category "), "p_type").alias("category_name")).distinct()

    @property
    def restaurants(self) -> DataFrame:
        named = self.raw("nation").join(F.broadcast(self.raw("region")), F.col("n_regionkey") == F.col("r_regionkey"))  # the region table is five rows by its definition
        return named.select(F.col("n_nationkey").cast("long").alias("restaurant_id"), F.col("n_name").alias("restaurant_name"), F.col("r_name").alias("city"))

    @property
    def promotions(self) -> DataFrame:
        return self.raw("nation").where("n_nationkey < 10").select(F.col("n_nationkey").cast("long").alias("promotion_id"), F.concat(F.lit("Promo "), "n_name").alias("promotion_name"))

    @property
    def customers(self) -> DataFrame:
        return self.raw("customer").select(F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("customer_segment"))

    @property
    def wastage(self) -> DataFrame:
        c = F.col
        return self.raw("lineitem").where("l_returnflag = 'R'").select(
            (c("l_orderkey") * 10 + c("l_linenumber")).alias("wastage_id"), (c("l_suppkey") % 25).alias("restaurant_id"), c("l_partkey").alias("menu_item_id"), F.to_date("l_shipdate").alias("wastage_date"),
            c("l_quantity").alias("quantity_wasted"), (c("l_extendedprice") / 100.0).alias("wastage_cost"), c("l_linestatus").alias("reason"),
        )

    @property
    def prices(self) -> DataFrame:
        c, key = F.col, F.col("p_partkey")
        return self.raw("part").select(
            key.alias("price_history_id"), key.alias("menu_item_id"), (key % 25).alias("restaurant_id"), c("p_retailprice").alias("old_price"),
            (c("p_retailprice") * (1.0 + (key % 5 - 2) / 10.0)).alias("new_price"), F.expr("date_add(date'1998-01-01', int(p_partkey % 700))").alias("effective_from"), c("p_brand").alias("change_reason"),
        )

    @property
    def ratings(self) -> DataFrame:
        c, key = F.col, F.col("event_id")
        return self.raw("events").select(
            key.alias("rating_id"), key.alias("order_id"), c("user_id").alias("customer_id"), (c("user_id") % 25).alias("restaurant_id"), (key % 6).cast("int").alias("rating"),
            (1.0 + key % 9 / 2.0).alias("food_rating"), F.when(key % 3 != 0, 1.0 + key % 5).alias("service_rating"), F.to_date("ts").alias("rating_date"),
        )

    @property
    def inventory(self) -> DataFrame:
        c, q = F.col, F.col("l_quantity").cast("int")
        return self.raw("lineitem").select(
            (c("l_orderkey") * 10 + c("l_linenumber")).alias("inventory_id"), (c("l_suppkey") % 25).alias("restaurant_id"), c("l_partkey").alias("menu_item_id"), F.to_date("l_shipdate").alias("record_date"),
            q.alias("opening_stock"), c("l_linenumber").alias("stock_received"), F.least(q, F.lit(5)).alias("stock_used"), (q + c("l_linenumber") - F.least(q, F.lit(5))).alias("closing_stock"),
            F.when(q < 10, "Low").otherwise("Normal").alias("stock_status"),
        )
