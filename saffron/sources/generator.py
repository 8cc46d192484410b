"""Seeded generator of the eleven tables, and injection of known defects.

Every value is a function of the row number and the seed, so tables of any size
are made in parallel, agree with each other and repeat exactly. Items follow a
Zipf-like popularity, hours have lunch and dinner peaks, months a season.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import CHANNELS, TABLES

# Shares out of 100 of hours 10 to 23, and of orders by status.
HOUR_SHARES = (2, 3, 9, 12, 8, 4, 3, 4, 7, 12, 14, 12, 7, 3)
CITIES = TABLES["restaurants"].domains["city"]
FIRST_DAY, DAYS = "2025-03-01", 549


@dataclass(frozen=True)
class Size:
    customers: int = 1_000
    restaurants: int = 25
    items: int = 200
    promotions: int = 80
    orders: int = 10_000
    ratings: int = 3_000
    stock: int = 2_000
    waste: int = 2_000
    prices: int = 500


def unit(salt: str, seed: int = 42, *columns: str) -> Column:
    """A pseudo-random number from 0 to 1 of a row."""
    return F.pmod(F.xxhash64(*(F.col(c) for c in (columns or ("n",))), F.lit(salt), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)


def pick(values: tuple[str, ...], u: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.floor(u * len(values)) + 1).cast("int"))


def number(top: int, u: Column) -> Column:
    """A whole number from 1 to ``top``."""
    return (F.floor(u * top) + 1).cast("int")


def code(prefix: str, width: int, n: Column) -> Column:
    return F.concat(F.lit(prefix), F.lpad(n.cast("string"), width, "0"))


def day(u: Column) -> Column:
    return F.date_add(F.lit(FIRST_DAY).cast("date"), F.floor(u * DAYS).cast("int"))


def money(u: Column, low: float, high: float) -> Column:
    return F.round(u * (high - low) + low, 2)


def weighted(shares: tuple[int, ...], u: Column, first: int) -> Column:
    """A value from ``first`` on by its share."""
    total, seen, out = sum(shares), 0, None
    for i, s in enumerate(shares):
        seen += s
        cond = u * total < seen
        out = F.when(cond, first + i) if out is None else out.when(cond, first + i)
    return out.otherwise(first + len(shares) - 1)


def generate(spark: SparkSession, size: Size = Size(), seed: int = 42) -> dict[str, DataFrame]:  # noqa: B008
    """Clean tables that satisfy every rule of the contract."""
    u = lambda salt: unit(salt, seed)
    rows = lambda n: spark.range(1, n + 1).withColumnRenamed("id", "n")
    n_cat = len(TABLES["menu_categories"].domains["category_name"])
    as_table = lambda name, df: df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[name].schema))
    dom = {k: t.domains for k, t in TABLES.items()}
    out = {
        "customers": rows(size.customers).select("*", code("C", 8, F.col("n")).alias("customer_id"), F.concat(F.lit("Customer "), F.col("n").cast("string")).alias("customer_name"), pick(dom["customers"]["gender"], u("g")).alias("gender"), (number(60, u("a")) + 17).alias("age"),
                                                 pick(CITIES, u("c")).alias("city"), day(u("s") * 0.5).alias("signup_date"), pick(dom["customers"]["customer_segment"], u("seg")).alias("customer_segment"), pick(CHANNELS, u("ch")).alias("preferred_channel"),
                                                 number(5000, u("l")).alias("loyalty_points"), (u("churn") < 0.1).alias("is_churned"), day(u("last") * 0.5 + 0.5).alias("last_order_date")),
        "restaurants": rows(size.restaurants).select("*", code("R", 3, F.col("n")).alias("restaurant_id"), F.concat(F.lit("Branch "), F.col("n").cast("string")).alias("restaurant_name"), pick(CITIES, u("c")).alias("city"), F.lit("Area").alias("area"),
                                                     F.lit("2024-01-01").alias("opening_date"), (number(150, u("s")) + 20).alias("seating_capacity"), pick(dom["restaurants"]["location_type"], u("t")).alias("location_type"), F.lit(True).alias("is_active")),
        "menu_categories": rows(n_cat).select("*", code("CAT", 3, F.col("n")).alias("category_id"), F.element_at(F.array(*map(F.lit, dom["menu_categories"]["category_name"])), F.col("n").cast("int")).alias("category_name"), F.lit("").alias("description"), F.lit(True).alias("is_active")),
        "menu_items": rows(size.items).withColumn("base_price", money(u("p"), 150, 2500)).select("*", code("M", 4, F.col("n")).alias("menu_item_id"), code("CAT", 3, F.col("n") % n_cat + 1).alias("category_id"), F.concat(F.lit("Dish "), F.col("n").cast("string")).alias("item_name"),
                                                    F.round(F.col("base_price") * (u("m") * 0.4 + 0.3), 2).alias("cost_price"), (number(35, u("t")) + 4).alias("preparation_time_min"), (u("v") < 0.4).alias("is_vegetarian"), F.lit(True).alias("is_available"), day(u("d") * 0.9).alias("launch_date")),
        "promotions": rows(size.promotions).withColumn("start_date", day(u("s") * 0.9)).select("*", code("P", 4, F.col("n")).alias("promotion_id"), F.concat(F.lit("Promo "), F.col("n").cast("string")).alias("promotion_name"), pick(dom["promotions"]["promotion_type"], u("t")).alias("promotion_type"),
                                                    pick(dom["promotions"]["discount_type"], u("k")).alias("discount_type"), (number(40, u("v")) + 4).alias("discount_value"), F.date_add("start_date", number(40, u("e"))).alias("end_date"), money(u("o"), 0, 1000).alias("minimum_order_value"),
                                                    pick((*CHANNELS, "All"), u("c")).alias("channel"), F.lit(True).alias("is_active")),
    }
    prices = out["menu_items"].select(F.col("n").alias("_item"), F.col("base_price").alias("unit_price"))
    # One to eight lines an order; the head of the catalogue sells most.
    orders = rows(size.orders)
    lines = orders.withColumn("at", F.explode(F.sequence(F.lit(1), number(8, u("size") * u("size"))))).withColumn("_item", number(size.items, F.pow(unit("item", seed, "n", "at"), 2.5)))
    lines = lines.join(F.broadcast(prices), "_item").withColumn("quantity", number(3, unit("q", seed, "n", "at"))) if size.items <= 100_000 else lines.join(prices, "_item").withColumn("quantity", number(3, unit("q", seed, "n", "at")))
    lines = lines.withColumn("item_discount", F.when(unit("disc", seed, "n", "at") < 0.1, F.round(F.col("unit_price") * F.col("quantity") * 0.1, 2)).otherwise(0.0))
    lines = lines.withColumn("line_total", F.round(F.col("quantity") * F.col("unit_price") - F.col("item_discount"), 2))
    sums = lines.groupBy("n").agg(F.round(F.sum("line_total"), 2).alias("subtotal"))
    season = F.pow(u("day"), 0.8)
    clock = F.make_interval(hours=weighted(HOUR_SHARES, u("hour"), 10), mins=F.floor(u("minute") * 60).cast("int"))
    done = orders.join(sums, "n").withColumns({
        "order_status": F.when(u("st") < 0.94, "Completed").when(u("st") < 0.98, "Cancelled").otherwise("Refunded"), "promotion_id": F.when(u("pr") < 0.25, code("P", 4, number(size.promotions, u("pid")))),
        "ordering_channel": pick(CHANNELS, u("ch")), "order_datetime": day(season).cast("timestamp") + clock,
    })
    done = done.withColumn("discount_amount", F.when(F.col("promotion_id").isNotNull(), F.round(F.col("subtotal") * (u("d") * 0.2 + 0.05), 2)).otherwise(0.0))
    done = done.withColumns({"tax_amount": F.round((F.col("subtotal") - F.col("discount_amount")) * 0.05, 2), "delivery_fee": F.when(F.col("ordering_channel") == "Delivery Partner", 120.0).otherwise(0.0)})
    settled = F.round(F.col("subtotal") - F.col("discount_amount") + F.col("tax_amount") + F.col("delivery_fee"), 2)
    out["orders"] = done.select("*", code("O", 9, F.col("n")).alias("order_id"), code("C", 8, number(size.customers, F.pow(u("cust"), 1.5))).alias("customer_id"), code("R", 3, number(size.restaurants, u("rest"))).alias("restaurant_id"),
                                F.when(F.col("order_status") == "Cancelled", 0.0).otherwise(settled).alias("final_amount"), pick(TABLES["orders"].domains["payment_method"], u("pay")).alias("payment_method"))
    out["order_items"] = lines.select("*", F.concat(code("I", 9, F.col("n")), F.lit("-"), F.col("at").cast("string")).alias("order_item_id"), code("O", 9, F.col("n")).alias("order_id"), code("M", 4, F.col("_item")).alias("menu_item_id"), F.lit(None).alias("special_request"))
    place = lambda: (code("R", 3, number(size.restaurants, u("rest"))).alias("restaurant_id"), code("M", 4, number(size.items, u("item"))).alias("menu_item_id"))
    out["pricing_history"] = rows(size.prices).withColumn("old_price", money(u("o"), 150, 2500)).select("*", code("H", 6, F.col("n")).alias("price_history_id"), *place(), F.round(F.col("old_price") * (u("f") * 0.3 + 0.9), 2).alias("new_price"), day(u("d")).alias("effective_from"), F.lit(None).alias("effective_to"), pick(dom["pricing_history"]["change_reason"], u("r")).alias("change_reason"))
    rated = rows(size.ratings).withColumn("_n", number(size.orders, u("order")))
    whose = out["orders"].select(F.col("n").alias("_n"), "order_id", "customer_id", "restaurant_id", F.to_date("order_datetime").alias("_day"))
    half = lambda salt: number(9, u(salt)) / 2.0 + 0.5
    out["ratings"] = rated.join(whose, "_n").select("*", code("T", 8, F.col("n")).alias("rating_id"), number(5, F.sqrt(u("r"))).alias("rating"), half("f").alias("food_rating"), half("s").alias("service_rating"), F.when(u("del") < 0.5, half("d")).alias("delivery_rating"), F.lit("ok").alias("review_text"), F.date_add("_day", number(5, u("lag"))).alias("rating_date"))
    stock = rows(size.stock).withColumns({"opening_stock": number(100, u("o")), "stock_received": number(50, u("r")), "reorder_level": F.lit(20)}).withColumn("stock_used", F.floor(u("u") * (F.col("opening_stock") + F.col("stock_received"))).cast("int"))
    stock = stock.withColumn("closing_stock", F.col("opening_stock") + F.col("stock_received") - F.col("stock_used"))
    out["inventory"] = stock.select("*", code("V", 8, F.col("n")).alias("inventory_id"), *place(), day(u("d")).alias("record_date"), F.when(F.col("closing_stock") < F.col("reorder_level"), "Low").otherwise("Normal").alias("stock_status"))
    waste = rows(size.waste).withColumns({"quantity_wasted": F.round(u("q") * 9 + 1, 1), "unit_cost": money(u("c"), 50, 900)})
    out["wastage"] = waste.select("*", code("W", 8, F.col("n")).alias("wastage_id"), *place(), day(u("d")).alias("wastage_date"), F.round(F.col("quantity_wasted") * F.col("unit_cost"), 2).alias("wastage_cost"), pick(dom["wastage"]["reason"], u("r")).alias("reason"))
    return {name: as_table(name, df) for name, df in out.items()}


#: Defects: table, name, share of rows, and the columns that are spoilt.
DEFECTS: tuple[tuple[str, str, float, dict[str, str]], ...] = (
    ("customers", "missing_city", 0.02, {"city": "NULL"}),
    ("orders", "missing_channel", 0.01, {"ordering_channel": "NULL"}),
    ("orders", "negative_discount", 0.005, {"discount_amount": "'-5'"}),
    ("orders", "invalid_datetime", 0.005, {"order_datetime": "'not a date'"}),
    ("order_items", "nonpositive_quantity", 0.01, {"quantity": "'-1'"}),
    ("order_items", "wrong_total", 0.01, {"line_total": "'99999'"}),
    ("ratings", "rating_out_of_range", 0.02, {"rating": "'6'"}),
    ("wastage", "negative_quantity", 0.01, {"quantity_wasted": "'-2'"}),
)
#: Share of rows that are repeated exactly.
COPIES = 0.001


def draw(salt: str, seed: int, key: str) -> Column:
    """A pseudo-random number from 0 to 1 of a row's key; MD5, so that other engines draw alike."""
    text = F.concat(F.lit(f"{salt}:{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    return F.conv(F.substr(F.md5(text.cast("binary")), F.lit(1), F.lit(8)), 16, 10).cast("long") / float(1 << 32)


def inject(tables: dict[str, DataFrame], seed: int = 42) -> tuple[dict[str, DataFrame], DataFrame]:
    """All columns as text with defects and exact copies, and the manifest (table, issue, rows).

    Defects of columns that a table lacks are left out.
    """
    dirty, counts = {}, []
    for name, df in tables.items():
        key = TABLES[name].key
        rows = df.select(*(F.col(c).cast("string").alias(c) for c in df.columns))
        marks = {}
        for table, issue, part, sets in DEFECTS:
            if table == name and set(sets) <= set(df.columns):
                marks[issue] = draw(issue, seed, key) < part
                rows = rows.withColumn(f"_{issue}", marks[issue])
                for c, value in sets.items():
                    rows = rows.withColumn(c, F.when(F.col(f"_{issue}"), F.expr(value)).otherwise(F.col(c)))
        again = draw("copy", seed, key) < COPIES
        rows = rows.withColumn("_copy", again)
        issues = [*marks, "copy"]
        counted = rows.agg(*(F.coalesce(F.sum(F.col(f"_{i}").cast("long")), F.lit(0)).alias(i) for i in issues))
        counts.append(counted.select(F.explode(F.array(*(F.struct(F.lit(name).alias("table"), F.lit(i).alias("issue"), F.col(i).alias("rows")) for i in issues))).alias("x")).select("x.*"))
        out = rows.select(*df.columns, F.explode(F.when(F.col("_copy"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_k")).drop("_k")
        dirty[name] = out
    manifest = counts[0]
    for c in counts[1:]:
        manifest = manifest.unionByName(c)
    return dirty, manifest


def signs(name: str, columns: list[str]) -> dict[str, Column]:
    """What a spoilt row of a table looks like, by defect."""
    return {issue: F.col(c).eqNullSafe(F.expr(v)) for table, issue, _, sets in DEFECTS if table == name and set(sets) <= set(columns) for c, v in sets.items()}


def observed(dirty: dict[str, DataFrame]) -> DataFrame:
    """(table, issue, rows) of the declared defects and exact copies, from one scan of each table."""
    from ..operators.onepass import single_pass

    told = single_pass(dirty, {t: signs(t, df.columns) for t, df in dirty.items()})
    return told.where(F.col("issue").isin("copy", *(d[1] for d in DEFECTS)))


def reconcile(manifest: DataFrame, observed: DataFrame) -> DataFrame:
    """Declared against observed (table, issue, rows), with the difference; what one side lacks counts zero."""
    both = manifest.join(observed.withColumnRenamed("rows", "observed"), ["table", "issue"], "full")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return both.select("table", "issue", zero("rows").alias("rows"), zero("observed").alias("observed"), (zero("observed") - zero("rows")).alias("delta"))
