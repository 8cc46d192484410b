"""Queries over scans, sinks, contracts, the generator, scenarios, comparison and saved models."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import half_up
from ..models import demand, forecast, risk
from ..operators import baskets, bitmaps, catalog, compare, contracts, customers, features, onepass, panels, quality, ranges, ranking, reports, rollups, verify, wastage, whatif
from ..sources import generator, readers, sinks
from ..sources.schemas import TABLES
from ..sources.shared import kept, shared_dir
from . import queries as base
from .queries import longs
from .tables import Domain

QUERIES: dict[str, base.Query] = {}


def query(f):
    QUERIES[f.__name__] = lambda spark, sf_dir: f(Domain(spark, sf_dir))
    return f


def folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors see."""
    return f"{shared_dir(spark)}/{name}-{uuid4().hex[:12]}"


# ------------------------------------------------------------------- scans


def lines_csv(d: Domain, rows: DataFrame, **options) -> str:
    path = folder(d.spark, "lines-csv")
    rows.write.options(header=True, **options).csv(path)
    return path


@query
def csv_typed_scan(d: Domain) -> DataFrame:
    """A CSV under its explicit schema: every seventh quantity doesn't parse."""
    broken = F.when(F.col("order_item_id").cast("long") % 7 == 0, "x").otherwise(F.col("quantity"))
    rows = readers.typed_csv(d.spark, lines_csv(d, base.line_source(d).withColumn("quantity", broken)), "order_items")
    return longs(rows.select("order_item_id", "quantity", F.col("unit_price").isNotNull().alias("has_price")), "quantity")


@query
def csv_strict_path(d: Domain) -> DataFrame:
    """From a source-preserving scan to reasons: every eleventh row has a column too many."""
    more = F.when(F.col("order_item_id").cast("long") % 11 == 0, "a,b").otherwise(F.col("special_request"))
    source = readers.source_csv(d.spark, lines_csv(d, base.line_source(d).withColumn("special_request", more), quote=""), "order_items")
    return quality.validate(source, "order_items", base.line_parents(d)).rule_counts()


@query
def csv_inferred_scan(d: Domain) -> DataFrame:
    return readers.inferred_csv(d.spark, lines_csv(d, base.line_source(d)), "order_items")[1]


@query
def view_report(d: Domain) -> DataFrame:
    """A report in SQL over registered views."""
    readers.register({"saffron_done": reports.completed(d.orders), "saffron_places": d.restaurants})
    return d.spark.sql("SELECT city, count(*) AS orders, max(subtotal) AS largest FROM saffron_done JOIN saffron_places USING (restaurant_id) GROUP BY city")


@query
def memory_rows(d: Domain) -> DataFrame:
    """Category rows in memory, joined with the items of each."""
    known = readers.rows_of(d.spark, "menu_categories", [("ECONOMY", "Pizza", "thin", True), ("SMALL", "Rice", None, False), ("NONE", "Pasta", "", True)])
    counts = d.menu.groupBy("category_id").agg(F.count(F.lit(1)).alias("items"))
    return known.join(counts, "category_id", "left")


@query
def evidence_lines(d: Domain) -> DataFrame:
    """Facts about a run, written as JSON and scanned as text."""
    path = folder(d.spark, "evidence")
    sinks.write_evidence(d.spark, path, {"job": "profile", "rows": str(d.orders.count())})
    return readers.evidence(d.spark, path)


# --------------------------------------------------------------- generator

def size_of(d: Domain) -> generator.Size:
    """As many generated rows as the given tables have."""
    n = {t: d.raw(t).count() for t in ("customer", "nation", "part", "supplier", "orders", "events")}
    return generator.Size(customers=n["customer"], restaurants=n["nation"], items=n["part"], promotions=n["supplier"], orders=n["orders"], ratings=n["events"], stock=n["part"], waste=n["part"], prices=n["part"])


@query
def generated_tables(d: Domain) -> DataFrame:
    """(table, rows) of generated tables that are as large as the given ones."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(t).alias("table"), "rows") for t, df in generator.generate(d.spark, size_of(d)).items() if t != "order_items"]
    return base.union(parts)


@query
def generator_assertions(d: Domain) -> DataFrame:
    """(check, rows, failed) of tables as large as the given ones: repeated keys, orphans, and orders that differ from their lines."""
    tables = {t: kept(df, f"generated-{t}") for t, df in generator.generate(d.spark, size_of(d)).items()}
    lines, orders = tables["order_items"], tables["orders"]
    told = onepass.single_pass(tables, {t: {} for t in tables})
    sums = lines.groupBy("order_id").agg(F.sum("line_total").alias("_lines"))
    off = orders.join(sums, "order_id", "left").where("abs(subtotal - coalesce(_lines, 0)) > 0.011").agg(F.count(F.lit(1)).alias("failed"))
    wanted = [(t, "repeated_key") for t in tables] + [(t, f"orphan:{c}") for t, x in TABLES.items() for c in x.parents]
    found = d.spark.createDataFrame(wanted, "table string, issue string").join(told.withColumnRenamed("rows", "failed"), ["table", "issue"], "left")
    checks = found.where("table <> 'order_items'").join(told.where("issue = 'rows'").select("table", "rows"), "table").select(F.concat_ws(" ", "table", "issue").alias("check"), "rows", F.coalesce("failed", F.lit(0).cast("long")).alias("failed"))
    return checks.unionByName(orders.agg(F.count(F.lit(1)).alias("rows")).crossJoin(off).select(F.lit("orders equal their lines").alias("check"), "rows", "failed"))


def spoilt(d: Domain) -> tuple[dict[str, DataFrame], DataFrame]:
    """Four given tables as text, with defects injected, and the manifest."""
    return generator.inject({"orders": d.orders, "order_items": d.items.select(*(c for c in d.items.columns)), "ratings": d.ratings, "wastage": d.wastage})


@query
def defect_reconciliation(d: Domain) -> DataFrame:
    """Defects injected into given tables against those that one scan of each spoilt table finds."""
    dirty, manifest = spoilt(d)
    return generator.reconcile(manifest, generator.observed(dirty))


@query
def single_pass_counts(d: Domain) -> DataFrame:
    """(table, issue, rows) of the spoilt tables from one scan of each: nulls, repeated keys, copies, orphans, ranges."""
    dirty = {t: kept(df, f"spoilt-{t}") for t, df in spoilt(d)[0].items()}
    ranges = {
        "orders": {"negative_discount": F.col("discount_amount").try_cast("double") < 0, "invalid_order_datetime": F.col("order_datetime").isNotNull() & F.col("order_datetime").try_cast("timestamp").isNull()},
        "order_items": {"nonpositive_quantity": F.col("quantity").try_cast("int") <= 0}, "ratings": {"invalid_rating": ~F.col("rating").try_cast("int").between(1, 5)}, "wastage": {"negative_quantity": F.col("quantity_wasted").try_cast("double") < 0},
    }
    return onepass.single_pass(dirty, {t: {f"null:{c}": F.col(c).isNull() for c in df.columns} | ranges[t] for t, df in dirty.items()})


# ------------------------------------------------------------------- sinks


@query
def written_version(d: Domain) -> DataFrame:
    return sinks.write_once(reports.channel_performance(d.orders), folder(d.spark, "marts"), "v1", "channel_performance", ["ordering_channel"])


@query
def overwritten_partitions(d: Domain) -> DataFrame:
    """All orders by status, then one status again with other amounts."""
    path, rows = folder(d.spark, "by-status"), d.orders.select("order_id", "subtotal", "order_status")
    sinks.overwrite(rows, path, ["order_status"])
    sinks.overwrite(rows.where("order_status = 'Completed'").withColumn("subtotal", F.col("subtotal") * 2), path, ["order_status"])
    return d.spark.read.parquet(path)


@query
def exported_csv(d: Domain) -> DataFrame:
    path, mart = folder(d.spark, "csv"), reports.channel_performance(d.orders)
    sinks.export_csv(mart, path, ["ordering_channel"], single_file=True)
    return d.spark.read.schema(mart.schema).option("header", True).csv(path)


@query
def exported_file(d: Domain) -> DataFrame:
    """A small mart as one file, with the number of files of its manifest."""
    path = folder(d.spark, "file")
    manifest = sinks.export_parquet(reports.channel_performance(d.orders), path)
    return d.spark.read.parquet(path).crossJoin(manifest.where("length(sha256) = 64 and bytes > 0").agg(F.count(F.lit(1)).alias("files")))


@query
def bundle_faults(d: Domain) -> DataFrame:
    """(fault, files) of a bundle whose manifest was tampered with."""
    path = folder(d.spark, "bundle")
    for name in ("one", "two"):
        sinks.export_parquet(reports.channel_performance(d.orders), f"{path}/{name}")
    whole = sinks.checksums(d.spark, path)
    other = d.spark.createDataFrame([("three/lost.parquet", 1, "0"), ("../outside.parquet", 1, "0")], "path string, bytes long, sha256 string")
    told = whole.where("path like 'one/%'").withColumn("sha256", F.reverse("sha256")).unionByName(other)
    return sinks.verify_bundle(d.spark, path, told).groupBy("fault").agg(F.count(F.lit(1)).alias("files"))


@query
def mart_preview(d: Domain) -> DataFrame:
    mart = reports.channel_performance(d.orders).select("ordering_channel", "orders").orderBy("ordering_channel")
    return d.spark.createDataFrame([(x,) for x in sinks.preview(mart, 3)], "value string")


@query
def reloaded_model(d: Domain) -> DataFrame:
    """(split, rows, scored) of a demand model that was saved and loaded again."""
    rows = demand.features(base.hourly_facts_panel(d), "event_type", "hour", "orders")
    parts = dict(zip(("train", "validation", "test"), panels.split_by_time(rows, "hour", "2024-01-20", "2024-01-25"), strict=True))
    fitted = demand.pipeline("event_type", demand.feature_names("orders"), demand.estimators("orders")["linear"]).fit(parts["train"])
    model = sinks.save_model(fitted, folder(d.spark, "model"), parts["test"])
    counted = [model.transform(df).agg(F.count(F.lit(1)).alias("rows"), F.count("prediction").alias("scored")).select(F.lit(n).alias("split"), "rows", "scored") for n, df in parts.items()]
    return base.union(counted)


# ------------------------------------------------------------------- marts


@query
def wastage_ranking_described(d: Domain) -> DataFrame:
    """A mart with the columns that tell its reader what it means."""
    as_of = features.as_of_day(d.orders)
    return sinks.with_provenance(wastage.ranking(d.wastage), "ranking by historical cost", "descriptive, no forecast", as_of)


#: What readers of a mart must know: how it was made and how far it goes.
DESCRIBED = {
    "wastage_ranking": ("ranking by historical cost", "descriptive, no forecast"), "customer_rfm_full": ("quintiles of recency, frequency and amount", "relative to all purchasers"),
    "price_sensitivity": ("sales before and after each change", "an association, no cause"), "rating_anomalies": ("daily means by deviation from the median", "unusual days, not explained"),
    "menu_profitability": ("net revenue less estimated cost", "classes relative to the catalogue"),
}


@query
def described_marts(d: Domain) -> DataFrame:
    """(mart, method, interpretation, analysis_as_of, rows): marts with the columns that tell their reader what they mean."""
    as_of, parts = features.as_of_day(d.orders), []
    for name, (method, meaning) in DESCRIBED.items():
        told = sinks.with_provenance(base.QUERIES[name](d.spark, d.dir), method, meaning, as_of)
        parts.append(told.groupBy(F.lit(name).alias("mart"), "method", "interpretation", "analysis_as_of").agg(F.count(F.lit(1)).alias("rows")))
    return base.union(parts)


@query
def catalog_mart(d: Domain) -> DataFrame:
    return features.catalog(d.menu, d.categories)


@query
def customers_mart(d: Domain) -> DataFrame:
    return sinks.refuse_personal_columns(d.customers)


@query
def promotions_mart(d: Domain) -> DataFrame:
    return d.promotions


@query
def price_events_mart(d: Domain) -> DataFrame:
    return d.prices


@query
def inventory_snapshots_mart(d: Domain) -> DataFrame:
    return longs(d.inventory, "opening_stock", "stock_received", "stock_used", "closing_stock")


# ----------------------------------------------------------------- quality


@query
def ingestion_counts(d: Domain) -> DataFrame:
    typed = d.items.withColumn("special_request", F.lit(None))
    rows = typed.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES["order_items"].schema))
    return quality.ingestion_profile(rows, "order_items", d.items.count())


@query
def rule_catalog(d: Domain) -> DataFrame:
    """(table, action, rules, fired) of the contract: how many rules it has, and how many fired on sources made from given tables."""
    fired = rules_fired(d).groupBy("table").agg(F.countDistinct("rule").alias("fired"))
    own = contracts.catalog(d.spark).groupBy("table", "action").agg(F.count(F.lit(1)).alias("rules"))
    return own.join(fired, "table", "left").select("table", "action", "rules", F.when(F.col("action") == "quarantine", F.col("fired")).alias("fired"))


#: Of each table: the given table and key that it is made from, cells of a valid row, and by
#: the remainder of the key by ten the rule that a row breaks and the cells that break it.
BROKEN: dict[str, tuple[str, str, dict[str, str], dict[int, tuple[str, dict[str, str]]]]] = {
    "customers": ("customer", "c_custkey", {"customer_name": "N", "gender": "Other", "age": "30", "city": "Multan", "signup_date": "2024-02-01", "customer_segment": "Loyal", "preferred_channel": "Takeaway", "loyalty_points": "7", "is_churned": "true", "last_order_date": "2024-03-01"},
                  {1: ("invalid_type:is_churned", {"is_churned": "soon"}), 2: ("domain:gender", {"gender": "?"}), 3: ("nonnegative:age", {"age": "-3"}), 4: ("date_order", {"last_order_date": "2024-01-01"}), 5: ("required:signup_date", {"signup_date": ""})}),
    "restaurants": ("nation", "n_nationkey", {"restaurant_name": "N", "city": "Multan", "area": "A", "opening_date": "2023-05-01", "seating_capacity": "12", "location_type": "Mall", "is_active": "true"},
                    {1: ("domain:location_type", {"location_type": "Pier"}), 2: ("nonnegative:seating_capacity", {"seating_capacity": "-1"}), 3: ("invalid_type:seating_capacity", {"seating_capacity": "few"})}),
    "menu_categories": ("region", "r_regionkey", {"category_name": "Rice", "description": "", "is_active": "true"}, {1: ("domain:category_name", {"category_name": "Stew"})}),
    "menu_items": ("part", "p_partkey", {"category_id": "2", "item_name": "N", "base_price": "20", "cost_price": "8", "preparation_time_min": "9", "is_vegetarian": "true", "is_available": "true", "launch_date": "2024-04-01"},
                   {1: ("positive:base_price", {"base_price": "0"}), 2: ("nonfinite:cost_price", {"cost_price": "Infinity"}), 3: ("foreign_key:category_id", {"category_id": "1"})}),
    "promotions": ("supplier", "s_suppkey", {"promotion_name": "N", "promotion_type": "Bundle", "discount_type": "Percentage", "discount_value": "15", "start_date": "2024-05-01", "end_date": "2024-05-09", "minimum_order_value": "0", "channel": "All", "is_active": "true"},
                   {1: ("percentage_over_100", {"discount_value": "130"}), 2: ("date_order", {"end_date": "2024-04-01"}), 3: ("nonnegative:minimum_order_value", {"minimum_order_value": "-2"})}),
    "orders": ("orders", "o_orderkey", {"customer_id": "10", "restaurant_id": "5", "promotion_id": "", "order_datetime": "2024-06-01 13:00:00", "ordering_channel": "Website", "order_status": "Completed", "subtotal": "80", "discount_amount": "8", "tax_amount": "4", "delivery_fee": "0", "final_amount": "76", "payment_method": "Card"},
               {1: ("discount_exceeds_subtotal", {"discount_amount": "90", "tax_amount": "86"}), 2: ("order_total_mismatch", {"final_amount": "70"}), 3: ("cancelled_settlement", {"order_status": "Cancelled"}), 4: ("foreign_key:customer_id", {"customer_id": "11"})}),
    "order_items": ("orders", "o_orderkey", {"order_id": "20", "menu_item_id": "30", "quantity": "3", "unit_price": "5", "item_discount": "1", "line_total": "14", "special_request": ""},
                    {1: ("positive:quantity", {"quantity": "0", "item_discount": "0"}), 2: ("discount_exceeds_line_value", {"item_discount": "16"}), 3: ("derived_nonfinite", {"unit_price": "1.7e308"}), 4: ("foreign_key:order_id", {"order_id": "21"})}),
    "pricing_history": ("part", "p_partkey", {"menu_item_id": "30", "restaurant_id": "5", "old_price": "10", "new_price": "11", "effective_from": "2024-07-01", "effective_to": "", "change_reason": "Inflation"},
                        {1: ("date_order", {"effective_to": "2024-06-01"}), 2: ("domain:change_reason", {"change_reason": "Mood"})}),
    "ratings": ("events", "event_id", {"order_id": "20", "customer_id": "10", "restaurant_id": "5", "rating": "4", "food_rating": "4.5", "service_rating": "", "delivery_rating": "", "review_text": "", "rating_date": "2024-06-03"},
                {1: ("rating_range:rating", {"rating": "9"}), 2: ("required:rating_date", {"rating_date": ""}), 3: ("foreign_key:restaurant_id", {"restaurant_id": "1"})}),
    "inventory": ("part", "p_partkey", {"restaurant_id": "5", "menu_item_id": "30", "record_date": "2024-08-01", "opening_stock": "9", "stock_received": "4", "stock_used": "6", "closing_stock": "7", "reorder_level": "3", "stock_status": "Normal"},
                  {1: ("stock_balance", {"closing_stock": "8"}), 2: ("domain:stock_status", {"stock_status": "Gone"})}),
    "wastage": ("part", "p_partkey", {"restaurant_id": "5", "menu_item_id": "30", "wastage_date": "2024-08-02", "quantity_wasted": "2", "unit_cost": "6", "wastage_cost": "12", "reason": "Unsold"},
                {1: ("nonnegative:quantity_wasted", {"quantity_wasted": "-1"}), 2: ("foreign_key:menu_item_id", {"menu_item_id": "31"})}),
}


def broken_sources(d: Domain) -> dict[str, DataFrame]:
    """All eleven tables as text, a row for each key of a given table, some of which break one rule."""
    out = {}
    for table, (given, key, cells, faults) in BROKEN.items():
        n = F.col(key).cast("long")
        columns = [n.cast("string").alias(TABLES[table].key)]
        for c, valid in cells.items():
            value = F.lit(valid)
            for left, (_, sets) in faults.items():
                if c in sets:
                    value = F.when(n % 10 == left, sets[c]).otherwise(value)
            columns.append(value.alias(c))
        out[table] = d.raw(given).select(*columns)
    return out


@query
def rules_fired(d: Domain) -> DataFrame:
    """(table, rule, rows): rules of all eleven tables on sources made from given tables, parents first."""
    done = quality.validate_all(broken_sources(d), lambda df, t: kept(df, f"accepted-{t}"))
    return base.union([v.rule_counts().select(F.lit(t).alias("table"), "rule", "rows") for t, v in done.items()])


@query
def issue_summary(d: Domain) -> DataFrame:
    """What each rule did to the lines; rules without rows are left out."""
    return quality.issue_summary(base.judged(d)).where("rows > 0").select("table", "rule", "action", "rows", "share")


@query
def repair_invalid_dates(d: Domain) -> DataFrame:
    at = F.when(F.col("order_id") % 5 == 0, "no date").otherwise(F.date_format("order_datetime", "yyyy-MM-dd HH:mm:ss"))
    return quality.repaired(d.orders.withColumn("order_datetime", at), "orders")[1].where("rule = 'null_invalid_date'")


@query
def retained_missing(d: Domain) -> DataFrame:
    """Audit of values that a repair counts and leaves missing."""
    menu = d.menu.withColumn("base_price", F.when(F.col("menu_item_id") % 9 != 0, F.col("base_price")))
    rated = d.ratings.withColumn("food_rating", F.when(F.col("rating_id") % 4 != 0, F.col("food_rating")))
    return quality.repaired(menu, "menu_items")[1].unionByName(quality.repaired(rated, "ratings")[1])


def cascade_sources(d: Domain) -> dict[str, DataFrame]:
    """Four tables as text. One restaurant and one category break a rule; some items stand twice."""
    c, text = F.col, lambda df, *cells: df.select(*(F.lit(x).alias(n) if isinstance(x, str) else x.cast("string").alias(n) for n, x in cells))
    city = F.element_at(F.array(*map(F.lit, TABLES["restaurants"].domains["city"])), (c("restaurant_id") % 6 + 1).cast("int"))
    places = text(
        d.restaurants, ("restaurant_id", c("restaurant_id")), ("restaurant_name", c("restaurant_name")), ("city", F.when(c("restaurant_id") == 3, "Nowhere").otherwise(city)), ("area", "A"),
        ("opening_date", "2024-01-01"), ("seating_capacity", "20"), ("location_type", "Mall"), ("is_active", "true"),
    )
    name = F.when(c("category_id") == "STANDARD", "Tacos").when(c("category_id") == "SMALL", "Pizza").otherwise("Rice")
    kinds = text(d.categories, ("category_id", c("category_id")), ("category_name", name), ("description", ""), ("is_active", "true"))
    items = text(
        d.menu, ("menu_item_id", c("menu_item_id")), ("category_id", c("category_id")), ("item_name", c("item_name")), ("base_price", "10"), ("cost_price", "5"), ("preparation_time_min", "5"),
        ("is_vegetarian", "true"), ("is_available", "true"), ("launch_date", "2024-01-01"),
    )
    items = items.unionByName(items.where(c("menu_item_id").cast("long") % 10 == 0))
    stock = text(
        d.inventory, ("inventory_id", c("inventory_id")), ("restaurant_id", c("restaurant_id")), ("menu_item_id", c("menu_item_id")), ("record_date", "2024-01-01"), ("opening_stock", "10"),
        ("stock_received", "5"), ("stock_used", "3"), ("closing_stock", "12"), ("reorder_level", "2"), ("stock_status", "Normal"),
    )
    return {"restaurants": places, "menu_categories": kinds, "menu_items": items, "inventory": stock}


@query
def cascade_accounting(d: Domain) -> DataFrame:
    """Rows read, accepted, set aside and collapsed of tables that refer to each other, parents first."""
    root = folder(d.spark, "accepted")
    done = quality.validate_all(cascade_sources(d), lambda df, t: sinks.write_once(df, root, "v1", t, [TABLES[t].key]))
    rows = [(t, *v.accounting().values()) for t, v in done.items()]
    return d.spark.createDataFrame(rows, "table string, before long, accepted long, quarantined long, exact_duplicates long")


@query
def mart_invariants(d: Domain) -> DataFrame:
    return verify.mart_checks(d.menu, base.menu_profitability(d), base.menu_by_location(d), base.basket_rules(d), 20, wastage.ranking(d.wastage))


GIVEN = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@query
def refused_columns(d: Domain) -> DataFrame:
    """(table, column, refused): columns of the given tables that a mart must not carry."""
    found = {t: (d.raw(t).columns, sinks.personal_columns(d.raw(t))) for t in GIVEN}
    return d.spark.createDataFrame([(t, c, c in bad) for t, (columns, bad) in found.items() for c in columns], "table string, column string, refused boolean")


# ------------------------------------------------- grains and order statistics


@query
def sales_rollup(d: Domain) -> DataFrame:
    """Seven grains of net sales from one scan, each group with its share of the grain above."""
    lines = base.sold(d).select("category_id", "menu_item_id", "restaurant_id", "month", "quantity", "net_revenue")
    return rollups.sales_rollup(lines)


@query
def distinct_by_grain(d: Domain) -> DataFrame:
    """Buyers, orders and visit days by item, place, month and place and month, all from one table of bitmaps."""
    lines = base.sold(d).select("menu_item_id", "restaurant_id", "month", "customer_id", "order_id", "day")
    people, orders = bitmaps.dense_numbers(d.orders, "customer_id", "_person"), bitmaps.dense_numbers(d.orders, "order_id", "_order")
    rows = lines.join(people, "customer_id", "left").join(orders, "order_id", "left")
    names = {"buyers": F.col("_person"), "orders": F.col("_order"), "visit_days": F.unix_date("day")}
    table = kept(bitmaps.bitmaps(rows, ["menu_item_id", "restaurant_id", "month"], names), "bitmaps")
    grains = {"item": ["menu_item_id"], "place": ["restaurant_id"], "month": ["month"], "place and month": ["restaurant_id", "month"]}
    column = lambda c, by, kind: (F.col(c) if c in by else F.lit(None).cast(kind)).alias(c)
    parts = [bitmaps.distinct_counts(table, by, list(names)).select(F.lit(g).alias("grain"), column("menu_item_id", by, "long"), column("restaurant_id", by, "long"), column("month", by, "string"), *names) for g, by in grains.items()]
    return base.union(parts)


@query
def line_medians(d: Domain) -> DataFrame:
    """Exact median and median absolute deviation of line totals: of all lines as one group, and by status."""
    lines = kept(d.raw("lineitem").select("l_linestatus", F.col("l_extendedprice").alias("total")), "line-totals")
    parts = []
    for name, rows in (("all", lines.withColumn("of", F.lit("all"))), ("status", lines.withColumnRenamed("l_linestatus", "of"))):
        mid = kept(ranges.quantiles(rows, ["of"], "total", 0.5, "median"), "line-median")
        off = rows.join(ranges.small(mid), "of").withColumn("_off", F.abs(F.col("total") - F.col("median")))
        parts.append(mid.join(ranges.quantiles(off, ["of"], "_off", 0.5, "mad"), "of").select(F.lit(name).alias("grain"), "of", "median", F.round("mad", 6).alias("mad")))
    return base.union(parts)


@query
def spread_sample(d: Domain) -> DataFrame:
    """Nine lines evenly spaced over all lines, by price, order and number; one group holds all rows."""
    rows = d.raw("lineitem").select("l_extendedprice", "l_orderkey", "l_partkey", "l_linenumber", F.lit("all").alias("of"))
    return longs(ranges.every_nth(rows, ["l_extendedprice", "l_orderkey", "l_partkey", "l_linenumber"], 9, ["of"]).drop("of"), "l_linenumber")


@query
def segmentation_check(d: Domain) -> DataFrame:
    """(score, customers, differing): scores by sorted ranges against scores by counts of values."""
    scored = kept(customers.rfm(d.orders), "scored")
    out = []
    for score, (value, down) in {"r_score": ("recency_days", True), "f_score": ("frequency", False), "m_score": ("monetary_value", False)}.items():
        again = ranges.counted_tiles(scored.select("customer_id", value, score), 5, value, "customer_id", "_again", descending=down)
        out.append(again.agg(F.count(F.lit(1)).alias("customers"), F.count_if(F.col(score) != F.col("_again")).alias("differing")).select(F.lit(score).alias("score"), "customers", "differing"))
    return base.union(out)


# ----------------------------------------------------------- sort and limit


@query
def sorted_rules(d: Domain) -> DataFrame:
    """The ten first rules by lift, confidence and count, as served."""
    found = baskets.directional(baskets.rules(base.brand_members(d), least=20, min_confidence=0.05), 0.05, 1.0)
    return baskets.rule_text(found).limit(10).select("antecedent", "consequent", "pair_count")


@query
def served_nulls_first(d: Domain) -> DataFrame:
    served = catalog.ReportCatalog({"menu": base.menu_profitability(d).select("menu_item_id", "item_name", "units_sold")})
    return served.view("menu", sort="units_sold", descending=True, limit=25)


@query
def head_sample(d: Domain) -> DataFrame:
    return ranking.top_n(base.hourly_facts_panel(d), [F.asc("hour"), F.asc("event_type")], 50)


# -------------------------------------------------------------- comparison


def altered_channels(d: Domain) -> DataFrame:
    """A report of another engine: one count differs, one channel is missing."""
    rows = reports.channel_performance(d.orders).where("ordering_channel <> '5-LOW'")
    return rows.withColumn("orders", F.col("orders") + F.when(F.col("ordering_channel") == "1-URGENT", 1).otherwise(0))


def compared_channels(d: Domain) -> DataFrame:
    return compare.compare_report("channel_performance", reports.channel_performance(d.orders), altered_channels(d))


@query
def report_comparison(d: Domain) -> DataFrame:
    return compared_channels(d).select("ordering_channel", "metric", "status", "passed")


@query
def comparison_summary(d: Domain) -> DataFrame:
    return compare.delta_summary(compared_channels(d)).select("metric", "compared", "exact", "near", "failed")


@query
def rounded_money(d: Domain) -> DataFrame:
    return d.items.select("order_item_id", half_up(F.col("quantity") / 8.0).cast("double").alias("rounded"))


# --------------------------------------------------------------- scenarios


def item_worth(d: Domain) -> DataFrame:
    return base.net_item_revenue(d).select("menu_item_id", F.col("units_sold").alias("demand"), "revenue", F.col("contribution_margin").alias("contribution"))


@query
def whatif_promotion(d: Domain) -> DataFrame:
    return whatif.promotion(item_worth(d), 0.2, 0.1).select("menu_item_id", "scenario_revenue", "scenario_contribution")


@query
def whatif_demand(d: Domain) -> DataFrame:
    rows = item_worth(d).withColumn("contribution_per_unit", F.col("contribution") / F.col("demand"))
    return whatif.demand(rows, 0.25).select("menu_item_id", "scenario_units", "scenario_contribution")


@query
def whatif_inventory(d: Domain) -> DataFrame:
    rows = d.inventory.select("inventory_id", F.col("stock_used").alias("demand"), F.col("closing_stock").alias("on_hand"))
    return whatif.inventory(rows, 0.25).select("inventory_id", "target_stock", "surplus", "shortfall")


@query
def whatif_preparation(d: Domain) -> DataFrame:
    rows = d.inventory.select("inventory_id", F.col("opening_stock").alias("prepared"), F.col("stock_used").alias("demand"))
    return whatif.preparation(rows, 0.25, 0.5).drop("prepared", "demand")


@query
def whatif_removal(d: Domain) -> DataFrame:
    return whatif.remove_item(item_worth(d)).select("menu_item_id", "revenue_lost", "contribution_lost", "scenario_revenue")


# ------------------------------------------------------------------ models


@query
def daily_lag_features(d: Domain) -> DataFrame:
    return forecast.training(forecast.daily_panel(base.channel_days(d)))


@query
def risk_labels(d: Domain) -> DataFrame:
    """Costly next weeks by a threshold of the training weeks."""
    rows = risk.features(base.weekly_panel(d).withColumn("demand", F.lit(0)), ["restaurant_id", "category_id"], "week", "waste", "demand")
    return longs(risk.labelled(rows, "2000-01-01").select("restaurant_id", "category_id", "week", "next_waste", "label"), "label")


@query
def served_forecast(d: Domain) -> DataFrame:
    made = forecast.rollout(forecast.daily_panel(base.channel_days(d)), forecast.naive, 28).withColumn("level", F.lit("channel"))
    return longs(forecast.select(made, "channel", "2-HIGH", 14).select("entity", "day", "horizon_day", "baseline"), "horizon_day")
