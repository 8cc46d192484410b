"""Strict validation: each rule of the contract on rows of our own."""

import json

import pytest
from pyspark.sql import functions as F

from saffron.operators import contracts, quality
from saffron.sources import readers
from saffron.sources.schemas import TABLE_ORDER, TABLES

ROWS = {
    "restaurants": {"restaurant_id": "harbour", "restaurant_name": "Harbour", "city": "Karachi", "opening_date": "2019-05-04", "seating_capacity": "64", "location_type": "Commercial", "is_active": "true"},
    "customers": {"customer_id": "amal", "gender": "Female", "age": "52", "city": "Multan", "signup_date": "2020-02-29", "customer_segment": "Loyal", "loyalty_points": "17", "is_churned": "true"},
    "menu_categories": {"category_id": "sweet", "category_name": "Desserts", "is_active": "true"},
    "menu_items": {"menu_item_id": "kheer", "category_id": "sweet", "item_name": "Kheer", "base_price": "320.5", "cost_price": "111.25", "preparation_time_min": "3", "launch_date": "2021-07-07"},
    "promotions": {"promotion_id": "eid", "promotion_type": "Bundle", "discount_type": "Fixed", "discount_value": "75", "start_date": "2022-04-20", "end_date": "2022-05-05", "minimum_order_value": "500", "channel": "Takeaway"},
    "orders": {"order_id": "o-77", "customer_id": "amal", "restaurant_id": "harbour", "promotion_id": "eid", "order_datetime": "2022-05-02 19:45:10", "ordering_channel": "Takeaway", "order_status": "Refunded", "subtotal": "961.5", "discount_amount": "75", "tax_amount": "44.33", "delivery_fee": "30", "final_amount": "960.83", "payment_method": "Mobile Wallet"},
    "order_items": {"order_item_id": "o-77/1", "order_id": "o-77", "menu_item_id": "kheer", "quantity": "3", "unit_price": "320.5", "item_discount": "0", "line_total": "961.5", "special_request": "cold"},
    "pricing_history": {"price_history_id": "kheer-2", "menu_item_id": "kheer", "restaurant_id": "harbour", "old_price": "300", "new_price": "320.5", "effective_from": "2022-01-01", "effective_to": "2022-12-31", "change_reason": "Supplier Cost"},
    "ratings": {"rating_id": "r-5", "order_id": "o-77", "customer_id": "amal", "restaurant_id": "harbour", "rating": "2", "food_rating": "1.5", "delivery_rating": "4.5", "review_text": "late", "rating_date": "2022-05-03"},
    "inventory": {"inventory_id": "s-9", "restaurant_id": "harbour", "menu_item_id": "kheer", "record_date": "2022-05-02", "opening_stock": "44", "stock_received": "0", "stock_used": "31", "closing_stock": "13", "reorder_level": "15", "stock_status": "Low"},
    "wastage": {"wastage_id": "w-3", "restaurant_id": "harbour", "menu_item_id": "kheer", "wastage_date": "2022-05-02", "quantity_wasted": "1.5", "unit_cost": "111.25", "wastage_cost": "166.88", "reason": "Expired"},
}


def row(table, **changes):
    cells = ROWS[table] | changes
    return tuple(cells.get(n) for n in TABLES[table].schema.names)


def parents_of(spark, table):
    """The tables that it refers to, with the one row of each."""
    return {p: spark.createDataFrame([(ROWS[p][TABLES[p].key],)], f"{TABLES[p].key} string") for p in TABLES[table].parents.values()}


def judge(spark, table, *rows, parents=None):
    return quality.validate(readers.source_rows(spark, table, rows), table, parents or parents_of(spark, table))


def reasons_by_key(v):
    return {r[0]: sorted(r["_quality_reasons"]) for r in v.quarantined.select(TABLES[v.table].key, "_quality_reasons").collect()}


def test_whole_set_of_tables_passes_parents_first(spark):
    done = quality.validate_all({t: readers.source_rows(spark, t, [row(t)]) for t in TABLE_ORDER}, lambda df, name: df)
    assert list(done) == list(TABLE_ORDER)
    assert {t: v.accepted.count() for t, v in done.items()} == dict.fromkeys(TABLE_ORDER, 1)
    assert done["wastage"].accepted.first()["wastage_cost"] == pytest.approx(166.88)


@pytest.mark.parametrize(("table", "changes", "rules"), [
    ("order_items", {"quantity": "0"}, ["positive:quantity"]),
    ("order_items", {"quantity": "three"}, ["invalid_type:quantity", "required:quantity"]),
    ("order_items", {"unit_price": "-Infinity"}, ["derived_nonfinite", "discount_exceeds_line_value", "nonfinite:unit_price", "positive:unit_price"]),
    ("order_items", {"item_discount": "961.51"}, ["discount_exceeds_line_value"]),
    ("order_items", {"order_id": "o-78", "menu_item_id": "halwa"}, ["foreign_key:menu_item_id", "foreign_key:order_id"]),
    ("orders", {"final_amount": "961"}, ["order_total_mismatch"]),
    ("orders", {"order_status": "Cancelled", "final_amount": "0.02"}, ["cancelled_settlement"]),
    ("orders", {"order_datetime": "2022-02-30 10:00:00"}, ["invalid_type:order_datetime", "required:order_datetime"]),
    ("orders", {"payment_method": "Barter", "tax_amount": "-1", "final_amount": "915.5"}, ["domain:payment_method", "nonnegative:tax_amount"]),
    ("promotions", {"discount_type": "Percentage", "discount_value": "100.5"}, ["percentage_over_100"]),
    ("promotions", {"start_date": "2022-05-06"}, ["date_order"]),
    ("pricing_history", {"new_price": "0", "effective_to": "2021-12-31"}, ["date_order", "positive:new_price"]),
    ("ratings", {"delivery_rating": "5.1"}, ["rating_range:delivery_rating"]),
    ("inventory", {"stock_used": "30"}, ["stock_balance"]),
    ("wastage", {"unit_cost": "1e300", "quantity_wasted": "1e9"}, ["derived_nonfinite"]),
    ("menu_items", {"category_id": "savoury", "launch_date": " "}, ["foreign_key:category_id", "required:launch_date"]),
    ("customers", {"age": "-4", "is_churned": "maybe"}, ["invalid_type:is_churned", "nonnegative:age"]),
    ("restaurants", {"location_type": "Pier"}, ["domain:location_type"]),
])
def test_one_bad_row(spark, table, changes, rules):
    v = judge(spark, table, row(table, **changes))
    assert list(reasons_by_key(v).values()) == [rules] and v.accepted.isEmpty()


def test_variants_copies_and_blank_keys(spark):
    """Three variants of one key, two copies of another row, and rows without any key."""
    rows = [row("inventory", inventory_id="twice", reorder_level=str(n)) for n in (5, 6, 7)] + [row("inventory", inventory_id="same")] * 3
    rows += [row("inventory", inventory_id=k, opening_stock=str(n), closing_stock=str(n - 31)) for k in (None, " ", "") for n in (40, 50)]
    v = judge(spark, "inventory", *rows)
    assert v.accounting() == {"before": 12, "accepted": 1, "quarantined": 9, "exact_duplicates": 2}
    found = {r["rule"]: r["rows"] for r in v.rule_counts().collect()}
    assert found == {"conflicting_primary_key": 3, "required:inventory_id": 6}
    assert [r["inventory_id"] for r in v.accepted.collect()] == ["same"]
    told = {(r["rule"], r["rows"], round(r["share"], 3)) for r in quality.issue_summary(v).where("rows > 0").collect()}
    assert told == {("conflicting_primary_key", 3, 0.25), ("required:inventory_id", 6, 0.5), ("exact_duplicate", 2, 0.167)}


def test_repairs_of_accepted_rows(spark):
    v = judge(spark, "wastage", row("wastage"), row("wastage", wastage_id="w-4", wastage_cost="5"), row("wastage", wastage_id="w-5", wastage_cost=None))
    assert {r["wastage_cost"] for r in v.accepted.collect()} == {166.88} and v.accepted.count() == 3
    assert [tuple(r) for r in v.repair_counts().collect()] == [("recompute:wastage_cost", 2)]
    filled = judge(spark, "customers", row("customers", city=None), row("customers", customer_id="bilal"))
    assert sorted(r["city"] for r in filled.accepted.collect()) == ["Multan", "Unknown"]


def test_a_rejected_parent_rejects_its_children(spark):
    sources = {"menu_categories": readers.source_rows(spark, "menu_categories", [row("menu_categories", category_name="Tapas")]), "menu_items": readers.source_rows(spark, "menu_items", [row("menu_items")])}
    done = quality.validate_all(sources, lambda df, name: df)
    assert reasons_by_key(done["menu_categories"]) == {"sweet": ["domain:category_name"]} and reasons_by_key(done["menu_items"]) == {"kheer": ["foreign_key:category_id"]}
    raw = json.loads(done["menu_items"].quarantined.first()["_raw_record"])
    assert raw["base_price"] == "320.5" and raw["is_available"] is None


def test_nothing_and_missing_parts(spark):
    assert sum(judge(spark, "ratings").accounting().values()) == 0
    with pytest.raises(ValueError, match="restaurants"):
        quality.validate(readers.source_rows(spark, "inventory", []), "inventory", {"menu_items": readers.rows_of(spark, "menu_items", [])})
    with pytest.raises(ValueError, match="reason"):
        quality.validate(spark.createDataFrame([("w",)], "wastage_id string"), "wastage", parents_of(spark, "wastage"))


def test_csv_with_broken_rows(spark, tmp_path):
    """A quoted line end is data; rows with cells too many or too few are malformed."""
    path = tmp_path / "promotions.csv"
    head = TABLES["promotions"].schema.names
    whole = lambda key, name: ",".join([key, name, *(x or "" for x in row("promotions")[2:])])
    path.write_text("\n".join([",".join(head), whole("p1", '"two\nlines, one name"'), whole("p2", "x") + ",more", "p3,short", whole("p4", "fine")]) + "\n")
    before = spark.conf.get("spark.sql.csv.parser.columnPruning.enabled")
    v = quality.validate(readers.source_csv(spark, str(path), "promotions").cache(), "promotions", {})
    assert {r["promotion_id"]: r["promotion_name"] for r in v.accepted.collect()} == {"p1": "two\nlines, one name", "p4": "fine"}
    assert v.rule_counts().where("rule = 'malformed_csv'").first()["rows"] == 2 and v.quarantined.where(F.col("_source_file").endswith("promotions.csv")).count() == 2
    assert spark.conf.get("spark.sql.csv.parser.columnPruning.enabled") == before
    other = tmp_path / "renamed.csv"
    other.write_text(",".join(["id", *head[1:]]) + "\n" + whole("p5", "fine") + "\n")
    with pytest.raises(Exception, match="(?i)header|column"):
        readers.source_csv(spark, str(other), "promotions").collect()


def test_catalog_names_every_rule(spark):
    rows = contracts.catalog(spark)
    assert rows.groupBy("table", "rule").count().where("count > 1").isEmpty()
    per = {r["table"]: r["n"] for r in rows.where("rule like 'foreign_key:%'").groupBy("table").agg(F.count("*").alias("n")).collect()}
    assert per == {t: len(x.parents) for t, x in TABLES.items() if x.parents}


@pytest.mark.parametrize("hot", [2, 100_000])
def test_frequent_keys_are_judged_alike(spark, monkeypatch, hot):
    """Copies, variants and blank keys, whether their buckets are dealt by value or by key."""
    monkeypatch.setattr(quality, "HOT", hot)
    rows = [row("inventory", inventory_id=f"k{i % 40}", reorder_level=str(i % 7 if i % 40 < 20 else 1)) for i in range(400)] + [row("inventory", inventory_id=" ", reorder_level=str(i % 3)) for i in range(30)]
    v = quality.validate(readers.source_rows(spark, "inventory", rows).repartition(5), "inventory", parents_of(spark, "inventory"))
    different = len(set(rows))
    assert v.accounting() == {"before": 430, "accepted": 20, "quarantined": different - 20, "exact_duplicates": 430 - different}
    assert {r["rule"]: r["rows"] for r in v.rule_counts().collect()} == {"conflicting_primary_key": different - 23, "required:inventory_id": 3}


def test_lines_are_shuffled_once_by_key_and_once_by_parent(spark):
    """Many repeated keys: no join by hashes, and only what was asked goes through the joins with parents."""
    from saffron.plans import queries as base
    from saffron.plans.tables import Domain

    plan = base.judged(Domain(spark, "/root/testdata/sf0.001")).rule_counts()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 2 and plan.count("RepartitionByExpression") == 1
    above = plan[: plan.index("Window")]
    assert "_text_unit_price" not in above.split("Join LeftOuter")[1]


def test_partitions_grow_with_rows(spark):
    from saffron.operators import ranges

    rows = spark.range(100).withColumnRenamed("id", "k")
    assert ranges.dealt(rows, 11 * ranges.PARTITION_ROWS, "k").rdd.getNumPartitions() == 11 and ranges.dealt(rows, 100, "k").rdd.getNumPartitions() <= 4


def test_reasons_and_facts_are_compiled(spark):
    """No lambda over an array on the way of each row."""
    from saffron.operators import onepass

    frame = spark.createDataFrame([("w", "r", "-2")], "wastage_id string, restaurant_id string, quantity_wasted string")
    facts = onepass._facts(frame, "wastage", ["wastage"], {}, {"null:restaurant_id": F.col("restaurant_id").isNull()})
    assert "lambda" not in facts._jdf.queryExecution().optimizedPlan().toString() and facts.count() == 1
    rules = [contracts.Rule("a", "", F.col("id") > 0), contracts.Rule("b", "", F.col("id") > 1), contracts.Rule("c", "", F.lit(None).cast("boolean"))]
    got = spark.range(3).select("id", contracts.reasons(rules).alias("r"))
    assert "lambda" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {r["id"]: r["r"] for r in got.collect()} == {0: [], 1: ["a"], 2: ["a", "b"]}
