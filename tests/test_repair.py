"""Repair, profiles and orphans on awkward rows."""

from datetime import date, datetime

from saffron.operators import quality
from saffron.sources import readers


def audit(df):
    return {r["rule"]: r["affected"] for r in df.collect()}


def test_lines(spark):
    rows = readers.rows_of(spark, "order_items", [
        ("I1", "O1", "M1", -1, 10.0, 0.0, 10.0, None), ("I2", "O1", "M1", 1, -5.0, 0.0, -5.0, None), ("I3", "O1", "M1", 2, 5.0, 1.0, 99.0, None),
        ("I4", "O1", "M1", 1, 5.0, None, 5.0, None), ("I5", "O1", "M1", 1, 5.0, 0.0, 5.0, None), ("I5", "O1", "M1", 1, 5.0, 0.0, 5.0, None),
    ])
    fixed, log = quality.repaired(rows, "order_items")
    got = {r["order_item_id"]: r for r in fixed.collect()}
    assert len(got) == 5
    assert got["I1"]["quantity"] is None and got["I1"]["line_total"] is None
    assert got["I2"]["unit_price"] is None
    assert got["I3"]["line_total"] == 9.0
    assert got["I4"]["line_total"] is None
    assert audit(log) == {"deduplicate_primary_key": 1, "null_invalid_quantity": 1, "null_invalid_unit_price": 1, "null_unverifiable_line_total": 3, "recompute_line_total": 1}


def order(key, **changes):
    base = {"customer_id": "C1", "restaurant_id": "R1", "promotion_id": None, "order_datetime": datetime(2026, 9, 1), "ordering_channel": "Website", "order_status": "Completed", "subtotal": 100.0, "discount_amount": 0.0, "tax_amount": 0.0, "delivery_fee": 0.0, "final_amount": 100.0, "payment_method": "Cash"}
    return (key, *(base | changes).values())


def test_orders(spark):
    rows = readers.rows_of(spark, "orders", [order("O1", ordering_channel=None), order("O2", discount_amount=-5.0), order("O3", ordering_channel="Carrier Pigeon"), order("O4", discount_amount=500.0), order("O5", order_datetime=None)])
    fixed, log = quality.repaired(rows, "orders")
    got = {r["order_id"]: r for r in fixed.collect()}
    assert got["O1"]["ordering_channel"] == "Unknown" and got["O3"]["ordering_channel"] == "Carrier Pigeon"
    assert got["O2"]["discount_amount"] is None and got["O4"]["discount_amount"] is None
    assert audit(log) == {"fill_missing_channel": 1, "null_negative_discount": 1, "null_excessive_discount": 1}
    counts = quality.profile_table(rows, "orders").first()
    assert counts["unexpected_ordering_channel"] == 1 and counts["invalid_order_datetime"] == 1 and counts["rows"] == 5


def test_ratings_waste_and_city(spark):
    rated = [(f"T{n}", "O1", "C1", "R1", n, 5.0, 4.0, None, None, date(2026, 9, 1)) for n in (0, 1, 5, 6)]
    got = {r["rating_id"]: r["rating"] for r in quality.repaired(readers.rows_of(spark, "ratings", rated), "ratings")[0].collect()}
    assert got == {"T0": None, "T1": 1, "T5": 5, "T6": None}
    wasted = [("W1", "R1", "M1", date(2026, 9, 1), -1.0, 1.0, 1.0, "Expired"), ("W2", "R1", "M1", date(2026, 9, 1), 100000.0, 1.0, 1.0, "Expired")]
    got = {r["wastage_id"]: r["quantity_wasted"] for r in quality.repaired(readers.rows_of(spark, "wastage", wasted), "wastage")[0].collect()}
    assert got == {"W1": None, "W2": 100000.0}
    person = [("C1", "n", "Other", 30, None, None, "New", "Website", 0, False, None)]
    assert quality.repaired(readers.rows_of(spark, "customers", person), "customers")[0].first()["city"] == "Unknown"


def test_orphans(spark):
    tables = {
        "customers": readers.rows_of(spark, "customers", [("C1", *[None] * 10)]), "restaurants": readers.rows_of(spark, "restaurants", [("R1", *[None] * 7)]),
        "promotions": readers.rows_of(spark, "promotions", [("P1", *[None] * 9)]), "menu_items": readers.rows_of(spark, "menu_items", [("M1", *[None] * 8)]),
        "orders": readers.rows_of(spark, "orders", [order("O1"), order("O2", customer_id="C9", restaurant_id="R9", promotion_id="P9")]),
        "order_items": readers.rows_of(spark, "order_items", [("I1", "O1", "M1", 1, 1.0, 0.0, 1.0, None), ("I2", "O9", "M1", 1, 1.0, 0.0, 1.0, None)]),
    }
    got = {r["relation"]: r["orphans"] for r in quality.orphan_counts(tables).collect()}
    assert {k: v for k, v in got.items() if v} == {"orders.customer_id->customers": 1, "orders.restaurant_id->restaurants": 1, "orders.promotion_id->promotions": 1, "order_items.order_id->orders": 1}


def test_typed_csv(spark, tmp_path):
    path = tmp_path / "orders.csv"
    names = "order_id,customer_id,restaurant_id,promotion_id,order_datetime,ordering_channel,order_status,subtotal,discount_amount,tax_amount,delivery_fee,final_amount,payment_method"
    path.write_text(f"{names}\nO1,C1,R1,,bad,Website,Completed,1,0,0,0,1,Cash\nO2,C1,R1,,2026-09-01T12:00:00Z,Website,Completed,1,0,0,0,1,Cash\n")
    got = {r["order_id"]: r["order_datetime"] for r in readers.typed_csv(spark, str(path), "orders").collect()}
    assert got["O1"] is None and got["O2"] is not None
    rows, compared = readers.inferred_csv(spark, str(path), "orders")
    assert rows.count() == 2 and not compared.where("column = 'order_datetime'").first()["equal"]
    one = quality.ingestion_profile(readers.typed_csv(spark, str(path), "orders"), "orders", 2).first()
    assert one["rows"] == one["expected_rows"] == 2 and one["schema_equal"] and one["nulls_promotion_id"] == 2
