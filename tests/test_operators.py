"""Formulas and composite operators on rows small enough to work out by hand."""

import json
import math
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from saffron.functions.numbers import fixed_avg, fixed_sum, half_up, ratio
from saffron.functions.times import Weekday, hour_of_week, weekday
from saffron.operators import anomalies, baskets, catalog, compare, customers, economics, expand, findings, panels, ranking, recommendations, wastage, whatif


def test_fixed_sums_do_not_depend_on_order(spark):
    rows = spark.createDataFrame([(0.1,), (0.2,), (0.3,), (1e9,), (-1e9,), (None,)], "x double")
    got = rows.agg(fixed_sum("x").alias("s"), fixed_avg("x").alias("a")).first()
    assert got["s"] == 0.6 and got["a"] == pytest.approx(0.12)
    one = spark.range(1).select(half_up(F.lit(1.005)).cast("string").alias("h"), ratio(F.lit(1.0), F.lit(0.0)).alias("r")).first()
    assert one["h"].startswith("1.01") and one["r"] is None


def test_weekday_encodings(spark):
    days = spark.createDataFrame([(datetime(2024, 1, 7, 13),), (datetime(2024, 1, 8, 0),)], "d timestamp")  # Sunday, Monday
    got = days.orderBy("d").select(*(weekday(F.col("d"), e).alias(e.name) for e in Weekday), hour_of_week(F.col("d")).alias("how")).collect()
    assert got[0].asDict() == {"SUNDAY_1": 1, "MONDAY_0": 6, "SUNDAY_0": 0, "ISO": 7, "how": 37}
    assert got[1].asDict() == {"SUNDAY_1": 2, "MONDAY_0": 0, "SUNDAY_0": 1, "ISO": 1, "how": 48}


CASES = [
    (10, 0.9, 0.0, 5.0, "2020-01-01", "Profit Driver"), (10, 0.9, 0.9, 5.0, "2020-01-01", "Volume Driver"), (10, 0.1, 0.0, 5.0, "2020-01-01", "Volume Driver"),
    (1, 0.9, 0.0, 5.0, "2020-01-01", "Hidden Opportunity"), (1, 0.1, 0.0, 5.0, "2020-01-01", "Low Performer"), (10, 0.9, 0.0, None, "2020-01-01", "Insufficient cost data"),
    (10, 0.9, 0.0, 0.0, "2020-01-01", "Insufficient cost data"), (10, 0.9, 0.0, 5.0, "2024-12-31", "Insufficient history"),
]


@pytest.mark.parametrize("case", CASES)
def test_performance_class(spark, case):
    units, margin, waste, cost, launch, want = case
    row = spark.createDataFrame([(units, margin, waste, cost, date.fromisoformat(launch), 1.0, 5, 0.5, 0.3, date(2025, 1, 1))], "units_sold long, contribution_margin_pct double, waste_ratio double, cost_price double, launch_date date, revenue double, units_p75 long, margin_p75 double, waste_p75 double, as_of date")
    assert row.select(economics.performance_class(F.col("as_of"))).first()[0] == want


def lines_of_one_order(spark, discount, subtotal):
    items = spark.createDataFrame([("O1", "M1", 1, 60.0, 60.0), ("O1", "M2", 2, 20.0, 40.0), ("O1", "M3", 0, 1.0, 0.0)], "order_id string, menu_item_id string, quantity int, unit_price double, line_total double")
    orders = spark.createDataFrame([("O1", "C1", "R1", None, datetime(2025, 1, 1), "Website", "Completed", subtotal, discount, 90.0)], "order_id string, customer_id string, restaurant_id string, promotion_id string, order_datetime timestamp, ordering_channel string, order_status string, subtotal double, discount_amount double, final_amount double")
    menu = spark.createDataFrame([("M1", "K", "a", 10.0), ("M2", "K", "b", None), ("M3", "K", "c", 1.0)], "menu_item_id string, category_id string, item_name string, cost_price double")
    return items, orders, menu


def test_discount_allocation(spark):
    args = lines_of_one_order(spark, 10.0, 100.0)
    got = {r["menu_item_id"]: r for r in economics.net_lines(*args).collect()}
    assert set(got) == {"M1", "M2"}  # no quantity, no line
    assert sum(r["net_revenue"] for r in got.values()) == pytest.approx(90.0)
    assert got["M1"]["estimated_cost"] == 10.0 and got["M2"]["estimated_cost"] is None


def test_two_policies_of_unclear_discounts(spark):
    args = lines_of_one_order(spark, 10.0, 0.0)
    assert economics.net_lines(*args).count() == 0
    kept = economics.net_lines(*args, drop_unclear=False).collect()
    assert len(kept) == 2 and all(r["net_revenue"] is None for r in kept)


def test_pair_metrics(spark):
    row = spark.createDataFrame([("a", "b", 200, 400, 500, 1000)], "item_a string, item_b string, pair_count long, count_a long, count_b long, basket_count long")
    got = baskets.with_metrics(row).first()
    assert (got["support"], got["confidence_a_to_b"], got["confidence_b_to_a"], got["lift"]) == (0.2, 0.5, 0.4, 1.0)
    assert baskets.directional(baskets.with_metrics(row)).count() == 0  # the lift must exceed one
    found = spark.createDataFrame([("A", "B", 10, 0.1, 0.2, 0.8, 2.0)], "item_a string, item_b string, pair_count long, support double, confidence_a_to_b double, confidence_b_to_a double, lift double")
    only = baskets.directional(found, 0.5).collect()
    assert [(r["antecedent"], r["consequent"]) for r in only] == [("B", "A")]
    assert "B also take A" in baskets.rule_text(baskets.directional(found, 0.5)).first()["evidence"]


def test_pairs_of_narrow_and_wide_baskets(spark, monkeypatch):
    members = baskets.membership(spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (1, "c"), (2, "a"), (2, "b"), (3, "c"), (4, None)], "order_id int, menu_item_id string"))
    want = {("a", "b"): 2, ("a", "c"): 1, ("b", "c"): 1}
    pairs = lambda: {(r["item_a"], r["item_b"]): r["pair_count"] for r in baskets.pair_counts(members).collect()}
    assert pairs() == want
    monkeypatch.setattr(baskets, "WIDE", 2)
    assert pairs() == want
    assert {(r["item_a"], r["item_b"]) for r in baskets.pair_counts(members, 2).collect()} == {("a", "b")}
    assert {r["distinct_items"]: r["baskets"] for r in baskets.sizes(members).collect()} == {3: 1, 2: 1, 1: 1}


@pytest.mark.parametrize("n", [1, 2, 4, 5, 7, 23, 100])
def test_ntile_equals_sql(spark, n):
    rows = spark.range(n).select(F.col("id"), (F.col("id") * 7 % 5).cast("double").alias("v"))
    rows.createOrReplaceTempView("tiles")
    for down in (False, True):
        got = {r["id"]: r["t"] for r in ranking.global_ntile(rows, 5, "v", "id", "t", down, ranges=3).collect()}
        want = {r["id"]: r["t"] for r in spark.sql(f"select id, ntile(5) over (order by v {'desc' if down else ''}, id) t from tiles").collect()}
        assert got == want


def test_dense_rank_latest_top_value(spark):
    rows = spark.createDataFrame([("a", 3.0), ("b", 1.0), ("c", 3.0), ("d", 2.0)], "k string, v double")
    assert {r["k"]: r["r"] for r in wastage.dense_rank_desc(rows, "v", "r", 3).collect()} == {"a": 1, "c": 1, "d": 2, "b": 3}
    seen = spark.createDataFrame([(1, "x"), (1, "y"), (1, "y"), (2, "b"), (2, "a"), (3, None)], "k int, v string")
    assert {r["k"]: r["f"] for r in ranking.top_value(seen, "k", "v", "f").collect()} == {1: "y", 2: "a", 3: None}
    assert {r["k"]: r["v"] for r in ranking.latest(seen.where("v is not null"), ["k"], ["v"]).collect()} == {1: "y", 2: "b"}


def test_rfm_with_customers_without_orders(spark):
    people = spark.createDataFrame([("C1",), ("C2",), ("C3",)], "customer_id string")
    orders = spark.createDataFrame([("O1", "C1", "R1", datetime(2025, 1, 1), 100.0, "Completed"), ("O2", "C1", "R2", datetime(2025, 2, 1), 200.0, "Completed"), ("O3", "C2", "R1", datetime(2025, 5, 3), 50.0, "Completed"), ("O4", "C3", "R1", datetime(2025, 5, 3), 50.0, "Cancelled")], "order_id string, customer_id string, restaurant_id string, order_datetime timestamp, final_amount double, order_status string")
    got = {r["customer_id"]: r for r in customers.rfm_full(people, orders).collect()}
    assert (got["C1"]["frequency"], got["C1"]["monetary_value"], got["C1"]["recency_days"]) == (2, 300.0, 91)
    assert got["C1"]["behavior_segment"] == "At risk (90d inactive)"
    assert got["C3"]["frequency"] == 0 and got["C3"]["recency_days"] is None and got["C3"]["behavior_segment"] == customers.NO_ORDERS
    assert "customer_name" not in customers.rfm_full(people, orders).columns
    new, old = customers.rfm(orders), customers.rfm(orders, legacy_recency=True)
    assert {r["customer_id"]: r["r_score"] for r in new.collect()} == {"C1": 1, "C2": 2}
    assert {r["customer_id"]: r["r_score"] for r in old.collect()} == {"C1": 5, "C2": 4}


def test_disengagement_leaves_the_last_month_out(spark):
    rows = spark.createDataFrame([("C", "2025-01", 1, 1.0, 1, date(2025, 1, 5), 0, ["a"]), ("C", "2025-03", 2, 1.0, 1, date(2025, 3, 5), 1, None), ("C", "2025-04", 1, 1.0, 1, date(2025, 4, 1), 0, [])], "customer_id string, month string, orders int, spend double, visit_days int, last_order_day date, promo_orders int, categories array<string>")
    assert [(r["month"], r["label"], r["category_count"]) for r in customers.disengagement(rows).orderBy("month").collect()] == [("2025-01", 1, 1), ("2025-03", 0, 0)]


def test_outliers_need_deviation(spark):
    rows = spark.createDataFrame([("a", x) for x in (1.0, 2.0, 2.0, 3.0, 50.0)] + [("b", 5.0)] * 4 + [("b", 99.0)], "g string, v double")
    assert [(r["g"], r["v"]) for r in anomalies.robust_outliers(rows, ["g"], "v").collect()] == [("a", 50.0)]


def test_dense_panel_lags_and_errors(spark):
    facts = spark.createDataFrame([("a", date(2025, 1, 1), 2), ("a", date(2025, 1, 3), 4)], "entity string, day date, units int")
    panel = panels.dense(facts, ["entity"], "day", "1 day", ["units"])
    assert [r["units"] for r in panel.orderBy("day").collect()] == [2, 0, 4]
    lagged = panels.past_means(panels.lags(panel, ["entity"], "day", "units", (1,)), ["entity"], "day", "units", (2,)).orderBy("day").collect()
    assert [(r["units_lag_1"], r["units_mean_prev_2"]) for r in lagged] == [(None, None), (2, 2.0), (0, 1.0)]
    assert [r["nxt"] for r in panels.next_value(panel, ["entity"], "day", "units", "nxt").orderBy("day").collect()] == [0, 4]
    with pytest.raises(panels.PanelError):
        panels.check_unique(facts.unionByName(facts), ["entity"], "day")
    bounds = spark.createDataFrame([(date(2026, 3, 31),), (date(2026, 4, 1),), (date(2026, 5, 31),), (date(2026, 6, 1),)], "d date")
    assert [x.count() for x in panels.split_by_time(bounds, "d", "2026-04-01", "2026-06-01")] == [1, 2, 1]


def test_whatif(spark):
    row = spark.createDataFrame([(100.0, 40.0, 10.0)], "price double, unit_cost double, units double")
    got = whatif.price(row, 0.1, -1.0).first()
    assert got["scenario_units"] == pytest.approx(9) and got["scenario_revenue"] == pytest.approx(990)
    prep = whatif.preparation(spark.createDataFrame([(100.0, 84.0)], "prepared double, demand double"), 0.12, 0.2).first()
    assert prep["scenario_waste"] == pytest.approx(9.6) and prep["shortfall"] == pytest.approx(13.6)
    stock = whatif.inventory(spark.createDataFrame([(100.0, 95.0)], "demand double, on_hand double"), 0.1).first()
    assert stock["shortfall"] == pytest.approx(15)
    promo = whatif.promotion(spark.createDataFrame([(1000.0, 400.0)], "revenue double, contribution double"), 0.1, 0.1).first()
    assert promo["scenario_contribution"] == pytest.approx(330)
    assert whatif.demand(spark.createDataFrame([(10.0, 2.0)], "demand double, contribution_per_unit double"), 0.5).first()["scenario_contribution"] == pytest.approx(30)
    assert whatif.remove_item(spark.createDataFrame([(-1.0, 2.0)], "revenue double, contribution double")).first()["revenue_lost"] is None
    for bad in (lambda: whatif.price(row, -1.0), lambda: whatif.price(row, 0.1, 1.0), lambda: whatif.price(row, float("nan"))):
        with pytest.raises(ValueError, match="must be between"):
            bad()


#: A profile without any finding, and for each finding what reaches its bounds and what just misses them.
PLAIN = {"units": 75, "margin_pct": 0.29, "waste_ratio": 0.25, "rating": 3.7}
EDGES = {
    "high_sales_loss_making": ({"margin_pct": -0.001}, {"margin_pct": 0.0}),
    "low_sales_high_margin": ({"units": 74, "margin_pct": 0.3}, {"units": 75, "margin_pct": 0.3}),
    "popular_high_wastage": ({"waste_ratio": 0.251}, {"waste_ratio": 0.25}),
    "high_rating_low_profit": ({"rating": 4.5, "margin_pct": 0.19}, {"rating": 4.49, "margin_pct": 0.19}),
    "low_rating_high_sales": ({"rating": 2.5}, {"rating": 2.51}),
    "promotion_dependent": ({"promo_share": 0.75, "promo_units": 40, "nonpromo_units": 10}, {"promo_share": 0.75, "promo_units": 40, "nonpromo_units": 11}),
    "location_contradiction": ({"location_margin_spread": 0.3}, {"location_margin_spread": 0.29}),
    "weekend_concentration": ({"weekend_units": 75, "weekday_units": 25}, {"weekend_units": 74, "weekday_units": 26}),
    "seasonal_menu": ({"peak_month_share": 0.6}, {"peak_month_share": 0.59}),
    "new_item_insufficient_history": ({"history_days": 29}, {"history_days": 30}),
    "high_price_sensitivity": ({"price_change_pct": -0.1, "unit_change_pct": 0.1}, {"price_change_pct": -0.1, "unit_change_pct": 0.09}),
    "rating_spike": ({"baseline_rating": 2.5, "recent_rating": 3.5}, {"baseline_rating": 2.5, "recent_rating": 3.25}),
    "sales_spike": ({"baseline_units": 3, "recent_units": 6}, {"baseline_units": 0, "recent_units": 6}),
    "churn_risk": ({"recency_increase_days": 30, "frequency_change": -1, "monetary_change_pct": -0.25}, {"recency_increase_days": 30, "frequency_change": -1, "monetary_change_pct": -0.24}),
    "engine_disagreement": ({"engine_label": "a", "oracle_label": None}, {"engine_label": None, "oracle_label": "a"}),
}


def test_item_findings_at_their_bounds(spark):
    cases = [(name, hit, PLAIN | x) for name, pair in EDGES.items() for hit, x in zip((True, False), pair, strict=True)]
    rows = spark.read.json(spark.sparkContext.parallelize([json.dumps(p | {"n": i}) for i, (_, _, p) in enumerate(cases)]))
    got = {r["n"]: r for r in findings.item_findings(rows).collect()}
    for i, (name, hit, _) in enumerate(cases):
        assert list(got[i]["findings"]) == ([name] if hit else []), (name, hit)
    assert [name for name, _ in findings.FINDINGS] == list(EDGES)
    classes = {(name, hit): got[i]["item_class"] for i, (name, hit, _) in enumerate(cases)}
    assert classes["low_sales_high_margin", True] == "Hidden Opportunity" and classes["low_sales_high_margin", False] == "Volume Driver" and classes["new_item_insufficient_history", True] == "Insufficient history"


def test_expand(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "k string, v int")
    out = expand.expand(rows, "k", 7)
    keys = [r["k"] for r in out.collect()]
    assert len(keys) == len(set(keys)) == 7 and sum(k.startswith("X") for k in keys) == 4 and out.columns == rows.columns
    for bad in (lambda: expand.expand(rows, "k", 2), lambda: expand.expand(rows, "nope", 9)):
        with pytest.raises(ValueError):
            bad()


def test_compare_statuses(spark):
    left = spark.createDataFrame([(1, 1.0, "x"), (2, None, "y"), (3, 5.0, None), (4, 1.0, "q")], "k int, a double, t string")
    right = spark.createDataFrame([(1, 1.004, "x"), (2, None, "z"), (3, None, None), (5, 1.0, "q")], "k int, a double, t string")
    got = {(r["k"], r["metric"]): r["status"] for r in compare.compare(left, right, ["k"], {"a": 0.005}, ["t"]).collect()}
    assert got == {(1, "a"): "within", (1, "t"): "same", (2, "a"): "both_null", (2, "t"): "different", (3, "a"): "one_null", (3, "t"): "both_null", (4, "a"): "missing_right", (4, "t"): "missing_right", (5, "a"): "missing_left", (5, "t"): "missing_left"}
    tight = compare.compare(left, right, ["k"], {"a": 0.001})
    assert tight.where("k = 1").first()["status"] == "beyond"
    assert compare.delta_summary(tight).first()["failed"] == 4
    with pytest.raises(compare.ComparisonError):
        compare.compare(left.unionByName(left), right, ["k"], {"a": 0.1})
    with pytest.raises(compare.ComparisonError):
        compare.compare(left, right, ["k"], {"b": 0.1})


def test_catalog_views(spark):
    mart = spark.createDataFrame([("Pizza A", 1), ("pizza b", None), ("Rice", 3)], "name string, v int")
    served = catalog.ReportCatalog({"m": mart})
    assert served.view("m", contains={"name": "PIZZA"}).count() == 2
    assert served.view("m", equals={"name": "rice"}).count() == 1
    assert [r["v"] for r in served.view("m", sort="v", descending=True).collect()] == [None, 3, 1]
    assert served.view("m", between={"v": (1, 2)}, limit=1).count() == 1
    assert served.closest("m", "name", "pizza a").first()["name"] == "Pizza A"
    for bad in (0, 1001):
        with pytest.raises(ValueError, match="limit"):
            served.view("m", limit=bad)
    with pytest.raises(KeyError):
        served.view("nope")


@pytest.fixture(scope="module")
def many_items(spark):
    """Classes of more items than an approximate percentile keeps apart, and their shuffled margins and units."""
    n = 30_011
    c = F.col
    items = spark.range(n).select(c("id").alias("menu_item_id"), (c("id") * 7919 % n).alias("units"), (c("id") * 104_729 % n).alias("cost"))
    net = items.select("menu_item_id", c("menu_item_id").alias("order_id"), (c("units") + 1).cast("int").alias("quantity"), F.lit(1000.0).alias("line_total"), F.lit(1000.0).alias("net_revenue"), (c("cost") / 100).alias("estimated_cost"))
    menu = items.select("menu_item_id", F.lit("x").alias("item_name"), F.lit("c").alias("category_id"), F.lit(1.0).alias("cost_price"), F.lit("2020-01-01").cast("date").alias("launch_date"))
    waste = items.select("menu_item_id", F.lit(1.0).alias("quantity_wasted"), F.lit(1.0).alias("wastage_cost"))
    kinds, as_of = spark.createDataFrame([("c", "C")], "category_id string, category_name string"), spark.sql("SELECT date'2024-01-01' AS as_of")
    return n, economics.menu_profitability(net, menu, kinds, waste, as_of).persist()


def test_cut_offs_of_many_items_are_exact(many_items):
    n, rows = many_items
    at = math.ceil(0.75 * n)
    cuts = rows.select("units_p75", "margin_p75", "waste_p75").distinct().collect()
    assert len(cuts) == 1 and cuts[0]["units_p75"] == at and cuts[0]["margin_p75"] == pytest.approx((1000 - (n - at) / 100) / 1000, abs=1e-9)
    assert cuts[0]["waste_p75"] == pytest.approx(100 / (n - math.ceil(0.75 * (n - 1))), rel=1e-12)


def test_recommended_classes_of_many_items(spark, many_items):
    """An action for each item but those over both cut-offs."""
    n, rows = many_items
    none = spark.createDataFrame([], "antecedent string, consequent string, pair_count long, lift double")
    stock = spark.createDataFrame([], "restaurant_id long, menu_item_id long, record_date date, inventory_id long, closing_stock int, stock_status string")
    got = recommendations.recommend(none, rows, spark.createDataFrame([], "behavior_segment string"), stock)
    at = math.ceil(0.75 * n)
    want = {"review portion and cost": 0, "test targeted visibility": 0, "review placement, cost and demand before removal": 0}
    for i in range(n):
        cost = i * 104_729 % n
        popular, profitable, frugal = i * 7919 % n + 1 >= at, n - cost >= at, cost == 0 or cost >= n - math.ceil(0.75 * (n - 1))
        if popular and not (profitable and frugal):
            want["review portion and cost"] += 1
        elif not popular:
            want["test targeted visibility" if profitable else "review placement, cost and demand before removal"] += 1
    assert {r["action"]: r["n"] for r in got.groupBy("action").agg(F.count(F.lit(1)).alias("n")).collect()} == want
