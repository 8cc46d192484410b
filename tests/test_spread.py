"""Joins whose partitions follow the number of rows, so that a task's memory doesn't grow with the input, and rows dealt by cut points."""

from bisect import bisect_left, bisect_right

import pytest
from pyspark.sql import functions as F

from saffron.operators import baskets, customers, expand, ranges, wastage
from saffron.plans import queries as base
from saffron.plans.tables import Domain

SF = "/root/testdata/sf0.001"
ROWS = 50


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def parts(spark, monkeypatch):
    """Partitions that the lines of the smallest tables need, if each holds ROWS of them."""
    monkeypatch.setattr(ranges, "PARTITION_ROWS", ROWS)
    return -(-Domain(spark, SF).items.count() // ROWS)


def test_spread_leaves_small_tables_alone(spark):
    df = spark.range(100)
    assert ranges.spread(100, "id", df) == (df,) and ranges.spread(0, "id", df) == (df,)


def test_basket_pairs_deal_and_write_members_once(spark, parts, monkeypatch):
    written = []
    real = baskets.kept
    monkeypatch.setattr(baskets, "kept", lambda df, name: written.append(df.rdd.getNumPartitions()) or real(df, name))
    pairs = base.QUERIES["basket_pairs"](spark, SF)
    assert written == [parts] and "lineitem" not in "".join(pairs.inputFiles())
    assert pairs.count() > 100


def test_basket_sizes_deal_lines(spark, parts):
    assert "RepartitionByExpression [order_id" in plan(base.QUERIES["basket_sizes"](spark, SF)) and base.brand_members(Domain(spark, SF)).rdd.getNumPartitions() == parts


def dealt(df, parts):
    """Whether lines and orders of the query each are dealt into ``parts`` by order."""
    lines = [x for x in plan(df).splitlines() if "RepartitionByExpression [order_id" in x]
    return len(lines) >= 2 and all(x.endswith(f", {parts}") for x in lines)


def test_menu_by_location_deals_lines(spark, parts):
    assert dealt(base.QUERIES["menu_by_location"](spark, SF), parts)


def test_net_item_revenue_deals_lines(spark, parts):
    assert dealt(base.QUERIES["net_item_revenue"](spark, SF), parts)


def test_full_outer_alignment_deals_lines(spark, parts):
    assert dealt(base.QUERIES["full_outer_alignment"](spark, SF), parts)


def test_repeat_buyers_deals_lines(spark, parts):
    assert dealt(base.QUERIES["repeat_buyers"](spark, SF), parts)


def test_repeat_buyers_deals_members(spark, parts):
    assert "RepartitionByExpression [menu_item_id#" in plan(base.QUERIES["repeat_buyers"](spark, SF))


def test_customer_month_deals_lines(spark, parts):
    assert dealt(base.QUERIES["customer_month"](spark, SF), parts)


def test_validated_rows_are_dealt_below_the_sessions_partitions(spark):
    """Spark would merge the session's many partitions, since their rows are few bytes."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "200")
        assert ranges.dealt(spark.range(1000), 11 * ranges.PARTITION_ROWS, "id").rdd.getNumPartitions() == 11
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("cuts", [[], [None] * 3, [5], [1, 1, 1], [0, 2, 2, 2, 3, 7, 9], list(range(0, 398, 2))])
def test_cut_points_are_found_by_halves(spark, cuts):
    rows = [(cuts, x) for x in [*range(-2, 12), 200, 395, 396, 400, None]]
    n = max(len(cuts), 1)
    got = spark.createDataFrame(rows, "cuts array<int>, x int").select("x", ranges.cuts_below(F.col("cuts"), F.col("x"), n).alias("below"), ranges.cuts_below(F.col("cuts"), F.col("x"), n, True).alias("upto")).collect()
    known = [c for c in cuts if c is not None]
    assert len(got) == len(rows) and all((r.below, r.upto) == ((0, 0) if r.x is None else (bisect_left(known, r.x), bisect_right(known, r.x))) for r in got)


def walks_all_cuts(df):
    """Whether a row is compared with every cut point."""
    return "filter(_cuts" in plan(df) or "filter(_ties" in plan(df)


def test_segmentation_check_halves_cut_points(spark):
    assert not walks_all_cuts(customers.rfm(Domain(spark, SF).orders))


def test_described_marts_halve_cut_points(spark):
    d = Domain(spark, SF)
    assert not walks_all_cuts(wastage.ranking(d.wastage)) and not walks_all_cuts(expand.smallest(d.orders, "order_id", 10))
