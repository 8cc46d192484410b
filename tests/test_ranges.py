"""Orders over all rows, bitmaps, rollups, event windows, pair pruning and the single-pass validator against plain loops."""

import datetime
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from saffron.operators import anomalies, baskets, bitmaps, customers, onepass, pricing, quality, ranges, rollups
from saffron.plans import queries as base
from saffron.plans.tables import Domain

SF = "/root/testdata/sf0.001"


def numbers(n=500, seed=1):
    rng = random.Random(seed)
    return [(rng.choice("aaaaaaab") if rng.random() > 0.05 else None, rng.randint(0, 40) if rng.random() > 0.1 else None, i) for i in range(n)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(numbers(), "g string, v int, id int").repartition(5).persist()


def by_group(rows):
    out = defaultdict(list)
    for g, v, i in rows:
        out[g].append((v, i))
    return out


def test_running_sums(spark, table):
    got = ranges.running_by(table.withColumn("one", F.lit(1)), ["g"], [F.col("id").desc()], {"at": "one"}).collect()
    want = {i: sum(j > i for _, j in rows) for rows in by_group(numbers()).values() for _, i in rows}
    assert {r["id"]: r["at"] for r in got} == want and all(r["at_all"] == len(by_group(numbers())[r["g"]]) for r in got)
    assert ranges.running_by(table.limit(0).withColumn("one", F.lit(1)), [], ["id"], {"at": "one"}).count() == 0


@pytest.mark.parametrize("few", [0, 1000])
def test_quantiles_are_exact(spark, table, monkeypatch, few):
    monkeypatch.setattr(ranges, "BROADCAST_GROUPS", few)
    for share in (0.0, 0.25, 0.5, 0.9, 1.0):
        got = {r["g"]: r["q"] for r in ranges.quantiles(table, ["g"], "v", share, "q").collect()}
        for g, rows in by_group(numbers()).items():
            values = sorted(v for v, _ in rows if v is not None)
            assert got[g] == values[max(1, math.ceil(share * len(values))) - 1]
    every = sorted(v for _, v, _ in numbers() if v is not None)
    assert ranges.quantiles(table, [], "v", 0.5, "q").first()["q"] == every[(len(every) + 1) // 2 - 1]
    assert ranges.quantiles(table.limit(0), ["g"], "v", 0.5, "q").count() == 0


def test_every_nth_is_even(table):
    for k in (1, 2, 5, 600):
        got = by_group((r["g"], r["v"], r["id"]) for r in ranges.every_nth(table, ["id"], k, ["g"]).collect())
        for g, rows in by_group(numbers()).items():
            ids = sorted(i for _, i in rows)
            n = len(ids)
            keep = [i for at, i in enumerate(ids) if n <= k or at == 0 or at * (k - 1) // max(1, n - 1) > (at - 1) * (k - 1) // max(1, n - 1)]
            assert sorted(i for _, i in got[g]) == keep and len(keep) == min(n, k)


@pytest.mark.parametrize("down", [False, True])
def test_counted_tiles(table, down):
    rows = numbers()
    order = sorted(rows, key=lambda r: ((r[1] is not None, r[1] or 0) if not down else (r[1] is None, -(r[1] or 0)), r[2]))
    for n in (1, 4, 7, 999):
        small, extra = divmod(len(rows), n)
        want, at = {}, 0
        for tile in range(n):
            for _ in range(small + (tile < extra)):
                want[order[at][2]] = tile + 1
                at += 1
        assert {r["id"]: r["t"] for r in ranges.counted_tiles(table, n, "v", "id", "t", down).collect()} == want


def test_another_tie_rule_is_noticed(spark):
    """The second derivation of customer scores agrees; with ties turned round it doesn't."""
    scored = customers.rfm(Domain(spark, SF).orders).persist()
    again = lambda tie: ranges.counted_tiles(scored.withColumn("_back", -F.col("customer_id")), 5, "frequency", tie, "_again").where("f_score <> _again").count()
    assert again("customer_id") == 0 and again("_back") > 0


def test_outliers_of_one_large_group(spark):
    rng = random.Random(7)
    values = [rng.gauss(100, 10) for _ in range(3000)] + [500.0, -300.0]
    df = spark.createDataFrame([("x", v) for v in values], "g string, v double").repartition(6)
    ordered = sorted(values)
    mid = ordered[(len(values) + 1) // 2 - 1]
    mad = sorted(abs(v - mid) for v in values)[(len(values) + 1) // 2 - 1]
    got = anomalies.robust_outliers(df, ["g"], "v").collect()
    assert sorted(r["v"] for r in got) == sorted(v for v in values if abs(v - mid) > 3 * anomalies.MAD_SCALE * mad)
    assert {(r["median"], r["mad"]) for r in got} == {(mid, mad)}


# ------------------------------------------------------------ bitmaps, rollups


def test_distinct_counts_at_three_grains(spark):
    rng = random.Random(3)
    rows = [(rng.choice("pq"), rng.choice("xyz"), f"c{int(rng.random() ** 3 * 200)}" if rng.random() > 0.05 else None) for _ in range(1500)]
    df = spark.createDataFrame(rows, "place string, item string, who string").repartition(4)
    ids = bitmaps.dense_numbers(df, "who", "n")
    assert sorted(r["n"] for r in ids.collect()) == list(range(ids.count())) and ids.count() == len({w for *_, w in rows if w})
    table = bitmaps.bitmaps(df.join(ids, "who", "left"), ["place", "item"], {"who": F.col("n"), "length": F.length("who")}).persist()
    for by in (["place", "item"], ["place"], ["item"]):
        want, lengths = defaultdict(set), defaultdict(set)
        for p, i, w in rows:
            key = tuple({"place": p, "item": i}[b] for b in by)
            if w:
                want[key].add(w)
                lengths[key].add(len(w))
        got = {tuple(r[b] for b in by): (r["who"], r["length"]) for r in bitmaps.distinct_counts(table, by, ["who", "length"]).collect()}
        assert got == {k: (len(v), len(lengths[k])) for k, v in want.items()}


def test_rollup_shares_and_missing_values(spark):
    rows = [("a", 1, 7, "2026-01", 2, 10.0), ("a", 2, 7, "2026-01", 1, 30.0), ("b", 3, 8, "2026-02", 1, 60.0), (None, 3, 8, None, 1, None)]
    lines = spark.createDataFrame(rows, "category_id string, menu_item_id int, restaurant_id int, month string, quantity int, net_revenue double")
    got = {(r["grain"], r["category_id"], r["menu_item_id"], r["restaurant_id"], r["month"]): (r["lines"], r["units"], r["revenue"], r["revenue_share"]) for r in rollups.sales_rollup(lines).collect()}
    assert got["all", None, None, None, None] == (4, 5, 100.0, 1.0)
    assert got["category", "a", None, None, None] == (2, 3, 40.0, 0.4) and got["category", None, None, None, None] == (1, 1, None, None)
    assert got["item", "a", 2, None, None] == (1, 1, 30.0, 0.75) and got["place", None, None, 8, None] == (2, 2, 60.0, 0.6)
    assert got["place and month", None, None, 8, None] == (1, 1, None, None) and got["month", None, None, None, "2026-02"] == (1, 1, 60.0, 0.6)
    scans = rollups.sales_rollup(lines.limit(0)).collect()
    assert [r["grain"] for r in scans] in ([], ["all"])


# ------------------------------------------------------- event windows and pairs


def test_event_windows_against_every_day(spark, monkeypatch):
    rng = random.Random(5)
    first = datetime.date(2026, 1, 1)
    sales = [(rng.choice((1, 1, 1, 2)), rng.randint(1, 2), datetime.datetime.combine(first + datetime.timedelta(rng.randint(0, 90)), datetime.time(12)), rng.randint(1, 4)) for _ in range(900)]
    events = [(rng.choice((1, 2, 3)), rng.randint(1, 2), 10.0, rng.choice((8.0, 10.0, 12.5)), first + datetime.timedelta(rng.randint(0, 95))) for _ in range(60)]
    events += [events[0], (1, 1, 10.0, 0.0, first), (1, 1, 10.0, 11.0, None)]
    net = spark.createDataFrame(sales, "restaurant_id int, menu_item_id int, order_datetime timestamp, quantity int")
    prices = spark.createDataFrame(events, "restaurant_id int, menu_item_id int, old_price double, new_price double, effective_from date")
    want = {}
    for r, m, old, new, at in set(events):
        if at is None or new <= 0:
            continue
        units = lambda lo, hi: sum(q for a, b, t, q in sales if (a, b) == (r, m) and lo <= (t.date() - at).days < hi)  # noqa: B023, E731
        if units(-14, 0) and units(0, 14):
            want[r, m, old, new, at] = units(-14, 0), units(0, 14)
    seen = []
    real = ranges.running
    monkeypatch.setattr(ranges, "running", lambda df, *a: seen.append(df.count()) or real(df, *a))
    got = {(r["restaurant_id"], r["menu_item_id"], r["old_price"], r["new_price"], r["effective_from"]): (r["pre_units"], r["post_units"]) for r in pricing.price_sensitivity(net, prices, 14).collect()}
    assert got == want and len(want) > 10
    # rows in order: one for each day sold and three for each event
    assert seen == [pricing.daily_units(net).count() + 3 * len({e for e in events if e[4] and e[3] > 0})]


def test_pair_pruning_is_exact_and_drops_rows(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(b, int(rng.random() ** 2 * 300)) for b in range(400) for _ in range(rng.randint(1, 9))]
    members = baskets.membership(spark.createDataFrame(rows, "order_id int, menu_item_id int")).persist()
    held = defaultdict(set)
    for b, i in rows:
        held[b].add(i)
    want = Counter((x, y) for items in held.values() for x in items for y in items if x < y)
    for few in (8, 1 << 22):
        monkeypatch.setattr(baskets, "BUCKETS", few)
        for least in (1, 3, 6):
            got = {(r["item_a"], r["item_b"]): r["pair_count"] for r in baskets.pair_counts(members, least).collect()}
            assert got == {p: n for p, n in want.items() if n >= least}
    pairs, _ = baskets.pair_rows(members, 6)
    before, after = pairs.count(), baskets.pruned(pairs, 6).count()
    assert after == sum(n for n in want.values() if n >= 6) < before / 3


# ------------------------------------------------------------------ single pass


def spoilt_tables(spark):
    orders = [("o1", "c1", "r1", "x"), ("o2", "c2", "r1", None), ("o2", "c2", "r1", None), ("o2", "c9", "r1", "y"), (None, "c1", "r2", "x"), (None, "c1", None, "x"), ("o3", "c1", "r1", "x"), ("o3", "c3", "r1", "x")]
    people = [("c1",), ("c2",), ("c2",), ("c2",)]
    return {"customers": spark.createDataFrame(people, "customer_id string"), "orders": spark.createDataFrame(orders, "order_id string, customer_id string, restaurant_id string, ordering_channel string").repartition(3)}


def test_single_pass_counts(spark):
    tables = spoilt_tables(spark)
    got = {(r["table"], r["issue"]): r["rows"] for r in onepass.single_pass(tables).collect()}
    assert got == {
        ("customers", "rows"): 4, ("customers", "repeated_key"): 3, ("customers", "copy"): 2, ("orders", "rows"): 8, ("orders", "repeated_key"): 7, ("orders", "copy"): 1, ("orders", "orphan:customer_id"): 2,
        ("orders", "null:order_id"): 2, ("orders", "null:restaurant_id"): 1, ("orders", "null:ordering_channel"): 2, ("orders", "unexpected_ordering_channel"): 6,
    }
    assert onepass.single_pass({k: t.limit(0) for k, t in tables.items()}).count() == 0


def test_single_pass_reads_a_clean_table_once(spark, tmp_path):
    Domain(spark, SF).raw("customer").select(F.col("c_custkey").cast("string").alias("customer_id"), "c_name").write.parquet(str(tmp_path / "people"))
    people = spark.read.parquet(str(tmp_path / "people"))
    scans = []
    real = onepass.kept
    try:
        onepass.kept = lambda df, name: scans.append((df._jdf.queryExecution().optimizedPlan().collectLeaves().size(), any("people" in f for f in df.inputFiles()))) or real(df, name)
        got = {r["issue"]: r["rows"] for r in onepass.single_pass({"customers": people}, {"customers": {"null:c_name": F.col("c_name").isNull()}}).collect()}
    finally:
        onepass.kept = real
    assert got == {"rows": 150} and scans[0] == (1, True) and not any(again for _, again in scans[1:])


def test_repaired_keeps_the_smallest_row(spark):
    rows = [("w1", 5.0), ("w1", -2.0), ("w1", 3.0), ("w2", 1.0)]
    for n in (1, 4):
        got, audit = quality.repaired(spark.createDataFrame(rows, "wastage_id string, quantity_wasted double").repartition(n), "wastage")
        assert {tuple(r) for r in got.collect()} == {("w1", None), ("w2", 1.0)}
        assert {r["rule"]: r["affected"] for r in audit.collect()} == {"deduplicate_primary_key": 2, "null_negative_wastage": 1}


def test_channel_days_of_given_tables(spark):
    """The panel that the forecasts learn from holds every order."""
    d = Domain(spark, SF)
    assert base.channel_days(d).agg(F.sum("units")).first()[0] == d.orders.count()
