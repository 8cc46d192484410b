"""Whole jobs on a small generated company."""

import pytest
from pyspark.sql import functions as F

from saffron.operators import compare, verify
from saffron.plans import jobs
from saffron.sources import generator

SIZE = generator.Size(customers=60, orders=300, ratings=80, stock=80, waste=80, prices=40, items=25, promotions=8, restaurants=4)


@pytest.fixture(scope="module")
def company(spark, tmp_path_factory):
    """Dirty CSV tables, cleaned into Parquet version v1."""
    root = f"file://{tmp_path_factory.mktemp('company')}"
    dirty, manifest = generator.inject(generator.generate(spark, SIZE), seed=1)
    for name, df in dirty.items():
        df.coalesce(1).write.option("header", True).option("emptyValue", "").csv(f"{root}/raw/{name}.csv")
    accounts = jobs.clean(spark, f"{root}/raw", f"{root}/accepted", f"{root}/quarantined", "v1")
    return root, accounts, manifest, jobs.read_tables(spark, f"{root}/accepted", "v1")


def test_every_row_is_accounted_for(company):
    _, accounts, manifest, tables = company
    for name, n in accounts.items():
        assert n["before"] == n["accepted"] + n["quarantined"] + n["exact_duplicates"]
        assert tables[name].count() == n["accepted"]
    declared = {(r["table"], r["issue"]): r["rows"] for r in manifest.collect()}
    assert accounts["ratings"]["quarantined"] >= declared["ratings", "rating_out_of_range"]
    assert accounts["customers"]["quarantined"] == 0


def test_reports_save_and_agree_with_themselves(spark, company):
    root, _, _, tables = company
    made = jobs.standing_reports(tables)
    assert set(made) == set(compare.REPORT_SPECS)
    rows = jobs.save(made, f"{root}/reports", "v1")
    assert rows["monthly_demand"] > 0 and rows["inventory_status"] == 2
    again = spark.read.parquet(f"{root}/reports/v1/channel_performance")
    assert compare.compare_report("channel_performance", made["channel_performance"][0], again).where("not passed").count() == 0
    with pytest.raises(Exception, match="already exists"):
        jobs.save({"monthly_demand": made["monthly_demand"]}, f"{root}/reports", "v1")


def test_gap_marts(company):
    root, _, _, tables = company
    marts = jobs.gap_marts(tables, least_pairs=3, min_confidence=0.05)
    keyed = {k: v for k, v in marts.items() if k != "recommendations"}
    rows = jobs.save(keyed, f"{root}/gap", "v1")
    assert rows["menu_profitability"] == tables["menu_items"].count() and rows["customer_rfm"] == tables["customers"].count()
    checks = verify.mart_checks(tables["menu_items"], marts["menu_profitability"][0], marts["menu_by_location"][0], marts["basket_rules"][0], 3)
    told = {r["check"]: r for r in checks.collect()}
    assert set(told) == {"every catalogue item", "one row an item", "one row a place and item", "every place with every item", "rules reach the pair threshold", "known classes", "one row a pair", "no personal columns"}
    places = marts["menu_by_location"][0]
    lacking = verify.missing_pairs(places, "restaurant_id", "menu_item_id").agg(F.sum("missing")).first()[0] or 0
    product = told.pop("every place with every item")
    assert product["expected"] - product["found"] == lacking and product["passed"] == (lacking == 0)
    assert all(r["passed"] for r in told.values())
    assert marts["recommendations"][0].where(F.col("source") == "customer behavior").count() > 0
    assert verify.histogram(marts["menu_profitability"][0], "performance_class").count() > 0


def test_feature_marts(spark, company):
    root, _, _, tables = company
    marts = jobs.feature_marts(tables)
    assert len(marts) == 22
    rows = jobs.save(marts, f"{root}/features", "v2")
    assert rows["customer_features"] == tables["customers"].count() and rows["menu_features"] == rows["catalog"]
    view = jobs.served(spark, f"{root}/features", "v2", ["menu_features"]).view("menu_features", contains={"item_name": "DISH"}, sort="units", descending=True, limit=5)
    assert view.count() == 5
    product = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "l int, r string")
    assert not verify.full_product(product, "l", "r", "x").first()["passed"]
