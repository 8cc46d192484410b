"""Queries: the operators over the domain views of one directory of tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import fixed_sum, share
from ..operators import anomalies, baskets, catalog, compare, customers, economics, expand, features, findings, panels, pricing, promotions, quality, ranges, ranking, recommendations, reports, wastage, whatif
from ..sources.shared import kept
from .tables import Domain

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Callable[[Domain], DataFrame]) -> Callable[[Domain], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: f(Domain(spark, sf_dir))
    return f


def net(d: Domain, drop_unclear: bool = True) -> DataFrame:
    return economics.net_lines(d.items, d.orders, d.menu, drop_unclear)


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


# ----------------------------------------------------------------- reports


@query
def item_performance(d: Domain) -> DataFrame:
    return reports.menu_item_performance(d.items, d.orders, d.menu, d.categories)


@query
def category_performance(d: Domain) -> DataFrame:
    return reports.category_performance(d.items, d.orders, d.menu, d.categories)


@query
def location_performance(d: Domain) -> DataFrame:
    return reports.restaurant_performance(d.orders, d.restaurants)


@query
def channel_performance(d: Domain) -> DataFrame:
    return reports.channel_performance(d.orders)


@query
def promotion_effectiveness(d: Domain) -> DataFrame:
    return reports.promotion_effectiveness(d.promotions, d.orders)


@query
def monthly_demand(d: Domain) -> DataFrame:
    return reports.monthly_demand(d.orders)


@query
def weekday_peak_hour(d: Domain) -> DataFrame:
    return longs(reports.weekday_peak_hour(d.orders), "weekday", "hour_of_day")


@query
def segment_behavior(d: Domain) -> DataFrame:
    return reports.customer_segment_behavior(d.customers, d.orders)


@query
def rating_summary(d: Domain) -> DataFrame:
    return reports.restaurant_ratings(d.ratings)


@query
def waste_by_reason(d: Domain) -> DataFrame:
    return reports.wastage_by_reason(d.wastage)


@query
def pricing_changes(d: Domain) -> DataFrame:
    return reports.pricing_changes(d.prices)


@query
def stock_status(d: Domain) -> DataFrame:
    return reports.inventory_status(d.inventory)


@query
def headline(d: Domain) -> DataFrame:
    return reports.headline(d.orders)


# --------------------------------------------------------------- economics


@query
def net_item_revenue(d: Domain) -> DataFrame:
    return economics.item_economics(net(d))


@query
def menu_by_location(d: Domain) -> DataFrame:
    return economics.menu_by_location(net(d))


def classes(d: Domain) -> DataFrame:
    return economics.menu_profitability(net(d), d.menu, d.categories, d.wastage, features.as_of_day(d.orders))


@query
def menu_profitability(d: Domain) -> DataFrame:
    return classes(d)


# ----------------------------------------------------------------- baskets


def brand_members(d: Domain) -> DataFrame:
    brands = d.raw("part").select(F.col("p_partkey").alias("menu_item_id"), F.col("p_brand").alias("brand"))
    lines, done = ranges.spread(d.items.count(), "order_id", d.items.select("order_id", "menu_item_id"), reports.completed(d.orders).select("order_id"))
    return baskets.membership(lines.join(done, "order_id").join(brands, "menu_item_id"), "order_id", "brand")


@query
def basket_pairs(d: Domain) -> DataFrame:
    return baskets.with_metrics(baskets.pair_counts(brand_members(d)))


@query
def basket_rules(d: Domain) -> DataFrame:
    return baskets.rules(brand_members(d), least=20, min_confidence=0.10)


@query
def directional_rules(d: Domain) -> DataFrame:
    return baskets.directional(baskets.rules(brand_members(d), least=20, min_confidence=0.05), 0.10, 1.0)


@query
def basket_sizes(d: Domain) -> DataFrame:
    return baskets.sizes(brand_members(d))


@query
def support_lift_recheck(d: Domain) -> DataFrame:
    return compare.support_lift_recheck(baskets.with_metrics(baskets.pair_counts(brand_members(d), 2)))


# --------------------------------------------------------------- customers


@query
def customer_rfm(d: Domain) -> DataFrame:
    return longs(customers.rfm(d.orders), "recency_days", "r_score", "f_score", "m_score")


@query
def customer_rfm_full(d: Domain) -> DataFrame:
    return longs(customers.rfm_full(d.customers, d.orders), "recency_days", "r_score", "f_score", "m_score")


@query
def segment_summary(d: Domain) -> DataFrame:
    return customers.segment_summary(customers.rfm_full(d.customers, d.orders))


def sold(d: Domain) -> DataFrame:
    return features.lines(net(d, drop_unclear=False))


@query
def customer_features(d: Domain) -> DataFrame:
    return longs(customers.features(d.customers, d.orders, features.members(sold(d))), "favourite_hour")


@query
def favourite_value(d: Domain) -> DataFrame:
    return ranking.top_value(customers.visits(d.orders), "customer_id", "ordering_channel", "favourite_channel")


@query
def customer_month(d: Domain) -> DataFrame:
    return customers.months(d.orders, features.members(sold(d))).withColumn("categories", F.array_join("categories", ","))


@query
def disengagement_labels(d: Domain) -> DataFrame:
    rows = customers.disengagement(customers.months(d.orders, features.members(sold(d))))
    return longs(rows.select("customer_id", "month", "orders", "spend", "visit_days", "promo_share", "category_count", "gap_days", "label"), "category_count", "gap_days", "label")


@query
def repeat_buyers(d: Domain) -> DataFrame:
    return customers.repeat_buyers(features.members(sold(d)), rows=d.items.count())


# ------------------------------------------------- waste, prices, anomalies


@query
def wastage_dimensions(d: Domain) -> DataFrame:
    return wastage.dimensions(d.wastage, d.menu, d.categories, d.restaurants)


@query
def wastage_ranking(d: Domain) -> DataFrame:
    return wastage.ranking(d.wastage)


@query
def wastage_shares(d: Domain) -> DataFrame:
    return wastage.shares(d.wastage, "reason")


@query
def price_sensitivity(d: Domain) -> DataFrame:
    return pricing.price_sensitivity(net(d), d.prices, days=700)


@query
def promotion_traps(d: Domain) -> DataFrame:
    return promotions.promotion_traps(net(d), d.orders, d.promotions)


@query
def rating_anomalies(d: Domain) -> DataFrame:
    return anomalies.rating_anomalies(d.ratings, least=5)


@query
def sales_anomalies(d: Domain) -> DataFrame:
    """Over events: the five types stand for restaurants, so hours repeat often enough."""
    c = F.col
    hits = d.raw("events").select(c("event_type").alias("restaurant_id"), c("event_id").alias("order_id"), c("ts").alias("order_datetime"), F.lit("Completed").alias("order_status"))
    return longs(anomalies.sales_anomalies(hits), "hour_of_week", "median", "mad")


@query
def recommended_actions(d: Domain) -> DataFrame:
    found = baskets.directional(baskets.rules(brand_members(d), least=20, min_confidence=0.05), 0.05, 1.0)
    return recommendations.recommend(found, classes(d), customers.rfm_full(d.customers, d.orders), d.inventory, top=20)


# ------------------------------------------------------------ feature marts


def daily(d: Domain) -> DataFrame:
    return features.daily_item_location(sold(d))


def linked(d: Domain) -> DataFrame:
    """Ratings with their orders; some customers agree by construction of the key."""
    own = d.orders.select("order_id", F.col("customer_id").alias("_c"), F.col("restaurant_id").alias("_r"))
    some = d.ratings.join(own, "order_id", "left")
    same = F.col("rating_id") % 4 != 0
    fitted = some.withColumns({"customer_id": F.when(same, F.col("_c")).otherwise(F.col("customer_id")), "restaurant_id": F.when(same, F.col("_r")).otherwise(F.col("restaurant_id")), "rating_date": F.date_sub("rating_date", 9000 - 8500 * (F.col("rating_id") % 2).cast("int"))}).drop("_c", "_r")
    # Dates lie on either side of the purchases.
    moved = fitted.withColumn("rating_date", F.when(F.col("rating_id") % 2 == 1, F.lit("2001-07-30").cast("date")).otherwise(F.lit("1997-06-15").cast("date")))
    return features.linked_ratings(moved, d.orders, features.as_of_day(d.orders))


@query
def menu_features(d: Domain) -> DataFrame:
    lines = kept(sold(d), "lines")
    rated = features.item_ratings(linked(d), features.members(lines))
    return features.menu_features(features.catalog(d.menu, d.categories).select("menu_item_id", "item_name", "category_name"), lines, rated, d.wastage, features.as_of_day(d.orders))


@query
def daily_item_location(d: Domain) -> DataFrame:
    return daily(d)


@query
def daily_demand_union(d: Domain) -> DataFrame:
    return features.daily_demand(daily(d))


@query
def location_menu(d: Domain) -> DataFrame:
    return features.location_menu(daily(d))


@query
def peak_periods(d: Domain) -> DataFrame:
    return longs(features.peak_periods(d.orders), "weekday", "hour")


@query
def customer_order_history(d: Domain) -> DataFrame:
    return features.order_history(d.orders)


@query
def wastage_daily(d: Domain) -> DataFrame:
    return features.wastage_daily(d.wastage, features.as_of_day(d.orders))


@query
def wastage_reasons(d: Domain) -> DataFrame:
    return features.wastage_reasons(d.wastage)


@query
def full_outer_alignment(d: Domain) -> DataFrame:
    return features.aligned(daily(d), features.wastage_daily(d.wastage, features.as_of_day(d.orders)))


@query
def weekly_operations(d: Domain) -> DataFrame:
    return features.weekly_operations(full_outer_alignment(d))


@query
def wastage_inventory_alignment(d: Domain) -> DataFrame:
    return features.wastage_inventory_alignment(features.wastage_daily(d.wastage, features.as_of_day(d.orders)), d.inventory, daily(d))


@query
def rating_events(d: Domain) -> DataFrame:
    return longs(features.rating_events(linked(d)), "promoted")


@query
def rating_context(d: Domain) -> DataFrame:
    return longs(features.rating_context(features.item_ratings(linked(d), features.members(sold(d)))), "promoted")


@query
def transaction_quality(d: Domain) -> DataFrame:
    odd = d.orders.withColumn("discount_amount", F.col("discount_amount") - 1.0)
    return reports.transaction_quality_candidates(odd).select("order_id", "subtotal", "discount_amount", "final_amount")


@query
def weekday_encodings(d: Domain) -> DataFrame:
    return longs(features.weekday_names(d.orders), "sunday_1", "monday_0", "sunday_0", "iso")


# ---------------------------------------------------------------- quality


def line_source(d: Domain) -> DataFrame:
    """Lines as a source-preserving scan gives them: all text; some quantities fall below one."""
    text = lambda c: F.col(c).cast("string").alias(c)
    rows = d.items.withColumn("quantity", F.col("quantity") - 2)
    return rows.select("*", F.lit(None).cast("string").alias("special_request")).select(*(text(c) for c in ("order_item_id", "order_id", "menu_item_id", "quantity", "unit_price", "item_discount", "line_total", "special_request")))


def line_parents(d: Domain) -> dict[str, DataFrame]:
    as_text = lambda df, c: df.select(F.col(c).cast("string").alias(c))
    return {"orders": as_text(reports.completed(d.orders), "order_id"), "menu_items": as_text(d.menu, "menu_item_id")}


def judged(d: Domain) -> quality.Validated:
    return quality.validate(line_source(d), "order_items", line_parents(d))


@query
def validate_reasons(d: Domain) -> DataFrame:
    return judged(d).rule_counts()


@query
def accepted_rows(d: Domain) -> DataFrame:
    return longs(judged(d).accepted.select("order_item_id", "order_id", "menu_item_id", "quantity"), "quantity")


@query
def quarantined_rows(d: Domain) -> DataFrame:
    return judged(d).quarantined.select("order_item_id", "quantity", "unit_price", F.array_join("_quality_reasons", ",").alias("reasons")).withColumn("quantity", F.col("quantity").cast("long"))


@query
def fk_orphans(d: Domain) -> DataFrame:
    no_lines = quality.orphans(d.orders, "order_id", d.items, "order_id").select(F.lit("orders without lines").alias("relation"), F.col("order_id").alias("id"))
    idle = quality.orphans(d.customers, "customer_id", reports.completed(d.orders), "customer_id").select(F.lit("customers without orders").alias("relation"), F.col("customer_id").alias("id"))
    return no_lines.unionByName(idle)


@query
def profile_counts(d: Domain) -> DataFrame:
    lines = d.items.select("order_item_id", "order_id", "menu_item_id", "quantity", "unit_price", "item_discount", "line_total")
    return quality.profile(lines, ["order_item_id"], quality.table_anomalies("order_items"))


@query
def profile_orders(d: Domain) -> DataFrame:
    return quality.profile(d.orders, ["order_id"], {k: v for k, v in quality.table_anomalies("orders").items() if k != "unexpected_payment_method"})


@query
def repair_ratings(d: Domain) -> DataFrame:
    rows = d.ratings.withColumn("delivery_rating", F.lit(None).cast("double"))
    return longs(quality.repaired(rows, "ratings")[0].select("rating_id", "rating", "food_rating", "service_rating"), "rating", "service_rating")


def unique_lines(d: Domain) -> DataFrame:
    q = (F.max("quantity") - 2).alias("quantity")
    return d.items.groupBy("order_item_id").agg(q, F.max("unit_price").alias("unit_price"), F.max("item_discount").alias("item_discount"), F.max("line_total").alias("line_total"))


@query
def repair_line_total(d: Domain) -> DataFrame:
    rows = quality.repaired(unique_lines(d), "order_items")[0]
    return longs(rows.select("order_item_id", "quantity", F.col("line_total").isNotNull().alias("has_total")), "quantity")


@query
def repair_audit(d: Domain) -> DataFrame:
    return quality.repaired(unique_lines(d), "order_items")[1]


# ----------------------------------------------------------------- panels


def hourly(d: Domain) -> DataFrame:
    at = F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")
    return d.raw("events").groupBy("event_type", at).agg(F.count(F.lit(1)).alias("orders"))


def hourly_facts_panel(d: Domain) -> DataFrame:
    return panels.dense(hourly(d), ["event_type"], "hour", "1 hour", ["orders"])


def hourly_panel(d: Domain) -> DataFrame:
    return panels.lags(hourly_facts_panel(d), ["event_type"], "hour", "orders", (1, 24, 168))


@query
def hourly_panel_lags(d: Domain) -> DataFrame:
    return hourly_panel(d)


def weekly_facts(d: Domain) -> DataFrame:
    week = F.to_date(F.date_trunc("week", F.col("wastage_date"))).alias("week")
    rows = d.wastage.join(d.menu.select("menu_item_id", "category_id"), "menu_item_id")
    return rows.groupBy("restaurant_id", "category_id", week).agg(F.sum(F.col("quantity_wasted").cast("long")).alias("waste"))


def weekly_panel(d: Domain) -> DataFrame:
    facts = weekly_facts(d)
    places = d.restaurants.select("restaurant_id").crossJoin(d.categories.select("category_id"))
    return panels.dense(facts, ["restaurant_id", "category_id"], "week", "7 days", ["waste"], entities=places)


@query
def weekly_rolling_features(d: Domain) -> DataFrame:
    entity = ["restaurant_id", "category_id"]
    rows = panels.lags(weekly_panel(d), entity, "week", "waste", (1,))
    return panels.past_means(rows, entity, "week", "waste", (4, 12))


@query
def next_target_lead(d: Domain) -> DataFrame:
    return panels.next_value(weekly_panel(d), ["restaurant_id", "category_id"], "week", "waste", "next_waste")


# ------------------------------------------------------------------ others


@query
def latest_snapshot(d: Domain) -> DataFrame:
    return ranking.latest(d.raw("events").select("user_id", "ts", "event_id", "event_type", "value"), ["user_id"], ["ts", "event_id"])


@query
def every_nth_sample(d: Domain) -> DataFrame:
    return ranges.every_nth(d.raw("events").select("event_type", "event_id"), ["event_id"], 5, ["event_type"])


@query
def share_of_total(d: Domain) -> DataFrame:
    rows = net_item_revenue(d).join(d.menu.select("menu_item_id", "category_id"), "menu_item_id").groupBy("category_id").agg(fixed_sum("revenue", 4).alias("revenue"))
    return rows.withColumn("revenue_share", share(F.col("revenue")))


@query
def location_category_matrix(d: Domain) -> DataFrame:
    """Revenue of each city by category, categories as columns."""
    rows = net(d).join(d.restaurants.select("restaurant_id", "city"), "restaurant_id")
    return rows.groupBy("city").pivot("category_id", ["ECONOMY", "SMALL", "STANDARD"]).agg(fixed_sum("net_revenue", 4)).withColumnsRenamed({"ECONOMY": "economy", "SMALL": "small", "STANDARD": "standard"})


@query
def tolerance_compare(d: Domain) -> DataFrame:
    """Brand totals exactly and as plain doubles, metric by metric."""
    exact = d.items.groupBy("menu_item_id").agg(fixed_sum("line_total").alias("amount"), F.count(F.lit(1)).alias("n"))
    plain = d.items.where("menu_item_id % 10 <> 3").groupBy("menu_item_id").agg((F.sum("line_total") + F.when(F.col("menu_item_id") % 10 == 4, 1.0).otherwise(0.0)).alias("amount"), F.count(F.lit(1)).alias("n"))
    rows = compare.compare(exact, plain, ["menu_item_id"], {"amount": 0.005, "n": 0.0})
    return rows.select("menu_item_id", "metric", "left", "status", "passed")


@query
def whatif_price(d: Domain) -> DataFrame:
    items = d.menu.select("menu_item_id", F.col("base_price").alias("price"), F.col("cost_price").alias("unit_cost")).join(net_item_revenue(d).select("menu_item_id", F.col("units_sold").alias("units")), "menu_item_id")
    return whatif.price(items, 0.10, -1.0)


@query
def item_findings(d: Domain) -> DataFrame:
    """Profiles from item economics; scaled so that each kind of finding can occur."""
    c = F.col
    rows = classes(d).where("units_sold is not null")
    profile = rows.select(
        "menu_item_id", c("units_sold").alias("units"), c("contribution_margin_pct").alias("margin_pct"), c("waste_ratio"), (c("menu_item_id") % 6).cast("double").alias("rating"),
        (c("menu_item_id") % 40).cast("double").alias("history_days"), (c("menu_item_id") % 10 / 10.0).alias("promo_share"), (c("menu_item_id") % 3 / 4.0).alias("peak_month_share"),
    )
    out = findings.item_findings(profile)
    return out.select("menu_item_id", "item_class", F.array_join("findings", ",").alias("findings"))


@query
def scale_group_aggregate(d: Domain) -> DataFrame:
    return expand.group_totals(d.items, "menu_item_id", "quantity", "line_total")


@query
def union_expand(d: Domain) -> DataFrame:
    source = d.orders.select("order_id", "customer_id")
    n = source.count()
    return expand.expand(source, "order_id", 2 * n + 7, n)


@query
def catalog_view(d: Domain) -> DataFrame:
    """The served form of a mart: filtered without regard to case, nulls first when descending."""
    served = catalog.ReportCatalog({"menu": menu_profitability(d).select("menu_item_id", "item_name", "category_id", "units_sold", "performance_class")})
    return served.view("menu", equals={"category_id": "economy"}, contains={"item_name": "RED"}, limit=1000)


# --------------------------------------------------- models and streaming


def event_days(d: Domain) -> DataFrame:
    return d.raw("events").groupBy(F.col("event_type").alias("entity"), F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("units"))


def channel_days(d: Domain) -> DataFrame:
    return d.orders.groupBy(F.col("ordering_channel").alias("entity"), F.to_date("order_datetime").alias("day")).agg(F.count(F.lit(1)).alias("units"))


@query
def naive_rollout(d: Domain) -> DataFrame:
    """The seasonal-naive baseline alone: each day repeats the one a week before."""
    from ..models import forecast

    out = forecast.rollout(forecast.daily_panel(event_days(d)), forecast.naive, 28)
    return longs(out.select("entity", "day", "horizon_day", "baseline"), "horizon_day")


@query
def forecast_errors(d: Domain) -> DataFrame:
    """Summary of the errors of the week-before prediction on the hourly panel."""
    rows = hourly_panel(d).where("orders_lag_168 is not null").select(F.col("orders").cast("double").alias("actual"), F.col("orders_lag_168").cast("double").alias("predicted"))
    return compare.error_summary(rows, "actual", "predicted").select("n", "median_error", "p90_error", "max_error", "within_0_5", "within_1_0", "within_2_0")


@query
def threshold_sweep(d: Domain) -> DataFrame:
    """Confusion counts over 19 thresholds of an event value as a score of purchases."""
    from ..models import evaluate

    scored = d.raw("events").select((F.least(F.col("value"), F.lit(99.0)) / 100.0).alias("probability_positive"), (F.col("event_type") == "purchase").cast("int").alias("label"))
    return evaluate.threshold_sweep(scored).select(F.round(F.col("threshold") * 20).cast("long").alias("twentieths"), "tp", "fp", "fn", "tn")


@query
def hourly_stream(d: Domain) -> DataFrame:
    """Closed hours of the events table, counted by a streaming query that runs to its end."""
    from uuid import uuid4

    from ..sources.shared import shared_dir
    from ..streaming import hourly as stream

    spark = d.spark
    path = f"{shared_dir(spark)}/stream-{uuid4().hex[:12]}"
    like = d.raw("events")
    counts = stream.hourly_counts(stream.source(spark, d.dir, "events.parquet", like))
    stream.write(counts, f"{path}/out", f"{path}/state").awaitTermination()
    return spark.read.schema(counts.schema).parquet(f"{path}/out")
