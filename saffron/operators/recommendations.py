"""Evidence-backed recommendations: one table from four marts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import latest, top_n

# Actions for classes and segments.
CLASS_ACTIONS = {"Hidden Opportunity": "test targeted visibility", "Low Performer": "review placement, cost and demand before removal", "Volume Driver": "review portion and cost"}
SEGMENT_ACTIONS = {"At risk (90d inactive)": "retention offer", "High-value loyal": "loyalty recognition", "One-time customer": "repeat-visit offer"}
OTHER_SEGMENT = "tailor communication to engagement"


def _case(column: str, cases: dict[str, str], other: str | None = None) -> Column:
    out = F.lit(other).cast("string")
    for k, v in cases.items():
        out = F.when(F.col(column) == k, F.lit(v)).otherwise(out)
    return out


def _row(source: str, action: Column, subject: Column, metric: str, evidence: Column) -> list[Column]:
    return [F.lit(source).alias("source"), action.alias("action"), subject.cast("string").alias("subject"), F.lit(metric).alias("metric"), evidence.cast("double").alias("evidence")]


def recommend(directional: DataFrame, menu_classes: DataFrame, scored: DataFrame, inventory: DataFrame, top: int = 100) -> DataFrame:
    """(source, action, subject, metric, evidence); numbers stay numbers.

    Only the direction of a rule that was found is named; of rules the ``top`` by
    lift and pairs, of stock the latest record of each place and item.
    """
    best = top_n(directional.where("lift > 1"), [F.desc("lift"), F.desc("pair_count"), F.asc("antecedent"), F.asc("consequent")], top)
    baskets = best.select(*_row("basket association", F.lit("cross-sell"), F.concat_ws(" > ", F.col("antecedent").cast("string"), F.col("consequent").cast("string")), "lift", F.col("lift")))
    wanted = menu_classes.where(F.col("performance_class").isin(*CLASS_ACTIONS))
    menu = wanted.select(*_row("menu profitability", _case("performance_class", CLASS_ACTIONS), F.col("menu_item_id"), "margin_pct", F.col("contribution_margin_pct")))
    segments = scored.groupBy("behavior_segment").agg(F.count(F.lit(1)).alias("n"))
    people = segments.select(*_row("customer behavior", _case("behavior_segment", SEGMENT_ACTIONS, OTHER_SEGMENT), F.col("behavior_segment"), "customers", F.col("n")))
    now = latest(inventory.select("restaurant_id", "menu_item_id", "record_date", "inventory_id", "closing_stock", "stock_status"), ["restaurant_id", "menu_item_id"], ["record_date", "inventory_id", "closing_stock"])
    stock = now.where("stock_status = 'Low'").select(*_row("inventory status", F.lit("review replenishment"), F.concat_ws(" @ ", F.col("menu_item_id").cast("string"), F.col("restaurant_id").cast("string")), "closing_stock", F.col("closing_stock")))
    return baskets.unionByName(menu).unionByName(people).unionByName(stock)
