"""Invariants of marts, each a row (check, expected, found, passed)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import personal_columns


def _row(df: DataFrame, name: str, expected, found) -> DataFrame:
    out = df.select(F.lit(name).alias("check"), expected.cast("long").alias("expected"), found.cast("long").alias("found"))
    return out.withColumn("passed", F.col("expected") == F.col("found"))


def same_rows(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
    """Both tables have as many rows."""
    n = lambda df, c: df.agg(F.count(F.lit(1)).alias(c))
    return _row(n(left, "l").crossJoin(n(right, "r")), name, F.col("l"), F.col("r"))


def unique_key(df: DataFrame, key: list[str], name: str) -> DataFrame:
    """As many distinct keys as rows."""
    per = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    return _row(per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("keys")), name, F.col("rows"), F.col("keys"))


def full_product(df: DataFrame, left: str, right: str, name: str) -> DataFrame:
    """Every combination of two columns' values stands, whatever the number of its rows."""
    pairs = df.groupBy(left, right).count()
    counts = pairs.agg((F.countDistinct(left) * F.countDistinct(right)).alias("all"), F.count(F.lit(1)).alias("pairs"))
    return _row(counts, name, F.col("all"), F.col("pairs"))


def missing_pairs(df: DataFrame, left: str, right: str) -> DataFrame:
    """(left, missing): how many of all values of ``right`` each value of ``left`` lacks; complete ones are left out."""
    pairs = df.select(left, right).distinct()
    total = pairs.agg(F.countDistinct(right).alias("_all"))
    counts = pairs.groupBy(left).agg(F.count(F.lit(1)).alias("_n")).crossJoin(F.broadcast(total))
    return counts.select(left, (F.col("_all") - F.col("_n")).alias("missing")).where("missing > 0")


def at_least(df: DataFrame, column: str, least: int, name: str) -> DataFrame:
    """No value below a bound."""
    return _row(df.agg(F.count(F.when(F.col(column) < least, 1)).alias("below")), name, F.lit(0), F.col("below"))


def histogram(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), column)


def among(df: DataFrame, column: str, allowed: tuple[str, ...], name: str) -> DataFrame:
    """No value but those allowed."""
    return _row(df.agg(F.count(F.when(~F.coalesce(F.col(column).isin(*allowed), F.lit(False)), 1)).alias("other")), name, F.lit(0), F.col("other"))


def dense_ranks(df: DataFrame, value: str, rank: str, name: str) -> DataFrame:
    """As many ranks as distinct values, and the last rank is their number."""
    return _row(df.agg(F.countDistinct(value).alias("values"), F.max(rank).alias("last")), name, F.col("values"), F.col("last"))


def no_personal_columns(marts: dict[str, DataFrame], name: str) -> DataFrame:
    """No mart carries a name, email, phone or address of a person."""
    found = sum(bool(personal_columns(df)) for df in marts.values())
    return _row(next(iter(marts.values())).sparkSession.range(1), name, F.lit(0), F.lit(found))


CLASSES = ("Insufficient history", "Insufficient cost data", "Low Performer", "Profit Driver", "Volume Driver", "Hidden Opportunity")


def mart_checks(menu: DataFrame, profitability: DataFrame, by_location: DataFrame, rules: DataFrame, least_pairs: int, ranked: DataFrame | None = None) -> DataFrame:
    """The standing invariants of the gap marts."""
    parts = [
        same_rows(menu, profitability, "every catalogue item"), unique_key(profitability, ["menu_item_id"], "one row an item"),
        unique_key(by_location, ["restaurant_id", "menu_item_id"], "one row a place and item"),
        full_product(by_location, "restaurant_id", "menu_item_id", "every place with every item"), at_least(rules, "pair_count", least_pairs, "rules reach the pair threshold"),
        among(profitability, "performance_class", CLASSES, "known classes"), unique_key(rules, ["item_a", "item_b"], "one row a pair"),
        no_personal_columns({"profitability": profitability.drop("item_name", "category_name"), "by_location": by_location.drop("item_name"), "rules": rules}, "no personal columns"),
    ]
    if ranked is not None:
        parts += [dense_ranks(ranked, "wastage_cost", "risk_rank", "dense risk ranks"), unique_key(ranked, ["restaurant_id", "menu_item_id"], "one rank a place and item")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
