"""Market baskets: distinct membership, pairs, association rules, sizes.

A basket's items are gathered once and their pairs unfolded inside the row, so
pairs need one shuffle instead of a self-join. Items below the least pair count
can't be in a pair that reaches it; they go first, without loss. Then pairs are counted
by hash bucket, BUCKETS small numbers whatever the number of pairs: a bucket that stays
below the least count holds no pair that reaches it, so its pairs go before any pair is
shuffled. The pairs that are left are counted exactly. Membership is written once: joins, items,
sizes and pairs would else be one stage, whose tasks hold a sort or hash table for each. A basket's
membership is bounded by the catalogue, and baskets of more than WIDE items
take the self-join, whose rows Spark can spill.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import kept
from .ranges import spread

WIDE = 500
#: Hash buckets of pairs, and those that one row of the bitmap of frequent ones holds.
BUCKETS, WORD = 1 << 22, 64


def membership(lines: DataFrame, basket: str = "order_id", item: str = "menu_item_id") -> DataFrame:
    return lines.select(F.col(basket).alias("basket"), F.col(item).alias("item")).where("basket is not null and item is not null").distinct()


def bucket(a: str = "item_a", b: str = "item_b") -> Column:
    return F.pmod(F.xxhash64(a, b), F.lit(BUCKETS))


def pair_rows(members: DataFrame, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """(item_a, item_b) of every basket with item_a < item_b, and (item, n) of items, of those in ``least`` baskets.

    ``members`` is read several times, so it should be written.
    """
    items = members.groupBy("item").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    left = members.join(items.select("item"), "item") if least > 1 else members
    (left,) = spread(members.count(), "basket", left)
    sizes = left.groupBy("basket").agg(F.count(F.lit(1)).alias("size"), F.when(F.count(F.lit(1)) <= WIDE, F.array_sort(F.collect_list(F.col("item")))).alias("items"))
    narrow = sizes.where(f"size between 2 and {WIDE}")
    # Each item with those after it; the inner list is dealt out in the same row.
    firsts = narrow.select(F.posexplode("items").alias("at", "item_a"), "items")
    pairs = firsts.select("item_a", F.explode(F.slice("items", F.col("at") + 2, F.size("items"))).alias("item_b"))
    wide = left.join(sizes.where(f"size > {WIDE}").select("basket"), "basket")
    crossed = wide.alias("l").join(wide.alias("r"), (F.col("l.basket") == F.col("r.basket")) & (F.col("l.item") < F.col("r.item"))).select(F.col("l.item").alias("item_a"), F.col("r.item").alias("item_b"))
    return pairs.unionByName(crossed), items


def frequent_buckets(pairs: DataFrame, least: int) -> DataFrame:
    """(word, bits): a bitmap of the hash buckets that at least ``least`` pairs fall into; at most BUCKETS / WORD rows."""
    counts = pairs.groupBy(bucket().alias("_bucket")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    return counts.groupBy(F.floor(F.col("_bucket") / WORD).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("_bucket", F.lit(WORD)).cast("int"))).alias("bits"))


def pruned(pairs: DataFrame, least: int) -> DataFrame:
    """Pairs of frequent buckets; the bitmap is broadcast, for its size is bounded."""
    own = pairs.withColumn("_bucket", bucket())
    known = own.join(F.broadcast(frequent_buckets(pairs, least)), F.floor(F.col("_bucket") / WORD) == F.col("word"))
    return known.where(F.getbit("bits", F.pmod("_bucket", F.lit(WORD)).cast("int")) == 1).select(*pairs.columns)


def pair_counts(members: DataFrame, least: int = 1) -> DataFrame:
    """(item_a, item_b, pair_count, count_a, count_b, basket_count) with item_a < item_b."""
    members = kept(members, "members")
    pairs, items = pair_rows(members, least)
    total = members.agg(F.countDistinct("basket").alias("basket_count"))
    left = pruned(pairs, least) if least > 1 else pairs
    counted = left.groupBy("item_a", "item_b").agg(F.count(F.lit(1)).alias("pair_count")).where(F.col("pair_count") >= least)
    named = lambda side: items.select(F.col("item").alias(f"item_{side}"), F.col("n").alias(f"count_{side}"))
    return counted.join(named("a"), "item_a").join(named("b"), "item_b").crossJoin(F.broadcast(total))


def with_metrics(pairs: DataFrame) -> DataFrame:
    n, a, b, all_ = (F.col(c) for c in ("pair_count", "count_a", "count_b", "basket_count"))
    return pairs.withColumns({"support": n / all_, "confidence_a_to_b": n / a, "confidence_b_to_a": n / b, "lift": n * all_ / (a * b)})


def rules(members: DataFrame, least: int = 100, min_confidence: float = 0.10) -> DataFrame:
    """Pairs of at least ``least`` baskets with either confidence reached."""
    found = with_metrics(pair_counts(members, least))
    return found.where((F.col("confidence_a_to_b") >= min_confidence) | (F.col("confidence_b_to_a") >= min_confidence))


def directional(found: DataFrame, min_confidence: float = 0.10, above_lift: float = 1.0) -> DataFrame:
    """Both directions of each rule that reach the confidence with a lift above the bound."""
    way = lambda x, y: found.select(F.col(f"item_{x}").alias("antecedent"), F.col(f"item_{y}").alias("consequent"), "pair_count", "support", F.col(f"confidence_{x}_to_{y}").alias("confidence"), "lift")
    return way("a", "b").unionByName(way("b", "a")).where((F.col("confidence") >= min_confidence) & (F.col("lift") > above_lift))


def rule_text(rows: DataFrame) -> DataFrame:
    """A sentence for each directional rule, for people; numbers to four places."""
    part = lambda c: F.format_number(c, 4)
    said = F.concat(F.lit("Buyers of "), F.col("antecedent").cast("string"), F.lit(" also take "), F.col("consequent").cast("string"), F.lit(": confidence "), part("confidence"), F.lit(", lift "), part("lift"))
    return rows.withColumn("evidence", said).orderBy(F.desc("lift"), F.desc("confidence"), F.desc("pair_count"), "antecedent", "consequent")


def sizes(members: DataFrame) -> DataFrame:
    per = members.groupBy("basket").agg(F.count(F.lit(1)).alias("distinct_items"))
    return per.groupBy("distinct_items").agg(F.count(F.lit(1)).alias("baskets"))
