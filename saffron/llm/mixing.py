"""Mixing sources to target weights, with DataFrame functions only.

Each document gets a hash-random key. Documents are range-sorted by (source,
key), distributed prefix sums of their sizes follow, and each source is cut at
its exact budget; a budget beyond the source's size repeats whole epochs.

Defined results: a null text has size 0; null is a source of its own, listed
last; a source without words takes nothing; rows of equal id and text share a key,
and some of them may be taken while others aren't; an empty table gives no rows. The
query leaves other columns out; ``mixed`` keeps the columns of its input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .durable import durable

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Sources up to which their table is broadcast (a few dozen bytes each).
BROADCAST_SOURCES = 20_000


def word_count(text: Column) -> Column:
    """Number of runs of characters that are no white space."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def random_key(id_col: Column, text: Column) -> Column:
    """The same pseudo-random key on each run."""
    return F.md5(F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit(""))).cast("binary"))


def prefix_sums(df: DataFrame, order: list[Column], sums: dict[str, str], name: str) -> DataFrame:
    """Add, for each new column, the sum of an existing one over the rows before in ``order``.

    Rows are dealt into ranges; totals of ranges give each range its start, and a
    running sum inside the range does the rest. ``order`` must tell all rows apart.
    """
    ranged = durable(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), name)
    totals = ranged.groupBy("_range").agg(*(F.sum(c).alias(f"_{n}") for n, c in sums.items()))
    # One row for each range: bounded by the number of partitions.
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_range", *(F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in sums))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.select("*", *(F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(n) for n, c in sums.items()))
    return summed.join(F.broadcast(starts), "_range").select(*df.columns, *((F.col(n) + F.col(f"_{n}")).alias(n) for n in sums))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) with the words before each source and its target.

    Sources weigh ``weights`` in turn by code point, null last. A common level
    times the weight is the target, except where that exceeds ``max_epochs`` times
    the source; the level is the one at which all targets sum to all sizes.
    """
    by_name = [F.col("source").asc_nulls_last()]
    ranked = prefix_sums(sources.withColumn("_one", F.lit(1).cast("long")), by_name, {"source_start": "source_size", "_rank": "_one"}, "sources")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("_rank") % len(weights) + 1).cast("int"))
    capped = ranked.withColumns({"_weight": weight, "_cap": (F.col("source_size") * max_epochs).cast("double")})
    capped = durable(capped.withColumn("_ratio", F.col("_cap") / F.col("_weight")), "ranked")
    whole = capped.agg(F.sum("source_size").cast("double").alias("_all"), F.sum("_weight").alias("_weights"))
    level = (F.col("_all") - F.col("_caps_before")) / (F.col("_weights") - F.col("_weights_before"))
    steps = prefix_sums(capped, [F.col("_ratio").asc(), F.col("_rank").asc()], {"_caps_before": "_cap", "_weights_before": "_weight"}, "caps")
    first = steps.crossJoin(F.broadcast(whole)).withColumn("_level", level).where("_level <= _ratio")
    found = first.agg(F.min(F.struct("_ratio", "_rank", "_level"))["_level"].alias("_level"))  # one row
    return capped.crossJoin(F.broadcast(found)).select("source", "source_size", "source_start", F.least("_cap", F.col("_weight") * F.col("_level")).alias("target"))


def mixture(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, key, size, source_size, target, taken, before, budget) of each document.

    ``taken`` sums to the rounded target of each source: whole epochs, then the
    documents of lowest key; the one at the cut gives only the words missing.
    """
    text = F.col(text_col).cast("string")
    rows = documents.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        word_count(text).alias("size"), random_key(F.col(id_col), text).alias("key"), F.monotonically_increasing_id().alias("_tie"),
    )
    sized = durable(rows.withColumn("size", F.coalesce("size", F.lit(0).cast("long"))), "sizes")
    sources = durable(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs), "targets")
    placed = prefix_sums(sized, [F.col("source").asc_nulls_last(), F.col("key").asc(), F.col("_tie").asc()], {"_before": "size"}, "placed")
    side = F.broadcast(sources) if sources.count() <= BROADCAST_SOURCES else sources
    own = sources.columns[1:]
    joined = placed.join(side.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).select(*placed.columns, *own)
    budget = F.floor(F.col("target") + 0.5).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size")
    before = F.col("_before") - F.col("source_start")
    last = F.greatest(F.lit(0), F.least(F.col("size"), rest - before))
    return joined.select("doc_id", "source", "key", "size", "source_size", "target", (epochs * F.col("size") + last).cast("long").alias("taken"), before.cast("long").alias("before"), epochs.alias("epochs"), rest.cast("long").alias("rest"))


def mixed(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents of the mix, each as often as the mix repeats it, with the input's columns.

    Documents stay whole: the one at a source's cut is taken where that comes nearer
    to the budget. Each source's cut is a key and how many rows of that key are taken,
    so the texts themselves don't move, but for rows that share the key at a cut.
    """
    plan = mixture(documents, weights, max_epochs, id_col, text_col, source_col).where("size > 0")
    missing = F.col("rest") - F.col("before")
    taken = (missing > 0) & (missing >= F.col("size") - missing)
    cuts = durable(plan.groupBy("source").agg(F.max("epochs").alias("_epochs"), F.max(F.when(taken, F.col("key"))).alias("_cut")), "cuts")
    small = cuts.count() <= BROADCAST_SOURCES
    near = lambda df: F.broadcast(df) if small else df
    side = near(cuts.withColumnRenamed("source", "_source"))
    at_cut = plan.join(side, F.col("source").eqNullSafe(F.col("_source")) & (F.col("key") == F.col("_cut"))).groupBy("source").agg(F.count(F.lit(1)).alias("_sharing"), F.count_if(taken).alias("_taken"))
    at_cut = durable(at_cut, "at-cut").withColumnRenamed("source", "_at")
    shared = not at_cut.where("_sharing > _taken").isEmpty()
    text = F.col(text_col).cast("string")
    # The input's columns travel as one, so that none of them clashes with those added.
    rows = documents.select(F.struct("*").alias("_row"), F.col(source_col).cast("string").alias("_own"), random_key(F.col(id_col), text).alias("_key"), (F.coalesce(word_count(text), F.lit(0)) > 0).alias("_words"))
    kept = rows.where("_words").join(side, F.col("_own").eqNullSafe(F.col("_source")))
    below = F.coalesce(F.col("_key") <= F.col("_cut"), F.lit(False))
    if not shared:
        return _copies(kept, F.col("_epochs") + below.cast("int"))
    split = kept.join(near(at_cut), F.col("_own").eqNullSafe(F.col("_at")), "left")
    on_cut = F.coalesce((F.col("_key") == F.col("_cut")) & (F.col("_sharing") > F.col("_taken")), F.lit(False))
    # Rows of one key are alike in id and text: which of them are taken is told by their number.
    sharing = split.where(on_cut).select("_row", "_own", "_epochs", "_taken").withColumns({"_tie": F.monotonically_increasing_id(), "_one": F.lit(1).cast("long")})
    nth = prefix_sums(sharing, [F.col("_own").asc_nulls_last(), F.col("_tie").asc()], {"_nth": "_one"}, "sharing")
    first = nth.groupBy("_own").agg(F.min("_nth").alias("_first")).withColumnRenamed("_own", "_at")
    nth = nth.join(near(first), F.col("_own").eqNullSafe(F.col("_at")))
    return _copies(split.where(~on_cut), F.col("_epochs") + below.cast("int")).unionByName(_copies(nth, F.col("_epochs") + (F.col("_nth") - F.col("_first") < F.col("_taken")).cast("int")))


def _copies(rows: DataFrame, times: Column) -> DataFrame:
    """The input's rows, each so many times."""
    return rows.withColumn("_times", times.cast("int")).where("_times > 0").select("_row", F.explode(F.array_repeat(F.lit(1), F.col("_times"))).alias("_copy")).select("_row.*")
