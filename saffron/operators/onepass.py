"""Keys, copies, references, nulls and ranges of many tables from one scan of each.

Every row gives facts: its key with a hash of the whole row, each reference to another
table, and the counters that it raises, most rows none. Facts are (space, value), where a
space is a table's keys or its counters; one aggregation, combined before it is shuffled,
holds for each value how many rows have it as key, the least and largest row hash, and
references by relation. All tables of a run share that aggregation, so a key and the
references to it meet without a join.

A key of one row is unique, a key without rows is an orphan. Only rows of repeated keys
are read again, to count copies by their values rather than by hashes; without such
keys nothing is read twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.schemas import TABLES
from ..sources.shared import kept
from .quality import table_anomalies
from .ranges import small


def counters(df: DataFrame, table: str) -> dict[str, Column]:
    """Nulls of every column, and the anomalies of the contract whose columns are there."""
    out = {f"null:{c}": F.col(c).isNull() for c in df.columns}
    for name, cond in table_anomalies(table).items():
        try:
            df.select(cond)
        except Exception as e:  # noqa: BLE001
            if "UNRESOLVED_COLUMN" not in str(e):
                raise
        else:
            out[name] = cond
    return out


def _facts(df: DataFrame, table: str, spaces: list[str], relations: dict[tuple[str, str], int], signs: dict[str, Column]) -> DataFrame:
    """(space, value, kind, slot, hash): kind 0 is a key, 1 a reference, 2 a counter."""
    key = TABLES[table].key
    fact = lambda space, value, kind, slot=0, own=None: F.struct(F.lit(space).alias("space"), value.cast("string").alias("value"), F.lit(kind).alias("kind"), F.lit(slot).alias("slot"), (F.lit(None).cast("long") if own is None else own).alias("hash"))
    found = [fact(table, F.col(key), 0, own=F.xxhash64(*(F.struct(F.col(c).isNull(), F.col(c)) for c in df.columns)))]
    for column, parent in TABLES[table].parents.items():
        if parent in spaces and column in df.columns:
            found.append(F.when(F.col(column).isNotNull(), fact(parent, F.col(column), 1, relations[table, column])))
    found += [F.when(F.coalesce(cond, F.lit(False)), fact(f"#{table}", F.lit(name), 2)) for name, cond in signs.items()]
    # Nulls go after the array is dealt out: a lambda over it would leave compiled code, row by row.
    return df.select(F.explode(F.array(*found)).alias("_fact")).where(F.col("_fact").isNotNull()).select("_fact.*")


def single_pass(tables: dict[str, DataFrame], signs: dict[str, dict[str, Column]] | None = None) -> DataFrame:
    """(table, issue, rows) of all issues with rows: rows, null:<column>, anomalies, repeated_key, copy, orphan:<column>.

    ``repeated_key`` counts the rows whose key stands on several rows (a null key too),
    ``copy`` the rows beyond the first of equal ones, ``orphan`` the rows whose present
    reference has no row in its table.
    """
    spaces = list(tables)
    signs = {t: counters(df, t) for t, df in tables.items()} if signs is None else signs
    relations: dict[tuple[str, str], int] = {}
    taken: dict[str, int] = {}
    for t in spaces:
        for column, parent in TABLES[t].parents.items():
            if parent in spaces and column in tables[t].columns:
                relations[t, column] = taken.get(parent, 0)
                taken[parent] = relations[t, column] + 1
    slots = range(max(taken.values(), default=0))
    facts = None
    for t, df in tables.items():
        part = _facts(df, t, spaces, relations, signs[t])
        facts = part if facts is None else facts.unionByName(part)
    kind = F.col("kind")
    state = facts.groupBy("space", "value").agg(
        F.count_if(kind != 1).alias("n"), F.min("hash").alias("low"), F.max("hash").alias("high"), *(F.count_if((kind == 1) & (F.col("slot") == i)).alias(f"refs_{i}") for i in slots),
    )
    state = kept(state, "key-states")
    rows = lambda name, n, where: F.when(where, F.struct(F.lit(name).alias("issue"), n.alias("rows")))
    parts = [state.where(F.col("space").startswith("#")).select(F.substr("space", F.lit(2)).alias("table"), F.col("value").alias("issue"), F.col("n").alias("rows"))]
    for t in spaces:
        own = state.where((F.col("space") == t))
        told = [rows("rows", F.col("n"), F.col("n") > 0), rows("repeated_key", F.col("n"), F.col("n") > 1)]
        summed = own.select(F.explode(F.filter(F.array(*told), lambda x: x.isNotNull())).alias("x")).groupBy("x.issue").agg(F.sum("x.rows").alias("rows"))
        parts.append(summed.select(F.lit(t).alias("table"), "issue", "rows"))
    for (t, column), slot in relations.items():
        lost = state.where((F.col("space") == TABLES[t].parents[column]) & (F.col("n") == 0)).agg(F.sum(f"refs_{slot}").alias("rows")).where("rows > 0")
        parts.append(lost.select(F.lit(t).alias("table"), F.lit(f"orphan:{column}").alias("issue"), "rows"))
    for t in spaces:
        # Keys that the state marks; two rows of different hashes are no copies.
        marked = kept(state.where((F.col("space") == t) & (F.col("n") > 1) & ((F.col("n") > 2) | (F.col("low") == F.col("high")))).select(F.col("value").alias("_marked")), f"repeated-{t}")
        if marked.isEmpty():
            continue
        again = tables[t].join(small(marked), F.col(TABLES[t].key).cast("string").eqNullSafe(F.col("_marked")), "left_semi")
        copies = again.groupBy(*tables[t].columns).count().where("count > 1").agg(F.sum(F.col("count") - 1).alias("rows")).where("rows > 0")
        parts.append(copies.select(F.lit(t).alias("table"), F.lit("copy").alias("issue"), "rows"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
