"""Data quality: one-pass profiles, orphan checks, repair, strict validation with quarantine."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.schemas import TABLE_ORDER, TABLES
from ..sources.shared import kept
from . import contracts
from .contracts import TOLERANCE
from .ranges import dealt

META = ("_corrupt_record", "_source_file")


class AccountingError(RuntimeError):
    """Rows read differ from rows accepted, set aside and collapsed."""


# ---------------------------------------------------------------- profiles


def count_if(conditions: dict[str, Column]) -> list[Column]:
    return [F.coalesce(F.sum(F.when(F.coalesce(c, F.lit(False)), 1).otherwise(0)), F.lit(0)).cast("long").alias(n) for n, c in conditions.items()]


def profile(df: DataFrame, key: list[str], anomalies: dict[str, Column]) -> DataFrame:
    """One row: rows, nulls of each column, rows in groups of a repeated key, and anomalies.

    All counters come from one scan; only repeated keys need a shuffle.
    """
    nulls = {f"nulls_{c}": F.col(c).isNull() for c in df.columns}
    counted = df.agg(F.count(F.lit(1)).alias("rows"), *count_if(nulls), *count_if(anomalies))
    repeated = df.groupBy(*key).count().where("count > 1").agg(F.coalesce(F.sum("count"), F.lit(0)).cast("long").alias("repeated_key_rows"))
    return counted.crossJoin(F.broadcast(repeated))


def table_anomalies(table: str) -> dict[str, Column]:
    """Counters of a typed table: dates, domains, ranges and totals."""
    t = TABLES[table]
    out = {f"unexpected_{c}": F.col(c).isNotNull() & ~F.col(c).isin(*v) for c, v in t.domains.items()}
    if table == "orders":
        out |= {
            "negative_discount": F.col("discount_amount") < 0, "discount_exceeds_subtotal": F.col("discount_amount") > F.col("subtotal"),
            "cancelled": F.col("order_status") == "Cancelled", "refunded": F.col("order_status") == "Refunded", "invalid_order_datetime": F.col("order_datetime").isNull(),
        }
    if table == "order_items":
        worth = F.col("quantity") * F.col("unit_price")
        out |= {
            "invalid_quantity": F.col("quantity") <= 0, "invalid_price": F.col("unit_price") <= 0, "invalid_item_discount": F.col("item_discount") < 0,
            "discount_exceeds_line_total": F.col("item_discount") > worth, "incorrect_line_total": F.abs(F.col("line_total") - (worth - F.col("item_discount"))) > TOLERANCE,
        }
    out |= {f"invalid_{c}": ~F.col(c).between(1, 5) for c in t.within_1_to_5}
    if table == "wastage":
        out["negative_quantity"] = F.col("quantity_wasted") < 0
    if table == "menu_items":
        out["nonpositive_base_price"] = F.col("base_price") <= 0
    return out


def profile_table(df: DataFrame, table: str) -> DataFrame:
    return profile(df, [TABLES[table].key], table_anomalies(table))


def ingestion_profile(df: DataFrame, table: str, expected_rows: int | None = None) -> DataFrame:
    """One row: rows against those expected, whether the schema is the declared one, and nulls."""
    nulls = {f"nulls_{c}": F.col(c).isNull() for c in df.columns}
    same = [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in TABLES[table].schema]
    rows = df.agg(F.count(F.lit(1)).alias("rows"), *count_if(nulls))
    return rows.withColumns({"expected_rows": F.lit(expected_rows).cast("long"), "schema_equal": F.lit(same)})


def issue_summary(validated: Validated) -> DataFrame:
    """(table, rule, action, about, rows, share): what each rule of a table set aside, repaired or collapsed.

    The machine-readable policy of a table beside what it did to the rows read; every
    rule stands, also without a row.
    """
    policy = contracts.catalog(validated.source_rows.sparkSession).where(F.col("table") == validated.table)
    fact = lambda rule, n=1: F.struct(rule.alias("rule"), F.lit(n).cast("long").alias("rows"))
    done = [F.when(cond, fact(F.lit(n))) for n, cond in validated.repair_conditions().items()] + [F.when(F.col("_copies") > 0, fact(F.lit("exact_duplicate"), F.col("_copies")))]
    facts = F.concat(F.transform("_quality_reasons", lambda r: fact(r)), F.filter(F.array(*done), lambda x: x.isNotNull()))
    done = validated.rows.select(F.explode(facts).alias("x")).groupBy("x.rule").agg(F.sum("x.rows").alias("rows"))
    total = validated.source_rows.agg(F.count(F.lit(1)).alias("_all"))
    rows = F.coalesce("rows", F.lit(0).cast("long"))
    return policy.join(F.broadcast(done), "rule", "left").crossJoin(F.broadcast(total)).select("table", "rule", "action", "about", rows.alias("rows"), F.try_divide(rows, "_all").alias("share"))


def orphans(child: DataFrame, column: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose present reference has no parent."""
    keys = parent.select(F.col(parent_key).alias("_parent")).distinct()
    return child.where(F.col(column).isNotNull()).join(keys, F.col(column) == F.col("_parent"), "left_anti")


def orphan_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(relation, orphans) of every declared reference between the tables given."""
    parts = []
    for name, df in tables.items():
        for column, parent in TABLES[name].parents.items():
            if parent in tables:
                missing = orphans(df, column, tables[parent], TABLES[parent].key)
                parts.append(missing.agg(F.count(F.lit(1)).alias("orphans")).select(F.lit(f"{name}.{column}->{parent}").alias("relation"), "orphans"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ------------------------------------------------------------------ repair


@dataclass(frozen=True)
class Repair:
    """One step: rows that it concerns, and new values of columns for them."""

    rule: str
    concerns: Column
    sets: dict[str, Column]
    needs: frozenset[str] = frozenset()


def null_where(column: str, bad: Column) -> dict[str, Column]:
    return {column: F.when(F.coalesce(bad, F.lit(False)), None).otherwise(F.col(column))}


def repairs(table: str, columns: list[str] | None = None) -> list[Repair]:
    """Steps in order; each sees the values that the ones before it left.

    A step that sets nothing only counts what stays missing. ``columns`` limits the steps
    to those whose columns are there.
    """
    c = F.col
    if columns is not None:
        return [s for s in repairs(table) if s.needs <= set(columns)]
    if table == "customers":
        return [Repair("fill_missing_city", c("city").isNull(), {"city": F.coalesce("city", F.lit("Unknown"))})]
    if table == "orders":
        over = c("discount_amount") > c("subtotal")
        at = "order_datetime"
        return [
            Repair("null_invalid_date", c(at).isNotNull() & c(at).try_cast("timestamp").isNull(), {at: F.when(c(at).try_cast("timestamp").isNotNull(), c(at))}),
            Repair("fill_missing_channel", c("ordering_channel").isNull(), {"ordering_channel": F.coalesce("ordering_channel", F.lit("Unknown"))}),
            Repair("null_negative_discount", c("discount_amount") < 0, null_where("discount_amount", c("discount_amount") < 0)),
            Repair("null_excessive_discount", over, null_where("discount_amount", over)),
        ]
    if table == "order_items":
        worth = c("quantity") * c("unit_price")
        known = c("quantity").isNotNull() & c("unit_price").isNotNull() & c("item_discount").isNotNull()
        due = worth - c("item_discount")
        return [
            *(Repair(f"null_invalid_{x}", c(x) <= 0, null_where(x, c(x) <= 0)) for x in ("quantity", "unit_price")),
            Repair("null_negative_item_discount", c("item_discount") < 0, null_where("item_discount", c("item_discount") < 0)),
            Repair("null_excessive_item_discount", c("item_discount") > worth, null_where("item_discount", c("item_discount") > worth)),
            Repair("null_unverifiable_line_total", ~known & c("line_total").isNotNull(), null_where("line_total", ~known)),
            Repair("recompute_line_total", known & (F.abs(c("line_total") - due) > TOLERANCE), {"line_total": F.when(known, F.round(due, 2))}),
        ]
    if table == "ratings":
        ranged = [Repair(f"null_out_of_range_{x}", ~c(x).between(1, 5), null_where(x, ~c(x).between(1, 5)), frozenset({x})) for x in TABLES[table].within_1_to_5]
        return [*ranged, Repair("retain_missing_food_rating", c("food_rating").isNull(), {})]
    if table == "menu_items":
        return [Repair("retain_missing_base_price", c("base_price").isNull(), {})]
    if table == "wastage":
        return [Repair("null_negative_wastage", c("quantity_wasted") < 0, null_where("quantity_wasted", c("quantity_wasted") < 0))]
    return []


def repaired(df: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """The repaired table without repeated keys, and (rule, affected) of its steps.

    A step's concern is kept as a flag beside the row, so one scan counts them all. Of the
    rows of a key the smallest stays, column by column in their order, so reruns agree.
    """
    steps, key = repairs(table, df.columns), TABLES[table].key
    rows = df.groupBy(key).agg(F.min(F.struct(*df.columns)).alias("_row")).select("_row.*")
    for i, step in enumerate(steps):
        rows = rows.withColumn(f"_step_{i}", F.coalesce(step.concerns, F.lit(False))).withColumns(step.sets)
    counts = rows.agg(F.count(F.lit(1)).alias("_kept"), *count_if({s.rule: F.col(f"_step_{i}") for i, s in enumerate(steps)}))
    before = df.agg(F.count(F.lit(1)).alias("_before"))
    flat = counts.crossJoin(F.broadcast(before)).withColumn("deduplicate_primary_key", F.col("_before") - F.col("_kept"))
    names = ["deduplicate_primary_key", *(s.rule for s in steps)]
    audit = flat.select(F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).cast("long").alias("affected")) for n in names))).alias("x")).select("x.*").where("affected > 0")
    return rows.select(*df.columns), audit


# -------------------------------------------------------------- validation


@dataclass(frozen=True)
class Validated:
    """All source rows but exact copies, each with its reasons; views on them."""

    rows: DataFrame
    table: str
    source_rows: DataFrame

    @property
    def accepted(self) -> DataFrame:
        t = TABLES[self.table]
        good = self.rows.where(F.size("_quality_reasons") == 0)
        if t.derived:
            good = good.withColumn(t.derived[0], F.round(F.expr(t.derived[1]), 2))
        if t.fill_unknown:
            good = good.withColumn(t.fill_unknown, F.coalesce(t.fill_unknown, F.lit("Unknown")))
        return good.select(*t.schema.names)

    @property
    def quarantined(self) -> DataFrame:
        bad = self.rows.where(F.size("_quality_reasons") > 0)
        return bad.select(*TABLES[self.table].schema.names, "_raw_record", *META, "_quality_reasons")

    def rule_counts(self) -> DataFrame:
        """(rule, rows); a row counts for each of its reasons."""
        return self.rows.select(F.explode("_quality_reasons").alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("rows"))

    def repair_conditions(self) -> dict[str, Column]:
        """By repair the accepted rows that it changes."""
        t, good = TABLES[self.table], F.size("_quality_reasons") == 0
        wanted: dict[str, Column] = {}
        if t.derived:
            name, formula = t.derived
            due = F.round(F.expr(formula), 2)
            wanted[f"recompute:{name}"] = good & (F.col(name).isNull() | (F.abs(F.col(name) - due) > TOLERANCE))
        if t.fill_unknown:
            wanted[f"fill:{t.fill_unknown}"] = good & F.col(t.fill_unknown).isNull()
        return wanted

    def repair_counts(self) -> DataFrame:
        wanted = self.repair_conditions()
        names = list(wanted) or ["none"]
        counted = self.rows.agg(*count_if(wanted or {"none": F.lit(False)}))
        return counted.select(F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(f"`{n}`").alias("rows")) for n in names))).alias("x")).select("x.*").where("rows > 0")

    def accounting(self) -> dict[str, int]:
        """Rows read, accepted, set aside and collapsed as exact copies; an imbalance raises."""
        before = self.source_rows.count()
        good = F.size("_quality_reasons") == 0
        n = self.rows.agg(*count_if({"accepted": good, "quarantined": ~good}), F.coalesce(F.sum("_copies"), F.lit(0)).alias("copies")).first()
        out = {"before": before, "accepted": n["accepted"], "quarantined": n["quarantined"], "exact_duplicates": n["copies"]}
        if before != sum(v for k, v in out.items() if k != "before"):
            raise AccountingError(f"{self.table}: {out}")
        return out


#: Buckets of key hashes, and rows of a bucket from which they are dealt by their values, not by their key.
BUCKETS, HOT = 1 << 16, 100_000


def _distinct(source: DataFrame, key: str) -> DataFrame:
    """Source rows but copies, with ``_copies`` and ``_key_variants``: how many different rows have their key.

    Rows without a key have no variants. Rows are shuffled once, by their key, and sorted
    once: copies and variants are neighbours. So that no task gets all rows of a frequent
    key, rows of overfull buckets of keys are grouped by their values first.
    """
    names = [c for c in source.columns if c != "_source_file"]
    blank = F.length(F.trim(F.coalesce(F.col(key), F.lit("")))) == 0
    # A hash of the row keeps rows without a key apart, so they spread over tasks.
    own = F.when(blank, F.concat(F.lit("\0"), F.xxhash64(*names).cast("string"))).otherwise(F.col(key))
    bucket = F.pmod(F.xxhash64(own), F.lit(BUCKETS)).cast("int")
    counts = kept(source.groupBy(bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("n")), "key-buckets")
    hot, total = counts.where(F.col("n") > HOT).select("_bucket"), counts.agg(F.sum("n")).first()[0] or 0
    collapsed = [F.min("_source_file").alias("_source_file"), (F.count(F.lit(1)) - 1).alias("_copies")]
    variants = lambda n: F.when(blank, F.lit(1).cast("long")).otherwise(n).alias("_key_variants")

    def by_key(rows: DataFrame) -> DataFrame:
        each = dealt(rows.withColumn("_own", own), total, "_own").groupBy("_own", *names).agg(*collapsed)
        return each.select(*source.columns, "_copies", variants(F.count(F.lit(1)).over(Window.partitionBy("_own"))))

    if hot.isEmpty():
        return by_key(source)
    # At most BUCKETS rows.
    marked = F.broadcast(hot)
    each = source.join(marked, bucket == F.col("_bucket"), "left_semi").groupBy(*names).agg(*collapsed)
    several = each.where(~blank).groupBy(F.col(key).alias("_variant_of")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    varied = each.join(several, own == F.col("_variant_of"), "left")
    return by_key(source.join(marked, bucket == F.col("_bucket"), "left_anti")).unionByName(varied.select(*source.columns, "_copies", variants(F.coalesce("_n", F.lit(1).cast("long")))))


def validate(source: DataFrame, table: str, parents: dict[str, DataFrame]) -> Validated:
    """Judge each source row of ``table`` (all columns text) by its contract.

    ``parents`` holds the accepted rows of each table that it refers to. Exact copies
    collapse and are counted; every variant of a key that stands on different rows is set
    aside. Rules on one row are judged before parents are joined, so that only what is
    asked of the rows goes through those joins; values are typed and records written after.
    """
    t = TABLES[table]
    names = t.schema.names
    if missing := [c for c in names if c not in source.columns] + [p for p in t.parents.values() if p not in parents]:
        raise ValueError(f"{table} lacks {missing}")
    for c in META:
        source = source if c in source.columns else source.withColumn(c, F.lit(None).cast("string"))
    distinct = _distinct(source.select(*names, *META), t.key)
    text = {c: F.col(f"_text_{c}") for c in names}
    some = {c: F.length(F.trim(x)) > 0 for c, x in text.items()}
    value = {f.name: F.when(some[f.name], text[f.name]) if f.dataType.simpleString() == "string" else F.when(some[f.name], F.trim(text[f.name])).try_cast(f.dataType) for f in t.schema}
    rows = distinct.withColumnsRenamed({c: f"_text_{c}" for c in names})
    typed = rows.withColumns({f"_present_{c}": F.coalesce(some[c], F.lit(False)) for c in names} | value)
    rows = typed.withColumn("_own_reasons", contracts.reasons(contracts.rules(table))).select(*rows.columns, "_own_reasons").drop("_key_variants")
    found = []
    for column, parent in t.parents.items():
        mark = f"_parent_{column}"
        keys = parents[parent].select(F.col(TABLES[parent].key).alias(mark)).distinct()
        rows = rows.join(keys, value[column] == F.col(mark), "left")
        found.append(contracts.Rule(f"foreign_key:{column}", "", value[column].isNotNull() & F.col(mark).isNull()))
    reasons = F.concat("_own_reasons", contracts.reasons(found)) if found else F.col("_own_reasons")
    record = F.to_json(F.struct(*(x.alias(c) for c, x in text.items())), {"ignoreNullFields": "false"})
    return Validated(rows.select(*(x.alias(c) for c, x in value.items()), record.alias("_raw_record"), *META, "_copies", reasons.alias("_quality_reasons")), table, source)


def validate_all(sources: dict[str, DataFrame], keep) -> dict[str, Validated]:
    """Validate parents before children; rejected parents reject their children's references.

    Judged rows are written once, and all that is asked of them comes from there.
    ``keep(df, name)`` stores the accepted rows and gives them back as read, which
    cuts the lineage between tables.
    """
    done: dict[str, Validated] = {}
    accepted: dict[str, DataFrame] = {}
    for table in TABLE_ORDER:
        if table in sources:
            judged = validate(sources[table], table, accepted)
            done[table] = Validated(kept(judged.rows, f"judged-{table}"), table, judged.source_rows)
            accepted[table] = keep(done[table].accepted, table)
    return done
