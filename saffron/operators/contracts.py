"""Row contracts: the ordered rules of a table, each an id, a description and a Column.

A rule fires where its Column is true; an unknown (null) outcome does not fire.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.schemas import TABLES

TOLERANCE = 0.011
INFINITE = float("inf")


@dataclass(frozen=True)
class Rule:
    id: str
    about: str
    fires: Column


def _not_finite(x: Column) -> Column:
    return F.isnan(x) | (F.abs(x) == INFINITE)


def _orders() -> list[Rule]:
    cancelled = F.col("order_status") == "Cancelled"
    settled = F.col("subtotal") - F.col("discount_amount") + F.col("tax_amount") + F.col("delivery_fee")
    return [
        Rule("discount_exceeds_subtotal", "the discount is at most the subtotal", F.col("discount_amount") > F.col("subtotal")),
        Rule("order_total_mismatch", "subtotal - discount + tax + delivery is the final amount unless cancelled", ~cancelled & (F.abs(F.col("final_amount") - settled) > TOLERANCE)),
        Rule("cancelled_settlement", "a cancelled order settles at zero", cancelled & (F.abs("final_amount") > TOLERANCE)),
    ]


def _lines() -> list[Rule]:
    return [Rule("discount_exceeds_line_value", "the discount is at most quantity times price", F.col("item_discount") > F.col("quantity") * F.col("unit_price"))]


def _promotions() -> list[Rule]:
    return [Rule("percentage_over_100", "a percentage is at most 100", (F.col("discount_type") == "Percentage") & (F.col("discount_value") > 100))]


def _inventory() -> list[Rule]:
    return [Rule("stock_balance", "closing is opening + received - used", F.col("closing_stock") != F.col("opening_stock") + F.col("stock_received") - F.col("stock_used"))]


_OWN = {"orders": _orders, "order_items": _lines, "promotions": _promotions, "inventory": _inventory}


def rules(table: str) -> list[Rule]:
    """Rules on one row; it also has ``_corrupt_record``, ``_key_variants`` and ``_present_<column>``."""
    t = TABLES[table]
    out = [
        Rule("malformed_csv", "the source row parses as CSV", F.col("_corrupt_record").isNotNull()),
        Rule("conflicting_primary_key", "one source row for each key; all variants are set aside", F.col("_key_variants") > 1),
        *(Rule(f"required:{c}", "a value is present and parses", F.col(c).isNull()) for c in t.required),
    ]
    for f in t.schema:
        kind = f.dataType.simpleString()
        if kind != "string":
            out.append(Rule(f"invalid_type:{f.name}", f"a present value parses as {kind}", F.col(f"_present_{f.name}") & F.col(f.name).isNull()))
        if kind == "double":
            out.append(Rule(f"nonfinite:{f.name}", "no NaN and no infinity", _not_finite(F.col(f.name))))
    out += [Rule(f"domain:{c}", f"one of {', '.join(v)}", F.col(c).isNotNull() & ~F.col(c).isin(*v)) for c, v in t.domains.items()]
    out += [Rule(f"positive:{c}", "above zero", F.col(c) <= 0) for c in t.positive]
    out += [Rule(f"nonnegative:{c}", "zero or above", F.col(c) < 0) for c in t.nonnegative]
    if t.date_order:
        out.append(Rule("date_order", f"{t.date_order[1]} is not before {t.date_order[0]}", F.col(t.date_order[1]) < F.col(t.date_order[0])))
    out += _OWN[table]() if table in _OWN else []
    out += [Rule(f"rating_range:{c}", "from 1 to 5", F.col(c).isNotNull() & ~F.col(c).between(1, 5)) for c in t.within_1_to_5]
    if t.derived:
        out.append(Rule("derived_nonfinite", "the derived amount is finite", _not_finite(F.expr(t.derived[1]).cast("double"))))
    return out


def reasons(found: list[Rule]) -> Column:
    """Ids of the rules that fire, in order, as an array.

    Not by a lambda, which would leave compiled code and judge row by row.
    """
    return F.array_except(F.array(*(F.when(F.coalesce(r.fires, F.lit(False)), F.lit(r.id)) for r in found)), F.array(F.lit(None).cast("string")))


def catalog(spark: SparkSession) -> DataFrame:
    """(table, rule, action, about) of every rule of every table."""
    rows = []
    for name, t in TABLES.items():
        rows += [(name, r.id, "quarantine", r.about) for r in rules(name)]
        rows += [(name, f"foreign_key:{c}", "quarantine", f"present values refer to accepted {p}") for c, p in t.parents.items()]
        rows.append((name, "exact_duplicate", "deduplicate", "identical source rows count once"))
        if t.derived:
            rows.append((name, f"recompute:{t.derived[0]}", "repair", f"round({t.derived[1]}, 2)"))
        if t.fill_unknown:
            rows.append((name, f"fill:{t.fill_unknown}", "repair", "a missing value becomes Unknown"))
    return spark.createDataFrame(rows, "table string, rule string, action string, about string")
