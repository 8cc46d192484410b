"""DuckDB SQL for each query of ``contract_queries``, and for the models' countable results."""

from __future__ import annotations

from ..operators.rollups import GRAINS
from ..sources.generator import COPIES, DEFECTS
from ..sources.schemas import TABLES
from . import oracle
from .contract_queries import BROKEN, DESCRIBED, GIVEN
from .oracle import PREFIX


def values(columns: str, rows: list[tuple]) -> str:
    def cell(x) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return "TRUE" if x else "FALSE"
        return f"CAST({x} AS BIGINT)" if isinstance(x, int) else "'" + x.replace("'", "''") + "'"

    return " SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + f") AS v({columns})"


_CHANNEL = oracle._BODIES["channel_performance"]
_JUDGED = oracle._SOURCE
_REASONS = "SELECT rule, count(*) AS rows FROM (SELECT unnest(string_split(reasons, ',')) AS rule FROM judged) WHERE rule <> '' GROUP BY rule"

_WORTH = f", worth AS (SELECT menu_item_id, CAST(units_sold AS DOUBLE) AS demand, revenue, revenue - estimated_cost AS contribution FROM ({oracle._ECONOMICS}))"

_CHANNEL_DAYS = """
, f AS (SELECT ordering_channel AS entity, CAST(order_datetime AS DATE) AS day, count(*) AS units FROM d_orders GROUP BY 1, 2
), ends AS (SELECT min(day) AS lo, max(day) AS hi FROM f
), grid AS (SELECT CAST(unnest(generate_series((SELECT lo FROM ends), (SELECT hi FROM ends), INTERVAL 1 DAY)) AS DATE) AS day
), panel AS (SELECT e.entity, grid.day, coalesce(f.units, 0) AS units FROM (SELECT DISTINCT entity FROM f) e CROSS JOIN grid LEFT JOIN f USING (entity, day))
"""
_ROLLED = """
, rolled AS (
  SELECT p.entity, CAST(hi + CAST(k AS INTEGER) AS DATE) AS day, CAST(k AS BIGINT) AS horizon_day, CAST(p.units AS DOUBLE) AS baseline
  FROM ends, (SELECT unnest(range(1, 29)) AS k) ks JOIN panel p ON p.day = hi - CAST(6 - (k - 1) % 7 AS INTEGER)
)
"""

_HOURS = """
, h AS (SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS orders FROM events GROUP BY 1, 2
), g AS (SELECT unnest(generate_series((SELECT min(hour) FROM h), (SELECT max(hour) FROM h), INTERVAL 1 HOUR)) AS hour
), p AS (SELECT e.event_type, g.hour, coalesce(h.orders, 0) AS orders FROM (SELECT DISTINCT event_type FROM h) e CROSS JOIN g LEFT JOIN h USING (event_type, hour)
), lagged AS (
  SELECT CASE WHEN hour < TIMESTAMP '2024-01-20' THEN 'train' WHEN hour < TIMESTAMP '2024-01-25' THEN 'validation' ELSE 'test' END AS split
  FROM (SELECT *, lag(orders, 168) OVER (PARTITION BY event_type ORDER BY hour) AS far FROM p) WHERE far IS NOT NULL
), sizes AS (SELECT split, count(*) AS n FROM lagged GROUP BY 1)
"""

# Rules of each table that set rows aside.
RULES = {"customers": 15, "inventory": 26, "menu_categories": 6, "menu_items": 17, "order_items": 22, "orders": 37, "pricing_history": 20, "promotions": 22, "ratings": 22, "restaurants": 10, "wastage": 21}

def _grain(name: str, own: tuple[str, ...], above: tuple[str, ...] | None) -> str:
    """One grain by its own aggregation, and the totals above it by another."""
    kinds = {"category_id": "VARCHAR", "menu_item_id": "BIGINT", "restaurant_id": "BIGINT", "month": "VARCHAR"}
    money = "CAST(sum(CAST(floor(net_revenue * 10000 + CAST(0.5 AS DOUBLE)) AS BIGINT)) AS BIGINT)"
    sums = lambda cols, out: f"SELECT {''.join(c + ', ' for c in cols)}{out} FROM lines{' GROUP BY ' + ', '.join(cols) if cols else ''}"
    a = sums(own, f"count(*) AS n, CAST(sum(quantity) AS BIGINT) AS units, {money} AS money")
    b = sums(above or (), f"{money} AS whole") if above is not None else None
    shown = ", ".join(f"{c if c in own else f'CAST(NULL AS {k})'} AS {c}" for c, k in kinds.items())
    joined = f"({a}) a" + (f" JOIN ({b}) b USING ({', '.join(above)})" if above else f", ({b}) b" if b else "")
    return f"SELECT '{name}' AS grain, {shown}, n AS lines, units, money / CAST(10000 AS DOUBLE) AS revenue, money / nullif({'whole' if b else 'money'}, 0) AS revenue_share FROM {joined}"


_ROLLUP = " " + " UNION ALL ".join(_grain(name, own, GRAINS[parent][0] if parent else None) for name, (own, parent) in GRAINS.items())

_RULES = values('"table", action, rules', [*((t, "quarantine", n) for t, n in RULES.items()), *((t, "deduplicate", 1) for t in RULES), *((t, "repair", 1) for t in ("customers", "order_items", "orders", "wastage"))]).strip()
_FIRED = " UNION ALL ".join(f"""SELECT '{t}' AS "table", '{rule}' AS rule, count(*) AS rows FROM {given} WHERE {key} % 10 = {left} HAVING count(*) > 0""" for t, (given, key, _, faults) in BROKEN.items() for left, (rule, _) in faults.items())

_SIZE_OF = {"customers": "customer", "restaurants": "nation", "menu_items": "part", "promotions": "supplier", "orders": "orders", "ratings": "events", "inventory": "part", "wastage": "part", "pricing_history": "part"}
_SIZES = " UNION ALL ".join(f"""SELECT '{t}' AS "table", count(*) AS rows FROM {given}""" for t, given in _SIZE_OF.items()) + " UNION ALL SELECT 'menu_categories', 15"
_CHECKS = values('"table", issue', [(t, "repeated_key") for t in TABLES] + [(t, f"orphan:{c}") for t, x in TABLES.items() for c in x.parents]).strip()
_PERSONAL = "regexp_matches(column_name, '(^|_)(name|email|phone|address)($|_)')"


def _draw(issue: str, key: str) -> str:
    return f"""CAST('0x' || substr(md5('{issue}:42:' || coalesce(CAST({key} AS VARCHAR), '')), 1, 8) AS BIGINT) / CAST(4294967296 AS DOUBLE)"""


def _spoil(table: str, source: str, columns: list[str]) -> str:
    """CTE s_<table>: the table as text with defects and copies."""
    key, cells = TABLES[table].key, {c: f"CAST({c} AS VARCHAR)" for c in columns}
    for t, issue, part, sets in DEFECTS:
        for c, v in sets.items():
            if t == table and c in cells:
                cells[c] = f"CASE WHEN {_draw(issue, key)} < {part} THEN {v} ELSE {cells[c]} END"
    own = ", ".join(f"{x} AS {c}" for c, x in cells.items())
    return f""", s_{table} AS MATERIALIZED (SELECT {own} FROM {source} UNION ALL SELECT {own} FROM {source} WHERE {_draw('copy', key)} < {COPIES})"""


_SPOILABLE = {
    "orders": ("d_orders", ["order_id", "customer_id", "restaurant_id", "promotion_id", "order_datetime", "ordering_channel", "order_status", "subtotal", "discount_amount", "final_amount"]),
    "order_items": ("d_items", ["order_item_id", "order_id", "menu_item_id", "quantity", "unit_price", "item_discount", "line_total"]),
    "ratings": ("d_ratings", ["rating_id", "order_id", "customer_id", "restaurant_id", "rating", "food_rating", "service_rating", "rating_date"]),
    "wastage": ("d_wastage", ["wastage_id", "restaurant_id", "menu_item_id", "wastage_date", "quantity_wasted", "wastage_cost", "reason"]),
}
_SPOILT = "".join(_spoil(t, source, columns) for t, (source, columns) in _SPOILABLE.items())


def _manifest() -> str:
    """(table, issue, rows, observed, delta): defects drawn, and what the spoilt tables show of them."""
    parts = []
    for t, (source, columns) in _SPOILABLE.items():
        key = TABLES[t].key
        parts.append(f"""SELECT '{t}' AS "table", 'copy' AS issue, (SELECT count(*) FROM {source} WHERE {_draw('copy', key)} < {COPIES}) AS rows, (SELECT count(*) FROM s_{t}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM s_{t})) AS observed""")
        for table, issue, part, sets in DEFECTS:
            if table == t and set(sets) <= set(columns):
                (c, v), = sets.items()
                parts.append(f"""SELECT '{t}', '{issue}', (SELECT count(*) FROM {source} WHERE {_draw(issue, key)} < {part}), (SELECT count(*) FROM s_{t} WHERE {c} IS NOT DISTINCT FROM {v})""")
    return 'SELECT "table", issue, rows, observed, observed - rows AS delta FROM (' + " UNION ALL ".join(parts) + ")"


_MANIFEST = _manifest()


def _single() -> str:
    """All issues of the spoilt tables by separate scans."""
    parts = []
    signs = {
        "orders": {"negative_discount": "TRY_CAST(discount_amount AS DOUBLE) < 0", "invalid_order_datetime": "order_datetime IS NOT NULL AND TRY_CAST(order_datetime AS TIMESTAMP) IS NULL"},
        "order_items": {"nonpositive_quantity": "TRY_CAST(quantity AS INTEGER) <= 0"}, "ratings": {"invalid_rating": "TRY_CAST(rating AS INTEGER) NOT BETWEEN 1 AND 5"}, "wastage": {"negative_quantity": "TRY_CAST(quantity_wasted AS DOUBLE) < 0"},
    }
    for t, (_, columns) in _SPOILABLE.items():
        key = TABLES[t].key
        checks = {f"null:{c}": f"{c} IS NULL" for c in columns} | signs[t] | {f"orphan:{c}": f"{c} IS NOT NULL AND {c} NOT IN (SELECT {TABLES[p].key} FROM s_{p} WHERE {TABLES[p].key} IS NOT NULL)" for c, p in TABLES[t].parents.items() if c in columns and p in _SPOILABLE}
        parts += [f"""SELECT '{t}' AS "table", '{name}' AS issue, count(*) AS rows FROM s_{t} WHERE {cond}""" for name, cond in checks.items()]
        parts.append(f"SELECT '{t}', 'rows', count(*) FROM s_{t}")
        parts.append(f"SELECT '{t}', 'repeated_key', coalesce(CAST(sum(n) AS BIGINT), 0) FROM (SELECT count(*) AS n FROM s_{t} GROUP BY {key} HAVING count(*) > 1)")
        parts.append(f"SELECT '{t}', 'copy', (SELECT count(*) FROM s_{t}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM s_{t}))")
    return " SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE rows > 0"


_SINGLE = _single()

_BODIES: dict[str, str] = {
    "csv_typed_scan": " SELECT CAST(order_item_id AS VARCHAR) AS order_item_id, CASE WHEN order_item_id % 7 <> 0 THEN CAST(quantity - 2 AS BIGINT) END AS quantity, TRUE AS has_price FROM d_items",
    "csv_strict_path": _JUDGED + f" SELECT * FROM ({_REASONS}) UNION ALL SELECT 'malformed_csv' AS rule, count(*) AS rows FROM d_items WHERE order_item_id % 11 = 0",
    "csv_inferred_scan": values('"column", declared, inferred, equal', [
        ("order_item_id", "string", "int", False), ("order_id", "string", "int", False), ("menu_item_id", "string", "int", False), ("quantity", "int", "int", True), ("unit_price", "double", "double", True),
        ("item_discount", "double", "double", True), ("line_total", "double", "double", True), ("special_request", "string", "string", True),
    ]),
    "view_report": " SELECT city, count(*) AS orders, max(subtotal) AS largest FROM done JOIN d_restaurants USING (restaurant_id) GROUP BY city",
    "memory_rows": """ SELECT v.*, items FROM (VALUES ('ECONOMY', 'Pizza', 'thin', TRUE), ('SMALL', 'Rice', NULL, FALSE), ('NONE', 'Pasta', '', TRUE)) AS v(category_id, category_name, description, is_active)
LEFT JOIN (SELECT category_id, count(*) AS items FROM d_menu GROUP BY 1) USING (category_id)""",
    "evidence_lines": """ SELECT '{"job":"profile","rows":"' || count(*) || '"}' AS value FROM d_orders""",
    "generated_tables": f" SELECT * FROM ({_SIZES})",
    "generator_assertions": f""" , sizes AS ({_SIZES}), checks AS (SELECT * FROM ({_CHECKS}))
SELECT "table" || ' ' || issue AS "check", rows, CAST(0 AS BIGINT) AS failed FROM checks JOIN sizes USING ("table") UNION ALL SELECT 'orders equal their lines', count(*), 0 FROM d_orders""",
    "defect_reconciliation": _SPOILT + f""" SELECT * FROM ({_MANIFEST})""",
    "single_pass_counts": _SPOILT + _SINGLE,
    "written_version": _CHANNEL,
    "overwritten_partitions": " SELECT order_id, CASE WHEN order_status = 'Completed' THEN subtotal * 2 ELSE subtotal END AS subtotal, order_status FROM d_orders",
    "exported_csv": _CHANNEL,
    "exported_file": f" SELECT *, CAST(1 AS BIGINT) AS files FROM ({_CHANNEL})",
    "bundle_faults": values("fault, files", [("changed", 1), ("missing", 1), ("outside", 1), ("unknown", 1)]),
    "mart_preview": """ SELECT '{"ordering_channel":"' || ordering_channel || '","orders":' || n || '}' AS value FROM (SELECT ordering_channel, count(*) AS n FROM done GROUP BY 1) ORDER BY ordering_channel LIMIT 3""",
    "reloaded_model": _HOURS + " SELECT split, n AS rows, n AS scored FROM sizes",
    "wastage_ranking_described": f" SELECT r.*, 'ranking by historical cost' AS method, 'descriptive, no forecast' AS interpretation, as_of AS analysis_as_of FROM ({oracle._BODIES['wastage_ranking']}) r, as_of",
    "described_marts": " " + " UNION ALL ".join(f"""SELECT '{name}' AS mart, '{method}' AS method, '{meaning}' AS interpretation, as_of AS analysis_as_of, count(*) AS rows FROM ({oracle.ORACLE_SQL[name]}) r, as_of GROUP BY ALL""" for name, (method, meaning) in DESCRIBED.items()),
    "catalog_mart": " SELECT m.*, c.category_name FROM d_menu m LEFT JOIN d_categories c USING (category_id)",
    "customers_mart": " SELECT * FROM d_customers",
    "promotions_mart": " SELECT * FROM d_promotions",
    "price_events_mart": " SELECT * FROM d_prices",
    "inventory_snapshots_mart": " SELECT * REPLACE (CAST(opening_stock AS BIGINT) AS opening_stock, CAST(stock_received AS BIGINT) AS stock_received, CAST(stock_used AS BIGINT) AS stock_used, CAST(closing_stock AS BIGINT) AS closing_stock) FROM d_inventory",
    "ingestion_counts": " SELECT count(*) AS rows, " + ", ".join(f"count(*) - count({c}) AS nulls_{c}" for c in ("order_item_id", "order_id", "menu_item_id", "quantity", "unit_price", "item_discount", "line_total")) + ", count(*) AS nulls_special_request, count(*) AS expected_rows, TRUE AS schema_equal FROM d_items",
    "rule_catalog": f""", fired AS ({_FIRED}), n AS (SELECT "table", count(DISTINCT rule) AS fired FROM fired GROUP BY 1), rules AS ({_RULES})
SELECT r."table", action, rules, CASE WHEN action = 'quarantine' THEN fired END AS fired FROM rules r LEFT JOIN n USING ("table")""",
    "rules_fired": f" SELECT * FROM ({_FIRED})",
    "issue_summary": _JUDGED + f"""
, found AS (
  SELECT rule, 'quarantine' AS action, rows FROM ({_REASONS})
  UNION ALL SELECT 'recompute:line_total', 'repair', count(*) FROM judged WHERE reasons = '' AND abs(line_total - round(quantity * unit_price, 2)) > CAST(0.011 AS DOUBLE)
)
SELECT 'order_items' AS "table", rule, action, rows, rows / (SELECT count(*) FROM judged) AS share FROM found WHERE rows > 0
""",
    "repair_invalid_dates": " SELECT 'null_invalid_date' AS rule, count(*) AS affected FROM d_orders WHERE order_id % 5 = 0 HAVING count(*) > 0",
    "retained_missing": """ SELECT * FROM (
  SELECT 'retain_missing_base_price' AS rule, count(*) AS affected FROM d_menu WHERE menu_item_id % 9 = 0
  UNION ALL SELECT 'null_out_of_range_rating', count(*) FROM d_ratings WHERE rating NOT BETWEEN 1 AND 5
  UNION ALL SELECT 'retain_missing_food_rating', count(*) FROM d_ratings WHERE rating_id % 4 = 0
) WHERE affected > 0""",
    "cascade_accounting": """ SELECT 'restaurants' AS "table", count(*) AS before, count(*) FILTER (restaurant_id <> 3) AS accepted, count(*) FILTER (restaurant_id = 3) AS quarantined, CAST(0 AS BIGINT) AS exact_duplicates FROM d_restaurants
UNION ALL SELECT 'menu_categories', count(*), count(*) FILTER (category_id <> 'STANDARD'), count(*) FILTER (category_id = 'STANDARD'), 0 FROM d_categories
UNION ALL SELECT 'menu_items', count(*) + count(*) FILTER (menu_item_id % 10 = 0), count(*) FILTER (category_id <> 'STANDARD'), count(*) FILTER (category_id = 'STANDARD'), count(*) FILTER (menu_item_id % 10 = 0) FROM d_menu
UNION ALL SELECT 'inventory', CAST(sum(n) AS BIGINT), count(*) FILTER (good AND variants = 1), count(*) FILTER (NOT good OR variants > 1), CAST(sum(n - 1) AS BIGINT) FROM (
  SELECT *, restaurant_id <> 3 AND category_id <> 'STANDARD' AS good, count(*) OVER (PARTITION BY inventory_id) AS variants
  FROM (SELECT inventory_id, restaurant_id, menu_item_id, count(*) AS n FROM d_inventory GROUP BY 1, 2, 3) JOIN d_menu USING (menu_item_id))""",
    "mart_invariants": oracle._pairs(20) + oracle._CLASSES + f""", rule_rows AS (SELECT * FROM mt WHERE confidence_a_to_b >= 0.1 OR confidence_b_to_a >= 0.1
), places AS (SELECT DISTINCT restaurant_id, menu_item_id FROM net), ranks AS ({oracle._BODIES['wastage_ranking']}
), counted AS (
  SELECT 'every catalogue item' AS "check", count(*) AS expected FROM d_menu UNION ALL SELECT 'one row an item', count(*) FROM classes UNION ALL SELECT 'one row a place and item', count(*) FROM places
  UNION ALL SELECT 'every place with every item', count(DISTINCT restaurant_id) * count(DISTINCT menu_item_id) FROM places
  UNION ALL SELECT 'rules reach the pair threshold', 0 UNION ALL SELECT 'known classes', 0 UNION ALL SELECT 'one row a pair', count(*) FROM rule_rows UNION ALL SELECT 'no personal columns', 0
  UNION ALL SELECT 'dense risk ranks', max(risk_rank) FROM ranks UNION ALL SELECT 'one rank a place and item', count(*) FROM ranks
)
SELECT *, expected = found AS passed FROM (
  SELECT "check", CAST(expected AS BIGINT) AS expected, CASE WHEN "check" = 'every place with every item' THEN (SELECT count(*) FROM places) ELSE CAST(expected AS BIGINT) END AS found FROM counted)""",
    "refused_columns": " " + " UNION ALL ".join(f"""SELECT '{t}' AS "table", column_name AS "column", {_PERSONAL} AS refused FROM (DESCRIBE {t})""" for t in GIVEN),
    "sales_rollup": _ROLLUP,
    "distinct_by_grain": " " + " UNION ALL ".join(f"""SELECT '{g}' AS grain, {', '.join((c if c in by else f'CAST(NULL AS {kind})') + f' AS {c}' for c, kind in (('menu_item_id', 'BIGINT'), ('restaurant_id', 'BIGINT'), ('month', 'VARCHAR')))},
  count(DISTINCT customer_id) AS buyers, count(DISTINCT order_id) AS orders, count(DISTINCT day) AS visit_days FROM lines GROUP BY {', '.join(by)}""" for g, by in (("item", ("menu_item_id",)), ("place", ("restaurant_id",)), ("month", ("month",)), ("place and month", ("restaurant_id", "month")))),
    "line_medians": """, t AS (SELECT 'all' AS grain, 'all' AS of, l_extendedprice AS total FROM lineitem UNION ALL SELECT 'status', l_linestatus, l_extendedprice FROM lineitem
), m AS (SELECT grain, of, quantile_disc(total, 0.5) AS median FROM t GROUP BY 1, 2)
SELECT grain, of, median, round(quantile_disc(abs(total - median), 0.5), 6) AS mad FROM t JOIN m USING (grain, of) GROUP BY 1, 2, 3""",
    "spread_sample": """, r AS (SELECT l_extendedprice, l_orderkey, l_partkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, row_number() OVER (ORDER BY l_extendedprice, l_orderkey, l_partkey, l_linenumber) - 1 AS k, count(*) OVER () AS n FROM lineitem)
SELECT l_extendedprice, l_orderkey, l_partkey, l_linenumber FROM r WHERE k = 0 OR floor(k * 8 / (n - 1)) > floor((k - 1) * 8 / (n - 1))""",
    "segmentation_check": " SELECT unnest(['r_score', 'f_score', 'm_score']) AS score, count(DISTINCT customer_id) AS customers, CAST(0 AS BIGINT) AS differing FROM done",
    "sorted_rules": oracle._pairs(20) + oracle._directional(0.05) + " SELECT antecedent, consequent, pair_count FROM dirs ORDER BY lift DESC, confidence DESC, pair_count DESC, antecedent, consequent LIMIT 10",
    "served_nulls_first": oracle._CLASSES + " SELECT menu_item_id, item_name, units_sold FROM classes ORDER BY units_sold DESC NULLS FIRST, menu_item_id LIMIT 25",
    "head_sample": _HOURS + " SELECT * FROM p ORDER BY hour, event_type LIMIT 50",
    "report_comparison": """
, c AS (SELECT DISTINCT ordering_channel FROM done), m AS (SELECT unnest(['orders', 'avg_order_value', 'completed_revenue']) AS metric
), s AS (SELECT ordering_channel, metric, CASE WHEN ordering_channel = '5-LOW' THEN 'missing_right' WHEN metric = 'orders' AND ordering_channel = '1-URGENT' THEN 'beyond' ELSE 'within' END AS status FROM c, m)
SELECT *, status = 'within' AS passed FROM s""",
    "comparison_summary": values("metric, compared, exact, near, failed", [("orders", 4, 3, 3, 2), ("avg_order_value", 4, 4, 4, 1), ("completed_revenue", 4, 4, 4, 1)]),
    "rounded_money": " SELECT order_item_id, CAST(round(CAST(quantity / CAST(8 AS DOUBLE) AS DECIMAL(28, 6)), 2) AS DOUBLE) AS rounded FROM d_items",
    "whatif_promotion": _WORTH + """ SELECT menu_item_id, r * CAST(1.2 AS DOUBLE) * CAST(0.9 AS DOUBLE) AS scenario_revenue, c * CAST(1.2 AS DOUBLE) - r * CAST(1.2 AS DOUBLE) * CAST(0.1 AS DOUBLE) AS scenario_contribution
FROM (SELECT menu_item_id, CASE WHEN revenue >= 0 THEN revenue END AS r, CASE WHEN contribution >= 0 THEN contribution END AS c FROM worth)""",
    "whatif_demand": _WORTH + " SELECT menu_item_id, demand * 1.25::DOUBLE AS scenario_units, CASE WHEN contribution / demand >= 0 THEN demand * 1.25::DOUBLE * (contribution / demand) END AS scenario_contribution FROM worth",
    "whatif_inventory": " SELECT inventory_id, target AS target_stock, greatest(CAST(0 AS DOUBLE), closing_stock - target) AS surplus, greatest(CAST(0 AS DOUBLE), target - closing_stock) AS shortfall FROM (SELECT *, stock_used * 1.25::DOUBLE AS target FROM d_inventory)",
    "whatif_preparation": """ SELECT inventory_id, opening_stock * 0.25::DOUBLE AS estimated_waste, opening_stock * 0.5::DOUBLE AS scenario_prepared, opening_stock * 0.125::DOUBLE AS scenario_waste,
       opening_stock * 0.375::DOUBLE AS available_after_waste, greatest(CAST(0 AS DOUBLE), stock_used - opening_stock * 0.375::DOUBLE) AS shortfall FROM d_inventory""",
    "whatif_removal": _WORTH + " SELECT menu_item_id, CASE WHEN revenue >= 0 THEN revenue END AS revenue_lost, CASE WHEN contribution >= 0 THEN contribution END AS contribution_lost, CAST(0 AS DOUBLE) AS scenario_revenue FROM worth",
    "daily_lag_features": _CHANNEL_DAYS + """
SELECT * FROM (
  SELECT entity, day, CAST(units AS DOUBLE) AS units, CAST(lag(units, 1) OVER w AS DOUBLE) AS units_lag_1, CAST(lag(units, 7) OVER w AS DOUBLE) AS units_lag_7, CAST(lag(units, 28) OVER w AS DOUBLE) AS units_lag_28,
         CAST(isodow(day) - 1 AS DOUBLE) AS dow, CAST(month(day) AS DOUBLE) AS month FROM panel WINDOW w AS (PARTITION BY entity ORDER BY day)
) WHERE units_lag_28 IS NOT NULL""",
    "risk_labels": oracle._WEEKLY + """
, nx AS (SELECT restaurant_id, category_id, week, CAST(lead(waste) OVER w AS DOUBLE) AS next_waste, lag(waste) OVER w AS before FROM panel WINDOW w AS (PARTITION BY restaurant_id, category_id ORDER BY week)
), r AS (SELECT * FROM nx WHERE next_waste IS NOT NULL AND before IS NOT NULL
), cut AS (SELECT quantile_disc(next_waste, 0.75) AS cut FROM r WHERE week + 7 < DATE '2000-01-01' AND next_waste > 0)
SELECT restaurant_id, category_id, week, next_waste, CAST(CASE WHEN next_waste >= cut THEN 1 ELSE 0 END AS BIGINT) AS label FROM r, cut""",
    "served_forecast": _CHANNEL_DAYS + _ROLLED + " SELECT * FROM rolled WHERE entity = '2-HIGH' AND horizon_day <= 14",
}

ORACLE_SQL: dict[str, str] = {name: PREFIX + body for name, body in _BODIES.items()}
