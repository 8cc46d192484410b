"""DuckDB SQL of the model queries: the same fits from sums, eliminated and iterated in SQL."""

from __future__ import annotations

from ..models.linear import STEPS
from . import contract_oracle, oracle
from .oracle import PREFIX

PENALTY = "CAST(0.001 AS DOUBLE)"


def eliminated(name: str, source: str, n: int, key: str = "") -> str:
    """CTEs ``name`` (key, b): solutions of the systems ``m`` (n rows of n + 1 numbers) of ``source``, by elimination."""
    own = f"{key}, " if key else ""
    row = "list_transform(m[k + 1], lambda v: v / m[k + 1][k + 1])"
    rest = "list_transform(r, lambda v, j: v - r[k + 1] / m[k + 1][k + 1] * m[k + 1][j])"
    return f"""
, {name}_steps AS (
  SELECT {own}0 AS k, m FROM {source}
  UNION ALL SELECT {own}k + 1, list_transform(m, lambda r, i: CASE WHEN i = k + 1 THEN {row} ELSE {rest} END) FROM {name}_steps WHERE k < {n}
), {name} AS MATERIALIZED (SELECT {own}list_transform(m, lambda r: r[{n + 1}]) AS b FROM {name}_steps WHERE k = {n})"""


def penalty(i: int) -> str:
    """Of feature i from 1: in proportion to its variance; a constant one gets no coefficient."""
    s = f"s_{i}_{i}"
    spread = f"({s} - s_0_{i} * s_0_{i} / s_0_0)"
    return f"CASE WHEN {spread} <= CAST(1e-9 AS DOUBLE) * {s} THEN s_0_0 ELSE {PENALTY} * {spread} END"


def cell(i: int, j: int) -> str:
    return f"s_{min(i, j)}_{max(i, j)}"


def regression(name: str, rows: str, features: list[str], target: str, key: str = "", where: str = "") -> str:
    """CTE ``name`` (key, b): ridge regressions of ``rows``."""
    xs = ["CAST(1 AS DOUBLE)", *(f"CAST({f} AS DOUBLE)" for f in features), f"CAST({target} AS DOUBLE)"]
    n = len(features) + 1
    sums = ", ".join(f"sum({xs[i]} * {xs[j]}) AS {cell(i, j)}" for i in range(n + 1) for j in range(i, n + 1))
    lines = ["[" + ", ".join(cell(i, j) + (f" + {penalty(i)}" if i == j and i else "") for j in range(n)) + f", {cell(i, n)}]" for i in range(n)]
    own, group = (f"{key}, ", f" GROUP BY {key}") if key else ("", "")
    return f"""
, {name}_sums AS (SELECT {own}{sums} FROM {rows}{f' WHERE {where}' if where else ''}{group}
), {name}_system AS MATERIALIZED (SELECT {own}[{', '.join(lines)}] AS m FROM {name}_sums)""" + eliminated(name, f"{name}_system", n, key)


def newton(name: str, rows: str, n: int) -> str:
    """CTE ``name`` (b): a logistic regression of ``rows`` (f: n numbers, the first one 1; y; w)."""
    sums = ", ".join(f"sum(w * f[{i + 1}] * f[{j + 1}]) AS {cell(i, j)}" for i in range(n) for j in range(i, n))
    out = f"""
, {name}_pens AS MATERIALIZED (SELECT [CAST(0 AS DOUBLE), {', '.join(penalty(i) for i in range(1, n))}] AS pens FROM (SELECT {sums} FROM {rows})
), {name}_0 AS MATERIALIZED (SELECT [{', '.join(['CAST(0 AS DOUBLE)'] * n)}] AS b)"""
    curve = ", ".join(f"sum(h * f[{i + 1}] * f[{j + 1}]) AS {cell(i, j)}" for i in range(n) for j in range(i, n))
    pull = ", ".join(f"sum(w * (y - p) * f[{i + 1}]) AS g_{i}" for i in range(n))
    lines = ", ".join("[" + ", ".join(cell(i, j) + (f" + pens[{i + 1}]" if i == j else "") for j in range(n)) + f", g_{i} - pens[{i + 1}] * b[{i + 1}]]" for i in range(n))
    for k in range(STEPS):
        out += f"""
, {name}_seen_{k} AS (SELECT f, y, w, p, w * p * (1 - p) AS h FROM (SELECT f, y, w, {probability('b', 'f')} AS p FROM {rows}, {name}_{k})
), {name}_system_{k} AS MATERIALIZED (SELECT b, [{lines}] AS m FROM (SELECT {curve}, {pull} FROM {name}_seen_{k}), {name}_pens, {name}_{k})""" + eliminated(f"{name}_move_{k}", f"{name}_system_{k}", n) + f"""
, {name}_{k + 1} AS MATERIALIZED (SELECT list_transform(s.b, lambda v, i: v + d.b[i]) AS b FROM {name}_system_{k} s, {name}_move_{k} d)"""
    return out + f", {name} AS (SELECT b FROM {name}_{STEPS})"


def probability(b: str, f: str) -> str:
    return f"1 / (1 + exp(-greatest(CAST(-30 AS DOUBLE), least(CAST(30 AS DOUBLE), list_dot_product({f}, {b})))))"


def product(b: str, features: list[str]) -> str:
    return f"{b}[1] + " + " + ".join(f"{b}[{i + 2}] * {f}" for i, f in enumerate(features))


def regression_row(name: str, split: str, source: str, predicted: str) -> str:
    e = f"(orders - {predicted})"
    return f"""SELECT '{name}' AS name, '{split}' AS split, count(*) AS n, round(sqrt(avg({e} * {e})), 6) AS rmse, round(avg(abs({e})), 6) AS mae,
  round(1 - sum({e} * {e}) / nullif(var_pop(orders) * count(orders), 0), 6) AS r2 FROM {source} WHERE split = '{split}'"""


_HOUR_FEATURES = ["lag_1", "lag_24", "lag_168", "hour_of_day", "weekday", "month", "weekend"]
_HOUR_NAMES = ["orders_lag_1", "orders_lag_24", "orders_lag_168", *_HOUR_FEATURES[3:]]
_HOURS = contract_oracle._HOURS.split(", lagged AS (")[0].rstrip().removesuffix(")") + """), x AS MATERIALIZED (
  SELECT event_type, hour, CAST(orders AS DOUBLE) AS orders, CAST(lag(orders, 1) OVER w AS DOUBLE) AS lag_1, CAST(lag(orders, 24) OVER w AS DOUBLE) AS lag_24, CAST(lag(orders, 168) OVER w AS DOUBLE) AS lag_168,
         CAST(hour(hour) AS DOUBLE) AS hour_of_day, CAST(dayofweek(hour) AS DOUBLE) AS weekday, CAST(month(hour) AS DOUBLE) AS month, CAST(isodow(hour) >= 6 AS DOUBLE) AS weekend,
         CASE WHEN hour < TIMESTAMP '2024-01-20' THEN 'train' WHEN hour < TIMESTAMP '2024-01-25' THEN 'validation' ELSE 'test' END AS split
  FROM p WINDOW w AS (PARTITION BY event_type ORDER BY hour)
), hours AS (SELECT * FROM x WHERE lag_168 IS NOT NULL)"""
_DEMAND = _HOURS + regression("early", "hours", _HOUR_FEATURES, "orders", where="split = 'train'") + regression("late", "hours", _HOUR_FEATURES, "orders", where="split <> 'test'")

_DAY_FEATURES = ["units_lag_1", "units_lag_7", "units_lag_28", "dow", "month"]
_DAYS = contract_oracle._CHANNEL_DAYS + """
, days AS MATERIALIZED (SELECT * FROM (
  SELECT entity, day, units, lag(units, 1) OVER w AS units_lag_1, lag(units, 7) OVER w AS units_lag_7, lag(units, 28) OVER w AS units_lag_28, isodow(day) - 1 AS dow, month(day) AS month
  FROM panel WINDOW w AS (PARTITION BY entity ORDER BY day)) WHERE units_lag_28 IS NOT NULL)"""
_ORIGINS = """
, origins AS (SELECT unnest(['1999-06-30', '2000-06-30', '2000-12-31']) AS origin
), by_origin AS (SELECT * FROM origins JOIN days ON day <= CAST(origin AS DATE))""" + regression("models", "by_origin", _DAY_FEATURES, "units", key="origin")


def rolled(models: str, step: str) -> str:
    """CTE ``made`` (origin, last, entity, k, prediction, baseline) of ``models`` (origin, last, b)."""
    return f"""
, past AS (SELECT origin, last, entity, b, list(CAST(units AS DOUBLE) ORDER BY day) AS v FROM {models} JOIN panel ON day <= last AND day > last - 28 GROUP BY ALL
), walk AS (
  SELECT origin, last, entity, b, v, v AS week, 0 AS k FROM past
  UNION ALL SELECT origin, last, entity, b, list_append(v, greatest(CAST(0 AS DOUBLE), {step})), week, k + 1 FROM walk WHERE k < 28
), made AS (SELECT origin, last, entity, CAST(last + CAST(d AS INTEGER) AS DATE) AS day, d AS k, v[28 + d] AS prediction, week[22 + (d - 1) % 7] AS baseline FROM walk, (SELECT unnest(range(1, 29)) AS d) WHERE k = 28)"""


_STEP = "b[1] + b[2] * v[-1] + b[3] * v[-7] + b[4] * v[-28] + b[5] * (isodow(last + CAST(k + 1 AS INTEGER)) - 1) + b[6] * month(last + CAST(k + 1 AS INTEGER))"

_WEEK_FEATURES = ["waste_lag_1", "waste_4", "waste_12", "demand_lag_1", "demand_4", "demand_12", "target_month", "target_week_no"]
_WEEKS = oracle._WEEKLY + """
, sold AS (SELECT restaurant_id, category_id, CAST(date_trunc('week', order_datetime) AS DATE) AS week, CAST(sum(quantity) AS BIGINT) AS demand FROM lines GROUP BY 1, 2, 3
), joined AS (SELECT p.*, coalesce(demand, 0) AS demand FROM panel p LEFT JOIN sold USING (restaurant_id, category_id, week)
), x AS (
  SELECT *, CAST(lag(waste) OVER w AS DOUBLE) AS waste_lag_1, CAST(lag(demand) OVER w AS DOUBLE) AS demand_lag_1, CAST(lead(waste) OVER w AS DOUBLE) AS next_waste, CAST(week + 7 AS DATE) AS target,
         avg(CAST(waste AS DOUBLE)) OVER (w ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS waste_4, avg(CAST(waste AS DOUBLE)) OVER (w ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS waste_12,
         avg(CAST(demand AS DOUBLE)) OVER (w ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS demand_4, avg(CAST(demand AS DOUBLE)) OVER (w ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS demand_12
  FROM joined WINDOW w AS (PARTITION BY restaurant_id, category_id ORDER BY week)
), known AS (SELECT *, CAST(month(target) AS DOUBLE) AS target_month, CAST(week(target) AS DOUBLE) AS target_week_no FROM x WHERE next_waste IS NOT NULL AND waste_lag_1 IS NOT NULL
), cut AS (SELECT quantile_disc(next_waste, 0.75) AS cut FROM known WHERE target < DATE '2000-01-01' AND next_waste > 0
), marked AS (
  SELECT CASE WHEN next_waste >= cut THEN 1 ELSE 0 END AS y, [CAST(1 AS DOUBLE), """ + ", ".join(f"coalesce({f}, CAST(0 AS DOUBLE))" for f in _WEEK_FEATURES) + """] AS f,
         CASE WHEN target < DATE '2000-01-01' THEN 'train' WHEN target < DATE '2000-10-01' THEN 'validation' ELSE 'test' END AS split
  FROM known, cut
), up AS (SELECT count(*) FILTER (y = 0) / count(*) FILTER (y = 1) AS up FROM marked WHERE split = 'train'
), weighed AS MATERIALIZED (SELECT f, CAST(y AS DOUBLE) AS y, split, CASE WHEN y = 1 THEN up ELSE CAST(1 AS DOUBLE) END AS w FROM marked, up
), train AS (SELECT * FROM weighed WHERE split = 'train'), more AS (SELECT * FROM weighed WHERE split <> 'test')"""


def rates(counts: str) -> str:
    """Rates of one row of counts."""
    return f"""SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM (
  SELECT *, coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0) AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall FROM ({counts}))"""


def counted(source: str, hit: str) -> str:
    c = lambda a, b: f"count(*) FILTER ({a} AND {b})"
    return f"SELECT {c(hit, 'y = 1')} AS tp, {c(hit, 'y = 0')} AS fp, {c(f'NOT ({hit})', 'y = 1')} AS fn, {c(f'NOT ({hit})', 'y = 0')} AS tn FROM {source}"


def auc(source: str) -> str:
    return f"""SELECT sum(CASE WHEN y = 1 THEN below + same / CAST(2 AS DOUBLE) END) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)) AS roc_auc FROM (
  SELECT y, coalesce(sum(1 - y) OVER (ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) - sum(1 - y) OVER (PARTITION BY p) AS below, sum(1 - y) OVER (PARTITION BY p) AS same FROM {source})"""


_METRICS = "tp, fp, fn, tn, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(roc_auc, 6) AS roc_auc"
_RISK = _WEEKS + newton("early", "train", len(_WEEK_FEATURES) + 1) + newton("late", "more", len(_WEEK_FEATURES) + 1) + f"""
, valid AS MATERIALIZED (SELECT y, {probability('b', 'f')} AS p FROM weighed, early WHERE split = 'validation'
), test AS MATERIALIZED (SELECT y, {probability('b', 'f')} AS p FROM weighed, late WHERE split = 'test'
), sweep AS (
  SELECT k / CAST(20 AS DOUBLE) AS threshold, count(*) FILTER (reach AND y = 1) AS tp, count(*) FILTER (reach AND y = 0) AS fp, count(*) FILTER (NOT reach AND y = 1) AS fn, count(*) FILTER (NOT reach AND y = 0) AS tn
  FROM (SELECT k, y, floor(p * 20 + CAST(1e-9 AS DOUBLE)) >= k AS reach FROM valid, (SELECT unnest(range(1, 20)) AS k)) GROUP BY k
), chosen AS (SELECT threshold FROM ({rates('SELECT * FROM sweep')}) ORDER BY f1 DESC, recall DESC, precision DESC, threshold LIMIT 1)
SELECT 'validation' AS split, threshold, {_METRICS} FROM chosen, ({rates(counted('valid, chosen', 'p >= threshold'))}), ({auc('valid')})
UNION ALL SELECT 'test', threshold, {_METRICS} FROM chosen, ({rates(counted('test, chosen', 'p >= threshold'))}), ({auc('test')})"""

_AWAY = oracle._BODIES["disengagement_labels"].replace("\nSELECT customer_id", "\n, labels AS MATERIALIZED (SELECT customer_id", 1) + """
), cut AS (SELECT quantile_disc(month, 0.75) AS cut FROM labels
), rate AS (SELECT avg(label) AS rate FROM labels, cut WHERE month <= cut
), marked AS MATERIALIZED (
  SELECT month > cut AS late, CAST(label AS DOUBLE) AS y, [CAST(1 AS DOUBLE), CAST(orders AS DOUBLE), spend, CAST(visit_days AS DOUBLE), promo_share, CAST(category_count AS DOUBLE)] AS f,
         CASE WHEN label = 1 THEN 0.5 / rate ELSE 0.5 / (1 - rate) END AS w FROM labels, cut, rate
), train AS (SELECT * FROM marked WHERE NOT late)""" + newton("model", "train", 6) + f"""
, scored AS MATERIALIZED (SELECT y, {probability('b', 'f')} AS p FROM marked, model WHERE late)
SELECT tp + fp + fn + tn AS n, tp + fn AS positives, {_METRICS} FROM ({rates(counted('scored', 'p >= 0.5'))}), ({auc('scored')})"""

_BODIES: dict[str, str] = {
    "demand_model": _DEMAND + ", told AS (" + regression_row("linear", "validation", "hours, early", f"({product('b', _HOUR_FEATURES)})") + "\nUNION ALL " + regression_row("linear", "test", "hours, late", f"({product('b', _HOUR_FEATURES)})")
    + "\nUNION ALL " + regression_row("seasonal_naive", "test", "hours", "lag_168") + """
), learned AS (
  SELECT name, split, count(*) AS n FROM hours JOIN (SELECT unnest(['forest', 'boosted']) AS name) ON split = 'validation' GROUP BY 1, 2
  UNION ALL SELECT 'chosen', split, count(*) FROM hours WHERE split = 'test' GROUP BY 2
)
SELECT *, TRUE AS has_errors FROM told UNION ALL SELECT name, split, n, NULL, NULL, NULL, TRUE FROM learned""",
    "demand_coefficients": _DEMAND + f" SELECT unnest(['intercept', {', '.join(repr(n) for n in _HOUR_NAMES)}]) AS name, round(unnest(b), 6) AS coefficient FROM late",
    "compiled_scores": _HOURS + " SELECT model, split, count(*) AS rows, CAST(0 AS BIGINT) AS differing FROM hours, (SELECT unnest(['linear', 'forest', 'boosted']) AS model) GROUP BY ALL",
    "one_row_scores": _DEMAND + f" SELECT event_type, hour, round({product('b', _HOUR_FEATURES)}, 6) AS prediction FROM hours, late WHERE hour = (SELECT max(hour) FROM hours) ORDER BY event_type LIMIT 5",
    "wastage_risk_model": _RISK,
    "disengagement_model": _AWAY,
    "daily_rollout": _DAYS + regression("model", "days", _DAY_FEATURES, "units") + ", models AS (SELECT '' AS origin, (SELECT hi FROM ends) AS last, b FROM model)" + rolled("models", _STEP)
    + " SELECT entity, day, k AS horizon_day, round(prediction, 6) AS prediction, baseline FROM made",
    "rising_rollout": contract_oracle._CHANNEL_DAYS + " SELECT entity, CAST(hi + CAST(k AS INTEGER) AS DATE) AS day, k AS horizon_day, CAST(units + k AS DOUBLE) AS prediction FROM ends JOIN panel ON day = hi, (SELECT CAST(unnest(range(1, 29)) AS BIGINT) AS k)",
    "forecast_coefficients": _DAYS + _ORIGINS + f" SELECT origin, unnest(['intercept', {', '.join(repr(n) for n in _DAY_FEATURES)}]) AS name, round(unnest(b), 6) AS coefficient FROM models",
    "backtest_errors": _DAYS + _ORIGINS + ", dated AS (SELECT origin, CAST(origin AS DATE) AS last, b FROM models)" + rolled("dated", _STEP) + """
SELECT last AS origin, horizon, count(*) AS n, round(avg(abs(units - prediction)), 6) AS mae, round(sqrt(avg((units - prediction) * (units - prediction))), 6) AS rmse,
       round(avg(CAST(abs(units - baseline) AS DOUBLE)), 6) AS naive_mae, round(sqrt(avg((units - baseline) * (units - baseline))), 6) AS naive_rmse
FROM made JOIN panel USING (entity, day) JOIN (SELECT CAST(unnest([7, 14, 28]) AS BIGINT) AS horizon) ON k <= horizon GROUP BY 1, 2""",
}

ORACLE_SQL: dict[str, str] = {name: PREFIX.replace("WITH ", "WITH RECURSIVE ", 1) + body for name, body in _BODIES.items()}
