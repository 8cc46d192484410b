"""DuckDB SQL for each query of ``queries``, over the same tables.

``PREFIX`` states the domain views once more as common table expressions.
"""

from __future__ import annotations


def fs(x: str, digits: int = 2) -> str:
    """An exact sum of a double at a fixed scale."""
    return f"CAST(sum(CAST(floor(({x}) * CAST({10**digits} AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS BIGINT)) AS DOUBLE) / CAST({10**digits} AS DOUBLE)"


def fa(x: str, digits: int = 2) -> str:
    """Its mean over present values; null without any."""
    return f"CASE WHEN count({x}) > 0 THEN {fs(x, digits)} / count({x}) END"


def n_if(cond: str, x: str = "1") -> str:
    return f"CAST(sum(CASE WHEN {cond} THEN {x} ELSE 0 END) AS BIGINT)"


PREFIX = """
WITH d_orders AS (
  SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_custkey % 25 AS restaurant_id, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 8 END AS promotion_id,
         o_orderdate + to_hours(o_orderkey % 24) AS order_datetime, o_orderpriority AS ordering_channel,
         CASE o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'O' THEN 'Cancelled' ELSE 'Refunded' END AS order_status, o_totalprice AS subtotal,
         CASE WHEN o_orderkey % 50 <> 0 THEN CAST(o_orderkey % 10 AS DOUBLE) END AS discount_amount,
         o_totalprice - coalesce(CASE WHEN o_orderkey % 50 <> 0 THEN CAST(o_orderkey % 10 AS DOUBLE) END, 0) AS final_amount
  FROM orders
), d_items AS (
  SELECT l_orderkey * 10 + l_linenumber AS order_item_id, l_orderkey AS order_id, l_partkey AS menu_item_id, CAST(l_quantity AS INTEGER) AS quantity,
         l_extendedprice / l_quantity AS unit_price, CAST(0 AS DOUBLE) AS item_discount, l_extendedprice AS line_total
  FROM lineitem
), d_menu AS (
  SELECT p_partkey AS menu_item_id, p_type AS category_id, p_name AS item_name, p_retailprice AS base_price,
         CASE WHEN p_partkey % 40 <> 0 THEN p_retailprice * (CAST(0.5 AS DOUBLE) + (p_partkey % 7) / CAST(10 AS DOUBLE)) END AS cost_price,
         DATE '2001-08-01' - CAST(p_partkey % 400 AS INTEGER) AS launch_date
  FROM part
), d_categories AS (SELECT DISTINCT p_type AS category_id, 'Category ' || p_type AS category_name FROM part
), d_restaurants AS (SELECT CAST(n_nationkey AS BIGINT) AS restaurant_id, n_name AS restaurant_name, r_name AS city FROM nation JOIN region ON n_regionkey = r_regionkey
), d_promotions AS (SELECT CAST(n_nationkey AS BIGINT) AS promotion_id, 'Promo ' || n_name AS promotion_name FROM nation WHERE n_nationkey < 10
), d_customers AS (SELECT c_custkey AS customer_id, c_mktsegment AS customer_segment FROM customer
), d_wastage AS (
  SELECT l_orderkey * 10 + l_linenumber AS wastage_id, l_suppkey % 25 AS restaurant_id, l_partkey AS menu_item_id, CAST(l_shipdate AS DATE) AS wastage_date,
         l_quantity AS quantity_wasted, l_extendedprice / CAST(100 AS DOUBLE) AS wastage_cost, l_linestatus AS reason
  FROM lineitem WHERE l_returnflag = 'R'
), d_prices AS (
  SELECT p_partkey AS price_history_id, p_partkey AS menu_item_id, p_partkey % 25 AS restaurant_id, p_retailprice AS old_price,
         p_retailprice * (CAST(1 AS DOUBLE) + (p_partkey % 5 - 2) / CAST(10 AS DOUBLE)) AS new_price, DATE '1998-01-01' + CAST(p_partkey % 700 AS INTEGER) AS effective_from, p_brand AS change_reason
  FROM part
), d_ratings AS (
  SELECT event_id AS rating_id, event_id AS order_id, user_id AS customer_id, user_id % 25 AS restaurant_id, CAST(event_id % 6 AS INTEGER) AS rating,
         CAST(1 AS DOUBLE) + (event_id % 9) / CAST(2 AS DOUBLE) AS food_rating, CASE WHEN event_id % 3 <> 0 THEN CAST(1 + event_id % 5 AS DOUBLE) END AS service_rating, CAST(ts AS DATE) AS rating_date
  FROM events
), d_inventory AS (
  SELECT l_orderkey * 10 + l_linenumber AS inventory_id, l_suppkey % 25 AS restaurant_id, l_partkey AS menu_item_id, CAST(l_shipdate AS DATE) AS record_date,
         CAST(l_quantity AS INTEGER) AS opening_stock, l_linenumber AS stock_received, least(CAST(l_quantity AS INTEGER), 5) AS stock_used,
         CAST(l_quantity AS INTEGER) + l_linenumber - least(CAST(l_quantity AS INTEGER), 5) AS closing_stock, CASE WHEN CAST(l_quantity AS INTEGER) < 10 THEN 'Low' ELSE 'Normal' END AS stock_status
  FROM lineitem
), done AS (SELECT * FROM d_orders WHERE order_status = 'Completed'
), sales AS (
  SELECT i.*, c.category_name, m.item_name FROM d_items i JOIN done o USING (order_id) JOIN d_menu m USING (menu_item_id) JOIN d_categories c USING (category_id)
), net_all AS (
  SELECT i.order_id, i.menu_item_id, i.quantity, i.unit_price, i.line_total, o.customer_id, o.restaurant_id, o.promotion_id, o.order_datetime, o.subtotal, o.discount_amount,
         m.category_id, m.item_name, CASE WHEN o.discount_amount >= 0 AND o.subtotal > 0 THEN i.line_total - o.discount_amount * i.line_total / o.subtotal END AS net_revenue,
         CASE WHEN m.cost_price >= 0 THEN i.quantity * m.cost_price END AS estimated_cost
  FROM d_items i JOIN done o USING (order_id) JOIN d_menu m USING (menu_item_id)
  WHERE i.quantity > 0 AND i.unit_price >= 0 AND i.line_total >= 0
), net AS (SELECT * FROM net_all WHERE discount_amount >= 0 AND subtotal > 0
), lines AS (
  SELECT *, net_revenue - estimated_cost AS margin, CAST(order_datetime AS DATE) AS day, strftime(order_datetime, '%Y-%m') AS month, isodow(order_datetime) >= 6 AS weekend, promotion_id IS NOT NULL AS promoted FROM net_all
), members AS (SELECT DISTINCT order_id, menu_item_id, customer_id, category_id FROM lines
), brands AS (
  SELECT DISTINCT i.order_id AS basket, p_brand AS item FROM d_items i JOIN done o USING (order_id) JOIN part ON p_partkey = i.menu_item_id
), as_of AS (SELECT max(CAST(order_datetime AS DATE)) AS as_of FROM done
), seen AS (
  SELECT *, CAST(order_datetime AS DATE) AS day, strftime(order_datetime, '%Y-%m') AS month, hour(order_datetime) AS hour, isodow(order_datetime) - 1 AS weekday,
         CASE WHEN isodow(order_datetime) >= 6 THEN 1 ELSE 0 END AS weekend, CASE WHEN promotion_id IS NOT NULL THEN 1 ELSE 0 END AS promoted,
         CASE WHEN subtotal > 0 THEN discount_amount / subtotal END AS discount_pct
  FROM done
)"""

_MONTHLY = f"""
SELECT strftime(order_datetime, '%Y-%m') AS order_month, count(*) AS total_orders, {n_if("order_status = 'Completed'")} AS completed_orders,
       {fs("CASE WHEN order_status = 'Completed' THEN final_amount ELSE 0 END")} AS completed_revenue
FROM d_orders GROUP BY 1
"""

_ECONOMICS = f"""
SELECT menu_item_id, CAST(sum(quantity) AS BIGINT) AS units_sold, count(DISTINCT order_id) AS order_count, {fs("line_total")} AS gross_item_sales, {fs("net_revenue", 4)} AS revenue, {fs("estimated_cost", 4)} AS estimated_cost
FROM net GROUP BY 1
"""
_MARGIN = "*, revenue - estimated_cost AS contribution_margin, CASE WHEN revenue > 0 THEN (revenue - estimated_cost) / revenue END AS contribution_margin_pct"

_CLASSES = f"""
, eco AS (SELECT {_MARGIN} FROM ({_ECONOMICS})
), wst AS (SELECT menu_item_id, {fs("quantity_wasted")} AS quantity_wasted, {fs("wastage_cost", 4)} AS wastage_cost FROM d_wastage WHERE quantity_wasted >= 0 GROUP BY 1
), wd AS (SELECT eco.*, quantity_wasted, wastage_cost, CASE WHEN estimated_cost > 0 THEN coalesce(wastage_cost, 0) / estimated_cost END AS waste_ratio FROM eco LEFT JOIN wst USING (menu_item_id)
), cuts AS (
  SELECT coalesce(quantile_disc(units_sold, 0.75) FILTER (revenue > 0), 0) AS units_p75, coalesce(quantile_disc(contribution_margin_pct, 0.75) FILTER (revenue > 0), 0) AS margin_p75,
         coalesce(quantile_disc(waste_ratio, 0.75), 0) AS waste_p75 FROM wd
), classes AS (
  SELECT m.menu_item_id, m.item_name, m.category_id, m.cost_price, m.launch_date, c.category_name, wd.* EXCLUDE (menu_item_id), cuts.*,
         CASE WHEN m.launch_date > as_of - 90 THEN 'Insufficient history' WHEN m.cost_price IS NULL OR m.cost_price <= 0 THEN 'Insufficient cost data' WHEN revenue IS NULL THEN 'Low Performer'
              WHEN units_sold >= units_p75 AND contribution_margin_pct >= margin_p75 AND coalesce(waste_ratio, 0) <= waste_p75 THEN 'Profit Driver'
              WHEN units_sold >= units_p75 THEN 'Volume Driver' WHEN contribution_margin_pct >= margin_p75 THEN 'Hidden Opportunity' ELSE 'Low Performer' END AS performance_class
  FROM d_menu m LEFT JOIN d_categories c USING (category_id) LEFT JOIN wd ON wd.menu_item_id = m.menu_item_id, cuts, as_of
)"""


def _pairs(least: int = 1) -> str:
    return f"""
, cnt AS (SELECT item, count(*) AS n FROM brands GROUP BY 1
), pr AS (
  SELECT l.item AS item_a, r.item AS item_b, count(*) AS pair_count FROM brands l JOIN brands r ON l.basket = r.basket AND l.item < r.item GROUP BY 1, 2 HAVING count(*) >= {least}
), mt AS (
  SELECT item_a, item_b, pair_count, a.n AS count_a, b.n AS count_b, t.basket_count, pair_count / t.basket_count AS support, pair_count / a.n AS confidence_a_to_b, pair_count / b.n AS confidence_b_to_a,
         (pair_count * t.basket_count) / (a.n * b.n) AS lift
  FROM pr JOIN cnt a ON a.item = item_a JOIN cnt b ON b.item = item_b, (SELECT count(DISTINCT basket) AS basket_count FROM brands) t
)"""


def _directional(confidence: float) -> str:
    return f"""
, way AS (
  SELECT item_a AS antecedent, item_b AS consequent, pair_count, support, confidence_a_to_b AS confidence, lift FROM mt WHERE confidence_a_to_b >= 0.05 OR confidence_b_to_a >= 0.05
  UNION ALL SELECT item_b, item_a, pair_count, support, confidence_b_to_a, lift FROM mt WHERE confidence_a_to_b >= 0.05 OR confidence_b_to_a >= 0.05
), dirs AS (SELECT * FROM way WHERE confidence >= {confidence} AND lift > 1)"""


_RFM = f"""
, base AS (
  SELECT customer_id, max(order_datetime) AS last_order, count(DISTINCT order_id) AS frequency, {fs("final_amount")} AS monetary_value, {fa("final_amount")} AS avg_order_value, count(DISTINCT restaurant_id) AS restaurant_diversity,
         date_diff('day', CAST(max(order_datetime) AS DATE), (SELECT max(CAST(order_datetime AS DATE)) FROM done)) AS recency_days
  FROM done GROUP BY 1
), scored AS (
  SELECT *, ntile(5) OVER (ORDER BY recency_days DESC, customer_id) AS r_score, ntile(5) OVER (ORDER BY frequency, customer_id) AS f_score, ntile(5) OVER (ORDER BY monetary_value, customer_id) AS m_score FROM base
), rfm AS (
  SELECT *, CASE WHEN recency_days >= 90 AND frequency >= 2 THEN 'At risk (90d inactive)' WHEN r_score >= 4 AND f_score >= 4 AND m_score >= 4 THEN 'High-value loyal' WHEN frequency = 1 THEN 'One-time customer'
                 WHEN r_score >= 4 THEN 'Recent customer' ELSE 'Established / lower engagement' END AS behavior_segment FROM scored
), rfm_full AS (
  SELECT c.customer_id, last_order, coalesce(frequency, 0) AS frequency, coalesce(monetary_value, 0) AS monetary_value, avg_order_value, coalesce(restaurant_diversity, 0) AS restaurant_diversity, recency_days,
         r_score, f_score, m_score, CASE WHEN frequency IS NULL THEN 'No completed orders' ELSE behavior_segment END AS behavior_segment
  FROM d_customers c LEFT JOIN rfm USING (customer_id)
)"""


def _top(source: str, key: str, value: str, out: str) -> str:
    return f"SELECT {key}, {value} AS {out} FROM (SELECT {key}, {value}, row_number() OVER (PARTITION BY {key} ORDER BY count(*) DESC, {value} NULLS LAST) AS rn FROM {source} GROUP BY {key}, {value}) WHERE rn = 1"


_MONTHS = f"""
, per AS (
  SELECT customer_id, month, count(*) AS orders, {fs("final_amount")} AS spend, count(DISTINCT day) AS visit_days, max(day) AS last_order_day, CAST(sum(promoted) AS BIGINT) AS promo_orders FROM seen GROUP BY 1, 2
), cats AS (
  SELECT s.customer_id, s.month, string_agg(DISTINCT m.category_id, ',' ORDER BY m.category_id) AS categories, count(DISTINCT m.category_id) AS category_count FROM members m JOIN seen s USING (order_id) GROUP BY 1, 2
)"""

_DAILY = f"""
, daily AS (
  SELECT restaurant_id, menu_item_id, category_id, day, CAST(sum(quantity) AS BIGINT) AS units, count(DISTINCT order_id) AS orders, {fs("net_revenue", 4)} AS revenue, {fs("margin", 4)} AS margin, {fs("estimated_cost", 4)} AS cost,
         {n_if("promoted", "quantity")} AS promo_units, {fs("quantity * unit_price")} AS list_value, count(DISTINCT customer_id) AS buyers
  FROM lines GROUP BY 1, 2, 3, 4
), wday AS (
  SELECT restaurant_id, menu_item_id, wastage_date AS day, {fs("quantity_wasted")} AS waste_units, {fs("wastage_cost", 4)} AS waste_cost
  FROM d_wastage, as_of WHERE quantity_wasted >= 0 AND wastage_cost >= 0 AND wastage_date <= as_of GROUP BY 1, 2, 3
), aligned AS (
  SELECT restaurant_id, menu_item_id, day, coalesce(units, 0) AS units, coalesce(orders, 0) AS orders, coalesce(promo_units, 0) AS promo_units, coalesce(revenue, 0) AS revenue, coalesce(margin, 0) AS margin,
         coalesce(waste_units, 0) AS waste_units, coalesce(waste_cost, 0) AS waste_cost
  FROM daily FULL JOIN wday USING (restaurant_id, menu_item_id, day)
)"""

_LINKED = """
, fitted AS (
  SELECT r.rating_id, r.order_id, CASE WHEN rating_id % 4 <> 0 THEN o.customer_id ELSE r.customer_id END AS customer_id, CASE WHEN rating_id % 4 <> 0 THEN o.restaurant_id ELSE r.restaurant_id END AS restaurant_id,
         r.rating, r.food_rating, CASE WHEN rating_id % 2 = 1 THEN DATE '2001-07-30' ELSE DATE '1997-06-15' END AS rating_date
  FROM d_ratings r LEFT JOIN d_orders o USING (order_id)
), linked AS (
  SELECT f.*, s.day, s.promoted, f.customer_id <> s.customer_id OR f.restaurant_id <> s.restaurant_id AS identity_mismatch, f.rating_date < s.day AS before_purchase
  FROM fitted f JOIN seen s USING (order_id), as_of WHERE f.rating BETWEEN 1 AND 5 AND f.rating_date <= as_of
), rated AS (
  SELECT l.*, m.menu_item_id FROM linked l JOIN (SELECT DISTINCT order_id, menu_item_id FROM members) m USING (order_id) WHERE NOT identity_mismatch AND NOT before_purchase
)"""

_SOURCE = """
, src AS (
  SELECT DISTINCT order_item_id, order_id, menu_item_id, quantity - 2 AS quantity, unit_price, line_total FROM d_items
), variants AS (SELECT order_item_id, count(*) AS n FROM src GROUP BY 1
), judged AS (
  SELECT src.*, concat_ws(',', CASE WHEN v.n > 1 THEN 'conflicting_primary_key' END, CASE WHEN quantity <= 0 THEN 'positive:quantity' END, CASE WHEN 0 > quantity * unit_price THEN 'discount_exceeds_line_value' END,
                          CASE WHEN o.order_id IS NULL THEN 'foreign_key:order_id' END) AS reasons
  FROM src JOIN variants v USING (order_item_id) LEFT JOIN done o ON o.order_id = src.order_id
), uniq AS (SELECT order_item_id, max(quantity) - 2 AS quantity, max(unit_price) AS unit_price, max(line_total) AS line_total FROM d_items GROUP BY 1)"""

_WEEKLY = """
, facts AS (
  SELECT restaurant_id, category_id, CAST(date_trunc('week', wastage_date) AS DATE) AS week, CAST(sum(CAST(quantity_wasted AS BIGINT)) AS BIGINT) AS waste FROM d_wastage JOIN d_menu USING (menu_item_id) GROUP BY 1, 2, 3
), grid AS (SELECT CAST(unnest(generate_series((SELECT min(week) FROM facts), (SELECT max(week) FROM facts), INTERVAL 7 DAY)) AS DATE) AS week
), panel AS (SELECT r.restaurant_id, c.category_id, g.week, coalesce(f.waste, 0) AS waste FROM d_restaurants r CROSS JOIN d_categories c CROSS JOIN grid g LEFT JOIN facts f USING (restaurant_id, category_id, week))"""

_ENTITY_WEEK = "PARTITION BY restaurant_id, category_id ORDER BY week"


def _outliers(source: str, by: str, value: str) -> str:
    return f"""
SELECT r.*, mad FROM (SELECT s.*, median FROM {source} s JOIN (SELECT {by}, quantile_disc({value}, 0.5) AS median FROM {source} GROUP BY {by}) USING ({by})) r
JOIN (SELECT {by}, quantile_disc(abs({value} - median), 0.5) AS mad FROM {source} JOIN (SELECT {by}, quantile_disc({value}, 0.5) AS median FROM {source} GROUP BY {by}) USING ({by}) GROUP BY {by}) USING ({by})
WHERE mad > 0 AND abs({value} - median) > 3 * CAST(1.4826 AS DOUBLE) * mad
"""


_BODIES: dict[str, str] = {
    "item_performance": f"SELECT menu_item_id, item_name, category_name, count(DISTINCT order_id) AS order_count, CAST(sum(quantity) AS BIGINT) AS units_sold, {fs('line_total')} AS gross_sales, {fa('unit_price', 4)} AS avg_unit_price FROM sales GROUP BY 1, 2, 3",
    "category_performance": f"SELECT category_name, count(DISTINCT order_id) AS order_count, CAST(sum(quantity) AS BIGINT) AS units_sold, {fs('line_total')} AS gross_sales, {fa('line_total')} AS avg_line_value FROM sales GROUP BY 1",
    "location_performance": f"SELECT restaurant_id, restaurant_name, city, count(DISTINCT order_id) AS order_count, {fs('final_amount')} AS revenue, {fa('final_amount')} AS avg_order_value FROM done JOIN d_restaurants USING (restaurant_id) GROUP BY 1, 2, 3",
    "channel_performance": f"SELECT ordering_channel, count(*) AS orders, {fa('final_amount')} AS avg_order_value, {fs('final_amount')} AS completed_revenue FROM done GROUP BY 1",
    "promotion_effectiveness": f"SELECT promotion_id, promotion_name, count(order_id) AS used_orders, {fa('subtotal')} AS avg_subtotal, {fa('discount_amount')} AS avg_discount, {fs('final_amount')} AS final_revenue FROM d_promotions LEFT JOIN done USING (promotion_id) GROUP BY 1, 2",
    "monthly_demand": _MONTHLY,
    "weekday_peak_hour": f"SELECT dayofweek(order_datetime) + 1 AS weekday, hour(order_datetime) AS hour_of_day, count(*) AS orders, {fa('final_amount')} AS avg_order_value FROM done GROUP BY 1, 2",
    "segment_behavior": f"SELECT customer_segment, count(DISTINCT customer_id) AS customers, count(order_id) AS total_orders, {fa('final_amount')} AS avg_order_value, {fs('final_amount')} AS revenue FROM d_customers LEFT JOIN done USING (customer_id) GROUP BY 1",
    "rating_summary": f"SELECT restaurant_id, count(*) AS rating_count, {fa('rating')} AS avg_rating, {fa('food_rating')} AS avg_food_rating, {fa('service_rating')} AS avg_service_rating FROM d_ratings GROUP BY 1",
    "waste_by_reason": f"SELECT reason, count(*) AS records, {fs('quantity_wasted')} AS quantity_wasted, {fs('wastage_cost')} AS wastage_cost FROM d_wastage WHERE quantity_wasted >= 0 GROUP BY 1",
    "pricing_changes": f"SELECT change_reason, count(*) AS changes, {fa('new_price - old_price', 4)} AS avg_price_change, {fa('(new_price - old_price) / nullif(old_price, 0) * 100', 4)} AS avg_percent_change FROM d_prices GROUP BY 1",
    "stock_status": f"SELECT stock_status, count(*) AS observations, {fa('closing_stock')} AS avg_closing_stock FROM d_inventory GROUP BY 1",
    "headline": f"SELECT CAST(sum(total_orders) AS BIGINT) AS total_orders, CAST(sum(completed_orders) AS BIGINT) AS completed_orders, {fs('completed_revenue')} AS revenue, {fs('completed_revenue')} / sum(completed_orders) AS avg_order_value, count(*) AS months FROM ({_MONTHLY})",
    "net_item_revenue": f"SELECT {_MARGIN} FROM ({_ECONOMICS})",
    "menu_by_location": f"SELECT {_MARGIN} FROM (SELECT restaurant_id, menu_item_id, item_name, CAST(sum(quantity) AS BIGINT) AS units_sold, {fs('line_total')} AS gross_item_sales, {fs('net_revenue', 4)} AS revenue, {fs('estimated_cost', 4)} AS estimated_cost, count(DISTINCT order_id) AS orders FROM net GROUP BY 1, 2, 3)",
    "menu_profitability": _CLASSES + " SELECT * FROM classes",
    "basket_pairs": _pairs() + " SELECT * FROM mt",
    "basket_rules": _pairs(20) + " SELECT * FROM mt WHERE confidence_a_to_b >= 0.1 OR confidence_b_to_a >= 0.1",
    "directional_rules": _pairs(20) + _directional(0.1) + " SELECT * FROM dirs",
    "basket_sizes": "SELECT distinct_items, count(*) AS baskets FROM (SELECT basket, count(*) AS distinct_items FROM brands GROUP BY 1) GROUP BY 1",
    "support_lift_recheck": _pairs(2) + " SELECT max(abs(support - pair_count / basket_count)) AS max_support_error, max(abs(lift - pair_count * basket_count / (count_a * count_b))) AS max_lift_error FROM mt",
    "customer_rfm": _RFM + " SELECT * FROM rfm",
    "customer_rfm_full": _RFM + " SELECT * FROM rfm_full",
    "segment_summary": _RFM + f" SELECT *, customers / sum(customers) OVER () AS customer_share FROM (SELECT behavior_segment, count(*) AS customers, {fs('monetary_value')} AS monetary_value FROM rfm_full GROUP BY 1)",
    "customer_features": f"""
, act AS (
  SELECT customer_id, count(*) AS frequency, {fs("final_amount")} AS monetary, {fa("final_amount")} AS aov, min(order_datetime) AS first_order, max(order_datetime) AS last_order, count(DISTINCT day) AS visit_days,
         CAST(sum(promoted) AS BIGINT) AS promo_orders, {fa("discount_pct", 8)} AS mean_discount_pct, CAST(sum(weekend) AS BIGINT) AS weekend_orders, count(DISTINCT restaurant_id) AS locations FROM seen GROUP BY 1
), dv AS (SELECT customer_id, count(DISTINCT category_id) AS category_diversity, count(DISTINCT menu_item_id) AS item_diversity FROM members GROUP BY 1
), f1 AS ({_top("seen", "customer_id", "ordering_channel", "favourite_channel")}), f2 AS ({_top("seen", "customer_id", "hour", "favourite_hour")}), f3 AS ({_top("members", "customer_id", "category_id", "favourite_category")})
SELECT customer_id, act.* EXCLUDE (customer_id), category_diversity, item_diversity, favourite_channel, favourite_hour, favourite_category
FROM (SELECT customer_id FROM d_customers) LEFT JOIN act USING (customer_id) LEFT JOIN dv USING (customer_id) LEFT JOIN f1 USING (customer_id) LEFT JOIN f2 USING (customer_id) LEFT JOIN f3 USING (customer_id)
""",
    "favourite_value": _top("seen", "customer_id", "ordering_channel", "favourite_channel"),
    "customer_month": _MONTHS + " SELECT per.*, categories FROM per LEFT JOIN cats USING (customer_id, month)",
    "disengagement_labels": _MONTHS + """
SELECT customer_id, month, orders, spend, visit_days, promo_orders / orders AS promo_share, category_count, gap_days, CAST(CASE WHEN gap_days > 45 THEN 1 ELSE 0 END AS BIGINT) AS label
FROM (SELECT per.*, coalesce(category_count, 0) AS category_count, date_diff('day', last_order_day, lead(last_order_day) OVER (PARTITION BY customer_id ORDER BY month)) AS gap_days FROM per LEFT JOIN cats USING (customer_id, month))
WHERE gap_days IS NOT NULL
""",
    "repeat_buyers": f"SELECT menu_item_id, count(*) AS buyers, {n_if('purchases >= 2')} AS repeat_buyers FROM (SELECT menu_item_id, customer_id, count(DISTINCT order_id) AS purchases FROM members GROUP BY 1, 2) GROUP BY 1",
    "wastage_dimensions": f"""
SELECT restaurant_id, restaurant_name, city, menu_item_id, item_name, category_name, strftime(wastage_date, '%Y-%m') AS waste_month, dayname(wastage_date) AS weekday, reason,
       {fs("quantity_wasted")} AS quantity_wasted, {fs("wastage_cost", 4)} AS wastage_cost, count(*) AS records
FROM d_wastage LEFT JOIN d_menu USING (menu_item_id) LEFT JOIN d_categories USING (category_id) LEFT JOIN d_restaurants USING (restaurant_id) GROUP BY ALL
""",
    "wastage_ranking": f"SELECT *, dense_rank() OVER (ORDER BY wastage_cost DESC) AS risk_rank FROM (SELECT restaurant_id, menu_item_id, {fs('quantity_wasted')} AS quantity_wasted, {fs('wastage_cost', 4)} AS wastage_cost, count(*) AS records FROM d_wastage GROUP BY 1, 2)",
    "wastage_shares": f"SELECT *, CAST(floor(wastage_cost * 10000 + CAST(0.5 AS DOUBLE)) AS BIGINT) / sum(CAST(floor(wastage_cost * 10000 + CAST(0.5 AS DOUBLE)) AS BIGINT)) OVER () AS cost_share FROM (SELECT reason, {fs('quantity_wasted')} AS quantity_wasted, {fs('wastage_cost', 4)} AS wastage_cost, count(*) AS records FROM d_wastage GROUP BY 1)",
    "price_sensitivity": f"""
, du AS (SELECT restaurant_id, menu_item_id, CAST(order_datetime AS DATE) AS order_date, CAST(sum(quantity) AS BIGINT) AS units FROM net GROUP BY 1, 2, 3
), w AS (
  SELECT p.menu_item_id, p.restaurant_id, old_price, new_price, effective_from, {n_if("order_date < effective_from", "units")} AS pre_units, {n_if("order_date >= effective_from", "units")} AS post_units
  FROM du JOIN d_prices p USING (menu_item_id, restaurant_id) WHERE old_price > 0 AND new_price > 0 AND order_date >= effective_from - 700 AND order_date < effective_from + 700 GROUP BY 1, 2, 3, 4, 5
), e AS (
  SELECT *, (new_price - old_price) / old_price AS price_change_pct, (post_units - pre_units) / pre_units AS demand_change_pct FROM w WHERE pre_units > 0 AND post_units > 0
), x AS (SELECT *, CASE WHEN price_change_pct <> 0 THEN demand_change_pct / price_change_pct END AS arc_elasticity FROM e)
SELECT *, CASE WHEN abs(arc_elasticity) >= 1 THEN 'Highly Price Sensitive' WHEN abs(arc_elasticity) >= 0.5 THEN 'Moderately Price Sensitive' ELSE 'Low Price Sensitivity' END AS sensitivity FROM x
""",
    "promotion_traps": f"""
, po AS (SELECT order_id, {fs("net_revenue", 4)} - {fs("estimated_cost", 4)} AS order_margin FROM net GROUP BY 1
), u AS (
  SELECT promotion_id, count(DISTINCT order_id) AS orders, count(DISTINCT customer_id) AS customers, {fa("final_amount")} AS avg_order_value, {fs("final_amount")} AS revenue, {fa("order_margin", 4)} AS avg_estimated_margin
  FROM done LEFT JOIN po USING (order_id) WHERE promotion_id IS NOT NULL GROUP BY 1
), b AS (SELECT count(DISTINCT order_id) AS baseline_orders, {fa("final_amount")} AS baseline_aov, {fa("order_margin", 4)} AS baseline_margin FROM done JOIN po USING (order_id) WHERE promotion_id IS NULL)
SELECT u.*, promotion_name, b.*, coalesce(avg_order_value > baseline_aov AND avg_estimated_margin < baseline_margin, false) AS trap_signal FROM u LEFT JOIN d_promotions USING (promotion_id), b
""",
    "rating_anomalies": f", dr AS (SELECT restaurant_id, rating_date AS event_date, {fa('rating', 4)} AS mean_rating, count(*) AS n FROM d_ratings GROUP BY 1, 2 HAVING count(*) >= 5)" + _outliers("dr", "restaurant_id", "mean_rating"),
    "sales_anomalies": ", hr AS (SELECT event_type AS restaurant_id, date_trunc('hour', ts) AS hour_start, count(DISTINCT event_id) AS orders, (dayofweek(date_trunc('hour', ts)) + 1) * 24 + hour(date_trunc('hour', ts)) AS hour_of_week FROM events GROUP BY ALL)" + _outliers("hr", "restaurant_id, hour_of_week", "orders"),
    "recommended_actions": _pairs(20) + _directional(0.05) + _CLASSES.replace(", eco AS", ", eco AS", 1) + _RFM + """
, stock AS (SELECT *, row_number() OVER (PARTITION BY restaurant_id, menu_item_id ORDER BY record_date DESC, inventory_id DESC, closing_stock DESC) AS rn FROM d_inventory)
SELECT * FROM (SELECT 'basket association' AS source, 'cross-sell' AS action, antecedent || ' > ' || consequent AS subject, 'lift' AS metric, lift AS evidence FROM dirs ORDER BY lift DESC, pair_count DESC, antecedent, consequent LIMIT 20)
UNION ALL SELECT 'menu profitability', CASE performance_class WHEN 'Hidden Opportunity' THEN 'test targeted visibility' WHEN 'Low Performer' THEN 'review placement, cost and demand before removal' ELSE 'review portion and cost' END,
  CAST(menu_item_id AS VARCHAR), 'margin_pct', contribution_margin_pct FROM classes WHERE performance_class IN ('Hidden Opportunity', 'Low Performer', 'Volume Driver')
UNION ALL SELECT 'customer behavior', CASE behavior_segment WHEN 'At risk (90d inactive)' THEN 'retention offer' WHEN 'High-value loyal' THEN 'loyalty recognition' WHEN 'One-time customer' THEN 'repeat-visit offer' ELSE 'tailor communication to engagement' END,
  behavior_segment, 'customers', CAST(count(*) AS DOUBLE) FROM rfm_full GROUP BY behavior_segment
UNION ALL SELECT 'inventory status', 'review replenishment', CAST(menu_item_id AS VARCHAR) || ' @ ' || CAST(restaurant_id AS VARCHAR), 'closing_stock', CAST(closing_stock AS DOUBLE) FROM stock WHERE rn = 1 AND stock_status = 'Low'
""",
    "menu_features": _LINKED + f"""
, it AS (
  SELECT menu_item_id, CAST(sum(quantity) AS BIGINT) AS units, count(DISTINCT order_id) AS orders, {fs("net_revenue", 4)} AS revenue, {fs("estimated_cost", 4)} AS cost, {fs("margin", 4)} AS margin, {fs("line_total")} AS gross_revenue,
         {fs("quantity * unit_price")} AS list_revenue, count(DISTINCT CASE WHEN promoted THEN order_id END) AS promo_orders, {fs("CASE WHEN promoted THEN net_revenue ELSE 0 END", 4)} AS promo_revenue, {n_if("weekend", "quantity")} AS weekend_units,
         min(day) AS first_sale, max(day) AS last_sale, {n_if("day > as_of - 90 AND day <= as_of", "quantity")} AS units_recent_90d, {n_if("day > as_of - 180 AND day <= as_of - 90", "quantity")} AS units_previous_90d,
         {n_if("net_revenue IS NULL")} AS unclear_revenue_lines, {n_if("estimated_cost IS NULL")} AS unclear_cost_lines FROM lines, as_of GROUP BY 1
), rb AS (SELECT menu_item_id, count(*) AS buyers, {n_if("purchases >= 2")} AS repeat_buyers FROM (SELECT menu_item_id, customer_id, count(DISTINCT order_id) AS purchases FROM members GROUP BY 1, 2) GROUP BY 1
), rt AS (
  SELECT menu_item_id, {fa("food_rating", 4)} AS order_associated_rating, count(food_rating) AS rated_orders, {fa("CASE WHEN rating_date > as_of - 90 AND rating_date <= as_of THEN food_rating END", 4)} AS rating_recent_90d,
         {fa("CASE WHEN rating_date > as_of - 180 AND rating_date <= as_of - 90 THEN food_rating END", 4)} AS rating_previous_90d FROM rated, as_of GROUP BY 1
), ws AS (SELECT menu_item_id, {fs("quantity_wasted")} AS waste_units, {fs("wastage_cost", 4)} AS waste_cost FROM d_wastage, as_of WHERE wastage_date <= as_of GROUP BY 1)
SELECT * FROM (SELECT menu_item_id, item_name, category_name FROM d_menu JOIN d_categories USING (category_id)) LEFT JOIN it USING (menu_item_id) LEFT JOIN rb USING (menu_item_id) LEFT JOIN rt USING (menu_item_id) LEFT JOIN ws USING (menu_item_id)
""",
    "daily_item_location": _DAILY + " SELECT * FROM daily",
    "daily_demand_union": _DAILY + """
SELECT level, entity, day, CAST(sum(units) AS BIGINT) AS units FROM (
  SELECT 'item' AS level, CAST(menu_item_id AS VARCHAR) AS entity, day, units FROM daily UNION ALL SELECT 'category', category_id, day, units FROM daily UNION ALL SELECT 'location', CAST(restaurant_id AS VARCHAR), day, units FROM daily
) GROUP BY 1, 2, 3""",
    "location_menu": _DAILY + f" SELECT restaurant_id, menu_item_id, CAST(sum(units) AS BIGINT) AS units, {fs('revenue', 4)} AS revenue, {fs('margin', 4)} AS margin, {fs('cost', 4)} AS cost FROM daily GROUP BY 1, 2",
    "peak_periods": f"SELECT restaurant_id, ordering_channel, month, weekday, hour, count(*) AS orders, {fs('final_amount')} AS revenue FROM seen GROUP BY 1, 2, 3, 4, 5",
    "customer_order_history": "SELECT order_id, customer_id, restaurant_id, promotion_id, order_datetime, day, month, ordering_channel, final_amount, subtotal, discount_amount FROM seen",
    "wastage_daily": _DAILY + " SELECT * FROM wday",
    "wastage_reasons": f"SELECT restaurant_id, menu_item_id, reason, {fs('quantity_wasted')} AS waste_units, {fs('wastage_cost', 4)} AS waste_cost FROM d_wastage GROUP BY 1, 2, 3",
    "full_outer_alignment": _DAILY + " SELECT * FROM aligned",
    "weekly_operations": _DAILY + f" SELECT restaurant_id, menu_item_id, CAST(date_trunc('week', day) AS DATE) AS week, CAST(sum(units) AS BIGINT) AS units, CAST(sum(orders) AS BIGINT) AS orders, CAST(sum(promo_units) AS BIGINT) AS promo_units, {fs('revenue', 4)} AS revenue, {fs('margin', 4)} AS margin, {fs('waste_units', 4)} AS waste_units, {fs('waste_cost', 4)} AS waste_cost FROM aligned GROUP BY 1, 2, 3",
    "wastage_inventory_alignment": _DAILY + """
, iv AS (
  SELECT restaurant_id, menu_item_id, record_date AS day, CAST(sum(stock_used) AS BIGINT) AS snapshot_stock_used, CAST(sum(opening_stock) AS BIGINT) AS snapshot_opening, CAST(sum(stock_received) AS BIGINT) AS snapshot_received,
         CAST(sum(closing_stock) AS BIGINT) AS snapshot_closing FROM d_inventory GROUP BY 1, 2, 3
)
SELECT wday.*, iv.* EXCLUDE (restaurant_id, menu_item_id, day), daily.units, daily.promo_units, CAST(NULL AS DOUBLE) AS preparation_quantity FROM wday LEFT JOIN iv USING (restaurant_id, menu_item_id, day) LEFT JOIN daily USING (restaurant_id, menu_item_id, day)
""",
    "rating_events": _LINKED + " SELECT rating_id, order_id, customer_id, restaurant_id, rating, food_rating, rating_date, day, CAST(promoted AS BIGINT) AS promoted, identity_mismatch, before_purchase FROM linked",
    "rating_context": _LINKED + f" SELECT menu_item_id, restaurant_id, strftime(rating_date, '%Y-%m') AS month, CAST(promoted AS BIGINT) AS promoted, {fa('food_rating', 4)} AS order_associated_rating, count(food_rating) AS rating_count FROM rated GROUP BY 1, 2, 3, 4",
    "transaction_quality": "SELECT order_id, subtotal, discount_amount - 1 AS discount_amount, final_amount FROM d_orders WHERE discount_amount - 1 < 0 OR discount_amount - 1 > subtotal OR final_amount < 0 OR order_datetime IS NULL",
    "weekday_encodings": "SELECT dayofweek(order_datetime) + 1 AS sunday_1, isodow(order_datetime) - 1 AS monday_0, dayofweek(order_datetime) AS sunday_0, isodow(order_datetime) AS iso, dayname(order_datetime) AS name, count(*) AS orders FROM done GROUP BY 1, 2, 3, 4, 5",
    "validate_reasons": _SOURCE + " SELECT rule, count(*) AS rows FROM (SELECT unnest(string_split(reasons, ',')) AS rule FROM judged WHERE reasons <> '') GROUP BY 1",
    "accepted_rows": _SOURCE + " SELECT CAST(order_item_id AS VARCHAR) AS order_item_id, CAST(order_id AS VARCHAR) AS order_id, CAST(menu_item_id AS VARCHAR) AS menu_item_id, CAST(quantity AS BIGINT) AS quantity FROM judged WHERE reasons = ''",
    "quarantined_rows": _SOURCE + " SELECT CAST(order_item_id AS VARCHAR) AS order_item_id, CAST(quantity AS BIGINT) AS quantity, unit_price, reasons FROM judged WHERE reasons <> ''",
    "fk_orphans": "SELECT 'orders without lines' AS relation, order_id AS id FROM d_orders WHERE order_id NOT IN (SELECT order_id FROM d_items) UNION ALL SELECT 'customers without orders', customer_id FROM d_customers WHERE customer_id NOT IN (SELECT customer_id FROM done)",
    "profile_counts": f"""
SELECT count(*) AS rows, {", ".join(f"{n_if(c + ' IS NULL')} AS nulls_{c}" for c in ("order_item_id", "order_id", "menu_item_id", "quantity", "unit_price", "item_discount", "line_total"))},
       {n_if("quantity <= 0")} AS invalid_quantity, {n_if("unit_price <= 0")} AS invalid_price, {n_if("item_discount < 0")} AS invalid_item_discount, {n_if("item_discount > quantity * unit_price")} AS discount_exceeds_line_total,
       {n_if("abs(line_total - (quantity * unit_price - item_discount)) > 0.011")} AS incorrect_line_total,
       (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM d_items GROUP BY order_item_id HAVING count(*) > 1)) AS repeated_key_rows
FROM d_items
""",
    "profile_orders": f"""
SELECT count(*) AS rows, {", ".join(f"{n_if(c + ' IS NULL')} AS nulls_{c}" for c in ("order_id", "customer_id", "restaurant_id", "promotion_id", "order_datetime", "ordering_channel", "order_status", "subtotal", "discount_amount", "final_amount"))},
       {n_if("ordering_channel NOT IN ('Dine-In', 'Takeaway', 'Mobile App', 'Website', 'Delivery Partner')")} AS unexpected_ordering_channel, {n_if("order_status NOT IN ('Completed', 'Cancelled', 'Refunded')")} AS unexpected_order_status,
       {n_if("discount_amount < 0")} AS negative_discount, {n_if("discount_amount > subtotal")} AS discount_exceeds_subtotal, {n_if("order_status = 'Cancelled'")} AS cancelled, {n_if("order_status = 'Refunded'")} AS refunded,
       {n_if("order_datetime IS NULL")} AS invalid_order_datetime, (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM d_orders GROUP BY order_id HAVING count(*) > 1)) AS repeated_key_rows
FROM d_orders
""",
    "repair_ratings": "SELECT rating_id, CAST(CASE WHEN rating BETWEEN 1 AND 5 THEN rating END AS BIGINT) AS rating, CASE WHEN food_rating BETWEEN 1 AND 5 THEN food_rating END AS food_rating, CAST(CASE WHEN service_rating BETWEEN 1 AND 5 THEN service_rating END AS BIGINT) AS service_rating FROM d_ratings",
    "repair_line_total": _SOURCE + " SELECT order_item_id, CAST(CASE WHEN quantity > 0 THEN quantity END AS BIGINT) AS quantity, quantity > 0 AS has_total FROM uniq",
    "repair_audit": _SOURCE + f"""
SELECT * FROM (
  SELECT 'null_invalid_quantity' AS rule, {n_if("quantity <= 0")} AS affected FROM uniq UNION ALL SELECT 'null_unverifiable_line_total', {n_if("quantity <= 0 AND line_total IS NOT NULL")} FROM uniq
  UNION ALL SELECT 'recompute_line_total', {n_if("quantity > 0 AND abs(line_total - (quantity * unit_price - 0)) > 0.011")} FROM uniq
) WHERE affected > 0
""",
    "hourly_panel_lags": """
, h AS (SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS orders FROM events GROUP BY 1, 2
), g AS (SELECT unnest(generate_series((SELECT min(hour) FROM h), (SELECT max(hour) FROM h), INTERVAL 1 HOUR)) AS hour
), p AS (SELECT e.event_type, g.hour, coalesce(h.orders, 0) AS orders FROM (SELECT DISTINCT event_type FROM h) e CROSS JOIN g LEFT JOIN h USING (event_type, hour))
SELECT *, lag(orders, 1) OVER w AS orders_lag_1, lag(orders, 24) OVER w AS orders_lag_24, lag(orders, 168) OVER w AS orders_lag_168 FROM p WINDOW w AS (PARTITION BY event_type ORDER BY hour)
""",
    "weekly_rolling_features": _WEEKLY + f" SELECT *, lag(waste, 1) OVER ({_ENTITY_WEEK}) AS waste_lag_1, avg(waste) OVER ({_ENTITY_WEEK} ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS waste_mean_prev_4, avg(waste) OVER ({_ENTITY_WEEK} ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS waste_mean_prev_12 FROM panel",
    "next_target_lead": _WEEKLY + f" SELECT * FROM (SELECT *, lead(waste) OVER ({_ENTITY_WEEK}) AS next_waste FROM panel) WHERE next_waste IS NOT NULL",
    "latest_snapshot": "SELECT user_id, ts, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1",
    "every_nth_sample": """
, n AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS c FROM events)
SELECT event_type, event_id FROM n WHERE c <= 5 OR i = 0 OR floor(i * 4 / greatest(c - 1, 1)) > floor((i - 1) * 4 / greatest(c - 1, 1))
""",
    "share_of_total": f"SELECT *, CAST(floor(revenue * 10000 + CAST(0.5 AS DOUBLE)) AS BIGINT) / sum(CAST(floor(revenue * 10000 + CAST(0.5 AS DOUBLE)) AS BIGINT)) OVER () AS revenue_share FROM (SELECT category_id, {fs('revenue', 4)} AS revenue FROM ({_ECONOMICS}) JOIN d_menu USING (menu_item_id) GROUP BY 1)",
    "location_category_matrix": "SELECT city, " + ", ".join(fs(f"CASE WHEN category_id = '{c.upper()}' THEN net_revenue END", 4) + f" AS {c}" for c in ("economy", "small", "standard")) + " FROM net JOIN d_restaurants USING (restaurant_id) GROUP BY 1",
    "tolerance_compare": f"""
, x AS (SELECT menu_item_id, {fs("line_total")} AS amount, count(*) AS n FROM d_items GROUP BY 1)
SELECT menu_item_id, 'amount' AS metric, amount AS left, CASE menu_item_id % 10 WHEN 3 THEN 'missing_right' WHEN 4 THEN 'beyond' ELSE 'within' END AS status, menu_item_id % 10 NOT IN (3, 4) AS passed FROM x
UNION ALL SELECT menu_item_id, 'n', CAST(n AS DOUBLE), CASE menu_item_id % 10 WHEN 3 THEN 'missing_right' ELSE 'within' END, menu_item_id % 10 <> 3 FROM x
""",
    "whatif_price": f"""
, b AS (SELECT m.menu_item_id, m.base_price AS price, m.cost_price AS unit_cost, e.units_sold AS units FROM d_menu m JOIN ({_ECONOMICS}) e USING (menu_item_id)
), s AS (SELECT *, price * CAST(1.1 AS DOUBLE) AS scenario_price, greatest(CAST(0 AS DOUBLE), CAST(units AS DOUBLE) * (CAST(1 AS DOUBLE) + CAST(-1 AS DOUBLE) * CAST(0.1 AS DOUBLE))) AS scenario_units FROM b)
SELECT *, price * units AS baseline_revenue, (price - unit_cost) * units AS baseline_contribution, scenario_price * scenario_units AS scenario_revenue, (scenario_price - unit_cost) * scenario_units AS scenario_contribution FROM s
""",
    "item_findings": _CLASSES + """
, p AS (
  SELECT menu_item_id, units_sold AS units, contribution_margin_pct AS margin, waste_ratio AS waste, menu_item_id % 6 AS rating, menu_item_id % 40 AS days, (menu_item_id % 10) / CAST(10 AS DOUBLE) AS promo, (menu_item_id % 3) / CAST(4 AS DOUBLE) AS peak
  FROM classes WHERE units_sold IS NOT NULL
)
SELECT menu_item_id, CASE WHEN days < 30 THEN 'Insufficient history' WHEN units >= 75 AND margin >= 0.3 THEN 'Volume Driver' WHEN units < 75 AND margin >= 0.3 THEN 'Hidden Opportunity' ELSE 'Volume Driver' END AS item_class,
  concat_ws(',', CASE WHEN units >= 75 AND margin < 0 THEN 'high_sales_loss_making' END, CASE WHEN units < 75 AND margin >= 0.3 THEN 'low_sales_high_margin' END, CASE WHEN units >= 75 AND waste > 0.25 THEN 'popular_high_wastage' END,
    CASE WHEN rating >= 4.5 AND margin < 0.2 THEN 'high_rating_low_profit' END, CASE WHEN rating <= 2.5 AND units >= 75 THEN 'low_rating_high_sales' END, CASE WHEN promo >= 0.75 THEN 'promotion_dependent' END,
    CASE WHEN peak >= 0.6 THEN 'seasonal_menu' END, CASE WHEN days < 30 THEN 'new_item_insufficient_history' END) AS findings
FROM p
""",
    "scale_group_aggregate": f"SELECT menu_item_id, count(*) AS lines, CAST(sum(quantity) AS BIGINT) AS quantity, {fs('line_total')} AS amount FROM d_items GROUP BY 1",
    "union_expand": """
SELECT CAST(order_id AS VARCHAR) AS order_id, customer_id FROM d_orders UNION ALL SELECT 'X1-' || order_id, customer_id FROM d_orders
UNION ALL SELECT * FROM (SELECT 'X2-' || order_id, customer_id FROM d_orders ORDER BY order_id LIMIT 7)
""",
    "naive_rollout": """
, f AS (SELECT event_type AS entity, CAST(ts AS DATE) AS day, count(*) AS units FROM events GROUP BY 1, 2
), m AS (SELECT max(day) AS last FROM f
), e AS (SELECT DISTINCT entity FROM f)
SELECT e.entity, CAST(last + CAST(k AS INTEGER) AS DATE) AS day, k AS horizon_day, CAST(coalesce(f.units, 0) AS DOUBLE) AS baseline
FROM e, m, (SELECT unnest(range(1, 29)) AS k) LEFT JOIN f ON f.entity = e.entity AND f.day = last - CAST(6 - (k - 1) % 7 AS INTEGER)
""",
    "forecast_errors": """
, h AS (SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS orders FROM events GROUP BY 1, 2
), g AS (SELECT unnest(generate_series((SELECT min(hour) FROM h), (SELECT max(hour) FROM h), INTERVAL 1 HOUR)) AS hour
), p AS (SELECT e.event_type, g.hour, coalesce(h.orders, 0) AS orders FROM (SELECT DISTINCT event_type FROM h) e CROSS JOIN g LEFT JOIN h USING (event_type, hour)
), l AS (SELECT CAST(abs(orders - lag(orders, 168) OVER (PARTITION BY event_type ORDER BY hour)) AS DOUBLE) AS err FROM p)
SELECT count(err) AS n, quantile_cont(err, 0.5) AS median_error, quantile_cont(err, 0.9) AS p90_error, max(err) AS max_error, count(*) FILTER (err <= 0.5) / count(err) AS within_0_5, count(*) FILTER (err <= 1) / count(err) AS within_1_0, count(*) FILTER (err <= 2) / count(err) AS within_2_0 FROM l
""",
    "threshold_sweep": """
, s AS (SELECT least(value, 99) / 100 AS p, event_type = 'purchase' AS y FROM events
), t AS (SELECT unnest(range(1, 20)) AS twentieths)
SELECT twentieths, count(*) FILTER (y AND floor(p * 20 + 1e-9) >= twentieths) AS tp, count(*) FILTER (NOT y AND floor(p * 20 + 1e-9) >= twentieths) AS fp,
       count(*) FILTER (y AND floor(p * 20 + 1e-9) < twentieths) AS fn, count(*) FILTER (NOT y AND floor(p * 20 + 1e-9) < twentieths) AS tn
FROM s, t GROUP BY 1
""",
    "hourly_stream": "SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS orders FROM events GROUP BY 1, 2 HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE",
    "catalog_view": _CLASSES + " SELECT menu_item_id, item_name, category_id, units_sold, performance_class FROM classes WHERE lower(category_id) = 'economy' AND contains(lower(item_name), 'red') LIMIT 1000",
}

ORACLE_SQL: dict[str, str] = {name: PREFIX + body for name, body in _BODIES.items()}
