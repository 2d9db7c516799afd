"""Equivalent SQL of the registered queries, for an independent engine on the same tables.

``VIEWS`` are named common table expressions; a query pulls in those it mentions, directly or
through one another. The SQL follows the definitions directly (plain joins, built-in
quantiles, row-by-row merges) rather than the pre-aggregations of the Spark operators.
"""

from __future__ import annotations

import re

from tidebook.plans.queries import QUERIES, CUTOFF, WINDOW
from tidebook.operators import early, impact, large, models, prediction, seasonality
from tidebook.sources.star import YEAR

_TS = "order_purchase_timestamp"
_MONTHS = "(VALUES ('Jan',1),('Feb',2),('Mar',3),('Apr',4),('May',5),('Jun',6),('Jul',7),('Aug',8),('Sep',9),('Oct',10),('Nov',11),('Dec',12)) AS mn(month_name, month)"


def _days(a: str, b: str) -> str:
    """Fractional days from a to b."""
    return f"(epoch({b}) - epoch({a})) / 86400.0"


def _floor_days(a: str, b: str) -> str:
    return f"CAST(floor((epoch({b}) - epoch({a})) / 86400.0) AS BIGINT)"


def _month_name(m: str) -> str:
    return f"['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'][{m}]"


def _month_label(m: str) -> str:
    return (
        "['January','February','March','April','May','June','July','August','September','October','November','December']"
        f"[{m}]"
    )


def _weekday_name(w: str) -> str:
    return f"['Mon','Tue','Wed','Thu','Fri','Sat','Sun'][{w} + 1]"


def _week(ts: str) -> str:
    monday = f"CAST(date_trunc('week', {ts}) AS DATE)"
    return f"CAST({monday} AS VARCHAR) || '/' || CAST({monday} + 6 AS VARCHAR)"


def _share(predicate: str) -> str:
    return f"avg(CASE WHEN {predicate} THEN 1.0 ELSE 0.0 END)"


VIEWS: dict[str, str] = {
    "nations_c": "SELECT n_nationkey, n_name AS state, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey",
    "orders_0": f"""
        SELECT *, o_orderdate + to_seconds(o_orderkey * 7919 % 86400) AS {_TS} FROM orders""",
    "orders_1": f"""
        SELECT *, {_TS} + to_hours(o_orderkey * 17 % 120 + 1) AS order_delivered_carrier_date FROM orders_0""",
    "orders_c": f"""
        SELECT o_orderkey AS order_id, o_custkey AS customer_id,
               CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'shipped' ELSE 'processing' END AS order_status,
               {_TS},
               CASE WHEN o_custkey % 23 <> 0 THEN {_TS} + to_minutes(o_orderkey * 31 % 2880) END AS order_approved_at,
               order_delivered_carrier_date,
               CASE WHEN o_orderstatus <> 'P' AND o_orderkey % 41 <> 0
                    THEN order_delivered_carrier_date + to_hours((o_custkey * 13 + o_orderkey) % 30 * 24 + o_orderkey * 11 % 24)
               END AS order_delivered_customer_date,
               o_orderdate + INTERVAL 20 DAY AS order_estimated_delivery_date
        FROM orders_1""",
    "items_c": """
        SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, l_partkey AS product_id, l_suppkey AS seller_id,
               l_shipdate AS shipping_limit_date, l_extendedprice AS price,
               CAST(l_quantity * 2.5 * (1 + l_suppkey % 12) + l_linenumber * 0.25 AS DOUBLE) AS freight_value
        FROM lineitem""",
    "products_c": """
        SELECT p_partkey AS product_id, CASE WHEN p_size <> 50 THEN p_brand END AS product_category_name,
               CAST(length(p_name) AS DOUBLE) AS product_name_lenght,
               CASE WHEN p_size % 9 <> 0 THEN CAST(length(p_name) * 10 + p_size AS DOUBLE) END AS product_description_lenght,
               CAST(nullif(p_size % 7, 0) AS DOUBLE) AS product_photos_qty,
               CAST(p_size * 100 AS DOUBLE) AS product_weight_g, CAST(p_size + 10 AS DOUBLE) AS product_length_cm,
               CAST(p_size % 13 + 2 AS DOUBLE) AS product_height_cm, CAST(p_size % 17 + 5 AS DOUBLE) AS product_width_cm
        FROM part""",
    "translations_c": """
        SELECT DISTINCT p_brand AS product_category_name,
               CASE WHEN p_brand <> 'Brand#25' THEN lower(replace(p_brand, '#', '_')) END AS product_category_name_english
        FROM part""",
    "payments_c": """
        SELECT l_orderkey AS order_id, l_linenumber AS payment_sequential,
               CASE l_returnflag WHEN 'A' THEN 'credit_card' WHEN 'N' THEN 'boleto' ELSE 'voucher' END AS payment_type,
               nullif(CAST(l_quantity AS INTEGER) % 13, 0) AS payment_installments,
               l_extendedprice * (1 - l_discount) AS payment_value
        FROM lineitem""",
    "reviews_c": """
        SELECT l_orderkey * 8 + l_linenumber AS review_id, l_orderkey AS order_id,
               CAST(nullif((l_suppkey + l_linenumber) % 6, 0) AS INTEGER) AS review_score,
               CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE l_returnflag END AS review_comment_title,
               CASE WHEN l_linenumber % 2 = 1 THEN l_linestatus END AS review_comment_message,
               l_shipdate AS review_creation_date, l_shipdate + to_hours(l_partkey % 72) AS review_answer_timestamp
        FROM lineitem""",
    "customers_c": """
        SELECT c_custkey AS customer_id, c_name AS customer_unique_id,
               lpad(CAST(c_nationkey * 3989 + c_custkey % 400 AS VARCHAR), 5, '0') AS customer_zip_code_prefix,
               lower(state) || '-' || CAST(c_custkey % 5 AS VARCHAR) AS customer_city, state AS customer_state
        FROM customer LEFT JOIN nations_c ON c_nationkey = n_nationkey""",
    "sellers_c": """
        SELECT s_suppkey AS seller_id,
               lpad(CAST(s_nationkey * 3989 + s_suppkey % 400 AS VARCHAR), 5, '0') AS seller_zip_code_prefix,
               lower(state) || '-' || CAST(s_suppkey % 5 AS VARCHAR) AS seller_city, state AS seller_state
        FROM supplier LEFT JOIN nations_c ON s_nationkey = n_nationkey""",
    "geolocation_c": """
        SELECT lpad(CAST(nk * 3989 + k % 400 AS VARCHAR), 5, '0') AS geolocation_zip_code_prefix,
               CAST(-36.0 + nk * 1.75 + (k % 64) / 64.0 AS DOUBLE) AS geolocation_lat,
               CAST(-70.0 + nk * 1.375 + (k % 32) / 32.0 AS DOUBLE) AS geolocation_lng,
               lower(state) || '-' || CAST(k % 5 AS VARCHAR) AS geolocation_city, state AS geolocation_state
        FROM (SELECT c_custkey AS k, c_nationkey AS nk FROM customer UNION ALL SELECT s_suppkey, s_nationkey FROM supplier)
        LEFT JOIN nations_c ON nk = n_nationkey""",
    "payment_modes": """
        SELECT order_id, payment_type FROM (
            SELECT order_id, payment_type, row_number() OVER (PARTITION BY order_id ORDER BY count(*) DESC, payment_type) AS rn
            FROM payments_c WHERE payment_type IS NOT NULL GROUP BY order_id, payment_type) WHERE rn = 1""",
    "pay_agg": """
        SELECT a.*, m.payment_type FROM (
            SELECT order_id, coalesce(sum(payment_value), 0) AS payment_value, max(payment_installments) AS payment_installments,
                   count(DISTINCT payment_type) AS payment_methods_count, count(*) AS payment_rows
            FROM payments_c GROUP BY order_id) a LEFT JOIN payment_modes m ON a.order_id = m.order_id""",
    "rev_agg": """
        SELECT order_id, avg(review_score) AS review_score, count(DISTINCT review_id) AS review_count,
               min(review_creation_date) AS review_creation_date FROM reviews_c GROUP BY order_id""",
    "products_en": """
        SELECT p.*, coalesce(t.product_category_name_english, p.product_category_name, 'unknown') AS product_category_name_english
        FROM products_c p LEFT JOIN translations_c t ON p.product_category_name = t.product_category_name""",
    "enriched": f"""
        SELECT i.*, o.* EXCLUDE (order_id), p.* EXCLUDE (product_id), pa.* EXCLUDE (order_id), ra.* EXCLUDE (order_id),
               c.* EXCLUDE (customer_id), s.* EXCLUDE (seller_id),
               year({_TS}) AS year, quarter({_TS}) AS quarter, month({_TS}) AS month,
               {_month_name(f'month({_TS})')} AS month_name, strftime({_TS}, '%Y-%m') AS year_month,
               {_week(_TS)} AS week, CAST({_TS} AS DATE) AS order_date, isodow({_TS}) - 1 AS weekday,
               {_weekday_name(f'(isodow({_TS}) - 1)')} AS weekday_name,
               product_length_cm * product_height_cm * product_width_cm AS product_volume_cm3,
               {_days(_TS, 'order_delivered_customer_date')} AS delivery_time_days,
               {_days('order_delivered_customer_date', 'order_estimated_delivery_date')} AS estimated_delivery_delta_days,
               freight_value / nullif(price + freight_value, 0) AS freight_share,
               coalesce(order_status = 'delivered', false) AS is_delivered,
               coalesce(review_score <= 2, false) AS is_low_review, coalesce(review_score >= 4, false) AS is_high_review
        FROM items_c i LEFT JOIN orders_c o ON i.order_id = o.order_id LEFT JOIN products_en p ON i.product_id = p.product_id
        LEFT JOIN pay_agg pa ON i.order_id = pa.order_id LEFT JOIN rev_agg ra ON i.order_id = ra.order_id
        LEFT JOIN customers_c c ON o.customer_id = c.customer_id LEFT JOIN sellers_c s ON i.seller_id = s.seller_id""",
    "delivered": "SELECT * FROM enriched WHERE is_delivered",
    "dy": f"SELECT *, coalesce(product_category_name_english, 'unknown') AS category FROM delivered WHERE year = {YEAR}",
    "order_rows": f"""
        SELECT order_id, {_TS}, year, month, year_month, week, weekday, payment_value, payment_installments, payment_type,
               customer_state, delivery_time_days, estimated_delivery_delta_days, review_score,
               coalesce(sum(price), 0) AS revenue, coalesce(sum(freight_value), 0) AS freight_sum,
               count(order_item_id) AS items_sold, count(DISTINCT product_category_name_english) AS categories_count,
               coalesce(sum(price), 0) + coalesce(sum(freight_value), 0) AS gmv
        FROM delivered GROUP BY ALL""",
    "order_cuts": "SELECT quantile_cont(payment_value, 0.9) AS p90, quantile_cont(payment_value, 0.75) AS p75 FROM order_rows",
    "flags": """
        SELECT order_rows.*, coalesce(payment_value >= p90, false) AS large_purchase_p90,
               coalesce(payment_value >= p75, false) AS large_purchase_p75 FROM order_rows, order_cuts""",
    "months12": "SELECT unnest(range(1, 13)) AS month",
    "cat_month_raw": """
        SELECT product_category_name_english AS category, month, count(DISTINCT order_id) AS orders_count,
               count(order_item_id) AS items_sold, sum(price) AS revenue, avg(price) AS avg_item_price,
               avg(freight_value) AS avg_freight_value, avg(payment_installments) AS avg_payment_installments,
               avg(review_score) AS avg_review_score, avg(delivery_time_days) AS avg_delivery_time_days,
               count(DISTINCT customer_state) AS customer_state_nunique, count(DISTINCT seller_state) AS seller_state_nunique
        FROM dy WHERE product_category_name_english IS NOT NULL GROUP BY 1, 2""",
    "cat_month": """
        SELECT category, month, orders_count, items_sold, revenue, avg_item_price, avg_freight_value, avg_payment_installments,
               avg_review_score, avg_delivery_time_days, customer_state_nunique, seller_state_nunique,
               orders_count / nullif(avg(orders_count) OVER (PARTITION BY category), 0) AS seasonal_index
        FROM (SELECT s.category, s.month, """
    + ", ".join(
        f"CASE WHEN r.category IS NULL THEN 0 ELSE r.{m} END AS {m}" for m in seasonality.MONTH_METRICS
    )
    + """ FROM (SELECT DISTINCT category, months12.month FROM dy, months12) s
             LEFT JOIN cat_month_raw r ON s.category = r.category AND s.month = r.month)""",
    "cat_daily": """
        SELECT product_category_name_english AS category, order_date, count(DISTINCT order_id) AS orders_count,
               count(order_item_id) AS items_sold, coalesce(sum(price), 0) AS revenue
        FROM delivered GROUP BY 1, 2""",
    "rolling": """
        SELECT category, order_date, orders_count,
               CASE WHEN rn >= 30 THEN avg(orders_count) OVER w END AS rolling_mean_30,
               CASE WHEN rn >= 30 THEN stddev_samp(orders_count) OVER w END AS rolling_std_30
        FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY order_date) AS rn,
                     count(*) OVER (PARTITION BY category) AS days FROM cat_daily WHERE category IS NOT NULL)
        WHERE days >= 35
        WINDOW w AS (PARTITION BY category ORDER BY order_date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""",
    "spikes": """
        SELECT * FROM (SELECT *, (orders_count - rolling_mean_30) / nullif(rolling_std_30, 0) AS z_score FROM rolling)
        WHERE abs(z_score) > 3""",
    "weekday_cat": """
        SELECT category, (max(n) - min(n)) / avg(n) AS weekly_pattern_strength FROM (
            SELECT product_category_name_english AS category, weekday, count(DISTINCT order_id) AS n
            FROM delivered WHERE product_category_name_english IS NOT NULL GROUP BY 1, 2) GROUP BY category""",
    "trend_cat": """
        SELECT category, CASE WHEN avg(orders_count) = 0 THEN 0
            ELSE abs(regr_slope(orders_count, month - 1)) * 11 / greatest(max(orders_count), 1) END AS trend_strength
        FROM cat_month GROUP BY category""",
    "cat_quarter": """
        SELECT category, q, n, row_number() OVER (PARTITION BY category ORDER BY n DESC, q) AS rn FROM (
            SELECT category, (month + 2) // 3 AS q, sum(orders_count) AS n FROM cat_month GROUP BY 1, 2)""",
    "cat_peak": """
        SELECT category, month, row_number() OVER (PARTITION BY category ORDER BY orders_count DESC, month) AS rn FROM cat_month""",
    "profile": """
        SELECT a.category, total_orders, total_revenue, active_months, monthly_mean, monthly_std,
               monthly_std / nullif(monthly_mean, 0) AS cv, top / nullif(monthly_mean, 0) AS peak_to_mean, top / low AS peak_to_min,
               top / nullif(total_orders, 0) AS peak_month_share, q.n / nullif(total_orders, 0) AS peak_quarter_share,
               top / nullif(monthly_mean, 0) AS seasonal_index_max,
               CASE WHEN total_orders > 0 THEN p.month END AS peak_month, CASE WHEN total_orders > 0 THEN q.q END AS peak_quarter,
               CASE WHEN total_orders >= 200 AND active_months >= 10 THEN 'high'
                    WHEN total_orders >= 100 AND active_months >= 6 THEN 'medium' ELSE 'low' END AS confidence_level,
               monthly_std / nullif(monthly_mean, 0) AS seasonality_score
        FROM (SELECT category, sum(orders_count) AS total_orders, sum(revenue) AS total_revenue,
                     count(*) FILTER (orders_count > 0) AS active_months, avg(orders_count) AS monthly_mean,
                     stddev_pop(orders_count) AS monthly_std, max(orders_count) AS top,
                     min(orders_count) FILTER (orders_count > 0) AS low
              FROM cat_month GROUP BY category) a
        JOIN (SELECT * FROM cat_quarter WHERE rn = 1) q ON a.category = q.category
        JOIN (SELECT * FROM cat_peak WHERE rn = 1) p ON a.category = p.category""",
    "ranking_0": """
        SELECT p.*, coalesce(s.n, 0) AS event_spike_count, s.z AS max_spike_z_score,
               coalesce(w.weekly_pattern_strength, 0) AS weekly_pattern_strength, coalesce(t.trend_strength, 0) AS trend_strength
        FROM profile p
        LEFT JOIN (SELECT category, count(order_date) AS n, max(z_score) AS z FROM spikes GROUP BY 1) s ON p.category = s.category
        LEFT JOIN weekday_cat w ON p.category = w.category LEFT JOIN trend_cat t ON p.category = t.category""",
    "ranking": """
        SELECT category, total_orders, total_revenue, active_months, monthly_mean, monthly_std, cv, peak_to_mean, peak_to_min,
               peak_month_share, peak_quarter_share, seasonal_index_max, peak_month, peak_quarter, confidence_level,
               event_spike_count, max_spike_z_score, weekly_pattern_strength, trend_strength, seasonality_score,
            CASE WHEN confidence_level = 'low' THEN 'low_confidence'
                 WHEN trend_strength > 0.55 AND cv > 0.8 THEN 'trend_driven'
                 WHEN event_spike_count >= 3 AND peak_month_share < 0.25 THEN 'event_driven'
                 WHEN cv < 0.35 AND peak_to_mean < 1.6 THEN 'stable'
                 WHEN peak_month_share >= 0.35 OR peak_to_mean >= 2.6 THEN 'single_month_spike'
                 WHEN peak_quarter = 4 AND peak_quarter_share >= 0.34 THEN 'holiday_q4'
                 WHEN peak_quarter = 1 AND peak_quarter_share >= 0.34 THEN 'early_year'
                 WHEN peak_quarter IN (2, 3) AND peak_quarter_share >= 0.34 THEN 'mid_year'
                 WHEN peak_quarter_share >= 0.45 THEN 'quarter_peak'
                 WHEN weekly_pattern_strength >= 0.45 THEN 'weekly_pattern' ELSE 'mixed_seasonal' END AS seasonality_type
        FROM ranking_0""",
    "eligible": "SELECT * FROM ranking WHERE confidence_level <> 'low'",
    "score_cut": "SELECT quantile_cont(seasonality_score, 0.75) AS cut FROM eligible",
    "seasonal": "SELECT eligible.* FROM eligible, score_cut WHERE seasonality_score >= cut",
    "peaks": """
        SELECT category, month FROM cat_month
        WHERE seasonal_index >= 1.25 AND category IN (SELECT category FROM seasonal)""",
    "top8": "SELECT category FROM eligible ORDER BY seasonality_score DESC NULLS LAST, category LIMIT 8",
    "line_rows": "SELECT * FROM dy WHERE category IN (SELECT category FROM top8)",
    "impact_rows": """
        SELECT d.*, product_category_name_english AS cat,
               CASE WHEN p.month IS NOT NULL THEN 'peak_months' ELSE 'normal_months' END AS period_type
        FROM delivered d LEFT JOIN peaks p ON d.product_category_name_english = p.category AND d.month = p.month
        WHERE d.product_category_name_english IN (SELECT category FROM seasonal)""",
    "impact_month": f"""
        SELECT cat, month, period_type, count(DISTINCT order_id) AS orders_count, count(order_item_id) AS items_sold,
               coalesce(sum(price), 0) AS revenue, avg(payment_value) AS avg_order_value, avg(price) AS avg_item_price,
               {_share('payment_value >= p90')} AS large_purchase_share,
               avg(payment_installments) AS avg_payment_installments,
               {_share('payment_installments >= 6')} AS share_installments_6_plus, avg(freight_share) AS freight_share,
               avg(delivery_time_days) AS avg_delivery_time_days, avg(review_score) AS avg_review_score,
               {_share('is_low_review')} AS share_low_reviews
        FROM impact_rows, order_cuts GROUP BY 1, 2, 3""",
    "price_cuts": "SELECT "
    + ", ".join(f"quantile_cont(price, {q}) AS {t}" for t, q in large.THRESHOLDS.items())
    + " FROM dy",
    "large_rows": "SELECT dy.*, "
    + ", ".join(f"coalesce(price >= {t}, false) AS is_{t}" for t in large.THRESHOLDS)
    + " FROM dy, price_cuts",
    "uplift_month": f"""
        SELECT d.category, d.month, CASE WHEN p.month IS NOT NULL THEN 'peak_months' ELSE 'normal_months' END AS period_type,
               count(DISTINCT order_id) AS orders_count, count(order_item_id) AS items_sold, coalesce(sum(price), 0) AS revenue,
               avg(price) AS avg_item_price, {_share('is_top10')} AS large_purchase_share,
               avg(payment_installments) AS avg_payment_installments, avg(delivery_time_days) AS avg_delivery_time_days,
               avg(review_score) AS avg_review_score, count(order_item_id) / count(DISTINCT order_id) AS items_per_order
        FROM large_rows d LEFT JOIN peaks p ON d.category = p.category AND d.month = p.month
        WHERE d.category IN (SELECT category FROM seasonal) GROUP BY 1, 2, 3""",
    "prod_month": """
        SELECT product_id, product_category_name_english AS category, month, count(DISTINCT order_id) AS orders_count,
               coalesce(sum(price), 0) AS revenue, count(order_item_id) AS items_sold
        FROM dy WHERE product_category_name_english IS NOT NULL GROUP BY 1, 2, 3""",
    "prod_dense": """
        SELECT k.product_id, k.category, m.month, coalesce(p.orders_count, 0) AS n, coalesce(p.revenue, 0) AS revenue
        FROM (SELECT DISTINCT product_id, category FROM prod_month) k CROSS JOIN months12 m
        LEFT JOIN prod_month p ON k.product_id = p.product_id AND k.category = p.category AND m.month = p.month""",
    "prod_quarter": """
        SELECT product_id, category, q, n, row_number() OVER (PARTITION BY product_id, category ORDER BY n DESC, q) AS rn FROM (
            SELECT product_id, category, (month + 2) // 3 AS q, sum(n) AS n FROM prod_dense GROUP BY 1, 2, 3)""",
    "prod_rank": """
        SELECT a.product_id, a.category, total_orders, total_revenue, active_months, sd / mean AS seasonality_score,
               top / mean AS peak_to_mean, p.month AS peak_month, q.q AS peak_quarter, q.n / total_orders AS peak_quarter_share,
               CASE WHEN total_orders >= 30 AND active_months >= 4 THEN 'high'
                    WHEN total_orders >= 20 AND active_months >= 3 THEN 'medium' ELSE 'low' END AS confidence_level
        FROM (SELECT product_id, category, sum(n) AS total_orders, sum(revenue) AS total_revenue,
                     count(*) FILTER (n > 0) AS active_months, stddev_pop(n) AS sd, avg(n) AS mean, max(n) AS top
              FROM prod_dense GROUP BY 1, 2) a
        JOIN (SELECT * FROM prod_quarter WHERE rn = 1) q ON a.product_id = q.product_id AND a.category = q.category
        JOIN (SELECT product_id, category, month, row_number() OVER (PARTITION BY product_id, category ORDER BY n DESC, month) AS rn
              FROM prod_dense) p ON a.product_id = p.product_id AND a.category = p.category AND p.rn = 1""",
    "h1": "SELECT * FROM dy WHERE month BETWEEN 1 AND 6",
    "h1_feat": f"""
        SELECT category, count(DISTINCT order_id) AS h1_orders, coalesce(sum(price), 0) AS h1_revenue, avg(price) AS h1_avg_item_price,
               avg(payment_installments) AS h1_avg_payment_installments,
               {_share('payment_installments >= 6')} AS h1_share_installments_6_plus, avg(freight_share) AS h1_freight_share,
               avg(review_score) AS h1_avg_review_score, count(DISTINCT customer_state) AS h1_customer_state_nunique,
               count(DISTINCT seller_state) AS h1_seller_state_nunique
        FROM h1 GROUP BY category""",
    "h1_growth": """
        SELECT j.category, (j.n + 1) / (a.n + 1) - 1 AS h1_growth_jan_to_jun FROM
            (SELECT category, count(DISTINCT order_id) AS n FROM h1 WHERE month = 6 GROUP BY 1) j JOIN
            (SELECT category, count(DISTINCT order_id) AS n FROM h1 WHERE month = 1 GROUP BY 1) a ON j.category = a.category""",
    "h1_week": """
        SELECT category, (max(n) - min(n)) / avg(n) AS h1_weekday_concentration FROM (
            SELECT category, weekday, count(DISTINCT order_id) AS n FROM h1 GROUP BY 1, 2) GROUP BY 1""",
    "h2_target": """
        SELECT category, stddev_pop(n) / avg(n) AS h2_seasonality_score, sum(n) AS h2_orders FROM (
            SELECT k.category, m.month, coalesce(c.n, 0) AS n
            FROM (SELECT DISTINCT category FROM dy WHERE month >= 7) k CROSS JOIN (SELECT month FROM months12 WHERE month >= 7) m
            LEFT JOIN (SELECT category, month, count(DISTINCT order_id) AS n FROM dy GROUP BY 1, 2) c
              ON k.category = c.category AND m.month = c.month) GROUP BY 1""",
    "early_0": """
        SELECT f.*, g.h1_growth_jan_to_jun, w.h1_weekday_concentration, t.h2_seasonality_score, t.h2_orders,
               r.confidence_level, r.seasonality_type, r.seasonality_score
        FROM h1_feat f LEFT JOIN h1_growth g ON f.category = g.category LEFT JOIN h1_week w ON f.category = w.category
        JOIN h2_target t ON f.category = t.category LEFT JOIN ranking r ON f.category = r.category""",
    "early_ok": "SELECT * FROM early_0 WHERE confidence_level <> 'low' AND h1_orders >= 20 AND h2_orders >= 20",
    "early_rows": """
        SELECT early_0.*, CASE WHEN h2_seasonality_score >= (SELECT quantile_cont(h2_seasonality_score, 0.75) FROM early_ok)
               THEN 1 ELSE 0 END AS is_h2_seasonal FROM early_0""",
    "scorecard": "SELECT *, ("
    + " + ".join(f"coalesce({f}_rank, 0)" for f in early.SCORE_FEATURES)
    + ") / nullif("
    + " + ".join(f"CASE WHEN {f}_rank IS NULL THEN 0 ELSE 1 END" for f in early.SCORE_FEATURES)
    + ", 0) AS early_warning_score FROM (SELECT *, "
    + ", ".join(
        f"CASE WHEN count({f}) OVER () > 1 AND max({f}) OVER () <> min({f}) OVER () THEN CASE WHEN {f} IS NOT NULL THEN "
        f"(rank() OVER (ORDER BY {f} NULLS LAST) + (count(*) OVER (PARTITION BY {f}) - 1) / 2.0) / count({f}) OVER () END ELSE 0 END AS {f}_rank"
        for f in early.SCORE_FEATURES
    )
    + " FROM early_rows)",
    "features": f"""
        SELECT product_category_name_english AS category, avg(price) AS avg_price, quantile_cont(price, 0.5) AS median_price,
               avg(freight_value) AS avg_freight_value, avg(freight_share) AS freight_share,
               avg(payment_installments) AS avg_payment_installments,
               {_share('payment_installments >= 6')} AS share_installments_6_plus, avg(review_score) AS avg_review_score,
               {_share('is_low_review')} AS share_low_reviews, avg(delivery_time_days) AS avg_delivery_time_days,
               avg(product_weight_g) AS avg_product_weight_g, avg(product_volume_cm3) AS avg_product_volume_cm3,
               avg(product_photos_qty) AS avg_product_photos_qty, avg(product_name_lenght) AS avg_product_name_length,
               avg(product_description_lenght) AS avg_product_description_length,
               count(DISTINCT customer_state) AS customer_state_nunique, count(DISTINCT seller_state) AS seller_state_nunique,
               count(DISTINCT order_id) AS total_orders, coalesce(sum(price), 0) AS total_revenue
        FROM delivered WHERE product_category_name_english IS NOT NULL GROUP BY 1""",
    "weeks": f"""
        SELECT w.week_start, CAST(coalesce(n, 0) AS DOUBLE) AS y FROM (
            SELECT CAST(unnest(generate_series(min(d), max(d), INTERVAL 7 DAY)) AS DATE) AS week_start
            FROM (SELECT date_trunc('week', {_TS}) AS d FROM delivered)) w
        LEFT JOIN (SELECT CAST(date_trunc('week', {_TS}) AS DATE) AS week_start, count(DISTINCT order_id) AS n
                   FROM delivered GROUP BY 1) c ON w.week_start = c.week_start
        WHERE w.week_start <= DATE '{CUTOFF}'""",
    "weeks_n": """
        SELECT *, row_number() OVER (ORDER BY week_start DESC) AS back, count(*) OVER () AS n,
               least(8, greatest(4, count(*) OVER () // 8)) AS h FROM weeks""",
    "holdout": """
        SELECT t.week_start, t.y AS actual,
               (SELECT avg(y) FROM weeks_n WHERE back > h AND back <= h + 4) AS last_4_week_mean,
               CASE WHEN count(s.y) OVER () = count(*) OVER () THEN s.y
                    ELSE (SELECT avg(y) FROM weeks_n WHERE back > h AND back <= h + 8) END AS seasonal_naive_or_8w_mean
        FROM weeks_n t LEFT JOIN (SELECT week_start, y FROM weeks_n WHERE back > h) s ON t.week_start = s.week_start + 364
        WHERE t.back <= t.h AND t.n >= 50""",
    "points": """
        SELECT *, CAST(substr(geolocation_zip_code_prefix, 1, 3) AS INTEGER) AS zip3,
               CAST(geolocation_zip_code_prefix AS INTEGER) AS zip_int,
               6378137.0 * radians(geolocation_lng) AS x, 6378137.0 * ln(tan(pi() / 4 + radians(geolocation_lat) / 2)) AS y
        FROM geolocation_c
        WHERE geolocation_lat BETWEEN -33.75116944 AND 5.27438888 AND geolocation_lng BETWEEN -73.98283055 AND -34.79314722""",
    "geo_rows": f"""
        SELECT o.order_id, o.order_delivered_customer_date, o.order_delivered_carrier_date, o.order_estimated_delivery_date,
               i.price, i.freight_value, r.review_score, CAST(substr(customer_zip_code_prefix, 1, 3) AS INTEGER) AS zip3,
               {_floor_days('order_delivered_carrier_date', 'order_delivered_customer_date')} AS days,
               coalesce(order_delivered_customer_date > order_estimated_delivery_date, false) AS is_delayed
        FROM orders_c o JOIN items_c i ON o.order_id = i.order_id JOIN customers_c c ON o.customer_id = c.customer_id
        JOIN reviews_c r ON o.order_id = r.order_id""",
    "geo_orders": """
        SELECT order_id, max(zip3) AS zip3, sum(price) AS price, sum(freight_value) AS freight_value, count(*) AS n
        FROM geo_rows GROUP BY order_id""",
    "geo_one": """
        SELECT geolocation_zip_code_prefix, geolocation_lat, geolocation_lng, geolocation_city, geolocation_state FROM (
            SELECT *, row_number() OVER (PARTITION BY geolocation_zip_code_prefix
                ORDER BY geolocation_lat, geolocation_lng, geolocation_city, geolocation_state) AS rn FROM geolocation_c) WHERE rn = 1""",
    "packages": """
        SELECT order_id, coalesce(sum(product_length_cm * product_width_cm * product_height_cm), 0) AS product_size_cm3,
               coalesce(sum(product_weight_g), 0) AS product_weight_g
        FROM items_c i LEFT JOIN products_c p ON i.product_id = p.product_id GROUP BY order_id""",
    "delivery_rows": f"""
        SELECT o.order_id, o.{_TS}, o.order_delivered_customer_date, gc.geolocation_state AS geolocation_state_customer,
               gs.geolocation_state AS geolocation_state_seller, gs.geolocation_lat AS geolocation_lat_seller,
               gs.geolocation_lng AS geolocation_lng_seller,
               2 * 6371 * asin(sqrt(pow(sin((radians(gc.geolocation_lat) - radians(gs.geolocation_lat)) / 2), 2)
                   + cos(radians(gs.geolocation_lat)) * cos(radians(gc.geolocation_lat))
                   * pow(sin((radians(gc.geolocation_lng) - radians(gs.geolocation_lng)) / 2), 2))) AS distance,
               k.product_size_cm3, k.product_weight_g,
               {_floor_days(_TS, 'order_delivered_customer_date')} AS wait_time,
               {_floor_days(_TS, 'order_estimated_delivery_date')} AS estimated_wait
        FROM orders_c o JOIN items_c i ON o.order_id = i.order_id
        JOIN (SELECT order_id FROM items_c GROUP BY 1 HAVING count(DISTINCT seller_id) = 1) m ON o.order_id = m.order_id
        JOIN sellers_c s ON i.seller_id = s.seller_id JOIN geo_one gs ON s.seller_zip_code_prefix = gs.geolocation_zip_code_prefix
        JOIN customers_c c ON o.customer_id = c.customer_id
        JOIN geo_one gc ON c.customer_zip_code_prefix = gc.geolocation_zip_code_prefix
        LEFT JOIN packages k ON o.order_id = k.order_id
        WHERE o.order_delivered_customer_date IS NOT NULL AND o.order_delivered_carrier_date IS NOT NULL
          AND o.order_estimated_delivery_date IS NOT NULL""",
    "delivery_orders": f"""
        SELECT order_id, any_value({_TS}) AS ts, count(*) AS n, any_value(wait_time) AS wait_time, any_value(distance) AS distance,
               any_value(product_size_cm3) AS size, any_value(product_weight_g) AS weight, any_value(geolocation_state_customer) AS c1,
               any_value(geolocation_state_seller) AS c2, any_value(year({_TS})) AS c3, any_value(month({_TS})) AS c4, any_value(isodow({_TS})) AS c5
        FROM delivery_rows GROUP BY order_id""",
    "delivery_points": f"""
        SELECT *, CAST(floor((row_number() OVER (ORDER BY CAST(ts AS DATE), order_id % {models.POSITION_BUCKETS}, order_id) - 1) * {models.FOLDS} / count(*) OVER ()) AS INTEGER) AS fold,
               (distance - min(distance) OVER ()) / (max(distance) OVER () - min(distance) OVER ()) AS x1,
               (size - min(size) OVER ()) / (max(size) OVER () - min(size) OVER ()) AS x2,
               (weight - min(weight) OVER ()) / (max(weight) OVER () - min(weight) OVER ()) AS x3
        FROM delivery_orders""",
    "delivery_near": """
        SELECT *, coalesce(sum(n) OVER (PARTITION BY order_id ORDER BY d, other ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (
            SELECT q.order_id, q.fold, q.n AS rows_of, q.wait_time, r.order_id AS other, r.n, r.wait_time AS waited,
                   (q.x1 - r.x1) * (q.x1 - r.x1) + (q.x2 - r.x2) * (q.x2 - r.x2) + (q.x3 - r.x3) * (q.x3 - r.x3)
                   + 2.0 * ((q.c1 <> r.c1)::INTEGER + (q.c2 <> r.c2)::INTEGER + (q.c3 <> r.c3)::INTEGER + (q.c4 <> r.c4)::INTEGER + (q.c5 <> r.c5)::INTEGER)::DOUBLE AS d
            FROM delivery_points q JOIN delivery_points r ON q.fold <> r.fold)""",
    "delivery_nearest": """
        SELECT order_id, any_value(fold) AS fold, any_value(rows_of) AS count, any_value(wait_time) AS wait_time,
               sum(waited * least(n, 3 - before)) / sum(least(n, 3 - before)) AS prediction
        FROM delivery_near WHERE before < 3 GROUP BY order_id""",
    "review_join": """
        SELECT r.review_id, r.review_score, r.review_comment_title, r.review_comment_message, r.review_creation_date,
               o.order_status, o.order_approved_at, o.order_delivered_carrier_date, o.order_estimated_delivery_date,
               c.customer_state, p.product_category_name
        FROM reviews_c r JOIN orders_c o ON r.order_id = o.order_id JOIN customers_c c ON c.customer_id = o.customer_id
        JOIN items_c i ON i.order_id = o.order_id JOIN products_c p ON p.product_id = i.product_id""",
    "review_rows": """
        SELECT review_id, review_creation_date AS review_date, order_approved_at AS order_approved,
               order_delivered_carrier_date AS delivered_carrier, order_estimated_delivery_date AS estimated_delivery,
               product_category_name AS product_category, order_status, nullif(review_comment_title, '') AS review_title,
               nullif(review_comment_message, '') AS review_message, customer_state, review_score AS score
        FROM (SELECT DISTINCT * FROM review_join)""",
    "review_days": f"""
        SELECT *, coalesce(days_raw, abs(avg(days_raw) OVER (PARTITION BY customer_state))) AS days_to_delivery FROM (
            SELECT *, CASE WHEN delivered_carrier >= order_approved
                           THEN CAST({_floor_days('order_approved', 'delivered_carrier')} AS DOUBLE) END AS days_raw
            FROM review_rows WHERE review_id IS NOT NULL AND review_date IS NOT NULL AND order_approved IS NOT NULL
              AND delivered_carrier IS NOT NULL AND estimated_delivery IS NOT NULL AND product_category IS NOT NULL
              AND order_status IS NOT NULL AND review_title IS NOT NULL AND review_message IS NOT NULL
              AND customer_state IS NOT NULL AND score IS NOT NULL)""",
    "merged": """
        SELECT oi.order_id, oi.order_item_id, oi.price, oi.freight_value, p.payment_type, r.review_score, pr.product_id,
               c.customer_id, c.customer_state, s.seller_id, s.seller_state
        FROM (SELECT o.order_id, o.customer_id, i.order_item_id, i.price, i.freight_value, i.product_id, i.seller_id
              FROM orders_c o LEFT JOIN items_c i ON o.order_id = i.order_id) oi
        FULL JOIN payments_c p ON oi.order_id = p.order_id
        FULL JOIN reviews_c r ON coalesce(oi.order_id, p.order_id) = r.order_id
        FULL JOIN products_c pr ON oi.product_id = pr.product_id
        FULL JOIN customers_c c ON oi.customer_id = c.customer_id
        FULL JOIN sellers_c s ON oi.seller_id = s.seller_id""",
    "merged_all": """
        SELECT coalesce(oi.order_id, p.order_id, r.order_id) AS order_id, coalesce(oi.customer_id, c.customer_id) AS customer_id,
               coalesce(oi.product_id, pr.product_id) AS product_id, coalesce(oi.seller_id, s.seller_id) AS seller_id,
               oi.* EXCLUDE (order_id, customer_id, product_id, seller_id), p.* EXCLUDE (order_id), r.* EXCLUDE (order_id),
               pr.* EXCLUDE (product_id), c.* EXCLUDE (customer_id), s.* EXCLUDE (seller_id)
        FROM (SELECT o.*, i.* EXCLUDE (order_id) FROM orders_c o LEFT JOIN items_c i ON o.order_id = i.order_id) oi
        FULL JOIN payments_c p ON oi.order_id = p.order_id
        FULL JOIN reviews_c r ON coalesce(oi.order_id, p.order_id) = r.order_id
        FULL JOIN products_c pr ON oi.product_id = pr.product_id
        FULL JOIN customers_c c ON oi.customer_id = c.customer_id
        FULL JOIN sellers_c s ON oi.seller_id = s.seller_id""",
    "sales_rows": f"""
        SELECT i.*, o.{_TS}, year({_TS}) AS year, month({_TS}) AS month, isodow({_TS}) - 1 AS weekday, hour({_TS}) AS hour
        FROM items_c i JOIN orders_c o ON i.order_id = o.order_id""",
    "factors": f"""
        SELECT o.order_status, CAST(year({_TS}) AS VARCHAR) || '.' || CAST(quarter({_TS}) AS VARCHAR) AS year_quarter,
               {_floor_days(_TS, 'order_delivered_customer_date')} AS act_lead_days,
               CAST(floor((epoch(order_approved_at) - epoch({_TS})) / 60.0) AS BIGINT) AS approval_mins,
               order_item_id, price, freight_value, product_weight_g
        FROM items_c i JOIN orders_c o ON i.order_id = o.order_id JOIN products_c p ON i.product_id = p.product_id
        WHERE order_approved_at IS NOT NULL AND order_delivered_customer_date IS NOT NULL AND product_category_name IS NOT NULL
          AND product_description_lenght IS NOT NULL AND product_photos_qty IS NOT NULL
          AND p.product_category_name IN (SELECT product_category_name FROM translations_c WHERE product_category_name_english IS NOT NULL)
          AND o.customer_id IN (SELECT customer_id FROM customers_c) AND i.seller_id IN (SELECT seller_id FROM sellers_c)""",
    "freight_moments": """
        SELECT CAST(order_item_id AS DOUBLE) AS x, CAST(count(*) AS DOUBLE) AS n, avg(freight_value) AS mean, sum(freight_value) AS sy,
               sum(freight_value * freight_value) AS syy FROM items_c GROUP BY 1""",
}

SQL: dict[str, str] = {}

_TABLES = {
    name: cols
    for name, cols in {
        "orders": f"order_id customer_id order_status {_TS} order_approved_at order_delivered_carrier_date order_delivered_customer_date order_estimated_delivery_date",
        "items": "order_id order_item_id product_id seller_id shipping_limit_date price freight_value",
        "products": "product_id product_category_name product_name_lenght product_description_lenght product_photos_qty product_weight_g product_length_cm product_height_cm product_width_cm",
        "translations": "product_category_name product_category_name_english",
        "payments": "order_id payment_sequential payment_type payment_installments payment_value",
        "reviews": "review_id order_id review_score review_comment_title review_comment_message review_creation_date review_answer_timestamp",
        "customers": "customer_id customer_unique_id customer_zip_code_prefix customer_city customer_state",
        "sellers": "seller_id seller_zip_code_prefix seller_city seller_state",
        "geolocation": "geolocation_zip_code_prefix geolocation_lat geolocation_lng geolocation_city geolocation_state",
    }.items()
}


# Types of the merged columns.
_TYPES = {
    c: kind
    for kind, cols in {
        "bigint": "order_id customer_id product_id seller_id review_id",
        "int": "order_item_id payment_sequential payment_installments review_score",
        "double": "price freight_value payment_value product_name_lenght product_description_lenght product_photos_qty product_weight_g product_length_cm product_height_cm product_width_cm",
        "string": "order_status payment_type review_comment_title review_comment_message product_category_name customer_unique_id customer_zip_code_prefix customer_city customer_state seller_zip_code_prefix seller_city seller_state",
        "timestamp_ntz": f"{_TS} order_approved_at order_delivered_carrier_date order_delivered_customer_date order_estimated_delivery_date shipping_limit_date review_creation_date review_answer_timestamp",
    }.items()
    for c in cols.split()
}


def _audit_sql(table: str, columns: str) -> str:
    cols = columns.split()
    nulls = " + ".join(f"(count(*) - count({c}))" for c in cols)
    return (
        f"SELECT '{table}' AS \"table\", count(*) AS \"rows\", {len(cols)} AS columns, "
        f"count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {table}_c)) AS duplicate_rows, "
        f"{nulls} AS missing_cells, '{', '.join(cols)}' AS columns_list FROM {table}_c"
    )


def _missing_sql(table: str, columns: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{table}' AS \"table\", '{c}' AS \"column\", count(*) - count({c}) AS missing FROM {table}_c HAVING count(*) > count({c})"
        for c in columns.split()
    )


def _merged_columns() -> dict[str, str]:
    """Column to table of the merge, in its order."""
    sides = ("orders", "items", "payments", "reviews", "products", "customers", "sellers")
    return {c: side for side in reversed(sides) for c in _TABLES[side].split()}


_ORDER_OF = "ORDER BY order_id NULLS LAST, order_item_id NULLS LAST, payment_sequential NULLS LAST, review_id NULLS LAST"


def _profile_sql() -> str:
    parts = []
    for c in _merged_columns():
        nth = lambda k: f"(SELECT CAST({c} AS VARCHAR) FROM merged_all {_ORDER_OF} LIMIT 1 OFFSET {k})"
        parts.append(
            f"SELECT '{c}' AS name, '{_TYPES[c]}' AS dtype, (SELECT count(*) - count({c}) FROM merged_all) AS missing, "
            f"(SELECT count(DISTINCT {c}) FROM merged_all) AS uniques, {nth(0)} AS first_value, {nth(1)} AS second_value, {nth(2)} AS third_value, "
            f"(SELECT -sum(p * log2(p)) FROM (SELECT count(*) / sum(count(*)) OVER () AS p FROM merged_all WHERE {c} IS NOT NULL GROUP BY {c})) AS entropy"
        )
    return " UNION ALL ".join(parts)


def _kinds_sql() -> str:
    ids = "('order_id', 'seller_id', 'customer_id', 'order_item_id', 'product_id', 'review_id', 'customer_unique_id', 'seller_zip_code_prefix')"
    union = " UNION ALL ".join(f"SELECT '{c}' AS name, count(DISTINCT {c}) AS uniques FROM merged_all" for c in _merged_columns())
    return (
        "SELECT name, uniques, CASE WHEN uniques = 2 THEN 'binary' WHEN uniques <= 27 THEN 'categorical' "
        f"WHEN name IN {ids} THEN 'id' ELSE 'numeric' END AS kind FROM ({union})"
    )


def _describe_sql(source: str, value: str) -> str:
    stats = {
        "count": f"count({value})", "mean": f"avg({value})", "std": f"stddev_samp({value})", "min": f"min({value})", "max": f"max({value})",
        "25%": f"quantile_cont({value}, 0.25)", "50%": f"quantile_cont({value}, 0.5)", "75%": f"quantile_cont({value}, 0.75)",
    }
    return " UNION ALL ".join(f"SELECT '{k}' AS statistic, CAST({e} AS DOUBLE) AS value FROM {source}" for k, e in stats.items())


def _lead_columns() -> str:
    elapsed = lambda a, b, unit: f"CAST(floor((epoch({b}) - epoch({a})) / {unit}) AS BIGINT)"
    approved, carrier, received, promised = (
        "order_approved_at", "order_delivered_carrier_date", "order_delivered_customer_date", "order_estimated_delivery_date",
    )
    return f"""
        {elapsed(_TS, promised, 86400.0)} AS est_lead_days, {elapsed(_TS, received, 86400.0)} AS act_lead_days,
        {elapsed(_TS, approved, 60.0)} AS approval_mins, {elapsed(_TS, carrier, 86400.0)} AS purchase_to_carrier_days,
        {elapsed(carrier, received, 86400.0)} AS carrier_to_customer_days,
        date_diff('minute', {_TS}, {approved}) AS processing_minutes, date_diff('hour', {_TS}, {approved}) AS processing_hours,
        date_diff('day', {approved}, {carrier}) AS approved_to_carrier_days, date_diff('day', {carrier}, {received}) AS carrier_to_customer_dates,
        date_diff('day', {received}, {promised}) AS customer_vs_estimate_days, date_diff('day', {approved}, {received}) AS approved_to_customer_days"""


def _line(keys: str, extra: str = "") -> str:
    return (
        f"SELECT category, {keys}, count(DISTINCT order_id) AS orders_count, count(order_item_id) AS items_sold, "
        f"coalesce(sum(price), 0) AS revenue{extra} FROM line_rows GROUP BY category, {keys}"
    )


def _top(period: str, entity: str, n: int) -> str:
    name = f", {_month_name('month')} AS month_name" if period == "month" else ""
    return f"""
        SELECT *{name} FROM (SELECT *, row_number() OVER (PARTITION BY {period}
                ORDER BY orders_count DESC, round(revenue, 2) DESC, items_sold DESC, {entity}) AS rank
            FROM (SELECT {period}, {entity}, count(DISTINCT order_id) AS orders_count, count(order_item_id) AS items_sold,
                         coalesce(sum(price), 0) AS revenue FROM dy GROUP BY ALL)) WHERE rank <= {n}"""


def _compare_sql(metrics: dict[str, str], source: str, keys: str = "") -> str:
    """One row per metric (and key) with the mean of both periods and their difference."""
    lead, group = (f"{keys}, ", f"GROUP BY {keys}") if keys else ("", "")
    parts = [
        f"SELECT {lead}'{m}' AS metric, avg({e}) FILTER (period_type = 'normal_months') AS normal_months, "
        f"avg({e}) FILTER (period_type = 'peak_months') AS peak_months FROM {source} {group}"
        for m, e in metrics.items()
    ]
    return (
        "SELECT *, peak_months - normal_months AS delta_abs, peak_months / nullif(normal_months, 0) - 1 AS delta_pct FROM ("
        + " UNION ALL ".join(parts) + ")"
    )


def _thresholds_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT '{t}' AS threshold, CAST({q} AS DOUBLE) AS price_quantile, (SELECT {t} FROM price_cuts) AS min_item_price, "
        f"count(*) FILTER (is_{t}) AS items_count, count(*) FILTER (is_{t}) / count(*) AS items_share, "
        f"sum(price) FILTER (is_{t}) AS revenue, sum(price) FILTER (is_{t}) / sum(price) AS revenue_share FROM large_rows"
        for t, q in large.THRESHOLDS.items()
    )


def _large_sql(keys: str) -> str:
    per = ", ".join(
        f"count(*) FILTER (is_{t}) AS large_items_count_{t}, coalesce(sum(price) FILTER (is_{t}), 0) AS large_revenue_{t}"
        for t in large.THRESHOLDS
    )
    shares = ", ".join(
        f"large_items_count_{t} / items_count AS large_items_share_{t}, large_revenue_{t} / total_revenue AS large_revenue_share_of_period_{t}, "
        f"large_revenue_{t} / sum(large_revenue_{t}) OVER () AS large_revenue_distribution_{t}"
        for t in large.THRESHOLDS
    )
    return f"""
        SELECT *, {shares} FROM (
            SELECT {keys}, count(DISTINCT order_id) AS orders_count, count(order_item_id) AS items_count, sum(price) AS total_revenue,
                   avg(price) AS avg_item_price, quantile_cont(price, 0.5) AS median_item_price, {per}
            FROM large_rows GROUP BY {keys})"""


_INST = """
    SELECT month, avg(payment_installments) AS all_avg_installments,
           avg(CASE WHEN payment_installments >= 6 THEN 1.0 ELSE 0.0 END) AS all_share_installments_6_plus,
           avg(payment_installments) FILTER (is_top10) AS top10_avg_installments,
           avg(CASE WHEN payment_installments >= 6 THEN 1.0 ELSE 0.0 END) FILTER (is_top10) AS top10_share_installments_6_plus
    FROM large_rows GROUP BY month"""
_BF = f"""
    SELECT order_date, sum(price) AS all_revenue, coalesce(sum(price) FILTER (is_top10), 0) AS top10_revenue,
           coalesce(sum(price) FILTER (is_top20), 0) AS top20_revenue
    FROM large_rows WHERE order_date BETWEEN DATE '{WINDOW[0]}' AND DATE '{WINDOW[1]}' GROUP BY order_date"""
_MIX = """
    SELECT period_type, category, revenue AS top10_expensive_revenue, items AS top10_expensive_items,
           revenue / sum(revenue) OVER (PARTITION BY period_type) AS period_revenue_share FROM (
        SELECT CASE WHEN p.month IS NOT NULL THEN 'peak_months' ELSE 'normal_months' END AS period_type, d.category,
               sum(price) AS revenue, count(order_item_id) AS items
        FROM large_rows d LEFT JOIN peaks p ON d.category = p.category AND d.month = p.month
        WHERE is_top10 AND d.category IN (SELECT category FROM seasonal) GROUP BY 1, 2)"""
_DECOMP = """
    SELECT period_type, avg(orders_count) AS orders_count, avg(items_per_order) AS items_per_order,
           avg(avg_item_price) AS avg_item_price, avg(revenue) AS revenue FROM uplift_month GROUP BY period_type"""


def _spearman_sql() -> str:
    rank = lambda v: f"rank() OVER (ORDER BY {v}) + (count(*) OVER (PARTITION BY {v}) - 1) / 2.0"
    return " UNION ALL ".join(
        f"SELECT '{f}' AS feature, CASE WHEN min(a) <> max(a) AND min(b) <> max(b) THEN abs(corr(a, b)) END AS importance "
        f"FROM (SELECT {rank(f)} AS a, {rank('h2_seasonality_score')} AS b FROM early_ok "
        f"WHERE {f} IS NOT NULL AND h2_seasonality_score IS NOT NULL)"
        for f in early.FEATURES
    )


def _long(source: str, keys: str, columns: list[str], name: str, value: str) -> str:
    return " UNION ALL ".join(f"SELECT {keys}, '{c}' AS {name}, {c} AS {value} FROM ({source})" for c in columns)


def _share_sql(source: str, key: str, counted: str) -> str:
    return f"""
        SELECT {key}, count({counted}) AS total, round(CAST(100.0 * count({counted}) / sum(count({counted})) OVER () AS DECIMAL(20, 9)), 2) AS percent
        FROM {source} WHERE {key} IS NOT NULL GROUP BY {key}"""


_TREND = "SELECT {0}, sum(price) AS total_value, avg(price) AS mean_transaction, count(order_id) AS order_count{1} FROM sales_rows GROUP BY {0}"
_BOX = (
    "min({0}) AS min_value, quantile_cont({0}, 0.25) AS q1, quantile_cont({0}, 0.5) AS median, "
    "quantile_cont({0}, 0.75) AS q3, max({0}) AS max_value"
)
_REGION_NAMES = {"AFRICA": "africa", "AMERICA": "america", "ASIA": "asia", "EUROPE": "europe", "MIDDLE EAST": "middle_east"}
_CALENDAR = f"""
    year({_TS}) AS year, quarter({_TS}) AS quarter, month({_TS}) AS month, {_month_name(f'month({_TS})')} AS month_name,
    strftime({_TS}, '%Y-%m') AS year_month, {_week(_TS)} AS week, CAST({_TS} AS DATE) AS order_date,
    isodow({_TS}) - 1 AS weekday, {_weekday_name(f'(isodow({_TS}) - 1)')} AS weekday_name"""
_KPIS = {
    "total_orders": "SELECT count(*) FROM orders_c",
    "late_orders": "SELECT count(*) FROM orders_c WHERE order_delivered_customer_date > order_estimated_delivery_date",
    "avg_processing_hours": f"SELECT avg(date_diff('hour', {_TS}, order_approved_at)) FROM orders_c",
    "avg_days_to_carrier": "SELECT avg(date_diff('day', order_approved_at, order_delivered_carrier_date)) FROM orders_c",
    "avg_days_to_customer": "SELECT avg(date_diff('day', order_delivered_carrier_date, order_delivered_customer_date)) FROM orders_c",
    "total_sales": "SELECT sum(price) FROM items_c",
    "products_sold": "SELECT count(*) FROM items_c",
    "products_for_sale": "SELECT count(DISTINCT product_id) FROM products_c",
    "late_dispatches": "SELECT count(*) FROM orders_c o JOIN (SELECT order_id, min(shipping_limit_date) AS l FROM items_c GROUP BY 1) i "
    "ON o.order_id = i.order_id WHERE order_delivered_carrier_date > l",
    "total_reviews": "SELECT count(*) FROM reviews_c",
    "avg_rating": "SELECT avg(review_score) FROM reviews_c",
    "five_star_reviews": "SELECT count(*) FROM reviews_c WHERE review_score = 5",
    "one_star_reviews": "SELECT count(*) FROM reviews_c WHERE review_score = 1",
    "bad_reviews": "SELECT count(*) FROM reviews_c WHERE review_score <= 3",
}

SQL.update(
    {
        "load_counts": " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS \"rows\" FROM {t}_c" for t in _TABLES),
        "table_audit": " UNION ALL ".join(_audit_sql(t, c) for t, c in _TABLES.items()),
        "missing_by_column": " UNION ALL ".join(_missing_sql(t, c) for t, c in _TABLES.items()),
        "coverage_by_year": " UNION ALL ".join(
            f"""SELECT '{scope}' AS scope, year({_TS}) AS year, count(*) AS orders, CAST(min({_TS}) AS DATE) AS first_order,
                CAST(max({_TS}) AS DATE) AS last_order, CAST(max({_TS}) AS DATE) - CAST(min({_TS}) AS DATE) + 1 AS span_days,
                count(DISTINCT CAST({_TS} AS DATE)) AS active_days, dayofyear(make_date(year({_TS}), 12, 31)) AS calendar_days,
                CAST(min({_TS}) AS DATE) - make_date(year({_TS}), 1, 1) AS missing_before,
                make_date(year({_TS}), 12, 31) - CAST(max({_TS}) AS DATE) AS missing_after
                FROM orders_c WHERE {cond} GROUP BY year({_TS})"""
            for scope, cond in (("all_orders", "true"), ("delivered", "order_status = 'delivered'"))
        ),
        "year_month_matrix": f"SELECT year({_TS}) AS year, "
        + ", ".join(f"count(DISTINCT order_id) FILTER (month({_TS}) = {m}) AS m{m:02d}" for m in range(1, 13))
        + f" FROM orders_c WHERE order_status = 'delivered' GROUP BY year({_TS})",
        "column_profile": _profile_sql(),
        "column_kinds": _kinds_sql(),
        "zip_count_describe": _describe_sql("(SELECT count(*) AS size FROM geolocation_c GROUP BY geolocation_zip_code_prefix)", "size"),
        "zip_describe": _describe_sql("points", "zip_int"),
        "status_counts": "SELECT order_status, count(DISTINCT order_id) AS orders_count, count(DISTINCT customer_id) AS customers_count FROM orders_c GROUP BY 1",
        "order_value_summary": "SELECT min(price) AS min_value, max(price) AS max_value, avg(price) AS avg_value, quantile_cont(price, 0.5) AS median_value FROM items_c",
        "log_value_moments": " UNION ALL ".join(
            f"""SELECT '{c}' AS "column", avg(pow(d, 3)) / pow(avg(d * d), 1.5) AS skewness, avg(pow(d, 4)) / pow(avg(d * d), 2) - 3 AS excess_kurtosis
                FROM (SELECT y - avg(y) OVER () AS d FROM (SELECT ln({c} + 1) AS y FROM items_c))"""
            for c in ("price", "freight_value")
        ),
        "price_outliers": """SELECT order_id, order_item_id, price, b AS outlier_bound
            FROM items_c, (SELECT avg(price) + 1.6 * stddev_samp(price) AS b FROM items_c) WHERE price > b""",
        "enriched_items": "SELECT * FROM enriched",
        "calendar_features": f"""SELECT order_id, {_TS}, {_CALENDAR}, day({_TS}) AS monthday, hour({_TS}) AS hour,
            CAST(year({_TS}) AS VARCHAR) || '.' || CAST(quarter({_TS}) AS VARCHAR) AS year_quarter, {_month_label(f'month({_TS})')} AS month_label
            FROM orders_c""",
        "payments_per_order": "SELECT * FROM pay_agg",
        "reviews_per_order": "SELECT * FROM rev_agg",
        "lead_times": f"SELECT order_id, {_lead_columns()} FROM orders_c",
        "order_cost_flags": """SELECT order_id, order_item_id, order_item_id * price AS order_price, order_item_id * freight_value AS order_freight,
            order_item_id * price + order_item_id * freight_value AS total_order_cost,
            CASE WHEN freight_value >= price THEN 1 ELSE 0 END AS freight_over_price FROM items_c""",
        "order_level": "SELECT * FROM order_rows",
        "order_flags": "SELECT order_id, payment_value, large_purchase_p90, large_purchase_p75 FROM flags",
        "monthly_metrics": f"""SELECT o.*, i.* EXCLUDE (year_month), i.revenue + i.freight_sum AS gmv,
                CAST(substr(o.year_month, 1, 4) AS INTEGER) AS year, CAST(substr(o.year_month, 6, 2) AS INTEGER) AS month FROM (
            SELECT year_month, count(DISTINCT order_id) AS orders_count, coalesce(sum(payment_value), 0) AS payment_value_sum,
                   avg(payment_value) AS avg_order_value, {_share('large_purchase_p90')} AS large_purchase_share,
                   avg(payment_installments) AS avg_payment_installments, {_share('payment_installments >= 6')} AS share_installments_6_plus
            FROM flags GROUP BY year_month) o LEFT JOIN (
            SELECT year_month, count(order_item_id) AS items_sold, count(DISTINCT product_id) AS products_sold, sum(price) AS revenue,
                   sum(freight_value) AS freight_sum, avg(price) AS avg_item_price, avg(freight_value) AS avg_freight_value,
                   avg(review_score) AS avg_review_score, avg(delivery_time_days) AS avg_delivery_time_days
            FROM delivered GROUP BY year_month) i ON o.year_month = i.year_month""",
        "weekly_metrics": f"""SELECT week, count(DISTINCT order_id) AS orders_count, sum(revenue) AS revenue, avg(payment_value) AS avg_order_value,
            {_share('large_purchase_p90')} AS large_purchase_share FROM flags GROUP BY week""",
        "category_month": f"SELECT *, {_month_name('month')} AS month_name FROM cat_month",
        "category_week": """SELECT product_category_name_english AS category, week, count(DISTINCT order_id) AS orders_count,
            sum(price) AS revenue, count(order_item_id) AS items_sold FROM delivered WHERE product_category_name_english IS NOT NULL GROUP BY 1, 2""",
        "category_daily": "SELECT * FROM cat_daily",
        "event_spikes": "SELECT * FROM spikes",
        "total_spikes": """SELECT *, coalesce(abs(z_score) > 3, false) AS is_spike FROM (
            SELECT *, (orders_count - rolling_mean_30) / nullif(rolling_std_30, 0) AS z_score FROM (
            SELECT date, orders_count, CASE WHEN rn >= 30 THEN avg(orders_count) OVER w END AS rolling_mean_30,
                   CASE WHEN rn >= 30 THEN stddev_samp(orders_count) OVER w END AS rolling_std_30 FROM (
                SELECT order_date AS date, count(DISTINCT order_id) AS orders_count, row_number() OVER (ORDER BY order_date) AS rn
                FROM delivered GROUP BY order_date)
            WINDOW w AS (ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)))""",
        "weekday_orders": f"""SELECT weekday, count(DISTINCT order_id) AS orders_count, sum(price) AS revenue,
            {_weekday_name('weekday')} AS weekday_name FROM delivered GROUP BY weekday""",
        "trend_strength": "SELECT * FROM trend_cat",
        "weekly_strength": "SELECT * FROM weekday_cat",
        "category_ranking": "SELECT * FROM ranking",
        "top_seasonal": "SELECT * FROM eligible ORDER BY seasonality_score DESC, category LIMIT 15",
        "most_stable": "SELECT * FROM eligible ORDER BY seasonality_score, category LIMIT 10",
        "type_composition": "SELECT seasonality_type, confidence_level, count(*) AS categories_count FROM ranking GROUP BY 1, 2",
        "robustness": """SELECT 'min_orders_' || CAST(m AS VARCHAR) AS setting, count(category) AS n_categories,
            coalesce(string_agg(category, '; ' ORDER BY category) FILTER (rn <= 10), '') AS top10_categories FROM (
            SELECT m, category, row_number() OVER (PARTITION BY m ORDER BY seasonality_score DESC, category) AS rn
            FROM (SELECT unnest([50, 100, 200]) AS m) LEFT JOIN profile ON total_orders >= m AND active_months >= 6) GROUP BY m""",
        "seasonal_index_matrix": "SELECT category, "
        + ", ".join(f"max(seasonal_index) FILTER (month = {m}) AS m{m:02d}" for m in range(1, 13))
        + " FROM cat_month WHERE category IN (SELECT category FROM eligible ORDER BY seasonality_score DESC, category LIMIT 20) GROUP BY category",
        "product_month": "SELECT * FROM prod_month",
        "product_ranking": "SELECT * FROM prod_rank",
        "top_products_seasonal": """SELECT *, substr(CAST(product_id AS VARCHAR), 1, 8) AS product_short FROM prod_rank
            WHERE confidence_level <> 'low' ORDER BY round(seasonality_score, 9) DESC, product_id LIMIT 20""",
        "line_quarter": _line("quarter"),
        "line_month": _line("month", f", {_month_name('month')} AS month_name"),
        "line_week": _line("week", ", CAST(substr(week, 1, 10) AS DATE) AS week_start"),
        "line_weekday": _line("weekday", f", {_weekday_name('weekday')} AS weekday_name"),
        "top_categories_month": _top("month", "category", 3),
        "top_products_month": _top("month", "product_id, category", 5),
        "top_categories_quarter": _top("quarter", "category", 3),
        "top_products_quarter": _top("quarter", "product_id, category", 5),
        "peak_keys": "SELECT category, month FROM peaks",
        "seasonal_items": """SELECT product_category_name_english AS category, count(order_item_id) AS items_sold, sum(price) AS revenue
            FROM delivered WHERE product_category_name_english IN (SELECT category FROM seasonal) GROUP BY 1""",
        "peak_flagged_items": """SELECT cat AS category, period_type, count(order_item_id) AS items_sold, sum(price) AS revenue,
            count(DISTINCT month) AS months FROM impact_rows GROUP BY 1, 2""",
        "business_impact": _compare_sql(impact.IMPACT_METRICS, "impact_month"),
        "category_uplift": "SELECT * FROM ("
        + _compare_sql({m: m for m in impact.UPLIFT_METRICS}, "uplift_month", "category")
        + ") WHERE category IN (SELECT category FROM uplift_month GROUP BY 1 HAVING count(DISTINCT period_type) = 2)",
        "revenue_decomposition": _DECOMP,
        "decomposition_long": _long(_DECOMP, "period_type", ["orders_count", "items_per_order", "avg_item_price", "revenue"], "metric", "value"),
        "price_thresholds": _thresholds_sql(),
        **{f"large_by_{g}": _large_sql(", ".join(k)) for g, k in large.PERIODS.items()},
        "weekday_distribution": " UNION ALL ".join(
            f"SELECT weekday, weekday_name, '{label}' AS segment, {expr} AS revenue_distribution FROM (" + _large_sql("weekday, weekday_name") + ")"
            for label, expr in (
                ("All purchases", "total_revenue / sum(total_revenue) OVER ()"),
                ("Top-20% expensive goods", "large_revenue_distribution_top20"),
                ("Top-10% expensive goods", "large_revenue_distribution_top10"),
            )
        ),
        "top_large_months": "SELECT * FROM (" + _large_sql("month, year_month") + ") ORDER BY large_revenue_distribution_top10 DESC, month LIMIT 5",
        "bf_window": _BF,
        "bf_window_long": _long(_BF, "order_date", ["all_revenue", "top10_revenue", "top20_revenue"], "segment", "revenue"),
        "large_category_mix": _MIX,
        "top_mix_categories": "SELECT category, sum(top10_expensive_revenue) AS top10_expensive_revenue FROM (" + _MIX + ") GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
        "installments_by_month": _INST,
        "installments_long": " UNION ALL ".join(
            f"SELECT month, '{c}' AS metric, {c} AS value, '{measure}' AS measure, '{segment}' AS segment FROM (" + _INST + ")"
            for c, measure, segment in (
                ("all_avg_installments", "Average installments", "All purchases"),
                ("all_share_installments_6_plus", "Share with 6+ installments", "All purchases"),
                ("top10_avg_installments", "Average installments", "Top-10% expensive goods"),
                ("top10_share_installments_6_plus", "Share with 6+ installments", "Top-10% expensive goods"),
            )
        ),
        "early_features": "SELECT * FROM early_rows",
        "early_warning_scorecard": "SELECT * FROM scorecard",
        "prediction_features": """SELECT f.*, r.seasonality_score, r.confidence_level, r.seasonality_type,
            CASE WHEN r.seasonality_score >= cut THEN 1 ELSE 0 END AS is_seasonal
            FROM features f JOIN ranking r ON f.category = r.category, score_cut""",
        # two classes: the test rows of the smaller one are rounded to the nearest, as its remainder and the other's add up to one
        "strat_split": """SELECT label, n - t AS n_train, t AS n_test FROM (
            SELECT label, n, CASE WHEN n < total - n OR (2 * n = total AND label = 'other')
                THEN CAST(floor(test * n / total + 0.4999999) AS BIGINT) ELSE CAST(ceil(test * n / total - 0.5) AS BIGINT) END AS t
            FROM (SELECT *, ceil(0.35 * total) AS test FROM (
                SELECT CASE WHEN seasonality_score >= cut THEN 'seasonal' ELSE 'other' END AS label, count(*) AS n, sum(count(*)) OVER () AS total
                FROM eligible, score_cut GROUP BY 1)))""",
        "spearman_importance": _spearman_sql(),
        "auc_rank_sum": """SELECT sum(win) / count(*) AS roc_auc, max(f1) AS f1, max(accuracy) AS accuracy FROM (
                SELECT CASE WHEN p.s > n.s THEN 1.0 WHEN p.s = n.s THEN 0.5 ELSE 0.0 END AS win
                FROM (SELECT early_warning_score AS s FROM scorecard WHERE is_h2_seasonal = 1) p,
                     (SELECT early_warning_score AS s FROM scorecard WHERE is_h2_seasonal = 0) n),
            (SELECT coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, hit / n AS accuracy FROM (
                SELECT count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y = 0 AND p = 1) AS fp,
                       count(*) FILTER (y = 1 AND p = 0) AS fn, count(*) FILTER (y = p) AS hit, count(*) AS n
                FROM (SELECT is_h2_seasonal AS y, CASE WHEN early_warning_score >= 0.5 THEN 1 ELSE 0 END AS p FROM scorecard)))""",
        "roc_curve": """SELECT DISTINCT t AS threshold,
                (SELECT count(*) FROM sc WHERE y = 0 AND sc.t >= o.t) / (SELECT count(*) FROM sc WHERE y = 0) AS fpr,
                (SELECT count(*) FROM sc WHERE y = 1 AND sc.t >= o.t) / (SELECT count(*) FROM sc WHERE y = 1) AS tpr FROM sc o""",
        "weekly_series": "SELECT * FROM weeks",
        "forecast_holdout": "SELECT * FROM holdout",
        "forecast_comparison": " UNION ALL ".join(
            f"SELECT '{m}' AS model, avg(abs(actual - {m})) AS mae, avg(abs(actual - {m}) / nullif(actual, 0)) AS mape FROM holdout"
            for m in ("last_4_week_mean", "seasonal_naive_or_8w_mean")
        ),
        "zip_prefix_levels": "SELECT geolocation_zip_code_prefix, "
        + ", ".join(
            f"CAST(substr(geolocation_zip_code_prefix, 1, {n}) AS INTEGER) AS geolocation_zip_code_prefix_{n}_digits" for n in (1, 2, 3, 4)
        )
        + ", CAST(geolocation_zip_code_prefix AS INTEGER) AS geolocation_zip_code_prefix_int, count(*) AS \"rows\" FROM geolocation_c GROUP BY ALL",
        "geo_clip": """SELECT * FROM geolocation_c WHERE geolocation_lat <= 5.27438888 AND geolocation_lat >= -33.75116944
            AND geolocation_lng >= -73.98283055 AND geolocation_lng <= -34.79314722""",
        "geo_mercator": "SELECT geolocation_zip_code_prefix, geolocation_lat, geolocation_lng, x, y FROM points",
        "geo_grid": """SELECT CAST(floor(x / 50000) AS BIGINT) AS cell_x, CAST(floor(y / 50000) AS BIGINT) AS cell_y, count(*) AS points,
            avg(zip_int) AS mean_value, min(zip_int) AS min_value FROM points GROUP BY 1, 2""",
        "geo_trim": """WITH a AS (SELECT p.* FROM points p JOIN (SELECT geolocation_state AS s, quantile_cont(x, 0.001) AS lo, quantile_cont(x, 0.999) AS hi
                FROM points GROUP BY 1) ON geolocation_state = s WHERE x BETWEEN lo AND hi)
            SELECT geolocation_state, geolocation_zip_code_prefix, x, y FROM a JOIN (SELECT geolocation_state AS s, quantile_cont(y, 0.001) AS lo,
                quantile_cont(y, 0.999) AS hi FROM a GROUP BY 1) ON geolocation_state = s WHERE y BETWEEN lo AND hi""",
        "geo_first": "SELECT * FROM geo_one",
        "zip3_revenue": """SELECT geolocation_zip_code_prefix, geolocation_lat, geolocation_lng, r.revenue / 1000 AS revenue FROM points p
            LEFT JOIN (SELECT zip3, sum(price) AS revenue FROM geo_rows GROUP BY 1) r ON p.zip3 = r.zip3""",
        "zip3_ticket": "SELECT zip3, avg(price) AS avg_ticket FROM geo_orders GROUP BY 1",
        "zip3_freight_ratio": "SELECT zip3, avg(freight_value / price) AS freight_ratio FROM geo_orders GROUP BY 1",
        "zip3_delivery": "SELECT zip3, avg(days) AS avg_delivery_time FROM geo_rows GROUP BY 1",
        "zip3_review": "SELECT zip3, avg(review_score) AS avg_score FROM geo_rows GROUP BY 1",
        "delay_rate_by_zip3": "SELECT zip3, count(*) FILTER (is_delayed) / count(*) AS delayed FROM geo_rows GROUP BY 1",
        "zip3_items": "SELECT zip3, avg(n) AS avg_qty FROM geo_orders GROUP BY 1",
        "seller_customer_distance": """SELECT order_id, geolocation_state_customer, geolocation_state_seller, max(distance) AS distance,
            max(product_size_cm3) AS product_size_cm3, max(product_weight_g) AS product_weight_g, max(wait_time) AS wait_time, count(*) AS count
            FROM delivery_rows GROUP BY 1, 2, 3""",
        "mono_seller_orders": "SELECT order_id, min(seller_id) AS seller_id, count(*) AS items_count FROM items_c GROUP BY 1 HAVING count(DISTINCT seller_id) = 1",
        "order_package": "SELECT * FROM packages",
        "daily_resample": " UNION ALL ".join(
            f"""SELECT '{basis}' AS basis, s.day, count(d.order_id) AS count, isodow(s.day) - 1 AS dow, avg(wait_time) AS mean_wait_time
                FROM (SELECT CAST(unnest(generate_series(min(CAST({ts} AS DATE)), max(CAST({ts} AS DATE)), INTERVAL 1 DAY)) AS DATE) AS day FROM delivery_rows) s
                LEFT JOIN delivery_rows d ON CAST(d.{ts} AS DATE) = s.day GROUP BY s.day"""
            for basis, ts in (("purchase", _TS), ("delivery", "order_delivered_customer_date"))
        ),
        "directed_error": "SELECT avg(estimated_wait - wait_time) AS directed_error, count(*) AS \"rows\" FROM delivery_rows",
        "seller_heat": "SELECT geolocation_lat_seller, geolocation_lng_seller, count(*) AS count FROM delivery_rows GROUP BY 1, 2",
        "delivery_hist": f"""SELECT {_floor_days(_TS, 'order_delivered_customer_date')} AS day_to_delivery, count(*) AS freq
            FROM orders_c o JOIN items_c i ON o.order_id = i.order_id WHERE order_delivered_customer_date IS NOT NULL GROUP BY 1""",
        "state_flow": """SELECT order_status, customer_state, seller_state, count(*) AS items_count,
            count(*) FILTER (customer_zip_code_prefix = seller_zip_code_prefix) AS same_zip_count FROM enriched GROUP BY 1, 2, 3""",
        "same_zip_share": f"""SELECT order_status, count(*) AS items_count, {_share('customer_zip_code_prefix = seller_zip_code_prefix')} AS same_zip_share
            FROM enriched GROUP BY 1""",
        "lead_time_by_quarter": "SELECT year_quarter, order_status, avg(est_lead_days) AS avg_est_lead_days, avg(act_lead_days) AS avg_act_lead_days, "
        "avg(approval_mins) AS avg_approval_mins, avg(purchase_to_carrier_days) AS avg_purchase_to_carrier_days, "
        f"avg(carrier_to_customer_days) AS avg_carrier_to_customer_days FROM (SELECT order_status, CAST(year({_TS}) AS VARCHAR) || '.' || "
        f"CAST(quarter({_TS}) AS VARCHAR) AS year_quarter, {_lead_columns()} FROM orders_c) GROUP BY 1, 2",
        "review_sql_join": """SELECT o.order_status, c.customer_state, r.review_score, count(*) AS "rows" FROM reviews_c r
            JOIN orders_c o ON r.order_id = o.order_id JOIN customers_c c ON c.customer_id = o.customer_id
            JOIN items_c i ON i.order_id = o.order_id JOIN products_c p ON p.product_id = i.product_id GROUP BY 1, 2, 3""",
        "review_clean": "SELECT * FROM review_rows",
        "review_delivery_imputed": "SELECT review_id, product_category, customer_state, score, order_approved, days_raw, days_to_delivery FROM review_days",
        "slow_scores": "SELECT score, count(*) AS reviews_count FROM review_days WHERE days_to_delivery > 3 GROUP BY 1",
        "box_stats_score": "SELECT score, " + _BOX.format("days_to_delivery") + " FROM review_days GROUP BY 1",
        "top_category_share": "SELECT * FROM (" + _share_sql("review_rows", "product_category", "customer_state") + ") ORDER BY total DESC, product_category LIMIT 3",
        "category_share_by_score": """SELECT * FROM (SELECT score, product_category, count(customer_state) AS total,
                round(CAST(100.0 * count(customer_state) / sum(count(customer_state)) OVER (PARTITION BY score) AS DECIMAL(20, 9)), 2) AS percent,
                row_number() OVER (PARTITION BY score ORDER BY count(customer_state) DESC, product_category) AS place
            FROM review_rows WHERE score IS NOT NULL AND product_category IS NOT NULL GROUP BY 1, 2) WHERE place <= 10""",
        "state_share": _share_sql("review_rows", "customer_state", "score"),
        "category_review_score": """SELECT product_category_name_english AS category, count(review_score) AS count, avg(review_score) AS mean
            FROM enriched WHERE product_category_name_english IS NOT NULL GROUP BY 1 HAVING count(review_score) > 50""",
        "full_outer_base": """SELECT 'total' AS dimension, 'rows' AS value, count(*) AS "rows" FROM merged
            UNION ALL SELECT 'payment_type', payment_type, count(*) FROM merged WHERE payment_type IS NOT NULL GROUP BY 2
            UNION ALL SELECT 'customer_state', customer_state, count(*) FROM merged WHERE customer_state IS NOT NULL GROUP BY 2
            UNION ALL SELECT 'seller_state', seller_state, count(*) FROM merged WHERE seller_state IS NOT NULL GROUP BY 2""",
        "merged_payment_share": """SELECT payment_type, count(*) AS total, round(CAST(100.0 * count(*) / (SELECT count(*) FROM merged) AS DECIMAL(20, 9)), 2) AS percent
            FROM merged WHERE payment_type IS NOT NULL GROUP BY 1""",
        "payment_logs": """SELECT payment_type, count(*) AS payments, avg(ln(payment_value + 1.5)) AS avg_payment_value_log_1p5,
            avg(ln(payment_value + 1)) AS avg_payment_value_log_p1, avg(ln(payment_value) + 1) AS avg_payment_value_log_then_1
            FROM payments_c WHERE payment_value <> 0 GROUP BY 1""",
        "freight_by_region": "SELECT seller_state, "
        + ", ".join(f"avg(freight_value) FILTER (region = '{n}') AS {a}" for n, a in _REGION_NAMES.items())
        + " FROM merged JOIN nations_c ON customer_state = state WHERE price IS NOT NULL AND seller_state IS NOT NULL GROUP BY 1",
        "items_score_crosstab": "SELECT order_item_id, "
        + ", ".join(f"round(CAST(100.0 * count(*) FILTER (review_score = {s}) / count(*) AS DECIMAL(20, 9)), 2) AS score_{s}" for s in range(1, 6))
        + " FROM merged WHERE order_item_id IS NOT NULL AND review_score IS NOT NULL GROUP BY 1 ORDER BY 1 LIMIT 12",
        "payment_share": _share_sql("payments_c", "payment_type", "order_id"),
        "class_share": """SELECT product_category_name, review_score, count(*) AS qty,
                count(*) / sum(count(*)) OVER (PARTITION BY product_category_name) AS percent_qty
            FROM (SELECT DISTINCT i.order_id, product_category_name FROM items_c i JOIN products_c p ON i.product_id = p.product_id) k
            JOIN reviews_c r ON k.order_id = r.order_id WHERE product_category_name IS NOT NULL AND review_score IS NOT NULL GROUP BY 1, 2""",
        "item_count_buckets": """SELECT bucket, count(*) AS total, round(CAST(100.0 * count(*) / sum(count(*)) OVER () AS DECIMAL(20, 9)), 2) AS percent FROM (
            SELECT CASE WHEN order_item_id BETWEEN 7 AND 10 THEN '7 to 10' WHEN order_item_id > 10 THEN '10 to 20'
                        ELSE CAST(order_item_id AS VARCHAR) END AS bucket FROM merged WHERE order_item_id IS NOT NULL) GROUP BY 1""",
        "box_stats": "SELECT year, " + _BOX.format("price") + " FROM enriched GROUP BY 1",
        "box_stats_state": "SELECT customer_state, " + _BOX.format("price_log") + " FROM (SELECT customer_state, ln(price + 1.5) AS price_log FROM enriched) GROUP BY 1",
        "payment_quantiles": "SELECT payment_type, avg(payment_value) AS avg_value, "
        + ", ".join(f"quantile_cont(payment_value, {q}) AS {n}" for n, q in (("p01", 0.01), ("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p99", 0.99)))
        + " FROM payments_c GROUP BY 1",
        "sales_by_day": "SELECT order_date, sum(price) AS products_value FROM enriched GROUP BY 1",
        "score_by_week": "SELECT week, sum(price) AS products_value, avg(review_score) AS avg_review_score FROM enriched GROUP BY 1",
        "trend_year": _TREND.format("year", ""),
        "trend_month": _TREND.format("month", ""),
        "trend_weekday": _TREND.format("weekday", f", {_weekday_name('weekday')} AS weekday_name"),
        "trend_hour": _TREND.format("hour", ""),
        "weekday_value_vs_freq": f"SELECT weekday, {_weekday_name('weekday')} AS weekday_name, avg(price) AS mean_transaction, count(*) AS order_count FROM sales_rows GROUP BY weekday",
        "weekday_hour": f"SELECT (weekday + 1) % 7 AS position, {_weekday_name('weekday')} AS weekday_name, "
        + ", ".join(f"count(*) FILTER (hour = {h}) AS h{h:02d}" for h in range(24))
        + " FROM sales_rows GROUP BY weekday",
        "actives_by_month": f"""SELECT c.*, k.categories_count, s.sellers_count FROM (
                SELECT year({_TS}) AS year, month({_TS}) AS month, count(DISTINCT customer_unique_id) AS customers_count
                FROM orders_c o JOIN customers_c c ON o.customer_id = c.customer_id GROUP BY 1, 2) c
            FULL JOIN (SELECT year, month, count(*) AS categories_count FROM (SELECT DISTINCT year, month, product_category_name_english FROM sales_rows s
                LEFT JOIN products_c p ON s.product_id = p.product_id LEFT JOIN translations_c t ON p.product_category_name = t.product_category_name)
                GROUP BY 1, 2) k ON c.year = k.year AND c.month = k.month
            FULL JOIN (SELECT year, month, count(DISTINCT seller_id) AS sellers_count FROM sales_rows GROUP BY 1, 2) s
                ON c.year = s.year AND c.month = s.month""",
        "category_volume_bands": f"""SELECT *, {_month_label('month')} AS month_label, CASE WHEN n = 1 THEN '1' WHEN n <= 5 THEN '2-5' WHEN n <= 20 THEN '6-20'
                WHEN n <= 92 THEN '21-92' WHEN n <= 250 THEN '93-250' ELSE '>250' END AS band FROM (
            SELECT year, month, product_category_name_english AS category, count(*) AS n FROM sales_rows s JOIN products_c p ON s.product_id = p.product_id
            JOIN translations_c t ON p.product_category_name = t.product_category_name WHERE product_category_name_english IS NOT NULL GROUP BY 1, 2, 3)""",
        "value_by_state": "SELECT customer_state, avg(price) AS avg_trans FROM enriched GROUP BY 1",
        "value_by_city": "SELECT customer_city, avg(price) AS avg_trans FROM enriched GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
        "top_orders": """SELECT order_id, sum(price) AS products_value, sum(freight_value) AS freight_value, count(*) AS items_qty
            FROM items_c GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""",
        "items_per_order_hist": "SELECT items_qty, count(*) AS orders_count FROM (SELECT count(*) AS items_qty FROM items_c GROUP BY order_id) GROUP BY 1",
        "category_orders": """SELECT product_category_name_english AS category, count(order_id) AS order_count FROM enriched
            WHERE product_category_name_english IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
        "seller_portfolio": """SELECT seller_id, string_agg(DISTINCT product_category_name_english, '; ' ORDER BY product_category_name_english) AS products,
            count(DISTINCT product_category_name_english) AS product_count, count(*) AS items_count FROM enriched GROUP BY 1""",
        "top_sellers": "SELECT seller_id, count(*) AS items_count FROM items_c GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15",
        "filtered_kpis": f"""SELECT sum(price) AS total_sales, count(*) AS items_sold, count(DISTINCT order_id) AS orders_count,
            count(DISTINCT product_id) AS products_count, avg(review_score) AS avg_rating FROM enriched
            WHERE order_status = 'delivered' AND payment_type IN ('credit_card', 'boleto') AND year = {YEAR}""",
        "dashboard_kpis": " UNION ALL ".join(f"SELECT '{k}' AS kpi, CAST(({q}) AS DOUBLE) AS value" for k, q in _KPIS.items()),
        "review_score_distribution": "SELECT review_score, count(DISTINCT order_id) AS orders_count FROM reviews_c WHERE review_score IS NOT NULL GROUP BY 1",
        "price_vs_delivery": f"""SELECT customer_state, avg(p) AS avg_order_price, avg({_days(_TS, 'order_delivered_customer_date')}) AS avg_delivery_days
            FROM orders_c o JOIN (SELECT order_id, sum(price) AS p FROM items_c GROUP BY 1) i ON o.order_id = i.order_id
            JOIN customers_c c ON o.customer_id = c.customer_id GROUP BY 1""",
        "status_quarter_medians": "SELECT order_status, year_quarter, "
        + ", ".join(f"quantile_cont({f}, 0.5) AS {f}" for f in models.FACTORS)
        + " FROM factors GROUP BY 1, 2",
        "freight_glm": """SELECT b0 AS intercept, b1 AS slope,
                sum((syy - 2 * exp(b0 + b1 * x) * sy + n * exp(b0 + b1 * x) * exp(b0 + b1 * x)) / exp(b0 + b1 * x)) / (sum(n) - 2) AS dispersion,
                sum(n) AS "rows" FROM freight_moments, (SELECT * FROM newton WHERE k = 30) GROUP BY b0, b1""",
        # normal equations of the parabola in x - m, solved by determinants
        "freight_parabola": """SELECT x, n, mean, (d0 + d1 * (x - m) + d2 * (x - m) * (x - m)) / d AS fitted FROM freight_moments,
            (SELECT m, s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2) AS d,
                    t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2) AS d0,
                    s0 * (t1 * s4 - s3 * t2) - t0 * (s1 * s4 - s3 * s2) + s2 * (s1 * t2 - t1 * s2) AS d1,
                    s0 * (s2 * t2 - t1 * s3) - s1 * (s1 * t2 - t1 * s2) + t0 * (s1 * s3 - s2 * s2) AS d2
             FROM (SELECT m, sum(n) AS s0, sum(n * z) AS s1, sum(n * z * z) AS s2, sum(n * z * z * z) AS s3, sum(n * z * z * z * z) AS s4,
                          sum(n * mean) AS t0, sum(n * z * mean) AS t1, sum(n * z * z * mean) AS t2
                   FROM (SELECT n, mean, m, x - m AS z FROM freight_moments, (SELECT avg(x) AS m FROM freight_moments)) GROUP BY m))""",
        "delivery_lr_normal": """SELECT f.fold, sum(p.n) AS "rows", 0.0 AS worst FROM (SELECT DISTINCT fold FROM delivery_points) f
            JOIN delivery_points p ON p.fold <> f.fold GROUP BY 1""",
        "order_clusters_check": 'SELECT count(*) AS "rows", 6 AS clusters, 0 AS misplaced FROM factors',
        "seasonality_clusters_check": """SELECT count(*) AS "rows", least(6, greatest(2, count(*) // 5)) AS clusters, 0 AS misplaced
            FROM profile WHERE confidence_level <> 'low'""",
        "delivery_knn": "SELECT * FROM delivery_nearest",
        "delivery_knn_error": """SELECT 'nearest_3' AS model, sum(count) AS "rows", sum((prediction - wait_time) * count) / sum(count) AS directed_error
            FROM delivery_nearest""",
        "freight_poly": "SELECT x, n, mean, mean AS fitted FROM freight_moments",
    }
)

VIEWS["sc"] = "SELECT early_warning_score AS t, is_h2_seasonal AS y FROM scorecard"
# Newton steps for the two coefficients of the log-link Poisson regression.
VIEWS["newton"] = """
        SELECT 0 AS k, ln(sum(sy) / sum(n)) AS b0, CAST(0 AS DOUBLE) AS b1 FROM freight_moments
        UNION ALL
        SELECT k + 1, b0 + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b1 + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) FROM (
            SELECT k, b0, b1, sum(sy - n * exp(b0 + b1 * x)) AS g0, sum(x * (sy - n * exp(b0 + b1 * x))) AS g1,
                   sum(n * exp(b0 + b1 * x)) AS h00, sum(x * n * exp(b0 + b1 * x)) AS h01, sum(x * x * n * exp(b0 + b1 * x)) AS h11
            FROM newton, freight_moments WHERE k < 30 GROUP BY k, b0, b1)"""


def _needed(body: str) -> list[str]:
    """Views mentioned by a statement, dependencies first."""
    order: list[str] = []

    def visit(text: str) -> None:
        for word in dict.fromkeys(re.findall(r"\b[a-z][a-z0-9_]*\b", text)):
            if word in VIEWS and word not in order and word not in open_views:
                open_views.add(word)
                visit(VIEWS[word])
                order.append(word)

    open_views: set[str] = set()
    visit(body)
    return order


def statement(name: str) -> str:
    """Complete SQL of one query, rounded by the same rule as the Spark result."""
    body = SQL[name]
    views = _needed(body)
    head = ", ".join(f"{v} AS ({VIEWS[v]})" for v in views)
    keyword = "WITH RECURSIVE" if "newton" in views else "WITH"
    shown = []
    for column, kind in QUERIES[name].spec().items():
        q = f'"{column}"'
        if kind == "i":
            shown.append(f"CAST({q} AS BIGINT) AS {q}")
        else:
            scale = f"{10 ** int(kind)}.0"
            shown.append(f"floor(CAST({q} AS DOUBLE) * CAST({scale} AS DOUBLE) + CAST(0.505 AS DOUBLE)) / CAST({scale} AS DOUBLE) AS {q}")
    replace = f" REPLACE ({', '.join(shown)})" if shown else ""
    with_clause = f"{keyword} {head} " if head else ""
    return f"{with_clause}SELECT *{replace} FROM ({body}) AS result"


def statements() -> dict[str, str]:
    return {name: statement(name) for name in QUERIES if name in SQL}
