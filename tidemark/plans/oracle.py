"""SQL twins of the registered queries, over the same tables. Each query is a SELECT on top of the common expressions."""

from __future__ import annotations

from tidemark.operators.sampling import AGE_RATIOS
from tidemark.plans.queries import LOADED_BEFORE


def _r(x: str, k: int) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(38,8)), {k}) AS DOUBLE)"


def _sum(c: str, k: int | None = 2) -> str:
    s = f"sum(CAST({c} AS DECIMAL(20,6)))"
    return f"CAST({f'round({s}, {k})' if k is not None else s} AS DOUBLE)"


def _mean(c: str, k: int = 2) -> str:
    return _r(f"({_sum(c, None)} / nullif(count({c}), 0))", k)


_TEXT = "'%Y-%m-%d %H:%M:%S'"
_AMOUNTS = f"""{_sum('item_total_amount')} AS total_sales_amount, {_sum('item_price')} AS total_product_sales_amount, {_sum('item_freight_value')} AS total_freight_amount"""
_DAILY = f"""SELECT *, {_r('(total_sales_amount / nullif(order_count, 0))', 2)} AS avg_order_amount, strftime(order_event_date, '%Y-%m') AS order_month FROM (
    SELECT order_event_date, {_AMOUNTS}, count(DISTINCT order_id) AS order_count, count(*) AS item_count, count(DISTINCT customer_id) AS customer_count FROM {{}} GROUP BY 1)"""
_RATIOS = ", ".join(f"('{k}', {r}::DOUBLE)" for k, r in AGE_RATIOS.items())
_CATEGORY = f"SELECT product_category_name_english, {_AMOUNTS}, count(DISTINCT order_id) AS order_count, count(*) AS item_count, {_mean('item_price')} AS avg_item_price FROM q_fact_item f LEFT JOIN q_dim_product d ON f.product_id = d.product_id GROUP BY 1"
_SEGMENT = f"""SELECT *, {_r('(total_sales_amount / nullif(customer_count, 0))', 2)} AS avg_customer_amount FROM (SELECT age_group, sex, occupation, {_AMOUNTS}, count(DISTINCT order_id) AS order_count,
        count(DISTINCT f.customer_id) AS customer_count, count(*) AS item_count FROM q_fact_item f LEFT JOIN q_dim_customer d ON f.customer_id = d.customer_id GROUP BY 1, 2, 3)"""

CTES = {
    "b_orders": """SELECT o_orderkey::VARCHAR AS order_id, o_custkey::VARCHAR AS customer_id,
        CASE o_orderstatus WHEN 'P' THEN 'canceled' WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'shipped' END AS order_status,
        o_orderdate AS order_purchase_timestamp,
        CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate + to_hours((o_orderkey % 48)::INT) END AS order_approved_at,
        CASE WHEN o_orderstatus IN ('F', 'O') AND o_orderkey % 13 <> 0 THEN o_orderdate + to_days((1 + o_orderkey % 5)::INT) END AS order_delivered_carrier_date,
        CASE WHEN o_orderstatus = 'F' THEN o_orderdate + to_days((3 + o_orderkey % 23)::INT) END AS order_delivered_customer_date,
        o_orderdate + to_days(14) AS order_estimated_delivery_date FROM orders""",
    "b_items": """SELECT l_orderkey::VARCHAR AS order_id, l_linenumber::BIGINT AS order_item_id, l_partkey::VARCHAR AS product_id, l_suppkey::VARCHAR AS seller_id,
        l_shipdate AS shipping_limit_date, l_extendedprice AS price, round(CAST(l_extendedprice * l_tax AS DECIMAL(38,8)), 2)::DOUBLE AS freight_value FROM lineitem""",
    "b_reviews": """SELECT concat('R', o_orderkey) AS review_id, o_orderkey::VARCHAR AS order_id, (1 + o_orderkey % 5)::INT AS review_score,
        o_orderdate + to_days(30) AS review_creation_date, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderdate + to_days((30 + o_orderkey % 6)::INT) END AS review_answer_timestamp
        FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 7 <> 0""",
    "b_personas": """SELECT p_partkey AS persona_id, nullif(split_part(trim(p_name), ' ', 1), '') AS customer_name, CASE WHEN p_partkey % 2 = 0 THEN 'F' ELSE 'M' END AS sex,
        20 + p_size AS age, CASE WHEN 20 + p_size < 30 THEN '20s' WHEN 20 + p_size < 40 THEN '30s' WHEN 20 + p_size < 50 THEN '40s' WHEN 20 + p_size < 60 THEN '50s' WHEN 20 + p_size < 70 THEN '60s' ELSE '70+' END AS age_group,
        p_brand AS occupation, concat('marital_status_', p_partkey % 3) AS marital_status, concat('education_level_', p_partkey % 4) AS education_level, concat('family_type_', p_partkey % 5) AS family_type,
        concat('housing_type_', p_partkey % 3) AS housing_type, concat('province_', p_partkey % 17) AS province, concat('district_', p_partkey % 40) AS district, p_name AS persona FROM part""",
    "q_order_events": f"""SELECT concat('ORDER_CREATED_', order_id) AS event_id, 'ORDER_CREATED' AS event_type, strftime(order_purchase_timestamp, {_TEXT}) AS event_time, order_id, customer_id, order_status FROM b_orders WHERE order_purchase_timestamp IS NOT NULL
        UNION ALL SELECT concat('ORDER_APPROVED_', order_id), 'ORDER_APPROVED', strftime(order_approved_at, {_TEXT}), order_id, customer_id, order_status FROM b_orders WHERE order_approved_at IS NOT NULL
        UNION ALL SELECT concat('ORDER_CANCELED_', order_id), 'ORDER_CANCELED', strftime(coalesce(order_approved_at, order_purchase_timestamp) + to_seconds(60 + ('0x' || substr(md5(order_id), 1, 8))::BIGINT % 3540), {_TEXT}), order_id, customer_id, order_status
        FROM b_orders WHERE order_status = 'canceled' AND order_purchase_timestamp IS NOT NULL""",
    "q_delivery_events": f"""SELECT concat(t, '_', order_id) AS event_id, t AS event_type, strftime(moment, {_TEXT}) AS event_time, order_id, customer_id, order_status, strftime(order_estimated_delivery_date, {_TEXT}) AS order_estimated_delivery_date FROM (
        SELECT 'DELIVERY_STARTED' AS t, order_delivered_carrier_date AS moment, * FROM b_orders UNION ALL SELECT 'DELIVERY_COMPLETED', order_delivered_customer_date, * FROM b_orders)
        WHERE moment IS NOT NULL AND order_status IS DISTINCT FROM 'canceled'""",
    "q_review_events": f"""SELECT concat('REVIEW_CREATED_', review_id) AS event_id, 'REVIEW_CREATED' AS event_type, strftime(review_creation_date, {_TEXT}) AS event_time, review_id, r.order_id, customer_id, review_score::VARCHAR AS review_score
        FROM b_reviews r LEFT JOIN b_orders o ON r.order_id = o.order_id WHERE review_creation_date IS NOT NULL""",
    "q_timeline": """SELECT event_id, event_type, event_time, order_id, customer_id, NULL::VARCHAR AS review_id FROM q_order_events UNION ALL
        SELECT event_id, event_type, event_time, order_id, customer_id, NULL FROM q_delivery_events UNION ALL SELECT event_id, event_type, event_time, order_id, customer_id, review_id FROM q_review_events""",
    "q_payments": f"SELECT l_orderkey::VARCHAR AS order_id, {_sum('l_extendedprice * (1 - l_discount)', None)} AS payment_total_value FROM lineitem GROUP BY 1",
    "q_dim_product": """SELECT p_partkey::VARCHAR AS product_id, coalesce(c, 'unknown') AS product_category_name, CASE WHEN c IN ('STANDARD', 'PROMO', 'ECONOMY', 'LARGE') THEN lower(c) ELSE 'unknown' END AS product_category_name_english,
        CASE WHEN p_size % 4 <> 0 THEN p_size % 6 ELSE 0 END AS product_photos_qty, p_retailprice AS product_weight_g, p_size AS product_length_cm, p_size + 1 AS product_height_cm, p_size + 2 AS product_width_cm
        FROM (SELECT *, nullif(p_type, 'MEDIUM') AS c FROM part)""",
    "q_dim_customer": """SELECT customer_id, customer_unique_id, customer_name, sex, age, age_group, occupation, marital_status, education_level, family_type, housing_type, province, district, persona
        FROM (SELECT c_custkey::VARCHAR AS customer_id, c_name AS customer_unique_id, row_number() OVER (ORDER BY c_custkey) AS i FROM customer) c
        JOIN (SELECT *, row_number() OVER (ORDER BY persona_id) AS i FROM b_personas) p ON c.i = p.i""",
    "q_dim_seller": "SELECT s_suppkey::VARCHAR AS seller_id, s_nationkey AS seller_zip_code_prefix, s_name AS seller_city, n_name AS seller_state FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "q_items": """SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY order_id, order_item_id ORDER BY shipping_limit_date, product_id, seller_id, price, freight_value) AS n FROM b_items) WHERE n = 1""",
    "q_fact_item": """SELECT e.order_id, order_item_id, customer_id, product_id, seller_id, event_type, event_time::TIMESTAMP AS event_time, order_status, shipping_limit_date, price AS item_price, freight_value AS item_freight_value,
        price + freight_value AS item_total_amount, payment_total_value, event_time::TIMESTAMP::DATE AS order_event_date, strftime(event_time::TIMESTAMP, '%Y-%m') AS order_month
        FROM q_order_events e JOIN q_items i ON e.order_id = i.order_id LEFT JOIN q_payments p ON e.order_id = p.order_id""",
    "q_fact_delivery": """SELECT e.order_id, e.customer_id, event_type, event_time::TIMESTAMP AS event_time, CASE event_type WHEN 'DELIVERY_STARTED' THEN 'started' ELSE 'completed' END AS delivery_status,
        order_purchase_timestamp, order_delivered_carrier_date, order_delivered_customer_date, o.order_estimated_delivery_date,
        date_diff('day', order_purchase_timestamp, order_delivered_carrier_date)::INT AS shipping_days, date_diff('day', order_purchase_timestamp, order_delivered_customer_date)::INT AS delivery_days,
        order_delivered_customer_date IS NOT NULL AS is_delivered, coalesce(order_delivered_customer_date > o.order_estimated_delivery_date, false) AS is_delayed,
        event_time::TIMESTAMP::DATE AS delivery_event_date, strftime(event_time::TIMESTAMP, '%Y-%m') AS delivery_month FROM q_delivery_events e LEFT JOIN b_orders o ON e.order_id = o.order_id""",
    "q_fact_review": """SELECT e.review_id, e.order_id, customer_id, event_type, event_time::TIMESTAMP AS event_time, e.review_score::INT AS review_score, review_answer_timestamp,
        date_diff('day', review_creation_date, review_answer_timestamp)::INT AS review_answer_days, event_time::TIMESTAMP::DATE AS review_event_date, strftime(event_time::TIMESTAMP, '%Y-%m') AS review_month
        FROM q_review_events e LEFT JOIN b_reviews r ON e.review_id = r.review_id""",
    "q_days": """SELECT *, dayofyear(ts) // 8 AS batch FROM events UNION ALL SELECT *, (dayofyear(ts) + 1) // 8 FROM events WHERE hour(ts) * 60 + minute(ts) < 120""",
    "q_minutes": "SELECT time_bucket(INTERVAL '1 minute', ts) AS window_start, time_bucket(INTERVAL '1 minute', ts) + INTERVAL '1 minute' AS window_end, event_type, count(*) AS event_count FROM events GROUP BY ALL",
    "q_quota": f"""SELECT k, CASE WHEN k = '70+' THEN n - sum(CASE WHEN k = '70+' THEN 0 ELSE floor(n * r)::BIGINT END) OVER () ELSE floor(n * r)::BIGINT END AS q
        FROM (VALUES {_RATIOS}) t(k, r), (SELECT count(*) AS n FROM b_personas)""",
    "q_ranked": "SELECT *, row_number() OVER (PARTITION BY age_group ORDER BY md5(concat('42:', persona_id)), persona_id) - 1 AS place, count(*) OVER (PARTITION BY age_group) AS size FROM b_personas",
}


def _profile(name: str, table: str, keys: str) -> str:
    null = " OR ".join(f"{k} IS NULL" for k in keys.split(", "))
    return f"""SELECT '{name}' AS table_name, sum(n)::BIGINT AS row_count, sum(CASE WHEN {null} THEN n ELSE 0 END)::BIGINT AS null_key_count,
        sum(CASE WHEN {null} THEN 0 ELSE n - 1 END)::BIGINT AS duplicate_key_count FROM (SELECT {keys}, count(*) AS n FROM {table} GROUP BY ALL)"""


SELECTS = {
    "order_events": "SELECT * FROM q_order_events",
    "delivery_events": "SELECT * FROM q_delivery_events",
    "review_events": "SELECT * FROM q_review_events",
    "event_timeline": "SELECT row_number() OVER (ORDER BY event_time, event_id) AS position, * FROM q_timeline",
    "event_key": "SELECT event_id, coalesce(nullif(order_id, ''), nullif(review_id, ''), nullif(event_id, '')) AS event_key FROM q_timeline",
    "parse_events_json": "SELECT * REPLACE (event_time::TIMESTAMP AS event_time) FROM q_order_events",
    "events_valid": "SELECT event_id::VARCHAR AS event_id, event_type, date_trunc('second', ts) AS event_time, user_id::VARCHAR AS customer_id FROM events WHERE event_id % 7 <> 0 AND event_id % 11 <> 0",
    "dedup_events": "SELECT * REPLACE (event_time::TIMESTAMP AS event_time) FROM q_order_events",
    "dim_seller": "SELECT * FROM q_dim_seller",
    "dim_product": "SELECT * FROM q_dim_product",
    "dim_customer": "SELECT * FROM q_dim_customer",
    "row_index_orders": "SELECT order_id, row_number() OVER (ORDER BY order_purchase_timestamp, order_id) AS row_idx FROM b_orders",
    "payments_total": "SELECT * FROM q_payments",
    "fact_order_item": "SELECT * FROM q_fact_item",
    "fact_delivery": "SELECT * FROM q_fact_delivery",
    "fact_review": "SELECT * FROM q_fact_review",
    "incr_order_item": f"SELECT * FROM q_fact_item WHERE order_month >= '{LOADED_BEFORE}'",
    "incr_delivery": f"SELECT * FROM q_fact_delivery WHERE delivery_month >= '{LOADED_BEFORE}'",
    "incr_review": f"SELECT * FROM q_fact_review WHERE review_month >= '{LOADED_BEFORE}'",
    "mart_daily_sales": _DAILY.format("q_fact_item"),
    "mart_daily_sales_net": _DAILY.format("(SELECT * FROM q_fact_item WHERE event_type = 'ORDER_CREATED' AND order_status IS DISTINCT FROM 'canceled')"),
    "mart_category_sales": _CATEGORY,
    "mart_customer_segment_sales": _SEGMENT,
    "mart_daily_sales_ordered": f"SELECT *, row_number() OVER (ORDER BY order_event_date) AS position FROM ({_DAILY.format('q_fact_item')})",
    "mart_category_sales_ordered": f"SELECT *, row_number() OVER (ORDER BY total_sales_amount DESC, product_category_name_english NULLS FIRST) AS position FROM ({_CATEGORY})",
    "mart_segment_sales_ordered": f"SELECT *, row_number() OVER (ORDER BY total_sales_amount DESC, age_group NULLS FIRST, sex NULLS FIRST, occupation NULLS FIRST) AS position FROM ({_SEGMENT})",
    "mart_delivery_kpi": f"""SELECT *, {_r('(delayed_delivery_count / delivery_event_count)', 4)} AS delay_rate, strftime(delivery_event_date, '%Y-%m') AS delivery_month FROM (SELECT delivery_event_date, count(*) AS delivery_event_count,
        count(*) FILTER (event_type = 'DELIVERY_COMPLETED') AS completed_delivery_count, count(*) FILTER (is_delayed) AS delayed_delivery_count, {_mean('shipping_days')} AS avg_days_to_carrier, {_mean('delivery_days')} AS avg_total_delivery_days FROM q_fact_delivery GROUP BY 1)""",
    "mart_review_kpi": f"""SELECT review_event_date, count(*) AS review_count, {_mean('review_score')} AS avg_review_score, {', '.join(f'count(*) FILTER (review_score = {s}) AS score_{s}_count' for s in range(1, 6))},
        {_mean('review_answer_days')} AS avg_review_answer_days, strftime(review_event_date, '%Y-%m') AS review_month FROM q_fact_review GROUP BY review_event_date""",
    "minute_counts": "SELECT * FROM q_minutes",
    "stream_minute_counts": "SELECT * FROM q_minutes",
    "stream_dedup": "SELECT DISTINCT event_id, event_type, user_id, ts FROM events",
    "stream_totals": "SELECT event_type, count(*) AS total_count FROM events GROUP BY 1",
    "latest_window": "SELECT event_type, window_start, window_end, event_count FROM q_minutes QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY window_start DESC) = 1",
    "series_retention": "SELECT * FROM q_minutes WHERE window_start >= (SELECT max(window_start) - INTERVAL '24 hours' FROM q_minutes)",
    "metric_keys": f"""SELECT concat('metrics:timeseries:', event_type, ':', strftime(window_start, {_TEXT})) AS key, event_count FROM q_minutes
        UNION ALL SELECT concat('metrics:latest:', event_type), event_count FROM q_minutes QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY window_start DESC) = 1
        UNION ALL SELECT concat('metrics:total:', event_type), sum(event_count)::BIGINT FROM q_minutes GROUP BY event_type""",
    "loaded_order_item": "SELECT * FROM q_fact_item",
    "replaced_daily_sales": _DAILY.format("q_fact_item"),
    "mart_daily_sales_stated": _DAILY.format("q_fact_item"),
    "mart_category_sales_stated": _CATEGORY,
    "order_events_ordered": "SELECT row_number() OVER (ORDER BY event_time, CASE event_type WHEN 'ORDER_CREATED' THEN 1 WHEN 'ORDER_APPROVED' THEN 2 ELSE 3 END, event_id) AS position, * FROM q_order_events",
    "routed_topics": """SELECT 'order-events' AS topic, order_id AS key, event_id FROM q_order_events UNION ALL SELECT 'delivery-events', order_id, event_id FROM q_delivery_events
        UNION ALL SELECT 'review-events', order_id, event_id FROM q_review_events""",
    "late_events": """SELECT DISTINCT event_id::VARCHAR AS event_id, event_type, kind FROM (
        SELECT *, CASE WHEN ts < (SELECT max(f.ts) - INTERVAL '1 hour' FROM q_days f WHERE f.batch < e.batch) THEN 'late' ELSE 'events' END AS kind FROM q_days e)""",
    "topic_totals": "SELECT event_type, count(*) AS total_count FROM events GROUP BY 1",
    "topic_series": "SELECT * FROM q_minutes WHERE window_start >= (SELECT max(window_start) - INTERVAL '24 hours' FROM q_minutes)",
    "orders_head": "SELECT * FROM b_orders ORDER BY order_purchase_timestamp, order_id LIMIT 100",
    "orders_from_csv": "SELECT * FROM b_orders",
    "events_from_jsonl": "SELECT * FROM q_order_events",
    "persona_normalized": "SELECT persona_id, sex, age, age_group, customer_name, persona FROM b_personas",
    "persona_age_group": "SELECT persona_id, age, age_group FROM b_personas",
    "persona_name": "SELECT persona_id, customer_name FROM b_personas",
    "persona_by_sex": "SELECT sex, count(*) AS persona_count FROM b_personas GROUP BY 1",
    "persona_age_share": "SELECT age_group, count(*)::DOUBLE / sum(count(*)) OVER () AS share FROM b_personas GROUP BY 1",
    "persona_quota_sample": "SELECT age_group, slot, persona_id, customer_name FROM (SELECT k, unnest(generate_series(0, q::BIGINT - 1)) AS slot FROM q_quota) JOIN q_ranked ON k = age_group AND slot % size = place",
    "persona_shuffle": "SELECT row_number() OVER (ORDER BY md5(concat('42:', persona_id)), persona_id) AS position, persona_id FROM b_personas",
    "silver_profile": " UNION ALL ".join([
        _profile("dim_customer", "q_dim_customer", "customer_id"), _profile("dim_product", "q_dim_product", "product_id"), _profile("dim_seller", "q_dim_seller", "seller_id"),
        _profile("fact_order_item", "q_fact_item", "order_id, order_item_id, event_type"), _profile("fact_delivery", "q_fact_delivery", "order_id, event_type"), _profile("fact_review", "q_fact_review", "review_id, event_type"),
    ]),
}

ORACLE = {name: "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in CTES.items()) + f"\n{select}" for name, select in SELECTS.items()}
