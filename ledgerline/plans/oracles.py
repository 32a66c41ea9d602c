"""DuckDB oracle SQL for every registered query that SQL can express.

The adapters are written a second time here as SQL text (one CTE each) and
the operator is re-stated as plain SQL over them, so the oracle shares no
code with the Spark operators.
"""

from __future__ import annotations

from ledgerline.plans.fixture_params import (EVENTS_AS_OF, FACET_MATERIALS, LINEITEM_AS_OF, ORDERS_AS_OF, PAGE_CHANNEL, PAGE_LIMIT,
                                             PAGE_OFFSET, RECENT_ROWS_LIMIT, SEARCH_LIMIT, STUDENT_QUERY,
                                             TRANSACTION_LIMIT)

ADAPTER_SQL = {
    "students": """
SELECT c.c_custkey AS id, c.c_name AS full_name,
       CASE WHEN c.c_custkey % 10 = 0 THEN NULL
            ELSE lower(c.c_mktsegment) || '.' || CAST(c.c_custkey AS VARCHAR) || '@example.com' END AS email,
       '+2010' || lpad(CAST(c.c_custkey AS VARCHAR), 8, '0') AS phone,
       o.last_order AS created_at
FROM customer c
LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last_order FROM orders GROUP BY o_custkey) o
  ON o.o_custkey = c.c_custkey""",
    "registrations": """
SELECT o_orderkey AS id, o_custkey - CASE WHEN o_custkey % 11 = 0 THEN 1 ELSE 0 END AS student_id,
       o_orderkey % 25 AS service_id,
       o_orderdate AS registration_date,
       CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(o_totalprice AS DECIMAL(12,2)) END AS amount_paid,
       o_orderpriority AS payment_method,
       CASE o_orderstatus WHEN 'F' THEN 'CONFIRMED' WHEN 'P' THEN 'PENDING' ELSE 'CANCELLED' END AS status
FROM orders""",
    "finance_transactions": """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate AS transaction_date,
       'order ' || CAST(l_orderkey AS VARCHAR) AS description,
       CASE l_suppkey % 8 WHEN 0 THEN 'Materials' WHEN 1 THEN 'Equipment' WHEN 2 THEN 'Sales (Out)'
            WHEN 3 THEN 'Sales Out' WHEN 4 THEN 'Courses' WHEN 5 THEN 'Rent' WHEN 6 THEN '' ELSE NULL END AS category,
       CASE WHEN l_linestatus = 'O' AND l_linenumber % 3 = 0 THEN CAST(l_extendedprice AS DECIMAL(12,2)) ELSE CAST(0 AS DECIMAL(12,2)) END AS income_receivable,
       CASE WHEN l_linestatus = 'O' AND l_linenumber % 3 = 1 THEN CAST(l_extendedprice AS DECIMAL(12,2)) ELSE CAST(0 AS DECIMAL(12,2)) END AS income_cash,
       CASE WHEN l_tax > 0.075 THEN NULL
            WHEN l_linestatus = 'O' AND l_linenumber % 3 = 2 THEN CAST(l_extendedprice AS DECIMAL(12,2)) ELSE CAST(0 AS DECIMAL(12,2)) END AS income_bank,
       CASE WHEN l_linestatus = 'F' AND l_linenumber % 3 = 0 THEN CAST(l_extendedprice AS DECIMAL(12,2)) ELSE CAST(0 AS DECIMAL(12,2)) END AS expense_payable,
       CASE WHEN l_linestatus = 'F' AND l_linenumber % 3 = 1 THEN CAST(l_extendedprice AS DECIMAL(12,2)) ELSE CAST(0 AS DECIMAL(12,2)) END AS expense_cash,
       CASE WHEN l_linestatus = 'F' AND l_linenumber % 3 = 2 THEN CAST(l_extendedprice AS DECIMAL(12,2)) ELSE CAST(0 AS DECIMAL(12,2)) END AS expense_bank
FROM lineitem""",
    "inventory_items": """
SELECT p.p_partkey AS id, p.p_name || ' ' || CAST(p.p_partkey AS VARCHAR) AS name, p.p_type AS category, 'pcs' AS unit,
       CAST(p.p_size AS DECIMAL(12,2)) AS current_stock, CAST(p.p_partkey % 12 AS DECIMAL(12,2)) AS minimum_stock,
       CAST(2 * (p.p_partkey % 12) AS DECIMAL(12,2)) AS reorder_point,
       CASE WHEN p.p_partkey % 9 = 0 THEN NULL ELSE CAST(p.p_retailprice AS DECIMAL(12,2)) END AS cost_per_unit,
       CASE WHEN p.p_partkey % 14 = 0 THEN NULL ELSE s.s_name END AS supplier
FROM part p LEFT JOIN supplier s ON s.s_suppkey = p.p_partkey % 10""",
    "stock_movements": """
SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey AS item_id,
       CASE l_linestatus WHEN 'O' THEN 'purchase' ELSE 'consumption' END AS movement_type,
       CAST(l_quantity AS DECIMAL(12,2)) AS quantity,
       CASE WHEN l_linenumber = 1 THEN NULL ELSE 'line ' || CAST(l_linenumber AS VARCHAR) END AS notes,
       l_shipdate AS created_at,
       CASE WHEN l_linenumber % 2 = 0 THEN 'dashboard' ELSE NULL END AS created_by
FROM lineitem""",
    "concierge_conversations": """
SELECT event_id AS id,
       CAST(user_id AS VARCHAR) || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) AS session_id,
       CASE event_id % 4 WHEN 0 THEN 'whatsapp' WHEN 1 THEN 'messenger' WHEN 2 THEN 'instagram' ELSE 'web' END AS channel,
       CAST(user_id AS VARCHAR) AS sender_id,
       'msg ' || CAST(event_id AS VARCHAR) AS original_message,
       CAST(NULL AS VARCHAR) AS rewritten_query, CAST(NULL AS VARCHAR) AS ai_response, CAST(NULL AS VARCHAR) AS model_used,
       CASE event_type WHEN 'view' THEN 'schedule' WHEN 'click' THEN 'pricing' WHEN 'signup' THEN 'booking'
            WHEN 'purchase' THEN 'course_info' ELSE NULL END AS intent_detected,
       CASE WHEN event_id % 50 = 7 THEN NULL ELSE event_id % 9 = 0 END AS escalated,
       CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(floor(value * 10) AS INT) END AS response_time_ms,
       CASE WHEN event_id % 3 = 0 THEN CAST(1 + event_id % 5 AS INT) ELSE NULL END AS customer_feedback,
       props AS metadata, ts AS created_at
FROM events""",
    "ai_events": """
SELECT event_id AS id,
       CASE event_type WHEN 'purchase' THEN 'booking' WHEN 'signup' THEN 'booking' WHEN 'view' THEN 'recommendation'
            WHEN 'click' THEN 'decision' ELSE 'cost_alert' END AS event_type,
       CASE event_id % 5 WHEN 0 THEN 'agent_a' WHEN 1 THEN 'agent_b' WHEN 2 THEN 'agent_c' WHEN 3 THEN 'agent_d' ELSE NULL END AS agent_name,
       CASE event_id % 7 WHEN 3 THEN 'failure' WHEN 4 THEN 'escalated' WHEN 5 THEN 'retry_needed' WHEN 6 THEN NULL ELSE 'success' END AS outcome,
       CAST(event_id % 101 AS DECIMAL(5,2)) AS success_metric,
       CASE WHEN event_id % 29 = 0 THEN NULL ELSE CAST(value AS DECIMAL(10,2)) END AS cost_cents,
       CAST(floor(value * 10) AS INT) AS latency_ms, ts AS created_at
FROM events""",
    "knowledge_embeddings": """
SELECT vec_id AS id, 'q ' || CAST(vec_id AS VARCHAR) AS question, 'a ' || CAST(vec_id AS VARCHAR) AS answer,
       CAST(label AS VARCHAR) AS category, CAST(vec_id % 11 AS DOUBLE) / 10 AS confidence,
       CASE WHEN vec_id % 37 = 0 THEN NULL ELSE embedding END AS embedding
FROM embeddings""",
    "ga4_payload": """
SELECT '{"date":"' || replace(CAST(CAST(ts AS DATE) AS VARCHAR), '-', '') || '","metricValues":[{"value":"'
       || CAST(count(DISTINCT user_id) AS VARCHAR) || '"}'
       || CASE WHEN extract(day FROM min(ts)) = 13 THEN '' ELSE ',{"value":"' || CAST(count(*) AS VARCHAR) || '"}' END
       || ']}' AS payload
FROM events GROUP BY CAST(ts AS DATE)""",
    "booking_payload": """
SELECT o_orderkey, '{"id":"b' || CAST(o_orderkey AS VARCHAR) || '"'
       || CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE ',"contactId":"' || CAST(o_custkey AS VARCHAR) || '"' END
       || ',"contactDetails":{'
       || CASE WHEN o_orderkey % 8 = 0 THEN '"lastName":"L"' ELSE '"firstName":"F' || CAST(o_custkey AS VARCHAR) || '","email":" U' || CAST(o_custkey AS VARCHAR) || '@Example.COM "' END
       || '},"priceInfo":{"totalPrice":'
       || CASE o_orderkey % 3 WHEN 0 THEN '{"value":"EGP ' || CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) || '"}'
               WHEN 1 THEN '{"value":' || CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) || '}'
               ELSE '"EGP 600"' END
       || '},"createdDate":"' || CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || '"'
       || CASE WHEN o_orderstatus = 'P' THEN '' ELSE ',"status":"' || o_orderstatus || '"' END || '}' AS payload
FROM orders""",
    "rights_message": """
SELECT conv_id, turn, '{"entry":[{"changes":[{"value":{"messages":[{"from":"' || CAST(conv_id % 150 AS VARCHAR) || '","text":{"body":"'
       || CASE (conv_id + turn) % 5 WHEN 0 THEN ' Please DELETE my data' WHEN 1 THEN 'show my data' WHEN 2 THEN 'STOP'
               WHEN 3 THEN 'احذف بياناتي' ELSE 'hello' END
       || '"}}]}}]}]}' AS payload
FROM conversations WHERE role = 'user'""",
    "extraction_response": """
SELECT doc_id, text AS raw_text, source AS submission_channel,
       CASE doc_id % 6
         WHEN 0 THEN 'no json here'
         WHEN 1 THEN 'x {"technique_name": broken} y'
         WHEN 2 THEN '```json {"technique_name":"T' || CAST(doc_id AS VARCHAR) || '","artisan_name":"","region":null,"category":" Carving ","materials":["oak","ash"],"tools":[],"description":"d","risk_level":"critical (likely disappearing)"} ```'
         WHEN 3 THEN '{"technique_name":"T' || CAST(doc_id AS VARCHAR) || '","artisan_name":"A","region":"' || lang || '","category":"pottery","materials":["walnut"],"tools":["lathe"],"description":"d","risk_level":"Rare"}'
         WHEN 4 THEN '{"technique_name":"T' || CAST(doc_id AS VARCHAR) || '","category":"inlay","materials":[],"tools":["saw","file"],"description":"d","risk_level":""}'
         ELSE '{"technique_name":"T' || CAST(doc_id AS VARCHAR) || '","category":"joinery","materials":["oak"],"tools":["saw"],"description":"d","risk_level":"extinct"}'
       END AS response_text
FROM documents""",
    "shadow_event": """
SELECT event_id, CASE WHEN event_id % 37 = 5 THEN NULL ELSE CAST(user_id AS VARCHAR) END AS customer_wa_id,
       CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'N' || CAST(user_id AS VARCHAR) END AS customer_name,
       CASE WHEN event_type IN ('view','click','error') THEN 'draft' ELSE 'reply' END AS kind,
       'text ' || CAST(event_id AS VARCHAR) AS text,
       CAST(CASE WHEN event_id % 23 = 0 THEN NULL WHEN event_id % 4 = 3 THEN event_id - 1 ELSE event_id END AS VARCHAR) AS wamid,
       CASE WHEN event_id % 53 = 11 THEN NULL ELSE ts END AS created_at
FROM events""",
    "service_payload": """
SELECT p_partkey AS pos, '{"id":"' || CASE WHEN p_partkey % 40 = 39 THEN '' ELSE 's' || CAST(p_partkey % 150 AS VARCHAR) END || '"'
       || CASE p_partkey % 3 WHEN 0 THEN ',"name":"' || p_name || '"' WHEN 1 THEN ',"info":{"name":"' || p_name || '"}' ELSE '' END
       || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE ',"type":"' || p_type || '"' END
       || CASE WHEN p_partkey % 2 = 0 THEN ',"category":{"name":"' || p_brand || '"},"schedule":{"availabilityConstraints":{"sessionDurations":[' || CAST(p_size AS VARCHAR) || ',90]}}' ELSE '' END
       || '}' AS payload
FROM part""",
    "rating": """
SELECT event_id AS seq, event_id - event_id % 3 AS shadow_id,
       CASE event_id % 7 WHEN 0 THEN 'better' WHEN 1 THEN 'similar' WHEN 2 THEN 'worse' WHEN 3 THEN 'great' ELSE 'similar' END AS quality_rating,
       CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'n' || CAST(event_id AS VARCHAR) END AS notes, ts AS created_at
FROM events WHERE event_type = 'click'""",
    "conversation_pair": """
SELECT u.conv_id, u.turn, CAST(u.conv_id AS VARCHAR) AS customer_wa_id,
       CASE WHEN u.conv_id % 2 = 0 THEN NULL ELSE 'N' || CAST(u.conv_id AS VARCHAR) END AS customer_name,
       'batch ' || CAST(u.conv_id % 10 AS VARCHAR) AS batch_name,
       CASE WHEN (u.conv_id + u.turn) % 9 = 0 THEN '   ' ELSE u.text END AS customer_message,
       a.text AS staff_reply, CASE WHEN u.conv_id % 3 = 0 THEN '' ELSE 'export' END AS source
FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
WHERE u.role = 'user'""",
    "usage_request": """
SELECT event_id, CASE WHEN event_id % 60 = 1 THEN -1 ELSE user_id % 50 END AS item_id,
       CAST(event_id % 6 AS DECIMAL(12,2)) AS quantity, ts AS created_at
FROM events""",
    "setting_change": """
SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'ai_concierge_mode' ELSE 'k' || CAST(user_id % 20 AS VARCHAR) END AS key,
       CASE event_id % 5 WHEN 0 THEN 'active' WHEN 1 THEN 'paused' WHEN 2 THEN 'off' WHEN 3 THEN 'active' ELSE 'paused' END AS value, ts AS created_at
FROM events""",
    "rewrite_response": """
SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN NULL ELSE 'en' END AS request_language,
       CASE (conv_id + turn) % 5
         WHEN 0 THEN '{"rewritten_query":"course pricing","is_greeting":false,"detected_language":"ar","intent":"pricing"}'
         WHEN 1 THEN '{"rewritten_query":"GREETING_ONLY","is_greeting":true}'
         WHEN 2 THEN 'not json'
         WHEN 3 THEN '{"rewritten_query":"","is_greeting":"true","intent":""}'
         ELSE NULL END AS response_text
FROM conversations WHERE role = 'user'""",
    "tier_response": """
SELECT doc_id AS request_id, CASE WHEN doc_id % 3 = 0 THEN text ELSE NULL END AS primary_text,
       CASE WHEN doc_id % 2 = 0 THEN 'fallback: ' || lang ELSE NULL END AS fallback_text
FROM documents""",
    "unchecked_conversations": """
SELECT event_id AS id, CASE event_id % 6 WHEN 0 THEN 'whatsapp' WHEN 1 THEN 'messenger' WHEN 2 THEN 'instagram' WHEN 3 THEN 'web' WHEN 4 THEN 'fax' ELSE NULL END AS channel,
       CASE WHEN event_id % 31 = 0 THEN NULL ELSE CAST(user_id AS VARCHAR) END AS sender_id,
       CASE WHEN event_id % 17 = 0 THEN '' WHEN event_id % 19 = 0 THEN repeat('x', 1001) ELSE 'msg' END AS original_message,
       CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(event_id % 7 AS INT) END AS customer_feedback
FROM events""",
    "unchecked_interactions": """
SELECT event_id AS id,
       CASE event_type WHEN 'view' THEN 'question' WHEN 'click' THEN 'booking' WHEN 'signup' THEN 'feedback'
            WHEN 'purchase' THEN 'other' WHEN 'error' THEN 'complaint' ELSE event_type END
         || CASE WHEN event_id % 23 = 0 THEN '?' ELSE '' END AS interaction_type,
       CASE event_id % 5 WHEN 0 THEN 'positive' WHEN 1 THEN 'neutral' WHEN 2 THEN 'negative' WHEN 3 THEN 'angry' ELSE NULL END AS sentiment,
       CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(event_id % 8 AS INT) END AS satisfaction_score,
       CASE event_id % 7 WHEN 0 THEN 'resolved' WHEN 1 THEN 'escalated' WHEN 2 THEN 'booked' WHEN 3 THEN 'follow_up'
            WHEN 4 THEN 'other' WHEN 5 THEN 'lost' ELSE NULL END AS outcome
FROM events""",
    "feedback_change": """
SELECT event_id AS seq, event_id - event_id % 4 AS id, CAST(1 + user_id % 5 AS INT) AS customer_feedback
FROM events WHERE event_type = 'click'""",
}

# short names used inside oracle bodies
_ALIASES = {"ft": "finance_transactions", "cc": "concierge_conversations", "ii": "inventory_items",
            "sm": "stock_movements", "ae": "ai_events", "ke": "knowledge_embeddings"}


def with_adapters(body: str, *names: str, extra: str = "") -> str:
    """Prefix ``body`` with one CTE per adapter (aliases map to adapter names)."""
    ctes = []
    for n in names:
        src = _ALIASES.get(n, n)
        ctes.append(f"{n} AS ({ADAPTER_SQL[src].strip()})")
    if extra:
        ctes.append(extra.strip())
    return "WITH " + ",\n".join(ctes) + "\n" + body.strip()


def _ts(v: str) -> str:
    return f"TIMESTAMP '{v}'"


INC = "(income_receivable + income_cash + income_bank)"
EXP = "(expense_payable + expense_cash + expense_bank)"
ESC = "COUNT(*) FILTER (WHERE escalated = TRUE)"
PURCH = "('Materials','Equipment','Sales (Out)','Sales Out')"

ORACLES: dict[str, str] = {}

ORACLES["student_ltv"] = with_adapters("""
SELECT s.id AS student_id, s.full_name, COUNT(r.id) AS total_courses_booked,
       CAST(SUM(r.amount_paid) AS DOUBLE) AS lifetime_value
FROM students s LEFT JOIN registrations r ON s.id = r.student_id
GROUP BY s.id, s.full_name""", "students", "registrations")

ORACLES["ai_performance"] = with_adapters(f"""
SELECT agent_name, COUNT(*) AS total_requests,
       CAST(SUM(CASE WHEN outcome = 'success' THEN 1 ELSE 0 END) AS DOUBLE) / NULLIF(COUNT(*), 0) * 100 AS success_rate_percent,
       CAST(SUM(CASE WHEN outcome = 'escalated' THEN 1 ELSE 0 END) AS BIGINT) AS escalations_count,
       CAST(SUM(success_metric) AS DOUBLE) / NULLIF(COUNT(success_metric), 0) AS avg_quality_score,
       CAST(SUM(cost_cents) AS DOUBLE) / 100 AS total_cost_dollars,
       CAST(ROUND(AVG(latency_ms)) AS INTEGER) AS avg_response_time_ms,
       CAST(MIN(created_at) AS DATE) AS first_event_date, CAST(MAX(created_at) AS DATE) AS last_event_date,
       CAST(MAX(created_at) AS DATE) AS report_date
FROM ae WHERE created_at >= {_ts(EVENTS_AS_OF)} - INTERVAL 30 DAY
GROUP BY agent_name""", "ae")

_AUTO = "COUNT(*) FILTER (WHERE event_type = 'booking' AND outcome = 'success')"
ORACLES["ai_business_impact"] = with_adapters(f"""
SELECT CAST(created_at AS DATE) AS event_date,
       {_AUTO} AS bookings_automated,
       COUNT(*) FILTER (WHERE event_type = 'booking' AND outcome = 'escalated') AS bookings_escalated,
       COUNT(*) FILTER (WHERE event_type = 'recommendation' AND outcome = 'success') AS recommendations_given,
       {_AUTO} * 50 AS estimated_revenue_dollars,
       CAST(SUM(cost_cents) AS DOUBLE) / 100 AS total_ai_cost_dollars,
       ROUND((CAST({_AUTO} * 50 AS DOUBLE) - CAST(SUM(cost_cents) AS DOUBLE) / 100) / NULLIF({_AUTO}, 0), 2)
         AS revenue_per_ai_cost
FROM ae GROUP BY CAST(created_at AS DATE)""", "ae")

ORACLES["channel_performance"] = with_adapters(f"""
SELECT channel, COUNT(*) AS total_conversations, {ESC} AS escalated,
       ROUND(CAST({ESC} AS DOUBLE) * 100 / NULLIF(COUNT(*), 0), 2) AS escalation_rate,
       ROUND(AVG(response_time_ms), 2) AS avg_response_ms, ROUND(AVG(customer_feedback), 2) AS avg_csat,
       MAX(created_at) AS last_conversation
FROM cc GROUP BY channel""", "cc")

ORACLES["daily_trends"] = with_adapters(f"""
SELECT CAST(created_at AS DATE) AS conversation_date, COUNT(*) AS total, {ESC} AS escalated,
       ROUND(CAST({ESC} AS DOUBLE) * 100 / NULLIF(COUNT(*), 0), 2) AS escalation_pct,
       ROUND(AVG(response_time_ms), 2) AS avg_response_ms,
       COUNT(DISTINCT sender_id) AS unique_customers, COUNT(DISTINCT session_id) AS unique_sessions
FROM cc GROUP BY CAST(created_at AS DATE)""", "cc")

ORACLES["weekly_trends"] = with_adapters(f"""
SELECT CAST(date_trunc('week', created_at) AS DATE) AS span, COUNT(*) AS total, {ESC} AS escalated,
       ROUND(CAST({ESC} AS DOUBLE) * 100 / NULLIF(COUNT(*), 0), 2) AS escalation_pct,
       ROUND(AVG(response_time_ms), 2) AS avg_response_ms, COUNT(DISTINCT sender_id) AS customers_exact,
       COUNT(DISTINCT session_id) AS sessions_exact, TRUE AS within_error
FROM cc WHERE created_at IS NOT NULL GROUP BY CAST(date_trunc('week', created_at) AS DATE)""", "cc")

ORACLES["top_intents"] = with_adapters(f"""
SELECT intent_detected, COUNT(*) AS count,
       ROUND(CAST(COUNT(*) AS DOUBLE) * 100
             / NULLIF((SELECT COUNT(*) FROM cc WHERE intent_detected IS NOT NULL), 0), 2) AS percentage,
       ROUND(AVG(response_time_ms), 2) AS avg_response_ms,
       ROUND(CAST({ESC} AS DOUBLE) * 100 / NULLIF(COUNT(*), 0), 2) AS escalation_rate
FROM cc WHERE intent_detected IS NOT NULL
GROUP BY intent_detected ORDER BY count DESC, intent_detected LIMIT 20""", "cc")

ORACLES["hourly_metrics"] = with_adapters(f"""
SELECT b.*, ti.top_intent, tc.top_channel
FROM (SELECT metric_hour, COUNT(*) AS total_conversations, {ESC} AS escalated_count,
             CAST(ROUND(AVG(response_time_ms)) AS INTEGER) AS avg_response_time_ms,
             ROUND(CAST(COUNT(*) - {ESC} AS DOUBLE) * 100 / COUNT(*), 2) AS resolution_rate,
             ROUND(AVG(customer_feedback), 2) AS csat_avg
      FROM hc GROUP BY metric_hour) b
LEFT JOIN (SELECT metric_hour, intent_detected AS top_intent,
                  row_number() OVER (PARTITION BY metric_hour ORDER BY COUNT(*) DESC, intent_detected) AS rn
           FROM hc WHERE intent_detected IS NOT NULL GROUP BY metric_hour, intent_detected) ti
  ON ti.metric_hour = b.metric_hour AND ti.rn = 1
LEFT JOIN (SELECT metric_hour, channel AS top_channel,
                  row_number() OVER (PARTITION BY metric_hour ORDER BY COUNT(*) DESC, channel) AS rn
           FROM hc WHERE channel IS NOT NULL GROUP BY metric_hour, channel) tc
  ON tc.metric_hour = b.metric_hour AND tc.rn = 1""", "cc",
    extra="hc AS (SELECT *, date_trunc('hour', created_at) AS metric_hour FROM cc)")

ORACLES["conversation_stats"] = with_adapters(f"""
SELECT COUNT(*) AS total, {ESC} AS escalated,
       CAST(ROUND(COALESCE(AVG(response_time_ms), 0)) AS INTEGER) AS avg_response_ms,
       COUNT(*) FILTER (WHERE channel = 'whatsapp') AS whatsapp,
       COUNT(*) FILTER (WHERE channel = 'messenger') AS messenger,
       COUNT(*) FILTER (WHERE channel = 'instagram') AS instagram,
       COUNT(*) FILTER (WHERE channel = 'web') AS web
FROM cc""", "cc")

ORACLES["conversation_page"] = with_adapters(f"""
SELECT id, session_id, channel, sender_id, original_message, rewritten_query, ai_response, model_used,
       intent_detected, escalated, response_time_ms, created_at
FROM cc WHERE channel = '{PAGE_CHANNEL}'
ORDER BY created_at DESC NULLS FIRST, id LIMIT {PAGE_LIMIT} OFFSET {PAGE_OFFSET}""", "cc")

ORACLES["conversation_page_deep"] = with_adapters(f"""
SELECT id, session_id, channel, sender_id, original_message, rewritten_query, ai_response, model_used,
       intent_detected, escalated, response_time_ms, created_at
FROM (SELECT *, row_number() OVER (ORDER BY created_at DESC NULLS FIRST, id) AS place, COUNT(*) OVER () AS every FROM cc)
WHERE place > every // 2 AND place <= every // 2 + {PAGE_LIMIT}""", "cc")

ORACLES["dashboard_stats"] = with_adapters(f"""
SELECT (SELECT COUNT(*) FROM students) AS total_students,
       (SELECT COUNT(*) FROM cc WHERE created_at >= {_ts(EVENTS_AS_OF)} - INTERVAL 24 HOUR) AS ai_convos_24h,
       (SELECT COUNT(*) FROM ft WHERE income_receivable > 0 AND (income_cash = 0 AND income_bank = 0)
          AND transaction_date >= {_ts(LINEITEM_AS_OF)} - INTERVAL 90 DAY) AS unpaid_invoices,
       (SELECT CAST(COALESCE(SUM(income_cash + income_bank), 0) AS DOUBLE) FROM ft
          WHERE transaction_date >= date_trunc('month', {_ts(LINEITEM_AS_OF)})) AS revenue_this_month
""", "students", "cc", "ft")

ORACLES["student_search"] = with_adapters(f"""
SELECT id, COALESCE(NULLIF(full_name, ''), 'Unknown') AS name, COALESCE(NULLIF(email, ''), '') AS email,
       COALESCE(NULLIF(phone, ''), '') AS phone, created_at
FROM students WHERE full_name ILIKE '%{STUDENT_QUERY}%' OR email ILIKE '%{STUDENT_QUERY}%'
ORDER BY created_at DESC NULLS FIRST, id LIMIT {SEARCH_LIMIT}""", "students")

ORACLES["student_activity"] = with_adapters(f"""
SELECT (SELECT COUNT(DISTINCT student_id) FROM registrations
          WHERE registration_date >= date_trunc('month', {_ts(ORDERS_AS_OF)})) AS active_this_month,
       (SELECT COUNT(*) FROM registrations) AS total_registrations,
       (SELECT COUNT(*) FROM students) AS total_students""", "students", "registrations")

ORACLES["finance_totals"] = with_adapters(f"""
SELECT CAST(COALESCE(SUM({INC}), 0) AS DOUBLE) AS total_income,
       CAST(COALESCE(SUM({EXP}), 0) AS DOUBLE) AS total_expense,
       CAST(COALESCE(SUM({INC}), 0) - COALESCE(SUM({EXP}), 0) AS DOUBLE) AS net_profit
FROM ft""", "ft")

ORACLES["finance_monthly_trend"] = with_adapters(f"""
SELECT CAST(date_trunc('month', transaction_date) AS DATE) AS month_start,
       strftime(date_trunc('month', transaction_date), '%b %y') AS month,
       CAST(COALESCE(SUM({INC}), 0) AS DOUBLE) AS revenue, CAST(COALESCE(SUM({EXP}), 0) AS DOUBLE) AS expenses
FROM ft WHERE transaction_date >= {_ts(LINEITEM_AS_OF)} - INTERVAL 6 MONTH
GROUP BY date_trunc('month', transaction_date) ORDER BY date_trunc('month', transaction_date)""", "ft")

ORACLES["revenue_by_category"] = with_adapters(f"""
SELECT category, CAST(SUM({INC}) AS DOUBLE) AS total FROM ft
WHERE {INC} > 0 AND category IS NOT NULL AND category != ''
GROUP BY category ORDER BY total DESC, category NULLS FIRST LIMIT 5""", "ft")

ORACLES["revenue_by_category_all"] = with_adapters(f"""
SELECT category, CAST(SUM({INC}) AS DOUBLE) AS total FROM ft WHERE {INC} > 0
GROUP BY category ORDER BY total DESC, category NULLS FIRST LIMIT 5""", "ft")

ORACLES["transaction_list"] = with_adapters(f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, date, description, category, amount, type FROM (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, transaction_date,
         COALESCE(strftime(transaction_date, '%Y-%m-%d'), '') AS date,
         COALESCE(NULLIF(description, ''), '') AS description,
         COALESCE(NULLIF(category, ''), 'Uncategorized') AS category,
         CASE WHEN {INC} > 0 THEN CAST({INC} AS DOUBLE) WHEN {INC} IS NOT NULL THEN -CAST({EXP} AS DOUBLE) END AS amount,
         CASE WHEN {INC} > 0 THEN 'income' WHEN {INC} IS NOT NULL THEN 'expense' END AS type
  FROM ft)
ORDER BY transaction_date DESC NULLS FIRST, l_orderkey, l_linenumber, l_partkey, l_suppkey, category,
         amount NULLS FIRST, type NULLS FIRST
LIMIT {TRANSACTION_LIMIT}""", "ft")

ORACLES["inventory_levels"] = with_adapters("""
SELECT id, name, category, unit, CAST(current_stock AS DOUBLE) AS current_stock,
       CAST(minimum_stock AS DOUBLE) AS minimum_stock, CAST(reorder_point AS DOUBLE) AS reorder_point,
       CASE WHEN cost_per_unit <> 0 THEN CAST(cost_per_unit AS DOUBLE) END AS cost_per_unit,
       COALESCE(NULLIF(supplier, ''), '') AS supplier, current_stock <= minimum_stock AS low_stock
FROM ii ORDER BY category, name, id""", "ii")

ORACLES["inventory_category_summary"] = with_adapters(f"""
SELECT category AS inventory_category, COUNT(*) AS purchase_count, CAST(SUM({EXP}) AS DOUBLE) AS total_invested,
       strftime(MAX(transaction_date), '%Y-%m-%d') AS last_purchase
FROM ft WHERE category IN {PURCH} AND {EXP} > 0 GROUP BY category""", "ft")

ORACLES["recent_movements"] = with_adapters("""
SELECT sm.l_orderkey, sm.l_linenumber, sm.l_suppkey, ii.name AS item_name, sm.movement_type AS type,
       CAST(sm.quantity AS DOUBLE) AS quantity, ii.unit, COALESCE(NULLIF(sm.notes, ''), '') AS notes,
       COALESCE(strftime(sm.created_at, '%Y-%m-%d'), '') AS date, COALESCE(NULLIF(sm.created_by, ''), 'system') AS by
FROM sm JOIN ii ON ii.id = sm.item_id
ORDER BY sm.created_at DESC NULLS FIRST, sm.l_orderkey, sm.l_linenumber, sm.l_suppkey, sm.item_id LIMIT 25""", "sm", "ii")

ORACLES["purchase_totals"] = with_adapters(f"""
SELECT COUNT(*) AS total_purchases, CAST(ROUND(COALESCE(SUM({EXP}), 0), 0) AS DOUBLE) AS total_invested,
       (SELECT COUNT(*) FROM ii WHERE current_stock <= minimum_stock) AS low_stock_alerts
FROM ft WHERE category IN {PURCH} AND {EXP} > 0""", "ft", "ii")

ORACLES["low_stock_top"] = with_adapters("""
SELECT id, name, CAST(current_stock AS DOUBLE) AS current_stock, CAST(minimum_stock AS DOUBLE) AS minimum_stock
FROM ii WHERE current_stock <= minimum_stock ORDER BY current_stock, name, id LIMIT 5""", "ii")

ORACLES["business_context"] = with_adapters(f"""
SELECT 1 AS line_no, 'Total students: ' || CAST(COUNT(*) AS VARCHAR) AS text FROM students
UNION ALL
SELECT 2, 'Total revenue: EGP ' || format('{{:,.0f}}', i) || ', Total expenses: EGP ' || format('{{:,.0f}}', e)
          || ', Net profit: EGP ' || format('{{:,.0f}}', i - e)
FROM (SELECT COALESCE(SUM({INC}), 0) AS i, COALESCE(SUM({EXP}), 0) AS e FROM ft)
UNION ALL
SELECT 3, 'Low stock items: ' || string_agg(COALESCE(name, 'None') || ' (' || CAST(current_stock AS VARCHAR) || ' left, min '
          || CAST(minimum_stock AS VARCHAR) || ')', ', ' ORDER BY current_stock, name, id)
FROM (SELECT * FROM ii WHERE current_stock <= minimum_stock ORDER BY current_stock, name, id LIMIT 5)
HAVING COUNT(*) > 0
UNION ALL
SELECT 4, 'New students this month: ' || CAST(COUNT(*) FILTER (WHERE created_at >= date_trunc('month', {_ts(ORDERS_AS_OF)})) AS VARCHAR)
FROM students
UNION ALL
SELECT 5, 'Revenue by category: ' || string_agg(COALESCE(category, 'None') || ': EGP ' || format('{{:,.0f}}', total), ', '
          ORDER BY total DESC, category NULLS FIRST)
FROM (SELECT category, SUM({INC}) AS total FROM ft WHERE {INC} > 0 GROUP BY category
      ORDER BY total DESC, category NULLS FIRST LIMIT 5)
HAVING COUNT(*) > 0""", "students", "ft", "ii")

ORACLES["snapshot_30d"] = with_adapters(f"""
SELECT revenue_30d, new_students_30d,
       'Database Snapshot: 30-day Revenue EGP ' || format('{{:,}}', revenue_30d) || ', 30-day New Students '
       || CAST(new_students_30d AS VARCHAR) AS snapshot_text
FROM (SELECT CAST(ROUND(COALESCE(SUM(amount_paid) FILTER (WHERE status = 'CONFIRMED'
                 AND registration_date >= CAST(CAST({_ts(ORDERS_AS_OF)} AS DATE) AS TIMESTAMP) - INTERVAL 30 DAY), 0)) AS INTEGER) AS revenue_30d,
             (SELECT COUNT(*) FROM students
               WHERE created_at >= CAST(CAST({_ts(ORDERS_AS_OF)} AS DATE) AS TIMESTAMP) - INTERVAL 30 DAY) AS new_students_30d
      FROM registrations)""", "students", "registrations")

ORACLES["recent_rows"] = with_adapters(f"""
SELECT id, original_message AS content, metadata, created_at FROM cc
ORDER BY created_at DESC NULLS FIRST, id LIMIT {RECENT_ROWS_LIMIT}""", "cc")

# ---------------------------------------------------------------- transforms
def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _js(p: str, path: str) -> str:
    """String at a JSON path with script truthiness ('' counts as missing)."""
    return f"NULLIF(json_extract_string({p}, '{path}'), '')"


SERVICES_SQL = f"""
SELECT pos,
       COALESCE({_js('payload', '$.id')}, '') AS wix_id,
       COALESCE({_js('payload', '$.type')}, 'BOOKING_SERVICE') AS service_type,
       COALESCE({_js('payload', '$.name')}, {_js('payload', '$.info.name')}, 'Unknown Service') AS title,
       CAST(0.0 AS DOUBLE) AS price,
       COALESCE({_js('payload', '$.status')}, 'ACTIVE') AS status,
       {_js('payload', '$.category.name')} AS category,
       NULLIF(CAST(json_extract(payload, '$.schedule.availabilityConstraints.sessionDurations[0]') AS INTEGER), 0) AS duration
FROM service_payload"""

_CLEAN = "regexp_replace(vs, '[^0-9.]', '', 'g')"
BOOKINGS_SQL = f"""
SELECT o_orderkey, COALESCE({_js('p', '$.id')}, '') AS wix_booking_id,
       COALESCE(NULLIF(contact, ''), email) AS wix_contact_id,
       COALESCE(NULLIF(name, ''), 'Guest') AS full_name, email,
       COALESCE({_js('p', '$.contactDetails.phone')}, '') AS phone,
       COALESCE({_js('p', '$.bookedEntity.slot.serviceId')}, '') AS wix_service_id,
       COALESCE({_js('p', '$.createdDate')}, '{ORDERS_AS_OF.replace(' ', 'T')}.000Z') AS registration_date,
       CASE WHEN tpt = 'OBJECT' AND vt IS NOT NULL THEN
              CASE WHEN vt = 'VARCHAR' THEN
                     CASE WHEN {_CLEAN} = '' THEN 0.0
                          ELSE TRY_CAST(NULLIF(regexp_extract({_CLEAN}, '^([0-9]+\\.?[0-9]*|\\.[0-9]+)', 0), '') AS DOUBLE) END
                   WHEN vt IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'INTEGER', 'UINTEGER') THEN COALESCE(NULLIF(CAST(vs AS DOUBLE), 0.0), 0.0)
                   ELSE 0.0 END
            ELSE 0.0 END AS amount_paid,
       COALESCE({_js('p', '$.status')}, 'CONFIRMED') AS status
FROM (SELECT o_orderkey, payload AS p,
             COALESCE({_js('payload', '$.contactId')}, {_js('payload', '$.contactDetails.contactId')}, '') AS contact,
             lower({_trim(f"COALESCE({_js('payload', '$.contactDetails.email')}, '')")}) AS email,
             {_trim(f"COALESCE({_js('payload', '$.contactDetails.firstName')}, '') || ' ' || COALESCE({_js('payload', '$.contactDetails.lastName')}, '')")} AS name,
             json_type(payload, '$.priceInfo.totalPrice') AS tpt,
             json_type(payload, '$.priceInfo.totalPrice.value') AS vt,
             json_extract_string(payload, '$.priceInfo.totalPrice.value') AS vs
      FROM booking_payload)
WHERE COALESCE(NULLIF(contact, ''), email) <> ''"""

ORACLES["parse_services"] = with_adapters(SERVICES_SQL, "service_payload")
ORACLES["parse_bookings"] = with_adapters(BOOKINGS_SQL, "booking_payload")
# the write fails as a whole if one service has no id; the summary then tells what was sent
ORACLES["sync_summary"] = with_adapters("""
SELECT CASE WHEN bad THEN 'PARTIAL' ELSE 'SUCCESS' END AS status, TIMESTAMP '2001-08-01 00:00:00' AS synced_at,
       services AS services_synced, sent AS bookings_synced, fetched AS bookings_fetched,
       fetched AS bookings_total_in_wix, CASE WHEN bad THEN 'service without id' END AS error
FROM (SELECT (SELECT COUNT(*) FROM services) AS services,
             (SELECT COUNT(*) FROM services WHERE wix_id IS NULL OR wix_id = '') > 0 AS bad,
             (SELECT COUNT(*) FROM bookings) AS sent, (SELECT COUNT(*) FROM booking_payload) AS fetched)""",
    "service_payload", "booking_payload",
    extra=f"services AS ({SERVICES_SQL.strip()}), bookings AS ({BOOKINGS_SQL.strip()})")

ORACLES["ga4_metrics"] = with_adapters("""
SELECT log_date, 'ga4' AS platform, 'activeUsers' AS metric_name, TRY_CAST(v0 AS DOUBLE) AS metric_value FROM g WHERE n >= 2
UNION ALL
SELECT log_date, 'ga4', 'sessions', TRY_CAST(v1 AS DOUBLE) FROM g WHERE n >= 2""", "ga4_payload", extra="""
g AS (SELECT CAST(strptime(json_extract_string(payload, '$.date'), '%Y%m%d') AS DATE) AS log_date,
             json_array_length(payload, '$.metricValues') AS n,
             json_extract_string(payload, '$.metricValues[0].value') AS v0,
             json_extract_string(payload, '$.metricValues[1].value') AS v1
      FROM ga4_payload)""")


def _any_contains(col: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({col}, '{p}')" for p in phrases) + ")"


def _rights_sql() -> str:
    from ledgerline.operators.transforms import ACCESS_PHRASES, DELETE_PHRASES, OPTOUT_PHRASES
    m = "$.entry[0].changes[0].value"
    return f"""
SELECT conv_id, turn, phone, message_text,
       CASE WHEN {_any_contains('message_text', DELETE_PHRASES)} THEN 'DELETE'
            WHEN {_any_contains('message_text', ACCESS_PHRASES)} THEN 'ACCESS'
            WHEN {_any_contains('message_text', OPTOUT_PHRASES)} THEN 'OPTOUT' ELSE 'unknown' END AS intent
FROM (SELECT conv_id, turn,
             COALESCE({_js('payload', m + '.messages[0].from')}, {_js('payload', m + '.contacts[0].wa_id')}, '') AS phone,
             lower({_trim(f"COALESCE({_js('payload', m + '.messages[0].text.body')}, '')")}) AS message_text
      FROM rights_message)"""


RIGHTS_SQL = _rights_sql()
ORACLES["rights_intent"] = with_adapters(RIGHTS_SQL, "rights_message")
ORACLES["rights_access_report"] = with_adapters("""
SELECT r.phone, COALESCE(rep.message_count, 0) AS message_count,
       COALESCE(rep.summary, 'ℹ️ لا توجد بيانات مخزنة لرقمك.' || chr(10) || chr(10)
                             || 'No stored data found for your number.') AS summary
FROM (SELECT DISTINCT phone FROM ri WHERE intent = 'ACCESS') r
LEFT JOIN (
  SELECT sender_id AS phone, COUNT(*) AS message_count,
         string_agg(CAST(rn AS VARCHAR) || '. [' || COALESCE(substring(strftime(created_at, '%Y-%m-%dT%H:%M:%S'), 1, 10), '')
                    || '] ' || COALESCE(NULLIF(intent_detected, ''), 'inquiry') || ': '
                    || substring(COALESCE(original_message, ''), 1, 60) || '...', chr(10) ORDER BY rn) AS summary
  FROM (SELECT *, row_number() OVER (PARTITION BY sender_id ORDER BY created_at DESC NULLS FIRST, id) AS rn
        FROM cc WHERE sender_id IN (SELECT phone FROM ri WHERE intent = 'ACCESS'))
  WHERE rn <= 20 GROUP BY sender_id) rep ON rep.phone = r.phone""", "rights_message", "cc",
    extra=f"ri AS ({RIGHTS_SQL.strip()})")

ORACLES["parse_rewrite"] = with_adapters("""
SELECT conv_id, turn, request_language,
       CASE WHEN NOT ok THEN 'REWRITE_FAILED'
            ELSE COALESCE(NULLIF(json_extract_string(j, '$.rewritten_query'), ''), 'REWRITE_FAILED') END AS rewritten_query,
       COALESCE(json_type(j, '$.is_greeting') = 'BOOLEAN' AND json_extract_string(j, '$.is_greeting') = 'true', false) AS is_greeting,
       CASE WHEN NOT ok THEN 'unknown'
            ELSE COALESCE(NULLIF(json_extract_string(j, '$.detected_language'), ''), NULLIF(request_language, ''), 'auto') END AS detected_language,
       CASE WHEN NOT ok THEN 'general' ELSE COALESCE(NULLIF(json_extract_string(j, '$.intent'), ''), 'general') END AS intent
FROM (SELECT *, json_valid(raw) AS ok, CASE WHEN json_valid(raw) THEN raw ELSE '{}' END AS j
      FROM (SELECT conv_id, turn, request_language,
                   COALESCE(NULLIF(regexp_replace(response_text, '^\\s+|\\s+$', '', 'g'), ''), '{}') AS raw
            FROM rewrite_response))""", "rewrite_response")

ORACLES["resolve_tiers"] = with_adapters("""
SELECT request_id,
       CASE WHEN primary_text IS NOT NULL THEN 'primary' WHEN fallback_text IS NOT NULL THEN 'fallback'
            ELSE 'graceful_error' END AS source,
       COALESCE(primary_text, fallback_text, 'AI services are temporarily unavailable. Please try again shortly.') AS response,
       primary_text IS NULL AS fallback_used,
       CASE WHEN primary_text IS NOT NULL THEN 0 WHEN fallback_text IS NOT NULL THEN 1 ELSE 2 END AS fallback_level
FROM tier_response""", "tier_response")

TECH_SQL = """
SELECT doc_id, submission_channel, raw_text, ok, j,
       CASE WHEN NOT ok THEN 'Unknown (extraction pending)'
            WHEN json_type(j, '$.technique_name') IS NULL THEN 'Unknown'
            ELSE json_extract_string(j, '$.technique_name') END AS technique_name,
       CASE WHEN ok THEN json_extract_string(j, '$.artisan_name') END AS artisan_name,
       CASE WHEN ok THEN json_extract_string(j, '$.region') END AS region,
       CASE WHEN ok THEN json_extract_string(j, '$.category') ELSE 'other' END AS category,
       CASE WHEN ok THEN COALESCE(json_extract_string(j, '$.materials[*]'), []) ELSE [] END AS materials_list,
       CASE WHEN ok THEN COALESCE(json_extract_string(j, '$.tools[*]'), []) ELSE [] END AS tools_list,
       CASE WHEN ok THEN json_extract_string(j, '$.description') ELSE substring(raw_text, 1, 500) END AS description,
       CASE WHEN ok THEN json_extract_string(j, '$.risk_level') ELSE 'unknown' END AS risk_level
FROM (SELECT *, CASE WHEN ok THEN m ELSE '{}' END AS j
      FROM (SELECT *, m <> '' AND json_valid(m) AS ok
            FROM (SELECT doc_id, submission_channel, raw_text,
                         regexp_extract(response_text, '\\{[\\s\\S]*\\}', 0) AS m FROM extraction_response)))"""

NORM_SQL = """
SELECT doc_id, technique_name, NULLIF(artisan_name, '') AS artisan_name,
       CASE WHEN t.cat IN ('carving','woodturning','joinery','inlay','marquetry','finishing','other') THEN t.cat ELSE 'other' END AS category,
       CASE WHEN NULLIF(risk_level, '') IS NULL THEN 'unknown'
            WHEN regexp_split_to_array(trim(lower(risk_level)), '\\s+')[1] IN ('critical','rare','common')
              THEN regexp_split_to_array(trim(lower(risk_level)), '\\s+')[1]
            ELSE 'unknown' END AS risk_level,
       materials_list
FROM (SELECT *, trim(lower(COALESCE(category, 'None'))) AS cat FROM tech) t"""

ORACLES["extract_technique"] = with_adapters("""
SELECT doc_id, submission_channel, ok AS extracted, technique_name, artisan_name, region, category,
       array_to_string(materials_list, ',') AS materials, array_to_string(tools_list, ',') AS tools,
       description, risk_level
FROM tech""", "extraction_response", extra=f"tech AS ({TECH_SQL.strip()})")

ORACLES["normalize_technique"] = with_adapters("""
SELECT doc_id, technique_name, artisan_name, category, risk_level FROM norm""", "extraction_response",
    extra=f"tech AS ({TECH_SQL.strip()}), norm AS ({NORM_SQL.strip()})")


def _piece(key: str, fallback: str) -> str:
    return (f"CASE WHEN NOT ok THEN {fallback} WHEN json_type(j, '$.{key}') IS NULL THEN '' "
            f"WHEN json_type(j, '$.{key}') = 'NULL' THEN 'None' ELSE json_extract_string(j, '$.{key}') END")


ORACLES["embedding_text"] = with_adapters(f"""
SELECT doc_id, regexp_replace({_piece('technique_name', 'technique_name')} || ' ' ||
       {_piece('description', "COALESCE(description, 'None')")} || ' ' || {_piece('category', 'category')} || ' ' ||
       {_piece('region', "COALESCE(region, 'None')")}, '^\\s+|\\s+$', '', 'g') AS embed_text
FROM tech""", "extraction_response", extra=f"tech AS ({TECH_SQL.strip()})")

ORACLES["technique_facets"] = with_adapters("""
SELECT facet, value, COUNT(*) AS n FROM (
  SELECT 'category' AS facet, category AS value FROM norm
  UNION ALL SELECT 'risk_level', risk_level FROM norm
  UNION ALL SELECT 'material', unnest(materials_list) FROM norm)
GROUP BY facet, value""", "extraction_response",
    extra=f"tech AS ({TECH_SQL.strip()}), norm AS ({NORM_SQL.strip()})")

ORACLES["facet_combinations"] = with_adapters(f"""
SELECT category, risk_level, material, COUNT(*) AS n FROM (
  SELECT unnest([category, NULL, category]) AS category, unnest([NULL, risk_level, risk_level]) AS risk_level, material
  FROM (SELECT DISTINCT doc_id, category, risk_level, unnest(materials_list) AS material FROM norm)
  WHERE material IN (SELECT m FROM (SELECT DISTINCT doc_id, unnest(materials_list) AS m FROM norm)
                     WHERE m IS NOT NULL GROUP BY m ORDER BY COUNT(*) DESC, m LIMIT {FACET_MATERIALS}))
GROUP BY category, risk_level, material""", "extraction_response",
    extra=f"tech AS ({TECH_SQL.strip()}), norm AS ({NORM_SQL.strip()})")

# ---------------------------------------------------------------- keyed writes and stateful
DRAFTS_SQL = """
SELECT event_id AS id, customer_wa_id, customer_name, text AS customer_message, wamid AS customer_message_wamid,
       'draft: ' || text AS ai_proposed_response, created_at AS ai_responded_at, created_at
FROM shadow_event WHERE kind = 'draft'"""

# one row for each message id: the first delivery, with the draft of the last one; rows without an id as they are
MERGED_SQL = """
SELECT f.id, f.customer_wa_id, f.customer_name, f.customer_message, f.customer_message_wamid, f.created_at,
       l.ai_proposed_response, l.ai_responded_at
FROM (SELECT *, row_number() OVER (PARTITION BY customer_message_wamid ORDER BY created_at NULLS FIRST, id) AS r
      FROM drafts WHERE customer_message_wamid IS NOT NULL) f
JOIN (SELECT *, row_number() OVER (PARTITION BY customer_message_wamid ORDER BY created_at DESC NULLS LAST, id DESC) AS r
      FROM drafts WHERE customer_message_wamid IS NOT NULL) l
  ON f.customer_message_wamid = l.customer_message_wamid AND f.r = 1 AND l.r = 1
UNION ALL
SELECT id, customer_wa_id, customer_name, customer_message, customer_message_wamid, created_at, ai_proposed_response,
       ai_responded_at
FROM drafts WHERE customer_message_wamid IS NULL"""

ORACLES["upsert_drafts"] = with_adapters(MERGED_SQL, "shadow_event", extra=f"drafts AS ({DRAFTS_SQL.strip()})")

# Literal replay of the reply matcher over the merged log and the imported messages without a reply: walk each
# customer's events in order with the stack of unanswered drafts as a list (a recursive CTE, one event per step).
# An event without a customer or a time is in no walk: NULL equals nothing.
SHADOW_SQL = f"""
merged AS ({MERGED_SQL.strip()}),
log AS (
  SELECT id, customer_wa_id, customer_name, customer_message, customer_message_wamid, created_at, ai_proposed_response,
         ai_responded_at, CAST(NULL AS VARCHAR) AS capture_source FROM merged
  UNION ALL
  SELECT -1 - (conv_id * 100000 + turn), customer_wa_id, COALESCE(NULLIF(customer_name, ''), batch_name),
         customer_message, NULL, {_ts(EVENTS_AS_OF)}, '[historical export - no AI draft]', NULL,
         COALESCE(NULLIF(source, ''), 'tampermonkey_extract_v3')
  FROM conversation_pair WHERE regexp_matches(customer_message, '\\S') AND staff_reply IS NULL),
events_in_order AS (
  SELECT id AS event_id, customer_wa_id, 'draft' AS kind, created_at FROM log
  UNION ALL
  SELECT event_id, customer_wa_id, kind, created_at FROM shadow_event WHERE kind = 'reply'),
ev AS (SELECT *, row_number() OVER (PARTITION BY customer_wa_id ORDER BY created_at, event_id) AS rn
       FROM events_in_order WHERE customer_wa_id IS NOT NULL AND created_at IS NOT NULL),
walk AS (
  SELECT customer_wa_id, CAST(0 AS BIGINT) AS rn,
         CAST([] AS STRUCT(id BIGINT, t TIMESTAMP)[]) AS stack,
         CAST(NULL AS BIGINT) AS reply_id, CAST(NULL AS BIGINT) AS draft_id
  FROM (SELECT DISTINCT customer_wa_id FROM ev)
  UNION ALL
  SELECT w.customer_wa_id, e.rn,
         CASE WHEN e.kind = 'draft' THEN list_append(w.stack, {{'id': e.event_id, 't': e.created_at}})
              WHEN len(w.stack) > 0 AND w.stack[len(w.stack)].t > e.created_at - INTERVAL 24 HOUR
                THEN list_slice(w.stack, 1, len(w.stack) - 1)
              ELSE w.stack END,
         CASE WHEN e.kind = 'reply' THEN e.event_id END,
         CASE WHEN e.kind = 'reply' AND len(w.stack) > 0 AND w.stack[len(w.stack)].t > e.created_at - INTERVAL 24 HOUR
              THEN w.stack[len(w.stack)].id END
  FROM walk w JOIN ev e ON e.customer_wa_id = w.customer_wa_id AND e.rn = w.rn + 1),
pairs AS (SELECT reply_id, draft_id FROM walk WHERE draft_id IS NOT NULL),
shadow AS (
  SELECT d.id, d.customer_wa_id, d.customer_name, d.customer_message, d.customer_message_wamid, d.ai_proposed_response,
         d.ai_responded_at, r.text AS human_reply, r.created_at AS human_replied_at,
         CASE WHEN r.event_id IS NOT NULL THEN 'tampermonkey' ELSE d.capture_source END AS capture_source, d.created_at
  FROM log d LEFT JOIN pairs p ON p.draft_id = d.id LEFT JOIN shadow_event r ON r.event_id = p.reply_id
  UNION ALL
  SELECT s.event_id, s.customer_wa_id, NULL, '[no AI draft captured]', NULL, NULL, NULL, s.text, s.created_at,
         'tampermonkey', s.created_at
  FROM shadow_event s WHERE s.kind = 'reply' AND s.event_id NOT IN (SELECT reply_id FROM pairs))"""

_SHADOW_CTES = f"drafts AS ({DRAFTS_SQL.strip()}),\n{SHADOW_SQL.strip()}"


def _with_shadow(body: str, *more: str, extra: str = "") -> str:
    sql = with_adapters(body, "shadow_event", "conversation_pair", *more, extra=_SHADOW_CTES + ("," + extra if extra else ""))
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


ORACLES["match_replies"] = _with_shadow("SELECT * FROM shadow")

RATED_SQL = """
valid AS (SELECT * FROM rating WHERE quality_rating IN ('better', 'similar', 'worse')),
lastr AS (SELECT shadow_id, quality_rating, notes, created_at AS rated_at FROM (
            SELECT *, row_number() OVER (PARTITION BY shadow_id ORDER BY seq DESC) AS r
            FROM valid WHERE shadow_id IN (SELECT id FROM shadow)) WHERE r = 1),
rated AS (SELECT s.*, l.quality_rating, l.notes, l.rated_at
          FROM shadow s LEFT JOIN lastr l ON l.shadow_id = s.id)"""

ORACLES["apply_ratings"] = _with_shadow("SELECT id, quality_rating, notes, rated_at FROM rated", "rating",
                                        extra=RATED_SQL)
ORACLES["apply_ratings_rejects"] = _with_shadow("""
SELECT seq, shadow_id, 'invalid' AS reason FROM rating
WHERE quality_rating IS NULL OR quality_rating NOT IN ('better', 'similar', 'worse')
UNION ALL
SELECT seq, shadow_id, 'not_found' FROM valid WHERE shadow_id NOT IN (SELECT id FROM shadow)""", "rating",
                                                extra=RATED_SQL)
ORACLES["training_pairs"] = _with_shadow("""
SELECT id, customer_wa_id, customer_name, customer_message, ai_proposed_response, human_reply,
       quality_rating, capture_source, created_at, human_replied_at
FROM rated WHERE ai_proposed_response IS NOT NULL AND human_reply IS NOT NULL
ORDER BY created_at DESC NULLS FIRST, id LIMIT 50""", "rating", extra=RATED_SQL)
ORACLES["training_pair_stats"] = _with_shadow("""
SELECT COUNT(*) FILTER (WHERE ai_proposed_response IS NOT NULL AND human_reply IS NOT NULL) AS complete_pairs,
       COUNT(*) FILTER (WHERE quality_rating = 'better') AS ai_better,
       COUNT(*) FILTER (WHERE quality_rating = 'similar') AS ai_similar,
       COUNT(*) FILTER (WHERE quality_rating = 'worse') AS ai_worse, COUNT(*) AS total
FROM rated""", "rating", extra=RATED_SQL)

ORACLES["ingest_pairs"] = with_adapters(f"""
SELECT conv_id, turn, customer_wa_id, COALESCE(NULLIF(customer_name, ''), batch_name) AS customer_name,
       customer_message, '[historical export - no AI draft]' AS ai_proposed_response,
       staff_reply AS human_reply, COALESCE(NULLIF(source, ''), 'tampermonkey_extract_v3') AS capture_source,
       {_ts(EVENTS_AS_OF)} AS created_at
FROM conversation_pair WHERE regexp_matches(customer_message, '\\S')""", "conversation_pair")
ORACLES["ingest_pairs_counts"] = with_adapters("""
SELECT batch_name, COUNT(*) FILTER (WHERE regexp_matches(customer_message, '\\S')) AS inserted,
       COUNT(*) FILTER (WHERE NOT regexp_matches(customer_message, '\\S')) AS skipped
FROM conversation_pair GROUP BY batch_name""", "conversation_pair")

# Literal replay of stock-checked usage per item (recursive CTE, one request per step).
ORACLES["usage_log"] = with_adapters("""
SELECT ur.event_id, ur.item_id,
       CASE WHEN ur.quantity IS NULL OR ur.quantity <= 0 THEN 'invalid'
            WHEN ii.id IS NULL THEN 'not_found'
            WHEN s.ok THEN 'accepted' ELSE 'insufficient' END AS verdict,
       CAST(s.left_stock AS DOUBLE) AS stock_after
FROM usage_request ur LEFT JOIN ii ON ii.id = ur.item_id LEFT JOIN steps s ON s.event_id = ur.event_id""",
    "usage_request", "ii", extra="""
q AS (SELECT ur.event_id, ur.item_id, ur.quantity, ii.current_stock,
             row_number() OVER (PARTITION BY ur.item_id ORDER BY ur.created_at, ur.event_id) AS rn
      FROM usage_request ur JOIN ii ON ii.id = ur.item_id WHERE ur.quantity > 0),
steps AS (
  SELECT event_id, item_id, rn, quantity <= current_stock AS ok,
         CASE WHEN quantity <= current_stock THEN current_stock - quantity ELSE current_stock END AS left_stock
  FROM q WHERE rn = 1
  UNION ALL
  SELECT q.event_id, q.item_id, q.rn, q.quantity <= s.left_stock,
         CASE WHEN q.quantity <= s.left_stock THEN s.left_stock - q.quantity ELSE s.left_stock END
  FROM steps s JOIN q ON q.item_id = s.item_id AND q.rn = s.rn + 1)""").replace("WITH ", "WITH RECURSIVE ", 1)

ORACLES["stock_ledger"] = with_adapters("""
SELECT item_id, CAST(SUM(CASE WHEN movement_type = 'consumption' THEN -quantity ELSE quantity END) AS DOUBLE) AS net_change,
       COUNT(*) AS movements
FROM sm GROUP BY item_id""", "sm")

ORACLES["upsert_services"] = with_adapters("""
SELECT f.wix_id AS wix_service_id, f.service_type, f.status, l.title, l.price AS price_egp,
       l.duration AS duration_minutes, l.category,
       CASE WHEN l.pos * 2 <= (SELECT max(p_partkey) FROM part) THEN TIMESTAMP '2001-07-31 00:00:00'
            ELSE TIMESTAMP '2001-08-01 00:00:00' END AS synced_at
FROM (SELECT *, row_number() OVER (PARTITION BY wix_id ORDER BY pos) AS r FROM services) f
JOIN (SELECT *, row_number() OVER (PARTITION BY wix_id ORDER BY pos DESC) AS r FROM services) l
  ON f.wix_id = l.wix_id AND f.r = 1 AND l.r = 1""", "service_payload", extra=f"services AS ({SERVICES_SQL.strip()})")

ORACLES["bookings_to_interactions"] = with_adapters(f"""
SELECT o_orderkey, wix_booking_id, wix_contact_id,
       'Booking: ' || COALESCE(full_name, 'None') || ' - ' || COALESCE(wix_service_id, 'None') AS message_text,
       'booked' AS outcome,
       '{{"email": ' || CASE WHEN email IS NULL THEN 'null' ELSE '"' || email || '"' END || ', "phone": '
       || CASE WHEN phone IS NULL THEN 'null' ELSE '"' || phone || '"' END || '}}' AS metadata,
       {_ts(ORDERS_AS_OF)} AS created_at
FROM bookings""", "booking_payload", extra=f"bookings AS ({BOOKINGS_SQL.strip()})")

ORACLES["insert_metrics"] = with_adapters("""
SELECT * FROM m""", "ga4_payload", extra="""
m AS (SELECT CAST(strptime(json_extract_string(payload, '$.date'), '%Y%m%d') AS DATE) AS log_date, 'ga4' AS platform,
             unnest(['activeUsers', 'sessions']) AS metric_name,
             TRY_CAST(unnest([json_extract_string(payload, '$.metricValues[0].value'),
                              json_extract_string(payload, '$.metricValues[1].value')]) AS DOUBLE) AS metric_value
      FROM ga4_payload WHERE json_array_length(payload, '$.metricValues') >= 2)""")

ORACLES["rights_delete"] = with_adapters("""
SELECT id, sender_id, channel, created_at FROM cc
WHERE sender_id NOT IN (SELECT phone FROM ri WHERE intent = 'DELETE')""", "rights_message", "cc",
    extra=f"ri AS ({RIGHTS_SQL.strip()})")

ORACLES["rights_optout"] = with_adapters("""
SELECT phone_number, reason, blocked_by FROM seed
UNION ALL
SELECT DISTINCT phone, 'user_opt_out', 'whatsapp_bot' FROM ri
WHERE intent = 'OPTOUT' AND phone NOT IN (SELECT phone_number FROM seed)""", "rights_message", extra=f"""
ri AS ({RIGHTS_SQL.strip()}),
seed AS (SELECT DISTINCT phone AS phone_number, 'user_opt_out' AS reason, 'seed' AS blocked_by FROM ri
         WHERE intent = 'DELETE')""")


def _cost_rules_sql() -> str:
    from ledgerline.plans.fixture_params import COST_RULE_SCALE
    vals = []
    for name, cond, action in (("Daily spend alert", "daily_spend > 40", "send_alert"),
                               ("Weekly budget alert", "weekly_spend > 300", "send_alert"),
                               ("Enable aggressive cache", "daily_spend > 30", "enable_cache_ttl_120"),
                               ("Switch to Flash", "daily_spend > 35", "switch_model_flash")):
        metric, thr = cond.split(">")
        vals.append(f"('{name}', 'agent_a', '{metric.strip()}', {float(thr) * COST_RULE_SCALE}, '{action}')")
    return "rules(rule_name, service_name, metric, threshold, action_to_take) AS (VALUES " + ", ".join(vals) + ")"


ORACLES["cost_rules_fired"] = with_adapters("""
SELECT r.rule_name, r.service_name, d.spend_date, r.metric,
       CAST(CASE r.metric WHEN 'daily_spend' THEN d.daily_cents ELSE d.weekly_cents END AS DOUBLE) / 100 AS spend,
       CAST(r.threshold AS DOUBLE) AS threshold, r.action_to_take
FROM d JOIN rules r ON r.service_name = d.service_name
WHERE CASE r.metric WHEN 'daily_spend' THEN d.daily_cents ELSE d.weekly_cents END > CAST(r.threshold AS DECIMAL(20,2)) * 100""",
    "ae", extra=_cost_rules_sql() + """,
d AS (SELECT *, SUM(daily_cents) OVER (PARTITION BY service_name, date_trunc('week', spend_date) ORDER BY spend_date
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS weekly_cents
      FROM (SELECT agent_name AS service_name, CAST(created_at AS DATE) AS spend_date, SUM(cost_cents) AS daily_cents
            FROM ae WHERE agent_name IS NOT NULL GROUP BY 1, 2))""")

ORACLES["current_settings"] = with_adapters("""
SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY created_at DESC, event_id DESC) AS r
                        FROM setting_change WHERE value IN ('active', 'paused')) WHERE r = 1""", "setting_change")
ORACLES["ai_mode"] = with_adapters("""
SELECT COALESCE(max(value), 'active') AS mode, COALESCE(max(value), 'active') = 'active' AS is_active
FROM (SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY created_at DESC, event_id DESC) AS r
                              FROM setting_change WHERE value IN ('active', 'paused')) WHERE r = 1)
WHERE key = 'ai_concierge_mode'""", "setting_change")

ORACLES["validate_rows"] = with_adapters("""
SELECT id, reasons = '' AS is_valid, reasons FROM (
  SELECT id, concat_ws(',',
           CASE WHEN channel IS NULL THEN 'channel_null' END,
           CASE WHEN channel NOT IN ('whatsapp', 'messenger', 'instagram', 'web') THEN 'channel_domain' END,
           CASE WHEN sender_id IS NULL THEN 'sender_null' END,
           CASE WHEN original_message IS NULL THEN 'message_null' END,
           CASE WHEN length(original_message) < 1 OR length(original_message) > 1000 THEN 'message_length' END,
           CASE WHEN customer_feedback < 1 OR customer_feedback > 5 THEN 'feedback_range' END) AS reasons
  FROM unchecked_conversations)""", "unchecked_conversations")

ORACLES["validate_interactions"] = with_adapters("""
SELECT id, reasons = '' AS is_valid, reasons FROM (
  SELECT id, concat_ws(',',
           CASE WHEN interaction_type NOT IN ('booking', 'question', 'complaint', 'feedback', 'other') THEN 'type_domain' END,
           CASE WHEN sentiment NOT IN ('positive', 'neutral', 'negative') THEN 'sentiment_domain' END,
           CASE WHEN satisfaction_score NOT BETWEEN 1 AND 5 THEN 'satisfaction_range' END,
           CASE WHEN outcome NOT IN ('resolved', 'escalated', 'booked', 'follow_up', 'other') THEN 'outcome_domain' END) AS reasons
  FROM unchecked_interactions)""", "unchecked_interactions")

ORACLES["validate_submissions"] = with_adapters("""
SELECT doc_id, reasons = '' AS is_valid, reasons FROM (
  SELECT doc_id, CASE WHEN raw_text IS NULL THEN 'text_null'
                      WHEN length(raw_text) NOT BETWEEN 5 AND 3000 THEN 'text_length' ELSE '' END AS reasons
  FROM extraction_response)""", "extraction_response")

ORACLES["update_conversations"] = with_adapters(f"""
SELECT cc.id, CASE WHEN n.id IS NULL THEN cc.customer_feedback ELSE n.customer_feedback END AS customer_feedback,
       CASE WHEN n.id IS NULL THEN cc.created_at ELSE {_ts(EVENTS_AS_OF)} END AS updated_at
FROM cc LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS r FROM feedback_change) n
  ON n.id = cc.id AND n.r = 1""", "cc", "feedback_change")

# Literal replay of the sliding-window limiter per client (list of accepted times as state).
ORACLES["rate_verdicts"] = """
WITH RECURSIVE r AS (
  SELECT event_id, user_id AS client, ts,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
steps AS (
  SELECT event_id, client, rn, TRUE AS ok, [ts] AS acc FROM r WHERE rn = 1
  UNION ALL
  SELECT r.event_id, r.client, r.rn,
         len(list_filter(s.acc, lambda x: r.ts - x < INTERVAL 12 HOUR)) < 3,
         CASE WHEN len(list_filter(s.acc, lambda x: r.ts - x < INTERVAL 12 HOUR)) < 3
              THEN list_append(list_filter(s.acc, lambda x: r.ts - x < INTERVAL 12 HOUR), r.ts)
              ELSE list_filter(s.acc, lambda x: r.ts - x < INTERVAL 12 HOUR) END
  FROM steps s JOIN r ON r.client = s.client AND r.rn = s.rn + 1)
SELECT event_id, client, CASE WHEN ok THEN 'accept' ELSE 'reject' END AS verdict FROM steps"""

# ---------------------------------------------------------------- vectors
_KB_Q = """
q AS (SELECT query_id, list(x ORDER BY pos) AS query_vec FROM (
        SELECT category AS query_id, pos, avg(CAST(x AS DOUBLE)) AS x FROM (
          SELECT category, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos
          FROM ke WHERE embedding IS NOT NULL) GROUP BY category, pos) GROUP BY query_id),
scored AS (SELECT q.query_id, k.id, k.question, k.answer, k.category, k.confidence,
                  list_cosine_similarity(CAST(k.embedding AS DOUBLE[]), q.query_vec) AS similarity
           FROM q, ke k WHERE k.embedding IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM scored)"""


def _kb_search_sql(k: int, min_sim: float) -> str:
    return with_adapters(f"""
SELECT query_id, rank, id, question, answer, category, CASE WHEN confidence <> 0 THEN confidence END AS confidence,
       CASE WHEN similarity <> 0 THEN round(similarity, 4) END AS similarity
FROM ranked WHERE rank <= {k} AND similarity >= {min_sim}""", "ke", extra=_KB_Q)


def _vector_oracles():
    from ledgerline.plans.fixture_params import IVF_PROBES, MEMORY_K, STRICT_MIN_SIMILARITY
    ORACLES["kb_search"] = _kb_search_sql(3, 0.12)
    ORACLES["kb_search_strict"] = _kb_search_sql(10, STRICT_MIN_SIMILARITY)
    ORACLES["memory_search"] = with_adapters(f"""
SELECT query_id, rank, id, question AS content, round(similarity, 4) AS score
FROM ranked WHERE rank <= {MEMORY_K}""", "ke", extra=_KB_Q)

    # cells by the nearest category centroid, the nearest cells of each query probed
    ivf = _KB_Q + f""",
c AS (SELECT row_number() OVER (ORDER BY query_id) - 1 AS cell, query_vec AS center FROM q),
home AS (SELECT id, embedding, cell FROM (
  SELECT k.id, k.embedding, c.cell, row_number() OVER (
           PARTITION BY k.id ORDER BY list_cosine_similarity(CAST(k.embedding AS DOUBLE[]), c.center) DESC, c.cell) AS r
  FROM ke k, c WHERE k.embedding IS NOT NULL) WHERE r = 1),
probe AS (SELECT query_id, query_vec, cell FROM (
  SELECT q.query_id, q.query_vec, c.cell, row_number() OVER (
           PARTITION BY q.query_id ORDER BY list_cosine_similarity(q.query_vec, c.center) DESC, c.cell) AS r
  FROM q, c) WHERE r <= {IVF_PROBES}),
found AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM (
  SELECT p.query_id, h.id, list_cosine_similarity(CAST(h.embedding AS DOUBLE[]), p.query_vec) AS similarity
  FROM probe p JOIN home h ON h.cell = p.cell))"""
    ORACLES["kb_search_ivf"] = with_adapters("""
SELECT query_id, rank, id, round(similarity, 4) AS similarity FROM found WHERE rank <= 10""", "ke", extra=ivf)
    ORACLES["kb_search_ivf_recall"] = with_adapters("""
SELECT e.query_id, COUNT(f.id) / COUNT(*) AS recall
FROM (SELECT query_id, id FROM ranked WHERE rank <= 10) e
LEFT JOIN (SELECT query_id, id FROM found WHERE rank <= 10) f ON f.query_id = e.query_id AND f.id = e.id
GROUP BY e.query_id""", "ke", extra=ivf)

    # lists split by their rows with the smallest md5 of the id, in rounds; a query goes down with the nearest nodes
    from ledgerline.plans.fixture_params import LIST_BEAM, LIST_FANOUT, LIST_ROWS
    levels = 3
    dot = "list_cosine_similarity"
    steps = ["""
u AS (SELECT id, CAST(embedding AS DOUBLE[]) AS v FROM ke
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l0 AS (SELECT id, v, 'r' AS cell FROM u)"""]
    for i in range(levels):
        steps.append(f"""
n{i} AS (SELECT cell AS parent, cell || '/' || (p - 1) AS node, p, v AS center FROM (
  SELECT *, row_number() OVER (PARTITION BY cell ORDER BY md5(CAST(id AS VARCHAR)), id) AS p,
         count(*) OVER (PARTITION BY cell) AS n FROM l{i})
  WHERE n > {LIST_ROWS} AND p <= {LIST_FANOUT} AND p <= ceil(n / {LIST_ROWS}::DOUBLE)),
l{i + 1} AS (SELECT id, v, cell FROM l{i} WHERE cell NOT IN (SELECT parent FROM n{i})
  UNION ALL SELECT id, v, node FROM (
    SELECT l.id, l.v, n.node, row_number() OVER (PARTITION BY l.id ORDER BY {dot}(l.v, n.center) DESC, n.p) AS best
    FROM l{i} l JOIN n{i} n ON n.parent = l.cell) WHERE best = 1)""")
    steps.append("\nnodes AS (" + " UNION ALL ".join(f"SELECT parent, node, center FROM n{i}" for i in range(levels)) + ")")
    steps.append("""
q AS (SELECT CAST(id AS VARCHAR) AS query_id, v AS qv FROM u WHERE id % 50 = 0),
f0 AS (SELECT query_id, qv, 'r' AS cell, 0.0::DOUBLE AS near FROM q)""")
    for i in range(levels):
        steps.append(f"""
f{i + 1} AS (SELECT query_id, qv, cell, near FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY near DESC, cell) AS place FROM (
    SELECT query_id, qv, cell, near FROM f{i} WHERE cell NOT IN (SELECT parent FROM nodes)
    UNION ALL SELECT f.query_id, f.qv, n.node, {dot}(f.qv, n.center) FROM f{i} f JOIN nodes n ON n.parent = f.cell))
  WHERE place <= {LIST_BEAM})""")
    steps.append(f"""
found AS (SELECT query_id, id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM (
  SELECT f.query_id, l.id, {dot}(f.qv, l.v) AS similarity FROM f{levels} f JOIN l{levels} l ON l.cell = f.cell)),
exact AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM (
  SELECT q.query_id, u.id, {dot}(q.qv, u.v) AS similarity FROM q, u))""")
    tree = ",".join(steps)
    ORACLES["kb_search_lists"] = with_adapters("""
SELECT query_id, rank, id, round(similarity, 4) AS similarity FROM found WHERE rank <= 10""", "ke", extra=tree)
    ORACLES["kb_search_lists_recall"] = with_adapters("""
SELECT e.query_id, COUNT(f.id) / COUNT(*) AS recall
FROM (SELECT query_id, id FROM exact WHERE rank <= 10) e
LEFT JOIN (SELECT query_id, id FROM found WHERE rank <= 10) f ON f.query_id = e.query_id AND f.id = e.id
GROUP BY e.query_id""", "ke", extra=tree)


_vector_oracles()
