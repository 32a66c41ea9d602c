"""Fixture adapters: the generated TPC-H-style tables re-shaped into the
business tables the operators are written against (students, registrations,
finance_transactions, concierge_conversations, ...).

Each adapter is one Spark SQL text over the catalog's tables (passed as
DataFrame parameters), so it is planned with the operator that consumes it:
column pruning and filter pushdown reach the parquet scan, and building it
costs one round trip instead of one per expression. The DuckDB twins used by
the oracle live in ``ledgerline.plans.oracles.ADAPTER_SQL``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ledgerline.sources.tables import Catalog

SQL = {
    "students": """
SELECT c.c_custkey AS id, c.c_name AS full_name,
       CASE WHEN c.c_custkey % 10 = 0 THEN NULL
            ELSE lower(c.c_mktsegment) || '.' || CAST(c.c_custkey AS STRING) || '@example.com' END AS email,
       '+2010' || lpad(CAST(c.c_custkey AS STRING), 8, '0') AS phone,
       o.last_order AS created_at
FROM {customer} c
LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last_order FROM {orders} GROUP BY o_custkey) o
  ON o.o_custkey = c.c_custkey""",
    "registrations": """
SELECT o_orderkey AS id, o_custkey - CASE WHEN o_custkey % 11 = 0 THEN 1 ELSE 0 END AS student_id,
       o_orderkey % 25 AS service_id,
       o_orderdate AS registration_date,
       CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(o_totalprice AS DECIMAL(12,2)) END AS amount_paid,
       o_orderpriority AS payment_method,
       CASE o_orderstatus WHEN 'F' THEN 'CONFIRMED' WHEN 'P' THEN 'PENDING' ELSE 'CANCELLED' END AS status
FROM {orders}""",
    "finance_transactions": """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate AS transaction_date,
       'order ' || CAST(l_orderkey AS STRING) AS description,
       CASE l_suppkey % 8 WHEN 0 THEN 'Materials' WHEN 1 THEN 'Equipment' WHEN 2 THEN 'Sales (Out)'
            WHEN 3 THEN 'Sales Out' WHEN 4 THEN 'Courses' WHEN 5 THEN 'Rent' WHEN 6 THEN '' ELSE NULL END AS category,
       CASE WHEN l_linestatus = 'O' AND l_linenumber % 3 = 0 THEN CAST(l_extendedprice AS DECIMAL(12,2)) ELSE CAST(0 AS DECIMAL(12,2)) END AS income_receivable,
       CASE WHEN l_linestatus = 'O' AND l_linenumber % 3 = 1 THEN CAST(l_extendedprice AS DECIMAL(12,2)) ELSE CAST(0 AS DECIMAL(12,2)) END AS income_cash,
       CASE WHEN l_tax > 0.075 THEN NULL
            WHEN l_linestatus = 'O' AND l_linenumber % 3 = 2 THEN CAST(l_extendedprice AS DECIMAL(12,2)) ELSE CAST(0 AS DECIMAL(12,2)) END AS income_bank,
       CASE WHEN l_linestatus = 'F' AND l_linenumber % 3 = 0 THEN CAST(l_extendedprice AS DECIMAL(12,2)) ELSE CAST(0 AS DECIMAL(12,2)) END AS expense_payable,
       CASE WHEN l_linestatus = 'F' AND l_linenumber % 3 = 1 THEN CAST(l_extendedprice AS DECIMAL(12,2)) ELSE CAST(0 AS DECIMAL(12,2)) END AS expense_cash,
       CASE WHEN l_linestatus = 'F' AND l_linenumber % 3 = 2 THEN CAST(l_extendedprice AS DECIMAL(12,2)) ELSE CAST(0 AS DECIMAL(12,2)) END AS expense_bank
FROM {lineitem}""",
    "inventory_items": """
SELECT p.p_partkey AS id, p.p_name || ' ' || CAST(p.p_partkey AS STRING) AS name, p.p_type AS category, 'pcs' AS unit,
       CAST(p.p_size AS DECIMAL(12,2)) AS current_stock, CAST(p.p_partkey % 12 AS DECIMAL(12,2)) AS minimum_stock,
       CAST(2 * (p.p_partkey % 12) AS DECIMAL(12,2)) AS reorder_point,
       CASE WHEN p.p_partkey % 9 = 0 THEN NULL ELSE CAST(p.p_retailprice AS DECIMAL(12,2)) END AS cost_per_unit,
       CASE WHEN p.p_partkey % 14 = 0 THEN NULL ELSE s.s_name END AS supplier
FROM {part} p LEFT JOIN {supplier} s ON s.s_suppkey = p.p_partkey % 10""",
    "stock_movements": """
SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey AS item_id,
       CASE l_linestatus WHEN 'O' THEN 'purchase' ELSE 'consumption' END AS movement_type,
       CAST(l_quantity AS DECIMAL(12,2)) AS quantity,
       CASE WHEN l_linenumber = 1 THEN NULL ELSE 'line ' || CAST(l_linenumber AS STRING) END AS notes,
       l_shipdate AS created_at,
       CASE WHEN l_linenumber % 2 = 0 THEN 'dashboard' ELSE NULL END AS created_by
FROM {lineitem}""",
    "concierge_conversations": """
SELECT event_id AS id,
       CAST(user_id AS STRING) || '-' || CAST(CAST(ts AS DATE) AS STRING) AS session_id,
       CASE event_id % 4 WHEN 0 THEN 'whatsapp' WHEN 1 THEN 'messenger' WHEN 2 THEN 'instagram' ELSE 'web' END AS channel,
       CAST(user_id AS STRING) AS sender_id,
       'msg ' || CAST(event_id AS STRING) AS original_message,
       CAST(NULL AS STRING) AS rewritten_query, CAST(NULL AS STRING) AS ai_response, CAST(NULL AS STRING) AS model_used,
       CASE event_type WHEN 'view' THEN 'schedule' WHEN 'click' THEN 'pricing' WHEN 'signup' THEN 'booking'
            WHEN 'purchase' THEN 'course_info' ELSE NULL END AS intent_detected,
       CASE WHEN event_id % 50 = 7 THEN NULL ELSE event_id % 9 = 0 END AS escalated,
       CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(floor(value * 10) AS INT) END AS response_time_ms,
       CASE WHEN event_id % 3 = 0 THEN CAST(1 + event_id % 5 AS INT) ELSE NULL END AS customer_feedback,
       props AS metadata, ts AS created_at
FROM {events}""",
    "ai_events": """
SELECT event_id AS id,
       CASE event_type WHEN 'purchase' THEN 'booking' WHEN 'signup' THEN 'booking' WHEN 'view' THEN 'recommendation'
            WHEN 'click' THEN 'decision' ELSE 'cost_alert' END AS event_type,
       CASE event_id % 5 WHEN 0 THEN 'agent_a' WHEN 1 THEN 'agent_b' WHEN 2 THEN 'agent_c' WHEN 3 THEN 'agent_d' ELSE NULL END AS agent_name,
       CASE event_id % 7 WHEN 3 THEN 'failure' WHEN 4 THEN 'escalated' WHEN 5 THEN 'retry_needed' WHEN 6 THEN NULL ELSE 'success' END AS outcome,
       CAST(event_id % 101 AS DECIMAL(5,2)) AS success_metric,
       CASE WHEN event_id % 29 = 0 THEN NULL ELSE CAST(value AS DECIMAL(10,2)) END AS cost_cents,
       CAST(floor(value * 10) AS INT) AS latency_ms, ts AS created_at
FROM {events}""",
    "knowledge_embeddings": """
SELECT vec_id AS id, 'q ' || CAST(vec_id AS STRING) AS question, 'a ' || CAST(vec_id AS STRING) AS answer,
       CAST(label AS STRING) AS category, CAST(vec_id % 11 AS DOUBLE) / 10 AS confidence,
       CASE WHEN vec_id % 37 = 0 THEN NULL ELSE embedding END AS embedding
FROM {embeddings}""",
    "ga4_payload": """
SELECT '{{"date":"' || replace(CAST(CAST(ts AS DATE) AS STRING), '-', '') || '","metricValues":[{{"value":"'
       || CAST(count(DISTINCT user_id) AS STRING) || '"}}'
       || CASE WHEN extract(DAY FROM min(ts)) = 13 THEN '' ELSE ',{{"value":"' || CAST(count(*) AS STRING) || '"}}' END
       || ']}}' AS payload
FROM {events} GROUP BY CAST(ts AS DATE)""",
    "booking_payload": """
SELECT o_orderkey, '{{"id":"b' || CAST(o_orderkey AS STRING) || '"'
       || CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE ',"contactId":"' || CAST(o_custkey AS STRING) || '"' END
       || ',"contactDetails":{{'
       || CASE WHEN o_orderkey % 8 = 0 THEN '"lastName":"L"' ELSE '"firstName":"F' || CAST(o_custkey AS STRING) || '","email":" U' || CAST(o_custkey AS STRING) || '@Example.COM "' END
       || '}},"priceInfo":{{"totalPrice":'
       || CASE o_orderkey % 3 WHEN 0 THEN '{{"value":"EGP ' || CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS STRING) || '"}}'
               WHEN 1 THEN '{{"value":' || CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS STRING) || '}}'
               ELSE '"EGP 600"' END
       || '}},"createdDate":"' || CAST(CAST(o_orderdate AS DATE) AS STRING) || '"'
       || CASE WHEN o_orderstatus = 'P' THEN '' ELSE ',"status":"' || o_orderstatus || '"' END || '}}' AS payload
FROM {orders}""",
    "rights_message": """
SELECT conv_id, turn, '{{"entry":[{{"changes":[{{"value":{{"messages":[{{"from":"' || CAST(conv_id % 150 AS STRING) || '","text":{{"body":"'
       || CASE (conv_id + turn) % 5 WHEN 0 THEN ' Please DELETE my data' WHEN 1 THEN 'show my data' WHEN 2 THEN 'STOP'
               WHEN 3 THEN 'احذف بياناتي' ELSE 'hello' END
       || '"}}}}]}}}}]}}]}}' AS payload
FROM {conversations} WHERE role = 'user'""",
    "extraction_response": """
SELECT doc_id, text AS raw_text, source AS submission_channel,
       CASE doc_id % 6
         WHEN 0 THEN 'no json here'
         WHEN 1 THEN 'x {{"technique_name": broken}} y'
         WHEN 2 THEN '```json {{"technique_name":"T' || CAST(doc_id AS STRING) || '","artisan_name":"","region":null,"category":" Carving ","materials":["oak","ash"],"tools":[],"description":"d","risk_level":"critical (likely disappearing)"}} ```'
         WHEN 3 THEN '{{"technique_name":"T' || CAST(doc_id AS STRING) || '","artisan_name":"A","region":"' || lang || '","category":"pottery","materials":["walnut"],"tools":["lathe"],"description":"d","risk_level":"Rare"}}'
         WHEN 4 THEN '{{"technique_name":"T' || CAST(doc_id AS STRING) || '","category":"inlay","materials":[],"tools":["saw","file"],"description":"d","risk_level":""}}'
         ELSE '{{"technique_name":"T' || CAST(doc_id AS STRING) || '","category":"joinery","materials":["oak"],"tools":["saw"],"description":"d","risk_level":"extinct"}}'
       END AS response_text
FROM {documents}""",
    "shadow_event": """
SELECT event_id, CASE WHEN event_id % 37 = 5 THEN NULL ELSE CAST(user_id AS STRING) END AS customer_wa_id,
       CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'N' || CAST(user_id AS STRING) END AS customer_name,
       CASE WHEN event_type IN ('view','click','error') THEN 'draft' ELSE 'reply' END AS kind,
       'text ' || CAST(event_id AS STRING) AS text,
       CAST(CASE WHEN event_id % 23 = 0 THEN NULL WHEN event_id % 4 = 3 THEN event_id - 1 ELSE event_id END AS STRING) AS wamid,
       CASE WHEN event_id % 53 = 11 THEN NULL ELSE ts END AS created_at
FROM {events}""",
    "service_payload": """
SELECT p_partkey AS pos, '{{"id":"' || CASE WHEN p_partkey % 40 = 39 THEN '' ELSE 's' || CAST(p_partkey % 150 AS STRING) END || '"'
       || CASE p_partkey % 3 WHEN 0 THEN ',"name":"' || p_name || '"' WHEN 1 THEN ',"info":{{"name":"' || p_name || '"}}' ELSE '' END
       || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE ',"type":"' || p_type || '"' END
       || CASE WHEN p_partkey % 2 = 0 THEN ',"category":{{"name":"' || p_brand || '"}},"schedule":{{"availabilityConstraints":{{"sessionDurations":[' || CAST(p_size AS STRING) || ',90]}}}}' ELSE '' END
       || '}}' AS payload
FROM {part}""",
    "rating": """
SELECT event_id AS seq, event_id - event_id % 3 AS shadow_id,
       CASE event_id % 7 WHEN 0 THEN 'better' WHEN 1 THEN 'similar' WHEN 2 THEN 'worse' WHEN 3 THEN 'great' ELSE 'similar' END AS quality_rating,
       CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'n' || CAST(event_id AS STRING) END AS notes, ts AS created_at
FROM {events} WHERE event_type = 'click'""",
    "conversation_pair": """
SELECT u.conv_id, u.turn, CAST(u.conv_id AS STRING) AS customer_wa_id,
       CASE WHEN u.conv_id % 2 = 0 THEN NULL ELSE 'N' || CAST(u.conv_id AS STRING) END AS customer_name,
       'batch ' || CAST(u.conv_id % 10 AS STRING) AS batch_name,
       CASE WHEN (u.conv_id + u.turn) % 9 = 0 THEN '   ' ELSE u.text END AS customer_message,
       a.text AS staff_reply, CASE WHEN u.conv_id % 3 = 0 THEN '' ELSE 'export' END AS source
FROM {conversations} u
LEFT JOIN {conversations} a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
WHERE u.role = 'user'""",
    "usage_request": """
SELECT event_id, CASE WHEN event_id % 60 = 1 THEN -1 ELSE user_id % 50 END AS item_id,
       CAST(event_id % 6 AS DECIMAL(12,2)) AS quantity, ts AS created_at
FROM {events}""",
    "setting_change": """
SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'ai_concierge_mode' ELSE 'k' || CAST(user_id % 20 AS STRING) END AS key,
       CASE event_id % 5 WHEN 0 THEN 'active' WHEN 1 THEN 'paused' WHEN 2 THEN 'off' WHEN 3 THEN 'active' ELSE 'paused' END AS value,
       ts AS created_at
FROM {events}""",
    "rewrite_response": """
SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN NULL ELSE 'en' END AS request_language,
       CASE (conv_id + turn) % 5
         WHEN 0 THEN '{{"rewritten_query":"course pricing","is_greeting":false,"detected_language":"ar","intent":"pricing"}}'
         WHEN 1 THEN '{{"rewritten_query":"GREETING_ONLY","is_greeting":true}}'
         WHEN 2 THEN 'not json'
         WHEN 3 THEN '{{"rewritten_query":"","is_greeting":"true","intent":""}}'
         ELSE NULL END AS response_text
FROM {conversations} WHERE role = 'user'""",
    "tier_response": """
SELECT doc_id AS request_id, CASE WHEN doc_id % 3 = 0 THEN text ELSE NULL END AS primary_text,
       CASE WHEN doc_id % 2 = 0 THEN 'fallback: ' || lang ELSE NULL END AS fallback_text
FROM {documents}""",
    "unchecked_conversations": """
SELECT event_id AS id,
       CASE event_id % 6 WHEN 0 THEN 'whatsapp' WHEN 1 THEN 'messenger' WHEN 2 THEN 'instagram' WHEN 3 THEN 'web'
            WHEN 4 THEN 'fax' ELSE NULL END AS channel,
       CASE WHEN event_id % 31 = 0 THEN NULL ELSE CAST(user_id AS STRING) END AS sender_id,
       CASE WHEN event_id % 17 = 0 THEN '' WHEN event_id % 19 = 0 THEN repeat('x', 1001) ELSE 'msg' END AS original_message,
       CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(event_id % 7 AS INT) END AS customer_feedback
FROM {events}""",
    "unchecked_interactions": """
SELECT event_id AS id,
       CASE event_type WHEN 'view' THEN 'question' WHEN 'click' THEN 'booking' WHEN 'signup' THEN 'feedback'
            WHEN 'purchase' THEN 'other' WHEN 'error' THEN 'complaint' ELSE event_type END
         || CASE WHEN event_id % 23 = 0 THEN '?' ELSE '' END AS interaction_type,
       CASE event_id % 5 WHEN 0 THEN 'positive' WHEN 1 THEN 'neutral' WHEN 2 THEN 'negative' WHEN 3 THEN 'angry' ELSE NULL END AS sentiment,
       CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(event_id % 8 AS INT) END AS satisfaction_score,
       CASE event_id % 7 WHEN 0 THEN 'resolved' WHEN 1 THEN 'escalated' WHEN 2 THEN 'booked' WHEN 3 THEN 'follow_up'
            WHEN 4 THEN 'other' WHEN 5 THEN 'lost' ELSE NULL END AS outcome
FROM {events}""",
    "feedback_change": """
SELECT event_id AS seq, event_id - event_id % 4 AS id, CAST(1 + user_id % 5 AS INT) AS customer_feedback
FROM {events} WHERE event_type = 'click'""",
}

# source tables each adapter reads
_SOURCES = {
    "students": ("customer", "orders"), "registrations": ("orders",), "finance_transactions": ("lineitem",),
    "inventory_items": ("part", "supplier"), "stock_movements": ("lineitem",),
    "concierge_conversations": ("events",), "ai_events": ("events",), "knowledge_embeddings": ("embeddings",),
    "ga4_payload": ("events",), "booking_payload": ("orders",), "rights_message": ("conversations",),
    "extraction_response": ("documents",), "shadow_event": ("events",), "service_payload": ("part",),
    "rating": ("events",), "conversation_pair": ("conversations",), "usage_request": ("events",),
    "setting_change": ("events",), "rewrite_response": ("conversations",), "tier_response": ("documents",),
    "unchecked_conversations": ("events",), "unchecked_interactions": ("events",), "feedback_change": ("events",),
}


def adapt(cat: Catalog, name: str) -> DataFrame:
    """The adapter ``name`` over the catalog's tables (batch or streaming)."""
    return cat.spark.sql(SQL[name], **{t: cat[t] for t in _SOURCES[name]})


def _make(name: str):
    def fn(cat: Catalog) -> DataFrame:
        return adapt(cat, name)
    fn.__name__ = name
    fn.__doc__ = f"Adapter: {name} (see SQL['{name}'])."
    return fn


students = _make("students")
registrations = _make("registrations")
finance_transactions = _make("finance_transactions")
inventory_items = _make("inventory_items")
stock_movements = _make("stock_movements")
concierge_conversations = _make("concierge_conversations")
ai_events = _make("ai_events")
knowledge_embeddings = _make("knowledge_embeddings")
ga4_payload = _make("ga4_payload")
booking_payload = _make("booking_payload")
rights_message = _make("rights_message")
extraction_response = _make("extraction_response")
shadow_event = _make("shadow_event")
service_payload = _make("service_payload")
rating = _make("rating")
conversation_pair = _make("conversation_pair")
usage_request = _make("usage_request")
setting_change = _make("setting_change")
rewrite_response = _make("rewrite_response")
tier_response = _make("tier_response")
unchecked_conversations = _make("unchecked_conversations")
unchecked_interactions = _make("unchecked_interactions")
feedback_change = _make("feedback_change")
