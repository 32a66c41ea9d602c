"""Hand-written cases for the semantic traps and script quirks."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from ledgerline.functions.core import pct, round_int
from ledgerline.operators import analytics as A
from ledgerline.operators import transforms as T
from ledgerline.operators import writes as W


def one(spark, **cols):
    return spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols))


def test_round_int_rounds_half_away_from_zero(spark):
    r = spark.createDataFrame([(2.5,), (3.5,), (-2.5,), (2.4,)], "x double").select(round_int("x").alias("y"))
    assert [x.y for x in r.collect()] == [3, 4, -3, 2]


def test_snapshot_sums_revenue_beyond_four_bytes(spark):
    regs = spark.sql("""SELECT timestamp_ntz'2024-01-20 00:00:00' AS registration_date, 'CONFIRMED' AS status,
                        CAST(1500000000.50 AS DECIMAL(12,2)) AS amount_paid FROM range(3)""")
    students = spark.sql("SELECT timestamp_ntz'2024-01-20 00:00:00' AS created_at")
    r = A.snapshot_30d(regs, students, "2024-01-31 00:00:00").first()
    assert (r.revenue_30d, r.new_students_30d) == (4_500_000_002, 1)
    assert r.snapshot_text == "Database Snapshot: 30-day Revenue EGP 4,500,000,002, 30-day New Students 1"


def test_pct_is_null_on_zero_denominator(spark):
    r = spark.createDataFrame([(1, 0), (1, 3)], "a long, b long").select(pct("a", "b").alias("p")).collect()
    assert r[0].p is None and r[1].p == 33.33


@pytest.mark.parametrize("total_price, expected", [
    ({"value": "EGP 600"}, 600.0),
    ({"value": "1.2.3"}, 1.2),
    ({"value": "EGP. 600"}, 0.6),
    ({"value": "."}, None),            # parseFloat('.') is NaN
    ({"value": "free"}, 0.0),          # nothing left after stripping
    ({"value": 250.5}, 250.5),
    ({"value": 0}, 0.0),
    ({"value": None}, 0.0),
    ({"value": True}, 0.0),
    ({}, 0.0),
    ("EGP 600", 0.0),                  # 'value' in <string> throws; the catch sets 0.0
    (600, 0.0),
    (None, 0.0),
])
def test_booking_price_shapes(spark, total_price, expected):
    b = {"id": "b1", "contactId": "c1", "priceInfo": {"totalPrice": total_price}}
    df = spark.createDataFrame([(json.dumps(b),)], "payload string")
    got = T.parse_bookings(df, "2024-01-31 00:00:00").first().amount_paid
    assert got == expected


def test_booking_identity_and_defaults(spark):
    rows = [json.dumps({"id": "b1", "contactDetails": {"email": "  A@B.COM ", "firstName": "Ann"}}),
            json.dumps({"id": "b2", "contactDetails": {"lastName": "Lee"}}),
            json.dumps({"contactId": "c3", "contactDetails": {}})]
    df = spark.createDataFrame([(r,) for r in rows], "payload string")
    out = {r.wix_contact_id: r for r in T.parse_bookings(df, "2024-01-31 00:00:00").collect()}
    assert set(out) == {"a@b.com", "c3"}                      # b2 has no identity: dropped
    assert out["a@b.com"].full_name == "Ann" and out["a@b.com"].status == "CONFIRMED"
    assert out["c3"].full_name == "Guest" and out["c3"].wix_booking_id == ""
    assert out["c3"].registration_date == "2024-01-31T00:00:00.000Z"


def test_service_defaults(spark):
    rows = [json.dumps({"id": "s1", "info": {"name": "Lathe"}, "schedule": {"availabilityConstraints": {
        "sessionDurations": [0, 90]}}}), json.dumps({"name": "", "type": ""})]
    df = spark.createDataFrame([(r,) for r in rows], "payload string")
    a, b = T.parse_services(df).orderBy(F.desc("wix_id")).collect()
    assert (a.title, a.duration, a.service_type, a.status) == ("Lathe", None, "BOOKING_SERVICE", "ACTIVE")
    assert (b.wix_id, b.title) == ("", "Unknown Service")


@pytest.mark.parametrize("body, intent", [
    ("Please DELETE my data", "DELETE"),      # also contains "my data": delete wins
    ("what is my data", "ACCESS"),
    ("stopped by", "OPTOUT"),                 # substring match inside words
    ("hello", "unknown"),
])
def test_rights_intent_order(spark, body, intent):
    p = {"entry": [{"changes": [{"value": {"messages": [{"from": "1", "text": {"body": body}}]}}]}]}
    df = spark.createDataFrame([(json.dumps(p),)], "payload string")
    assert T.rights_intent(df).first().intent == intent


def test_rights_intent_contact_fallback(spark):
    p = {"entry": [{"changes": [{"value": {"contacts": [{"wa_id": "77"}], "messages": [{"text": {"body": "x"}}]}}]}]}
    df = spark.createDataFrame([(json.dumps(p),), ("not json",)], "payload string")
    got = [r.phone for r in T.rights_intent(df).collect()]
    assert sorted(got) == ["", "77"]


def test_parse_rewrite_failures_and_strict_greeting(spark):
    rows = [("not json", "en"), ('{"rewritten_query":"x","is_greeting":"true"}', None), (None, None),
            ('{"is_greeting":true,"detected_language":"ar"}', "en")]
    df = spark.createDataFrame(rows, "response_text string, request_language string")
    out = T.parse_rewrite(df).collect()
    assert (out[0].rewritten_query, out[0].detected_language, out[0].intent) == ("REWRITE_FAILED", "unknown", "general")
    assert (out[1].rewritten_query, out[1].is_greeting, out[1].detected_language) == ("x", False, "auto")
    assert (out[2].rewritten_query, out[2].detected_language) == ("REWRITE_FAILED", "auto")
    assert (out[3].is_greeting, out[3].detected_language) == (True, "ar")


def test_extract_technique_fallback_and_embedding_text(spark):
    raw = "w" * 700
    rows = [("no json", raw), ('pre {"technique_name":"T","region":null,"category":"Inlay"} post', "r"),
            ('{"technique_name": broken}', "short")]
    df = spark.createDataFrame(rows, "response_text string, raw_text string")
    t = T.embedding_text(T.extract_technique(df)).collect()
    assert t[0].technique_name == "Unknown (extraction pending)" and t[0].description == "w" * 500
    assert t[0].embed_text == "Unknown (extraction pending) " + "w" * 500 + " other None"
    assert t[1].extracted and t[1].embed_text == "T  Inlay None"     # absent description -> ''
    assert not t[2].extracted
    n = T.normalize_technique(T.extract_technique(df)).collect()
    assert [r.category for r in n] == ["other", "inlay", "other"]


def test_risk_level_first_word(spark):
    df = spark.createDataFrame([("critical (likely)",), ("Rare",), ("",), ("extinct",), (None,)],
                               "risk_level string").select(
        "risk_level", F.lit("x").alias("category"), F.lit(None).cast("string").alias("artisan_name"))
    got = [r.risk_level for r in T.normalize_technique(df).collect()]
    assert got == ["critical", "rare", "unknown", "unknown", "unknown"]


def test_keyed_merge_first_insert_last_update_and_null_keys(spark):
    t0 = dt.datetime(2024, 1, 1)
    batch = spark.createDataFrame([
        (1, "k", "m1", "d1", t0), (2, "k", "m2", "d2", t0 + dt.timedelta(hours=1)),
        (3, None, "m3", "d3", t0), (4, None, "m4", "d4", t0)],
        "id long, customer_message_wamid string, customer_message string, ai_proposed_response string, "
        "created_at timestamp_ntz").withColumn("customer_wa_id", F.lit("c")).withColumn(
        "customer_name", F.lit("n")).withColumn(
        "ai_responded_at", F.col("created_at"))
    out = W.upsert_drafts(None, batch).orderBy("id").collect()
    assert [(r.id, r.customer_message, r.ai_proposed_response) for r in out] == [
        (1, "m1", "d2"), (3, "m3", "d3"), (4, "m4", "d4")]
    again = W.upsert_drafts(W.upsert_drafts(None, batch.where("id = 1")), batch.where("id > 1"))
    assert again.orderBy("id").collect() == W.upsert_drafts(None, batch).orderBy("id").collect()


def test_service_upsert_keeps_type_and_status(spark):
    a = spark.createDataFrame([(1, "s1", "A", "T1", "ACTIVE", 0.0, 60, "c")],
                              "pos long, wix_id string, title string, service_type string, status string, "
                              "price double, duration int, category string")
    b = a.selectExpr("2 AS pos", "wix_id", "'B' AS title", "'T2' AS service_type", "'OFF' AS status", "price",
                     "90 AS duration", "category")
    r = W.upsert_services(W.upsert_services(None, a, "2024-01-01 00:00:00"), b, "2024-01-02 00:00:00").first()
    assert (r.title, r.service_type, r.status, r.duration_minutes) == ("B", "T1", "ACTIVE", 90)
    assert r.synced_at == dt.datetime(2024, 1, 2)


def test_service_upsert_aborts_on_missing_key(spark):
    a = spark.createDataFrame([(1, None, "A", "T1", "ACTIVE", 0.0, 60, "c")],
                              "pos long, wix_id string, title string, service_type string, status string, "
                              "price double, duration int, category string")
    with pytest.raises(Exception, match="batch aborted"):
        W.upsert_services(None, a, "2024-01-01 00:00:00").collect()


def test_insert_metrics_modes(spark):
    d = dt.date(2024, 1, 1)
    tgt = spark.createDataFrame([(d, "ga4", "sessions", 1.0)], "log_date date, platform string, metric_name string, "
                                                               "metric_value double")
    batch = spark.createDataFrame([(d, "ga4", "sessions", 2.0), (d, "ga4", "activeUsers", 3.0)], tgt.schema)
    assert W.insert_metrics(tgt, batch, mode="ignore").count() == 2
    with pytest.raises(Exception, match="duplicate key"):
        W.insert_metrics(tgt, batch, mode="error").collect()
    fresh = batch.where("metric_name = 'activeUsers'")
    assert W.insert_metrics(tgt, fresh, mode="error").count() == 2


def test_validate_rows_reasons(spark):
    df = spark.createDataFrame([(1, "web", "s", "hi", 5), (2, "fax", None, "", 9), (3, None, "s", "x" * 1001, None)],
                               "id long, channel string, sender_id string, original_message string, "
                               "customer_feedback int")
    got = {r.id: r.reasons for r in W.validate_rows(df).collect()}
    assert got == {1: "", 2: "channel_domain,sender_null,message_length,feedback_range",
                   3: "channel_null,message_length"}


def test_json_quote_matches_python(spark):
    from ledgerline.functions.core import json_quote
    vals = ['a"b', "back\\slash", "line\nbreak", None, ""]
    df = spark.createDataFrame([(v,) for v in vals], "v string").select(json_quote("v").alias("q"))
    assert [r.q for r in df.collect()] == [json.dumps(v) for v in vals]


def test_epoch_micros_ignores_session_zone(spark):
    from ledgerline.functions.core import epoch_micros
    df = spark.createDataFrame([(dt.datetime(2024, 3, 10, 12, 30, 15, 250),)], "t timestamp_ntz")
    want = int((dt.datetime(2024, 3, 10, 12, 30, 15, 250) - dt.datetime(1970, 1, 1)).total_seconds() * 1e6)
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/Los_Angeles", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert df.select(epoch_micros("t").alias("m")).first().m == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_daily_trends_approximate_is_close(spark):
    from ledgerline.operators.analytics import daily_trends
    from ledgerline.sources import adapters as ad
    from ledgerline.sources.tables import Catalog
    conv = ad.concierge_conversations(Catalog(spark, "/root/testdata/sf0.01"))
    exact = {r.conversation_date: r.unique_customers for r in daily_trends(conv).collect()}
    approx = {r.conversation_date: r.unique_customers for r in daily_trends(conv, approximate=True).collect()}
    assert exact.keys() == approx.keys()
    assert all(abs(approx[d] - exact[d]) <= 0.05 * exact[d] + 1 for d in exact)


def test_recent_movements_widens_past_unknown_items(spark):
    from ledgerline.operators.analytics import recent_movements
    t0 = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(300):
        item = 1 if i % 50 == 0 else 999          # only every 50th movement has a known item
        rows.append((i, 1, 1, item, "purchase", 1.0, None, t0 + dt.timedelta(minutes=i), None))
    mv = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_suppkey long, item_id long, "
                                     "movement_type string, quantity double, notes string, "
                                     "created_at timestamp_ntz, created_by string")
    items = spark.createDataFrame([(1, "glue", "pcs")], "id long, name string, unit string")
    got = [r.l_orderkey for r in recent_movements(mv, items, n=5).collect()]
    assert got == [250, 200, 150, 100, 50]
    got_all = [r.l_orderkey for r in recent_movements(mv, items, n=10).collect()]
    assert got_all == [250, 200, 150, 100, 50, 0]          # fewer than n exist: all of them


def test_recent_movements_joins_all_when_nearly_all_items_are_unknown(spark, monkeypatch):
    from ledgerline.operators import analytics as A
    monkeypatch.setattr(A, "MOST_CANDIDATES", 10)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, 1, 1, 1 if i < 3 else 999, "purchase", 1.0, None, t0 + dt.timedelta(minutes=i), None, "x") for i in range(200)]
    mv = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_suppkey long, item_id long, movement_type string, "
                                     "quantity double, notes string, created_at timestamp_ntz, created_by string, unit string")
    items = spark.createDataFrame([(1, "glue", "pcs"), (1, "paste", "kg")], "id long, name string, unit string")
    got = [(r.l_orderkey, r.unit) for r in A.recent_movements(mv, items, n=2).collect()]
    assert [k for k, _ in got] == [2, 2] and {u for _, u in got} == {"pcs", "kg"}
    assert A.recent_movements(mv.limit(0), items, n=2).count() == 0


def _services_and_bookings(spark, ids):
    svc = spark.createDataFrame([(i,) for i in ids], "wix_id string")
    every = spark.createDataFrame([("c1",), ("",), ("c2",)], "wix_contact_id string")
    return svc, every, every.where("wix_contact_id <> ''")


def test_sync_summary_status_follows_the_write(spark):
    svc, every, sent = _services_and_bookings(spark, ["a", "b"])
    ok = T.sync_summary(svc, every, T.sync_result(svc, sent), "2024-01-01 00:00:00").first()
    assert (ok.status, ok.services_synced, ok.bookings_synced, ok.bookings_total_in_wix, ok.error) == ("SUCCESS", 2, 2, 3, None)
    assert T.sync_run(svc, every, "2024-01-01 00:00:00").first() == ok
    total = spark.createDataFrame([(250,)], "total long")
    for ids in (["a", ""], ["a", None]):
        svc, every, sent = _services_and_bookings(spark, ids)
        bad = T.sync_summary(svc, every, T.sync_result(svc, sent), "2024-01-01 00:00:00", total).first()
        assert (bad.status, bad.services_synced, bad.bookings_synced, bad.bookings_total_in_wix) == ("PARTIAL", 2, 2, 250)
        assert bad.error and bad.synced_at == dt.datetime(2024, 1, 1)
        assert T.sync_run(svc, every, "2024-01-01 00:00:00", total).first() == bad


def test_ga4_malformed_date_does_not_stop_the_job(spark):
    vals = '"metricValues":[{"value":"1"},{"value":"2"}]'
    df = spark.createDataFrame([(f'{{"date":"20240230",{vals}}}',), (f'{{"date":"x",{vals}}}',),
                                (f'{{"date":"20240228",{vals}}}',)], "payload string")
    got = [r.log_date for r in T.ga4_metrics(df).collect()]
    assert sorted((str(d) for d in got)) == ["2024-02-28"] * 2 + ["None"] * 4


def test_access_report_for_a_requester_without_rows(spark):
    intents = spark.createDataFrame([("1", "ACCESS"), ("2", "STOP")], "phone string, intent string")
    conv = spark.createDataFrame([], "id long, sender_id string, created_at timestamp_ntz, intent_detected string, "
                                     "original_message string")
    row = T.rights_access_report(intents, conv).collect()
    assert [(r.phone, r.message_count, r.summary) for r in row] == [("1", 0, T.NO_DATA_TEXT)]


def test_update_rows_touches_only_what_changes(spark):
    t0 = dt.datetime(2024, 1, 1)
    target = spark.createDataFrame([(1, 5, t0), (2, None, t0), (3, 4, t0)], "id long, customer_feedback int, updated_at timestamp_ntz")
    changes = spark.createDataFrame([(1, 1, 2), (2, 1, 5), (3, 9, 1), (4, None, 1), (5, 2, None)],
                                    "seq long, id long, customer_feedback int")
    got = {r.id: (r.customer_feedback, r.updated_at) for r in W.update_rows(target, changes, "2024-02-01 00:00:00").collect()}
    t1 = dt.datetime(2024, 2, 1)
    assert got == {1: (5, t1), 2: (None, t1), 3: (4, t0)}


def test_seeded_rules_only_if_absent(spark):
    seeds = W.cost_rules_frame(spark, "svc")
    have = seeds.where("rule_name = 'Daily spend alert'").withColumn("is_enabled", F.lit(False))
    got = {r.rule_name: r.is_enabled for r in W.seed_rules(have, seeds).collect()}
    assert len(got) == 4 and got["Daily spend alert"] is False and sum(got.values()) == 3
    assert W.seed_rules(W.seed_rules(have, seeds), seeds).count() == 4


def test_interaction_and_submission_rules(spark):
    df = spark.createDataFrame([(1, "booking", "neutral", 5, "booked"), (2, "x", "y", 6, "z"), (3, None, None, None, None)],
                               "id long, interaction_type string, sentiment string, satisfaction_score int, outcome string")
    assert {r.id: r.reasons for r in W.validate_interactions(df).collect()} == {
        1: "", 2: "type_domain,sentiment_domain,satisfaction_range,outcome_domain", 3: ""}
    txt = spark.createDataFrame([(1, "abcde"), (2, "abcd"), (3, "x" * 3001), (4, None)], "id long, raw_text string")
    assert {r.id: r.reasons for r in W.validate_submissions(txt).collect()} == {1: "", 2: "text_length", 3: "text_length",
                                                                              4: "text_null"}


def test_rows_without_a_key_meet_in_no_aggregation(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = spark.range(200).select(
        F.col("id"), F.lit(None).cast("string").alias("customer_message_wamid"), F.lit("c").alias("customer_wa_id"),
        F.lit("n").alias("customer_name"), F.lit("m").alias("customer_message"), F.lit("d").alias("ai_proposed_response"),
        F.lit(t0).cast("timestamp_ntz").alias("created_at"), F.lit(t0).cast("timestamp_ntz").alias("ai_responded_at"))
    assert W.upsert_drafts(W.upsert_drafts(None, rows), rows).count() == 400
