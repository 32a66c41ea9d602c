"""Sequential operators against literal Python replays on random inputs."""

import datetime as dt
import random
from collections import defaultdict

import pytest

from ledgerline.operators import stateful as X

T0 = dt.datetime(2024, 1, 1)


def _replay_replies(events, hours=24):
    """The source behaviour, one event at a time: a reply takes the newest
    unanswered draft of its customer created strictly within the last `hours`."""
    open_drafts = defaultdict(list)
    match = {}
    for eid, cust, kind, t in sorted(events, key=lambda e: (e[3], e[0])):
        if kind == "draft":
            open_drafts[cust].append((t, eid))
            continue
        live = [d for d in open_drafts[cust] if d[0] > t - dt.timedelta(hours=hours)]
        if live:
            best = max(live)
            open_drafts[cust].remove(best)
            match[eid] = best[1]
        else:
            match[eid] = None
    return match


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_match_replies_equals_replay(spark, seed):
    rnd = random.Random(seed)
    events = []
    for i in range(600):
        t = T0 + dt.timedelta(minutes=rnd.randint(0, 60 * 24 * 6))
        events.append((i, f"c{rnd.randint(0, 6)}", rnd.choice(["draft", "draft", "reply"]), t))
    ev = spark.createDataFrame(events, "id long, customer_wa_id string, kind string, created_at timestamp_ntz")
    drafts = ev.where("kind = 'draft'").drop("kind")
    replies = ev.where("kind = 'reply'").drop("kind").selectExpr("*", "'r' AS reply_text", "'t' AS capture_source")
    out = X.match_replies(drafts, replies).collect()
    want = _replay_replies(events)
    got = {}
    reply_ids = {e[0] for e in events if e[2] == "reply"}
    matched_drafts = {r.id: r.human_replied_at for r in out if r.id not in reply_ids and r.human_reply}
    standalone = {r.id for r in out if r.id in reply_ids}
    for rid in reply_ids:
        got[rid] = None if rid in standalone else "matched"
    assert {k: (v is not None) for k, v in want.items()} == {k: (v is not None) for k, v in got.items()}
    assert len(matched_drafts) == sum(v is not None for v in want.values())
    assert set(matched_drafts) == {v for v in want.values() if v is not None}


def _replay_rate(reqs, limit, window):
    acc = defaultdict(list)
    out = {}
    for eid, client, t in sorted(reqs, key=lambda r: (r[1], r[2], r[0])):
        live = [a for a in acc[client] if (t - a).total_seconds() < window]
        if len(live) < limit:
            live.append(t)
            out[eid] = "accept"
        else:
            out[eid] = "reject"
        acc[client] = live
    return out


def test_rate_verdicts_equal_replay(spark):
    rnd = random.Random(5)
    reqs = [(i, rnd.randint(0, 4), T0 + dt.timedelta(seconds=rnd.randint(0, 3600))) for i in range(800)]
    df = spark.createDataFrame(reqs, "event_id long, client long, created_at timestamp_ntz")
    got = {r.event_id: r.verdict for r in X.rate_verdicts(df, limit=5, window_seconds=120).collect()}
    assert got == _replay_rate(reqs, 5, 120)


def test_usage_log_equals_replay(spark):
    rnd = random.Random(9)
    stock = {i: rnd.randint(0, 30) for i in range(5)}
    reqs = [(i, rnd.choice([0, 1, 2, 3, 4, 99]), rnd.choice([0, 1, 2, 5, 7]),
             T0 + dt.timedelta(seconds=rnd.randint(0, 10 ** 5))) for i in range(700)]
    items = spark.createDataFrame([(k, float(v)) for k, v in stock.items()], "id long, current_stock double") \
        .selectExpr("id", "CAST(current_stock AS DECIMAL(12,2)) AS current_stock")
    r = spark.createDataFrame(reqs, "event_id long, item_id long, quantity int, created_at timestamp_ntz") \
        .selectExpr("event_id", "item_id", "CAST(quantity AS DECIMAL(12,2)) AS quantity", "created_at")
    got = {x.event_id: x.verdict for x in X.usage_log(r, items).collect()}
    left = dict(stock)
    want = {}
    for eid, item, q, _t in sorted(reqs, key=lambda x: (x[3], x[0])):
        if q <= 0:
            want[eid] = "invalid"
        elif item not in left:
            want[eid] = "not_found"
        elif left[item] >= q:
            left[item] -= q
            want[eid] = "accepted"
        else:
            want[eid] = "insufficient"
    assert got == want


@pytest.mark.parametrize("bucket_minutes", [1, 7, 100000])
def test_match_replies_hot_customer_any_bucket(spark, bucket_minutes):
    """One customer holds most events; chunk edges fall everywhere."""
    rnd = random.Random(bucket_minutes)
    events = []
    for i in range(900):
        t = T0 + dt.timedelta(minutes=rnd.randint(0, 60 * 24 * 4))
        cust = "hot" if rnd.random() < 0.8 else f"c{rnd.randint(0, 3)}"
        events.append((i, cust, rnd.choice(["draft", "reply", "draft", "reply", "reply"]), t))
    ev = spark.createDataFrame(events, "id long, customer_wa_id string, kind string, created_at timestamp_ntz")
    drafts = ev.where("kind = 'draft'").drop("kind")
    replies = ev.where("kind = 'reply'").drop("kind").selectExpr("*", "'r' AS reply_text", "'t' AS capture_source")
    out = X.match_replies(drafts, replies, bucket_minutes=bucket_minutes).collect()
    want = _replay_replies(events)
    reply_ids = {e[0] for e in events if e[2] == "reply"}
    standalone = {r.id for r in out if r.id in reply_ids}
    matched_drafts = {r.id for r in out if r.id not in reply_ids and r.human_reply}
    assert standalone == {k for k, v in want.items() if v is None}
    assert matched_drafts == {v for v in want.values() if v is not None}


def test_match_replies_adaptive_chunks(spark):
    """A tiny row target forces second-wide chunks; results must not change."""
    rnd = random.Random(11)
    events = []
    for i in range(700):
        t = T0 + dt.timedelta(seconds=rnd.randint(0, 3 * 24 * 3600))
        events.append((i, "hot" if rnd.random() < 0.9 else "c1", rnd.choice(["draft", "reply", "draft"]), t))
    ev = spark.createDataFrame(events, "id long, customer_wa_id string, kind string, created_at timestamp_ntz")
    drafts = ev.where("kind = 'draft'").drop("kind")
    replies = ev.where("kind = 'reply'").drop("kind").selectExpr("*", "'r' AS reply_text", "'t' AS capture_source")
    want = _replay_replies(events)
    reply_ids = {e[0] for e in events if e[2] == "reply"}
    for target in (3, 2_000_000):
        out = X.match_replies(drafts, replies, target_chunk_rows=target).collect()
        assert {r.id for r in out if r.id in reply_ids} == {k for k, v in want.items() if v is None}
        assert {r.id for r in out if r.id not in reply_ids and r.human_reply} == {v for v in want.values() if v}


def test_match_replies_keeps_rows_without_customer_or_time(spark):
    t = dt.datetime(2024, 1, 1)
    drafts = spark.createDataFrame([(1, "a", "A", t), (2, None, "B", t), (3, "a", None, None), (4, None, None, None)],
                                   "id long, customer_wa_id string, customer_name string, created_at timestamp_ntz")
    h = dt.timedelta(hours=1)
    replies = spark.createDataFrame([(10, "a", t + h, "r10", "t"), (11, None, t + h, "r11", "t"), (12, "a", None, "r12", "t")],
                                    "id long, customer_wa_id string, created_at timestamp_ntz, reply_text string, capture_source string")
    got = {r.id: (r.human_reply, r.customer_name) for r in X.match_replies(drafts, replies).collect()}
    assert got == {1: ("r10", "A"), 2: (None, "B"), 3: (None, None), 4: (None, None), 11: ("r11", None), 12: ("r12", None)}


def test_busy_hours_are_cut_for_their_customer_only(spark):
    rnd = random.Random(9)
    events = [(i, "busy" if i % 4 else f"c{i % 7}", rnd.choice(["draft", "reply"]),
               T0 + dt.timedelta(seconds=rnd.randint(0, 7200))) for i in range(900)]
    ev = spark.createDataFrame(events, "id long, customer_wa_id string, kind string, created_at timestamp_ntz")
    drafts = ev.where("kind = 'draft'").drop("kind")
    replies = ev.where("kind = 'reply'").drop("kind").selectExpr("*", "CAST(id AS STRING) AS reply_text", "'t' AS capture_source")
    out = X.match_replies(drafts, replies, target_chunk_rows=25).collect()
    reply_ids = {e[0] for e in events if e[2] == "reply"}
    got = {int(r.human_reply): r.id for r in out if r.id not in reply_ids and r.human_reply}
    assert got == {k: v for k, v in _replay_replies(events).items() if v is not None}


def test_rate_verdicts_split_a_hot_client(spark):
    """One client with most of the rows: its busy stretches are separate groups, calm ones are not replayed."""
    rnd = random.Random(2)
    reqs, t = [], T0
    for i in range(1500):
        t += dt.timedelta(seconds=rnd.choice([1, 2, 3, 5, 200]) if (i // 100) % 2 else 40)
        reqs.append((i, "hot" if i % 5 else f"c{i % 3}", t))
    df = spark.createDataFrame(reqs, "event_id long, client string, created_at timestamp_ntz")
    got = {r.event_id: r.verdict for r in X.rate_verdicts(df, limit=4, window_seconds=60).collect()}
    assert got == _replay_rate(reqs, 4, 60) and {"accept", "reject"} == set(got.values())
    plan = X.rate_verdicts(df, 4, 60)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_COL" in plan and "hashpartitioning(client" in plan and "_island" in plan


def test_usage_log_refuses_quantities_finer_than_hundredths(spark):
    req = spark.createDataFrame([(1, 1, 0.005, T0), (2, 1, 1.25, T0 + dt.timedelta(1)), (3, None, 1.0, T0), (4, 1, None, T0),
                                 (5, 9, 1.0, T0)], "event_id long, item_id long, quantity double, created_at timestamp_ntz")
    items = spark.createDataFrame([(1, 2.0)], "id long, current_stock double")
    got = {r.event_id: (r.verdict, None if r.stock_after is None else float(r.stock_after)) for r in X.usage_log(req, items).collect()}
    assert got == {1: ("invalid", None), 2: ("accepted", 0.75), 3: ("not_found", None), 4: ("invalid", None), 5: ("not_found", None)}


def _usage_frames(spark, reqs, stock):
    items = spark.createDataFrame([(k, str(v)) for k, v in stock.items()], "id long, current_stock string") \
        .selectExpr("id", "CAST(current_stock AS DECIMAL(12,2)) AS current_stock")
    r = spark.createDataFrame([(i, it, str(q), t) for i, it, q, t in reqs],
                              "event_id long, item_id long, quantity string, created_at timestamp_ntz") \
        .selectExpr("event_id", "item_id", "CAST(quantity AS DECIMAL(12,2)) AS quantity", "created_at")
    return r, items


def _replay_usage(reqs, stock):
    left, want = {k: round(v * 100) for k, v in stock.items()}, {}
    for eid, item, q, _ in sorted(reqs, key=lambda x: (x[3], x[0])):
        c = round(q * 100)
        if c <= 0:
            want[eid] = ("invalid", None)
        elif item not in left:
            want[eid] = ("not_found", None)
        else:
            ok = left[item] >= c
            left[item] -= c if ok else 0
            want[eid] = ("accepted" if ok else "insufficient", left[item])
    return want


@pytest.mark.parametrize("seed,sizes", [(1, (0.01, 3.0)), (2, (1.0, 400.0)), (3, (5.0, 5.0))])
def test_usage_log_splits_a_hot_item(spark, seed, sizes):
    """One item with most of the requests, many of them at the same time, in small chunks."""
    rnd = random.Random(seed)
    stock = {0: 900.0, 1: 55.5, 2: 0.0, 3: 10.0}
    reqs = [(i, 0 if rnd.random() < 0.8 else rnd.choice([1, 2, 3, 99]),
             rnd.choice([round(rnd.uniform(*sizes), 2), round(10 ** rnd.uniform(-2, 3), 2), 0.0]),
             T0 + dt.timedelta(seconds=rnd.randint(0, 40))) for i in range(1200)]
    r, items = _usage_frames(spark, reqs, stock)
    got = {x.event_id: (x.verdict, None if x.stock_after is None else round(float(x.stock_after) * 100))
           for x in X.usage_log(r, items, chunk_rows=60).collect()}
    assert got == _replay_usage(reqs, stock)


def test_hot_item_is_spread_and_few_chunks_are_walked(spark, monkeypatch):
    rnd = random.Random(4)
    reqs = [(i, 0 if i % 5 else 1 + i % 7, round(rnd.uniform(0.01, 9), 2), T0 + dt.timedelta(seconds=i)) for i in range(4000)]
    stock = {0: 6000.0, **{i: 40.0 for i in range(1, 8)}}
    seen = {}
    starts = X.usage_starts

    def watched(rows, scales):
        out = starts(rows, scales)
        seen["chunks"] = rows.where("item_id = 0").select("_chunk").distinct().count()
        seen["most"] = rows.groupBy("_chunk").count().agg({"count": "max"}).first()[0]
        seen["starts"] = out.count()
        return out
    monkeypatch.setattr(X, "usage_starts", watched)
    r, items = _usage_frames(spark, reqs, stock)
    got = {x.event_id: (x.verdict, None if x.stock_after is None else round(float(x.stock_after) * 100))
           for x in X.usage_log(r, items, chunk_rows=100).collect()}
    assert got == _replay_usage(reqs, stock)
    assert seen["chunks"] >= 25 and seen["most"] < 400 and seen["starts"] >= 32


def test_summaries_agree_with_a_walk():
    import numpy as np
    rnd = random.Random(6)
    whole = 0
    for _ in range(3000):
        q = [rnd.choice([1, 2, 3, 7, 8, 20, 100, 5000]) for _ in range(rnd.randint(0, 12))]
        left = rnd.choice([0, 1, 5, 9, 16, 64, 130, 1000, 4096])
        small, least = X.usage_summary(np.array(q, dtype=np.int64), 14)
        after = X.passes_whole(left, small, least)
        assert after is None or after == X.stock_left(q, left)
        whole += after is not None
    assert whole > 1000


def test_rate_verdicts_cut_a_client_that_never_pauses(spark):
    """Every bucket of the client holds requests; calm pairs of buckets still cut it, and refused ones are jumped over."""
    rnd = random.Random(7)
    reqs, i = [], 0
    for minute in range(200):
        for _ in range(1 if minute % 10 < 6 else rnd.randint(5, 30)):
            reqs.append((i, "hot", T0 + dt.timedelta(minutes=minute, milliseconds=rnd.randint(0, 59_999))))
            i += 1
    df = spark.createDataFrame(reqs, "event_id long, client string, created_at timestamp_ntz")
    got = {r.event_id: r.verdict for r in X.rate_verdicts(df, limit=4, window_seconds=60).collect()}
    assert got == _replay_rate(reqs, 4, 60)
    assert X.rate_verdicts(df, 0, 60).where("verdict = 'accept'").count() == 0
