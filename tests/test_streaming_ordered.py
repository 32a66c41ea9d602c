"""Stateful streams in order of event time: late rows, restarts and a hot key, against the batch operators."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import stateful as X
from ledgerline.streaming import jobs as S
from ledgerline.streaming import ordered as O

T0 = dt.datetime(2024, 1, 1)
FAR = T0 + dt.timedelta(days=30)


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    yield spark
    spark.conf.set(key, before)


def _land(spark, rows, schema, path, files):
    """As many micro-batches as files; rows in order of arrival."""
    n = -(-len(rows) // files)
    for k in range(files):
        spark.createDataFrame(rows[k * n:(k + 1) * n], schema).coalesce(1).write.mode("append").parquet(path)


def _shuffled(rows, at, minutes, rnd):
    """Order of arrival: up to ``minutes`` late."""
    return sorted(rows, key=lambda r: r[at] + dt.timedelta(minutes=rnd.uniform(0, minutes)))


def _drain(stream, tmp_path):
    out = str(tmp_path / "out")
    S.run_available_now(stream, out, str(tmp_path / "ck"))
    return stream.sparkSession.read.parquet(out)


def test_rate_verdicts_of_late_rows_and_a_hot_client_over_a_restart(rocks, tmp_path):
    rnd = random.Random(1)
    schema = "event_id long, client string, created_at timestamp_ntz"
    rows = [(i, "hot" if i % 5 else f"c{i % 3}", T0 + dt.timedelta(seconds=rnd.randint(0, 6 * 3600))) for i in range(900)]
    rows += [(2000, None, T0), (2001, "c0", None)]
    late = _shuffled(rows[:900], 2, 30, rnd) + rows[900:]
    end = [(9000, "end", FAR), (9001, "end", FAR + dt.timedelta(days=1))]
    land = str(tmp_path / "land")
    (tmp_path / "land").mkdir()
    stream = S.stream_table(rocks, land, rocks.createDataFrame([], schema).schema, max_files=1)
    job = lambda: O.rate_verdicts_in_order(stream, 4, 600, lateness="40 minutes")
    _land(rocks, late[:450], schema, land, 3)
    first = _drain(job(), tmp_path).count()
    _land(rocks, late[450:], schema, land, 3)
    for e in end:
        _land(rocks, [e], schema, land, 1)
    got = {r.event_id: r.verdict for r in _drain(job(), tmp_path).where("event_id < 2000").collect()}
    want = X.rate_verdicts(rocks.createDataFrame(rows[:900], schema), 4, 600).collect()
    assert 0 < first < 450 and got == {r.event_id: r.verdict for r in want}
    assert set(got.values()) == {"accept", "reject"}


def test_reply_matches_of_late_rows(rocks, tmp_path):
    rnd = random.Random(2)
    schema = "id long, customer_wa_id string, kind string, created_at timestamp_ntz"
    rows = [(i, "hot" if i % 4 else f"c{i % 3}", rnd.choice(["draft", "reply", "reply"]),
             T0 + dt.timedelta(seconds=rnd.randint(0, 86_400))) for i in range(600)]
    land = str(tmp_path / "land")
    _land(rocks, _shuffled(rows, 3, 30, rnd), schema, land, 4)
    for k, at in enumerate((FAR, FAR + dt.timedelta(days=1))):
        _land(rocks, [(9000 + k, "end", "draft", at)], schema, land, 1)
    stream = S.stream_table(rocks, land, rocks.createDataFrame([], schema).schema, max_files=1)
    got = {r.reply_id: r.draft_id for r in _drain(O.reply_matches_in_order(
        stream, window_hours=2, lateness="40 minutes"), tmp_path).collect()}
    df = rocks.createDataFrame(rows, schema)
    replies = df.where("kind = 'reply'").drop("kind").select("*", F.col("id").cast("string").alias("reply_text"),
                                                             F.lit("t").alias("capture_source"))
    out = X.match_replies(df.where("kind = 'draft'").drop("kind"), replies, window_hours=2).collect()
    replied = {r[0] for r in rows if r[2] == "reply"}
    pairs = {int(r.human_reply): r.id for r in out if r.id not in replied and r.human_reply}
    assert got == {i: pairs.get(i) for i in replied} and None in got.values()


def test_state_of_quiet_keys_goes(rocks, tmp_path):
    schema = "event_id long, client string, created_at timestamp_ntz"
    land = str(tmp_path / "land")
    _land(rocks, [(i, f"c{i}", T0 + dt.timedelta(minutes=i)) for i in range(40)], schema, land, 2)
    for k in range(4):
        _land(rocks, [(100 + k, "late", T0 + dt.timedelta(days=2 + k))], schema, land, 1)
    stream = S.stream_table(rocks, land, rocks.createDataFrame([], schema).schema, max_files=1)
    q = S.run_available_now(O.rate_verdicts_in_order(stream, 3, 3600, lateness="1 minute"), str(tmp_path / "out"),
                            str(tmp_path / "ck"))
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(kept) >= 40 and kept[-1] <= 8
    assert rocks.read.parquet(str(tmp_path / "out")).count() >= 42
