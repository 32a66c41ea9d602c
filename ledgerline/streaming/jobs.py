"""Structured Streaming forms of the batch operators.

St1  hourly metrics: event-time tumbling window with a watermark, append mode; with all
     columns of the batch report (modes too) by two chained aggregations.
St2  keyed upserts: foreachBatch merges into a versioned table, rewriting only the
     buckets it touches and skipping an epoch it has seen; redelivered records
     are dropped within the watermark.
St3  rate verdicts: applyInPandasWithState, state = accepted times (<= limit).
St4  reply matching: applyInPandasWithState, state = open drafts of the last
     window (expired drafts can never match again, so they are pruned).
     The state of St3 and St4 is removed once the watermark passes its last
     event by the window.
St5  scheduled pulls: a file source drained with Trigger.AvailableNow.

Fixture timestamps are zone-less; watermarks need TIMESTAMP, so event time is
cast with the session zone pinned to UTC.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import StructType

from ledgerline.functions.core import epoch_micros, round_int
from ledgerline.sources.sinks import upsert_version


def event_time(df: DataFrame, col: str = "created_at", out: str = "event_time") -> DataFrame:
    return df.withColumn(out, F.col(col).cast("timestamp"))


def stream_table(spark: SparkSession, path: str, schema: StructType, max_files: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(path)


# ----------------------------------------------------------------------------- St1
def hourly_metrics_stream(conversations: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Additive hourly columns of the metrics rollup; a window is emitted once the
    watermark passes its end."""
    c = event_time(conversations).withWatermark("event_time", lateness)
    esc = F.count(F.when(F.col("escalated") == F.lit(True), 1))
    return (c.groupBy(F.window("event_time", "1 hour").alias("w")).agg(
        F.count(F.lit(1)).alias("total_conversations"), esc.alias("escalated_count"),
        F.sum("response_time_ms").alias("sum_response_ms"), F.count("response_time_ms").alias("n_response"),
        F.sum("customer_feedback").alias("sum_feedback"), F.count("customer_feedback").alias("n_feedback"))
        .select(F.col("w.start").alias("metric_hour"), "*").drop("w"))


def hourly_rollup_stream(conversations: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """All columns of ``hourly_metrics`` as a stream: two chained aggregations in append mode. The first counts each
    (hour, set, value), where a row is in the hour's own set, its intent's and its channel's, as partial aggregates, so a
    hot hour is combined before the shuffle; the second, by hour, adds the totals and picks the modes. An hour is
    emitted once the watermark passes its end; rows without a time belong to no hour."""
    c = event_time(conversations).withWatermark("event_time", lateness)
    one = lambda kind, v: F.struct(F.lit(kind).alias("kind"), v.cast("string").alias("value"))
    sets = c.select("event_time", "escalated", "response_time_ms", "customer_feedback", F.explode(F.array(
        one("hour", F.lit(None)), one("intent", F.col("intent_detected")), one("channel", F.col("channel")))).alias("s"))
    counts = sets.groupBy(F.window("event_time", "1 hour").alias("w"), "s.kind", "s.value").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("escalated") == F.lit(True), 1)).alias("e"),
        F.sum("response_time_ms").alias("rs"), F.count("response_time_ms").alias("rn"),
        F.sum("customer_feedback").alias("fs"), F.count("customer_feedback").alias("fn"))

    def tot(name):
        return F.sum(F.when(F.col("kind") == "hour", F.col(name)))

    def mode(kind):
        rank = F.struct((-F.col("n")).alias("nc"), F.col("value").alias("v"))
        return F.min_by("value", F.when((F.col("kind") == kind) & F.col("value").isNotNull(), rank))

    n, e = tot("n"), tot("e")
    return counts.groupBy(F.window(F.window_time("w"), "1 hour").alias("h")).agg(
        n.alias("total_conversations"), e.alias("escalated_count"),
        round_int(tot("rs").cast("double") / tot("rn")).alias("avg_response_time_ms"),
        F.round((n - e).cast("double") * 100 / n, 2).alias("resolution_rate"),
        F.round(tot("fs").cast("double") / tot("fn"), 2).alias("csat_avg"),
        mode("intent").alias("top_intent"), mode("channel").alias("top_channel")).select(
            F.col("h.start").alias("metric_hour"), "*").drop("h")


# ----------------------------------------------------------------------------- St2
def upsert_stream_batch(base_path: str, key: str, order: list[str], insert_cols: list[str],
                        update_cols: list[str], buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """foreachBatch body: merge the micro-batch into the current version (see ``upsert_version``)."""
    def run(batch: DataFrame, epoch_id: int) -> None:
        upsert_version(batch, base_path, key, order, insert_cols, update_cols, epoch=epoch_id, buckets=buckets)
    return run


def dedupe_redelivery(stream: DataFrame, id_col: str, time_col: str = "event_time",
                      lateness: str = "1 hour") -> DataFrame:
    return stream.withWatermark(time_col, lateness).dropDuplicatesWithinWatermark([id_col])


# ----------------------------------------------------------------------------- St3
def _keep_until(state, last_us: int, window_us: int) -> None:
    """The state goes when the watermark passes its last event by the window."""
    state.setTimeoutTimestamp(max((last_us + window_us) // 1000, state.getCurrentWatermarkMs()) + 1)


def rate_verdict_stream(requests: DataFrame, limit: int, window_seconds: int, client_col: str = "client",
                        id_col: str = "event_id", lateness: str = "1 hour") -> DataFrame:
    """Per client sliding-window limiter over a stream (rows arrive in time order
    per client; within a micro-batch they are sorted)."""
    window_us = window_seconds * 1_000_000
    src = event_time(requests).withWatermark("event_time", lateness).select(
        F.col(id_col).alias("event_id"), F.col(client_col).cast("string").alias("client"),
        epoch_micros("created_at").alias("t_us"), "event_time")

    def fn(key, pdfs, state):
        if state.hasTimedOut:
            state.remove()
            return
        acc = list(state.get[0]) if state.exists else []
        pdf = pd.concat(list(pdfs), ignore_index=True).sort_values(["t_us", "event_id"])
        out, t = [], 0
        for eid, t in zip(pdf["event_id"].tolist(), pdf["t_us"].tolist()):
            acc = [a for a in acc if t - a < window_us]
            if len(acc) < limit:
                acc.append(t)
                out.append((eid, key[0], "accept"))
            else:
                out.append((eid, key[0], "reject"))
        state.update((acc,))
        _keep_until(state, t, window_us)
        yield pd.DataFrame(out, columns=["event_id", "client", "verdict"])

    return src.groupBy("client").applyInPandasWithState(
        fn, "event_id long, client string, verdict string", "acc array<long>", "append",
        GroupStateTimeout.EventTimeTimeout)


# ----------------------------------------------------------------------------- St4
def reply_match_stream(events: DataFrame, window_hours: int = 24, lateness: str = "1 hour") -> DataFrame:
    """events: id, customer_wa_id, kind ('draft' | 'reply'), created_at.
    Emits one row per reply: (reply_id, draft_id or NULL). Events without a customer or a time match nothing."""
    live_us = window_hours * 3600 * 1_000_000
    timed = event_time(events).withWatermark("event_time", lateness)
    matchable = F.col("customer_wa_id").isNotNull() & F.col("created_at").isNotNull()
    src = timed.where(matchable).select("id", "customer_wa_id", "kind", epoch_micros("created_at").alias("t_us"),
                                        "event_time")
    alone = timed.where(~matchable & (F.col("kind") == "reply")).select(
        F.col("id").alias("reply_id"), F.lit(None).cast("long").alias("draft_id"))

    def fn(key, pdfs, state):
        if state.hasTimedOut:
            state.remove()
            return
        ids, ts = (list(state.get[0]), list(state.get[1])) if state.exists else ([], [])
        pdf = pd.concat(list(pdfs), ignore_index=True).sort_values(["t_us", "id"])
        out = []
        for i, kind, t in zip(pdf["id"].tolist(), pdf["kind"].tolist(), pdf["t_us"].tolist()):
            while ts and ts[0] <= t - live_us:          # expired: can never match again
                ids.pop(0)
                ts.pop(0)
            if kind == "draft":
                ids.append(i)
                ts.append(t)
            elif ids and ts[-1] > t - live_us:
                out.append((i, ids.pop()))
                ts.pop()
            else:
                out.append((i, None))
        if ids:
            state.update((ids, ts))
            _keep_until(state, ts[-1], live_us)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["reply_id", "draft_id"]).astype({"draft_id": "Int64"})

    return src.groupBy("customer_wa_id").applyInPandasWithState(
        fn, "reply_id long, draft_id long", "ids array<long>, ts array<long>", "append",
        GroupStateTimeout.EventTimeTimeout).unionAll(alone)


# ----------------------------------------------------------------------------- St5
def run_available_now(stream: DataFrame, sink: str, checkpoint: str, fmt: str = "parquet",
                      output_mode: str = "append", foreach_batch=None):
    """Drain everything available now (the cron pull) and stop."""
    w = stream.writeStream.option("checkpointLocation", checkpoint).outputMode(output_mode).trigger(
        availableNow=True)
    if foreach_batch is not None:
        q = w.foreachBatch(foreach_batch).start()
    else:
        q = w.format(fmt).option("path", sink).start()
    q.awaitTermination()
    return q
