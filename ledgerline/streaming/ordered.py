"""Stateful jobs in order of event time: rows wait in state until the watermark has passed them.

The jobs of ``jobs.py`` answer at once, in the order in which micro-batches arrive. Here a row that comes late, but within
the watermark's delay, is put where it belongs, so the results are those of the batch operators on the same rows. The
state is that of ``transformWithStateInPandas`` (RocksDB): rows wait in a map by short slots of time, an event-time
timer releases a slot once the watermark has passed its end, and a timer forgets what a quiet key has left. A key's
micro-batch is taken chunk by chunk and only one slot of a key is in memory.

Rows without a key or a time, and rows behind the watermark, are answered by nobody (Spark drops the latter). What is
younger than the last watermark waits for the next run.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ledgerline.functions.core import epoch_micros
from ledgerline.operators.stateful import accepted_positions
from ledgerline.streaming.jobs import event_time

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Sets the state store that these jobs need, for queries started from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


class _InOrder(StatefulProcessor):
    """Rows (t_us, id, kind) of a key, handed to ``answers`` slot by slot in order of (t_us, id)."""

    memory = "ids array<long>, ts array<long>"          # what a key remembers from slot to slot

    def __init__(self, slot_seconds: int, keep_us: int):
        self.slot_us, self.keep_us = slot_seconds * 1_000_000, keep_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "slot long", "ts array<long>, ids array<long>, kinds array<int>")
        self.kept = handle.getValueState("kept", self.memory)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            slots = pdf["t_us"].to_numpy() // self.slot_us
            for slot in np.unique(slots).tolist():
                some = pdf[slots == slot]
                new = [some[c].tolist() for c in ("t_us", "id", "kind")]
                if self.waiting.containsKey((slot,)):
                    new = [list(old) + own for old, own in zip(self.waiting.getValue((slot,)), new)]
                else:
                    self.handle.registerTimer((slot + 1) * self.slot_us // 1000)
                self.waiting.updateValue((slot,), tuple(new))
        yield pd.DataFrame(columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at_us = expiredTimerInfo.getExpiryTimeInMs() * 1000
        slot = at_us // self.slot_us - 1
        ids, ts = (list(v) for v in self.kept.get()) if self.kept.exists() else ([], [])
        if not self.waiting.containsKey((slot,)):        # a timer to forget by
            if ts and ts[-1] + self.keep_us <= at_us:
                self.kept.clear()
            return
        t, i, kind = (np.array(v, dtype=np.int64) for v in self.waiting.getValue((slot,)))
        self.waiting.removeKey((slot,))
        order = np.lexsort((i, t))
        out, ids, ts = self.answers(key, t[order], i[order], kind[order], ids, ts)
        if ts:
            self.kept.update((ids, ts))
            # on a slot's edge, as all timers
            self.handle.registerTimer(((ts[-1] + self.keep_us) // self.slot_us + 1) * self.slot_us // 1000)
        elif self.kept.exists():
            self.kept.clear()
        yield out

    def close(self) -> None:
        pass


class _Rates(_InOrder):
    columns = ["event_id", "client", "verdict"]

    def __init__(self, slot_seconds: int, limit: int, window_us: int):
        super().__init__(slot_seconds, window_us)
        self.limit = limit

    def answers(self, key, t, i, kind, ids, ts):
        open_ = deque(ts)
        verdict = np.full(len(t), "reject", dtype=object)
        verdict[accepted_positions(t, open_, self.limit, self.keep_us)] = "accept"
        return pd.DataFrame({"event_id": i, "client": key[0], "verdict": verdict}), [], list(open_)


class _Replies(_InOrder):
    columns = ["reply_id", "draft_id"]

    def answers(self, key, t, i, kind, ids, ts):
        first = 0                                        # drafts before it have expired
        out = []
        for at, own, is_draft in zip(t.tolist(), i.tolist(), kind.tolist()):
            while first < len(ts) and ts[first] <= at - self.keep_us:
                first += 1
            if is_draft:
                ids.append(own)
                ts.append(at)
            elif len(ts) > first:
                out.append((own, ids.pop()))
                ts.pop()
            else:
                out.append((own, None))
        return (pd.DataFrame(out, columns=self.columns).astype({"reply_id": "int64", "draft_id": "Int64"}),
                ids[first:], ts[first:])


def _run(rows: DataFrame, key: str, processor: _InOrder, schema: str) -> DataFrame:
    use_rocksdb(rows.sparkSession)
    return rows.groupBy(key).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="append", timeMode="eventTime")


def rate_verdicts_in_order(requests: DataFrame, limit: int, window_seconds: int, client_col: str = "client",
                           id_col: str = "event_id", lateness: str = "1 hour", slot_seconds: int = 60) -> DataFrame:
    """St3 in order of event time: (event_id, client, verdict) as ``rate_verdicts`` gives them for the same rows."""
    rows = event_time(requests).withWatermark("event_time", lateness).select(
        F.col(client_col).cast("string").alias("client"), F.col(id_col).cast("long").alias("id"),
        epoch_micros("created_at").alias("t_us"), F.lit(0).alias("kind"), "event_time").where(
        "client IS NOT NULL AND t_us IS NOT NULL")
    return _run(rows, "client", _Rates(slot_seconds, limit, window_seconds * 1_000_000),
                "event_id long, client string, verdict string")


def reply_matches_in_order(events: DataFrame, window_hours: int = 24, lateness: str = "1 hour",
                           slot_seconds: int = 60) -> DataFrame:
    """St4 in order of event time: (reply_id, draft_id or NULL) as ``match_replies`` pairs the same rows."""
    rows = event_time(events).withWatermark("event_time", lateness).select(
        "customer_wa_id", F.col("id").cast("long").alias("id"), epoch_micros("created_at").alias("t_us"),
        (F.col("kind") == "draft").cast("int").alias("kind"), "event_time").where(
        "customer_wa_id IS NOT NULL AND t_us IS NOT NULL")
    return _run(rows, "customer_wa_id", _Replies(slot_seconds, window_hours * 3_600_000_000),
                "reply_id long, draft_id long")
