"""Stateful operators.

X29 (reply matching) is set-based: window functions over (customer, time
bucket) chunks stitched by small per-chunk summaries, so no customer is one task.
X49 (rate verdicts) and W33 (stock-checked usage) are sequential: a rejected
request does not consume. They run as a sorted stream: hash-partition by key, sort
within partitions (external sort, spills), then ``mapInPandas`` walks Arrow batches
carrying O(1) state per key. No group is ever materialised whole in memory. X49
splits a client's time where nothing is remembered and replays only what can be
rejected at all; W33 cuts a hot item's requests into chunks and finds the stock at
the start of each from summaries.
"""

from __future__ import annotations

import uuid
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerline.functions.core import epoch_micros
from ledgerline.session import cut_lineage, ensure_checkpoint_dir

# Message text of a reply stored without a matching draft.
STANDALONE_MESSAGE = "[no AI draft captured]"


def _micros(c: str) -> F.Column:
    """Microseconds since epoch of a zone-less timestamp (no session-zone shift)."""
    return epoch_micros(c)


# ----------------------------------------------------------------------------- X29
def match_replies(drafts: DataFrame, replies: DataFrame, window_hours: int = 24,
                  key: str = "customer_wa_id", bucket_minutes: int | None = None,
                  target_chunk_rows: int = 2_000_000) -> DataFrame:
    """Each reply takes the newest unanswered draft of the same customer created
    strictly within the previous ``window_hours``; that draft is consumed. A reply
    without one becomes a standalone record.

    drafts:  id, customer_wa_id, created_at, + draft columns (kept as is)
    replies: id, customer_wa_id, created_at, reply_text, capture_source

    Set-based form of the stack replay: per customer in (created_at, id) order,
    s = running sum of +1 (draft) / -1 (reply), depth d = s - min(0, running min s).
    A draft sits at level d; a reply pops level lag(d). Within a (customer, level)
    run the event after a draft is the reply that pops it, so ``lead``/``lag`` pair
    them. Pairs older than the window are voided (expired drafts only lie under
    live ones, so popping them early never changes a later match).

    Rows without a customer or a time can't match (NULL equals nothing): such drafts stay unanswered, such replies
    stand alone. They are kept apart, so that they form no group.

    No customer is ever one task: running sums and minima are a two-level prefix
    scan over (customer, chunk of time) — a window inside each chunk plus a
    small per-chunk summary carried across chunks — and the level pairing runs per
    (customer, level, chunk) with the chunk boundaries stitched from summaries.
    A chunk is ``bucket_minutes`` or else an hour; a customer's hour that holds more than
    ``target_chunk_rows`` is cut finer (down to one second), all others stay whole.
    """
    ev = (drafts.withColumn("_kind", F.lit(1))
          .unionByName(replies.withColumn("_kind", F.lit(-1)), allowMissingColumns=True))
    draft_cols = [c for c in drafts.columns if c not in ("id", key, "created_at", "capture_source")]
    matchable = F.col(key).isNotNull() & F.col("created_at").isNotNull()
    apart, ev = ev.where(~matchable), ev.where(matchable)
    span = int(bucket_minutes or 60) * 60_000_000
    us = _micros("created_at")
    ev = ev.withColumn("_h", F.floor(us / span))
    if bucket_minutes:
        ev = ev.withColumn("_b", F.col("_h"))
    else:
        busy = (ev.groupBy(key, "_h").agg(F.count("*").alias("_n")).where(F.col("_n") > target_chunk_rows)
                .select(key, "_h", F.greatest(F.lit(1_000_000), F.floor(
                    F.lit(float(span) * target_chunk_rows) / F.col("_n"))).alias("_width")))
        part = F.coalesce(F.floor((us - F.col("_h") * span) / F.col("_width")), F.lit(0))
        ev = ev.join(busy, [key, "_h"], "left").withColumn("_b", F.col("_h") * 3_600 + part).drop("_width")
    ev = ev.drop("_h")
    order = [F.col("created_at"), F.col("id")]
    wb = Window.partitionBy(key, "_b").orderBy(*order)
    run_b = wb.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ev = ev.withColumn("_ls", F.sum("_kind").over(run_b))
    ev = cut_lineage(ev.withColumn("_lmin", F.min("_ls").over(run_b)))   # read twice below
    # level 2: per customer over its bucket summaries (a few rows per customer-bucket)
    summ = ev.groupBy(key, "_b").agg(F.sum("_kind").alias("_S"), F.min("_ls").alias("_M"))
    before = Window.partitionBy(key).orderBy(F.col("_b").asc_nulls_first()).rowsBetween(
        Window.unboundedPreceding, -1)
    summ = summ.withColumn("_C", F.coalesce(F.sum("_S").over(before), F.lit(0)))
    summ = summ.withColumn("_PM", F.min(F.col("_C") + F.col("_M")).over(before))
    ev = ev.join(summ.select(key, "_b", "_C", "_PM"), [key, "_b"])
    never = F.lit(1 << 62)
    floor_before = F.least(F.lit(0), F.coalesce(F.col("_PM"), never))
    s = F.col("_C") + F.col("_ls")
    d = s - F.least(F.lit(0), F.least(F.coalesce(F.col("_PM"), never), F.col("_C") + F.col("_lmin")))
    ev = ev.withColumn("_d", d)
    prev_d = F.coalesce(F.lag("_d").over(wb), F.col("_C") - floor_before)
    ev = cut_lineage(ev.withColumn("_lvl", F.when(F.col("_kind") == 1, F.col("_d")).otherwise(prev_d))
                     .drop("_ls", "_lmin", "_C", "_PM", "_d"))                         # read twice below
    # pairing inside (customer, level, bucket); chunk edges come from the neighbour chunks
    wl = Window.partitionBy(key, "_lvl", "_b").orderBy(*order)
    nxt_row = F.struct(F.col("_kind").alias("k"), F.col("created_at").alias("t"),
                       F.col("reply_text").alias("text"), F.col("capture_source").alias("src"))
    prv_row = F.struct(F.col("_kind").alias("k"), F.col("created_at").alias("t"))
    ordk = F.struct("created_at", "id")
    chunks = ev.groupBy(key, "_lvl", "_b").agg(F.min_by(nxt_row, ordk).alias("_first"),
                                                F.max_by(prv_row, ordk).alias("_last"))
    wc = Window.partitionBy(key, "_lvl").orderBy(F.col("_b").asc_nulls_first())
    chunks = chunks.select(key, "_lvl", "_b", F.lead("_first").over(wc).alias("_next_first"),
                           F.lag("_last").over(wc).alias("_prev_last"))
    ev = (ev.withColumn("_nxt", F.lead(nxt_row).over(wl)).withColumn("_prv", F.lag(prv_row).over(wl))
          .join(chunks, [key, "_lvl", "_b"]))
    nxt = F.coalesce(F.col("_nxt"), F.col("_next_first"))
    prv = F.coalesce(F.col("_prv"), F.col("_prev_last"))
    live = F.expr(f"INTERVAL {int(window_hours)} HOURS")
    ev = (ev.withColumn("_draft_matched", (F.col("_kind") == 1) & F.coalesce(nxt["k"] == -1, F.lit(False))
                        & (F.col("created_at") > nxt["t"] - live))
          .withColumn("_reply_matched", (F.col("_kind") == -1) & (F.col("_lvl") >= 1)
                      & F.coalesce(prv["k"] == 1, F.lit(False)) & (prv["t"] > F.col("created_at") - live)))
    # one projection for both row kinds (a union of two filtered branches would
    # evaluate the whole pipeline twice); consumed replies are dropped
    is_draft = F.col("_kind") == 1
    matched = is_draft & F.coalesce(F.col("_draft_matched"), F.lit(False))

    def shadow(df: DataFrame, text: F.Column, at: F.Column, source: F.Column) -> DataFrame:
        return df.select(
            "id", key,
            *[F.when(is_draft, F.col(c)).otherwise(F.lit(STANDALONE_MESSAGE) if c == "customer_message" else None)
              .alias(c) for c in draft_cols],
            F.when(~is_draft, F.col("reply_text")).otherwise(text).alias("human_reply"),
            F.when(~is_draft, F.col("created_at")).otherwise(at).alias("human_replied_at"),
            F.coalesce(source, F.col("capture_source")).alias("capture_source"), "created_at")

    answered = ev.where(is_draft | ~F.coalesce(F.col("_reply_matched"), F.lit(False)))
    none = F.lit(None)
    return shadow(answered, F.when(matched, nxt["text"]), F.when(matched, nxt["t"]),
                  F.when(matched, nxt["src"])).unionByName(shadow(apart, none, none, none))


# ----------------------------------------------------------------------------- X49
def accepted_positions(times: np.ndarray, open_: deque, limit: int, window_us: int) -> list[int]:
    """Positions accepted among sorted request times, walking from one accepted request to the next.

    ``open_`` holds the newest accepted times (``limit`` at most) and is brought up to date. When it is full, the next
    request that can be accepted is the first one a window after its oldest; all before are refused unseen."""
    out, at, n = [], 0, len(times)
    while at < n:
        if len(open_) == limit:
            if limit == 0:
                break
            at = max(at, int(np.searchsorted(times, open_[0] + window_us)))
            if at >= n:
                break
            open_.popleft()
        open_.append(int(times[at]))
        out.append(at)
        at += 1
    return out


def _rate_stream(limit: int, window_us: int):
    def run(batches):
        cur, open_ = None, deque()
        for pdf in batches:
            t = pdf["_t_us"].to_numpy()
            verdict = np.full(len(pdf), "reject", dtype=object)
            same = (pdf["client"].eq(pdf["client"].shift()) & pdf["_island"].eq(pdf["_island"].shift())).to_numpy()
            starts = [0, *[int(i) for i in np.flatnonzero(~same) if i], len(pdf)]
            for lo, hi in zip(starts, starts[1:]):
                if lo == hi:
                    continue
                key = (pdf["client"].iat[lo], pdf["_island"].iat[lo])
                if key != cur:
                    cur, open_ = key, deque()
                verdict[[lo + i for i in accepted_positions(t[lo:hi], open_, limit, window_us)]] = "accept"
            yield pdf.drop(columns=["_t_us", "_island"]).assign(verdict=verdict)
    return run


def rate_verdicts(requests: DataFrame, limit: int = 100, window_seconds: int = 60,
                  client_col: str = "client", ts_col: str = "created_at", id_col: str = "event_id") -> DataFrame:
    """Per client: accept a request iff fewer than ``limit`` accepted requests are
    younger than ``window_seconds``; rejected requests do not count.
    Output: event_id, client, created_at, verdict (columns ride through the stream,
    so there is no join back to the input).

    Time is cut into buckets of the window's length. A bucket that holds no more than ``limit`` requests together
    with the one before accepts all of its requests, whatever was accepted earlier, and older ones are forgotten
    when it ends: there a client's time is cut into islands that know nothing of each other. Islands of one such
    bucket accept all; the others are replayed, one sorted stream each, which goes from one accepted request to the
    next and never looks at the refused ones between."""
    window_us = window_seconds * 1_000_000
    src = requests.select(F.col(id_col).alias("event_id"), F.col(client_col).alias("client"),
                          F.col(ts_col).alias("created_at"), _micros(ts_col).alias("_t_us"))
    src = src.withColumn("_b", F.floor(F.col("_t_us") / window_us))
    by_time = Window.partitionBy("client").orderBy("_b")
    before = F.when(F.lag("_b").over(by_time) == F.col("_b") - 1, F.lag("_n").over(by_time)).otherwise(0)
    runs = (src.groupBy("client", "_b").agg(F.count(F.lit(1)).alias("_n"))
            .withColumn("_load", F.col("_n") + F.coalesce(before, F.lit(0)))
            .withColumn("_follows", F.col("_load") > limit)
            .withColumn("_island", F.sum(F.when(F.col("_follows"), 0).otherwise(1)).over(
                by_time.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
            .withColumn("_busy", F.max("_load").over(Window.partitionBy("client", "_island")) > limit)
            .select(F.col("client").alias("_c"), F.col("_b").alias("_rb"), "_island", "_busy"))
    ev = (src.join(runs, F.col("client").eqNullSafe(F.col("_c")) & F.col("_b").eqNullSafe(F.col("_rb")))
          .select("event_id", "client", "created_at", "_t_us", "_island", "_busy"))
    calm = ev.where(~F.col("_busy")).select("event_id", "client", "created_at", F.lit("accept").alias("verdict"))
    busy = (ev.where(F.col("_busy")).drop("_busy").repartition("client", "_island")
            .sortWithinPartitions("client", "_island", "_t_us", "event_id"))
    fields = {f.name: f.dataType.simpleString() for f in src.schema.fields}
    schema = (f"event_id {fields['event_id']}, client {fields['client']}, created_at {fields['created_at']}, "
              "verdict string")
    return calm.unionByName(busy.mapInPandas(_rate_stream(limit, window_us), schema))


# ----------------------------------------------------------------------------- W33
def _usage_stream():
    def run(batches):
        cur, left = None, 0
        for pdf in batches:
            verdict, after = [], []
            for it, chunk, pre, st, q in zip(pdf["item_id"].tolist(), pdf["_chunk"].tolist(), pdf["_pre"].tolist(),
                                             pdf["_stock_c"].tolist(), pdf["_qty_c"].tolist()):
                if isinstance(pre, str):                 # decided up front
                    verdict.append(pre)
                    after.append(None)
                    continue
                if (it, chunk) != cur:
                    cur, left = (it, chunk), int(st)
                if left >= q:
                    left -= int(q)
                    verdict.append("accepted")
                else:
                    verdict.append("insufficient")
                after.append(left)
            yield pd.DataFrame({"event_id": pdf["event_id"], "item_id": pdf["item_id"], "verdict": verdict,
                                "_left_c": pd.array(after, dtype="Int64")})
    return run


def stock_left(quantities, left: int) -> int:
    """What is left of a stock after requests in order, each accepted if there is enough."""
    for q in quantities:
        if q <= left:
            left -= int(q)
    return left


def usage_summary(quantities: np.ndarray, scales: int) -> tuple[list[int], list[int]]:
    """(small, least) of a stretch of requests, one number for each scale k.

    Between 2^k and 2^(k+1) of stock, requests under 2^k are accepted as long as the stock stays in the scale, those
    of 2^(k+1) and more are refused, and one between is accepted if it and the small ones before it fit. ``small[k]``:
    sum of the small ones; ``least[k]``: least of (a middle one + the small ones before it), or -1."""
    small, least = [], []
    for k in range(scales):
        q = quantities[quantities < (2 << k)]
        sums = q if len(q) == 0 or len(q) < (1 << 62) >> (k + 1) else q.astype(object)
        low = np.where(sums < (1 << k), sums, 0)
        before = np.cumsum(low) - low
        middle = (q >= (1 << k))
        small.append(int(low.sum()) if len(q) else 0)
        least.append(int((before + sums)[middle].min()) if middle.any() else -1)
    return small, least


def passes_whole(left: int, small: list[int], least: list[int]) -> int | None:
    """Stock after a stretch that leaves it in its scale, from the summary alone; None if it leaves the scale."""
    if left <= 0:
        return left
    k = left.bit_length() - 1
    if k < len(small) and (least[k] < 0 or least[k] > left) and left - small[k] >= 1 << k:
        return left - small[k]
    return None


def usage_starts(rows: DataFrame, scales: int) -> DataFrame:
    """(item_id, _chunk, _start_c): the stock at the start of every chunk of a hot item.

    rows: item_id, _chunk, _t_us, event_id, _qty_c, _stock_c, a chunk being a stretch of an item's requests in order.
    Chunks are summed up in parallel. The scan over an item's summaries only stops at a chunk in which the stock falls
    to a lower power of two, and asks for that chunk's rows; a stock has at most 63 of them, so there are at most
    63 rounds, each of one chunk an item, however many requests there are."""
    spark = rows.sparkSession
    kind = rows.schema["item_id"].dataType.simpleString()

    def summed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_t_us", "event_id"])
        small, least = usage_summary(pdf["_qty_c"].to_numpy(), scales)
        return pd.DataFrame({"item_id": pdf["item_id"].iloc[:1], "_chunk": pdf["_chunk"].iloc[:1], "small": [small],
                             "least": [least], "stock": int(pdf["_stock_c"].iat[0])})

    def walked(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_t_us", "event_id"])
        return pd.DataFrame({"item_id": pdf["item_id"].iloc[:1], "_chunk": pdf["_chunk"].iloc[:1],
                             "left": stock_left(pdf["_qty_c"].tolist(), int(pdf["_start_c"].iat[0]))})

    schema = f"item_id {kind}, _chunk int, small array<long>, least array<long>, stock long"
    todo: dict = {}
    for r in sorted(rows.groupBy("item_id", "_chunk").applyInPandas(summed, schema).collect(), key=lambda r: r._chunk):
        todo.setdefault(r.item_id, []).append(r)
    left = {item: rs[0].stock for item, rs in todo.items()}
    starts = []
    while todo:
        stops = []
        for item in list(todo):
            rs = todo[item]
            while rs:
                starts.append((item, rs[0]._chunk, left[item]))
                after = passes_whole(left[item], rs[0].small, rs[0].least)
                if after is None and len(rs) > 1:
                    stops.append((item, rs[0]._chunk, left[item]))
                    break
                left[item] = after
                rs = todo[item] = rs[1:]
            if not rs:
                del todo[item]
        if stops:
            frame = spark.createDataFrame(stops, f"item_id {kind}, _chunk int, _start_c long")
            there = rows.where(F.col("_chunk").isin(sorted({c for _, c, _ in stops}))).join(frame, ["item_id", "_chunk"])
            for r in there.groupBy("item_id", "_chunk").applyInPandas(
                    walked, f"item_id {kind}, _chunk int, left long").collect():
                left[r.item_id] = r.left
                todo[r.item_id] = todo[r.item_id][1:]
    return spark.createDataFrame(starts, f"item_id {kind}, _chunk int, _start_c long")


def usage_log(requests: DataFrame, items: DataFrame, chunk_rows: int = 1_000_000) -> DataFrame:
    """Consumption requests in time order: invalid (quantity <= 0, NULL, or finer than
    hundredths), not_found, insufficient (remaining stock < quantity) or accepted (stock decreases).

    requests: event_id, item_id, quantity, created_at;  items: id, current_stock.
    Output: event_id, item_id, verdict, stock_after. One join and one sorted stream per
    item with amounts as integer cents (exact); requests that are decided up front ride
    along, spread by their own id, and touch no stock.

    An item with more than ``chunk_rows`` requests is cut into range partitions of its requests in order, written by
    chunk; ``usage_starts`` finds the stock at the start of each, and the chunks are replayed independently.
    """
    it = items.select(F.col("id").alias("_item"), "current_stock")
    j = requests.join(it, requests.item_id == it._item, "left")
    q = F.col("quantity")
    cents = (q * 100).cast("decimal(20,4)")
    whole = cents == F.floor(cents)
    pre = F.when(q.isNull() | (q <= 0) | ~whole, "invalid").when(F.col("_item").isNull(), "not_found")
    j = j.withColumn("_pre", pre)
    spread_by = F.when(F.col("_pre").isNull(), F.xxhash64("item_id")).otherwise(F.xxhash64("event_id"))
    seq = j.select("event_id", "item_id", "_pre", (F.col("current_stock") * 100).cast("long").alias("_stock_c"),
                   F.when(F.col("_pre").isNull(), cents.cast("long")).alias("_qty_c"),
                   _micros("created_at").alias("_t_us"), spread_by.alias("_key"), F.lit(0).alias("_chunk"))
    hot = (seq.where("_pre IS NULL").groupBy("item_id").agg(F.count("*").alias("_n"), F.max("_stock_c").alias("_top"))
           .where(F.col("_n") > chunk_rows))
    size = hot.agg(F.sum(F.ceil(F.col("_n") / chunk_rows)).alias("chunks"), F.max("_top").alias("top")).first()
    if size.chunks:
        is_hot = hot.select(F.col("item_id").alias("_hot"))
        decide = seq.join(is_hot, F.col("item_id") == F.col("_hot"), "left")
        mine = F.col("_hot").isNotNull() & F.col("_pre").isNull()
        folder = f"{ensure_checkpoint_dir(seq.sparkSession).rstrip('/')}/usage-{uuid.uuid4().hex}"
        (decide.where(mine).drop("_hot", "_chunk", "_key", "_pre")
         .repartitionByRange(int(size.chunks), "item_id", "_t_us", "event_id")
         .withColumn("_chunk", F.spark_partition_id()).write.partitionBy("_chunk").parquet(folder))
        rows = seq.sparkSession.read.parquet(folder)
        starts = usage_starts(rows, max(1, int(size.top or 0).bit_length()))
        chunked = (rows.join(starts, ["item_id", "_chunk"]).select(
            "event_id", "item_id", F.lit(None).cast("string").alias("_pre"), F.col("_start_c").alias("_stock_c"), "_qty_c",
            "_t_us", F.xxhash64("item_id", "_chunk").alias("_key"), "_chunk"))
        seq = decide.where(~mine).drop("_hot").unionByName(chunked)
    seq = seq.repartition("_key").sortWithinPartitions("item_id", "_chunk", "_t_us", "event_id")
    types = {f.name: f.dataType.simpleString() for f in seq.schema.fields}
    res = seq.mapInPandas(_usage_stream(), f"event_id {types['event_id']}, item_id {types['item_id']}, "
                                           "verdict string, _left_c long")
    return res.select("event_id", "item_id", "verdict",
                      (F.col("_left_c").cast("decimal(20,0)") / 100).cast("decimal(12,2)").alias("stock_after"))
