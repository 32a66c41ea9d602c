"""A9 at any offset: a page of rows, newest first, without a heap of offset + limit rows.

The place of a row in the order (time descending with NULL times first, then id ascending with NULL ids first) is found
by counting: the range of times that holds the offset is cut into ``BINS`` equal ones, a partial aggregation counts
each, and the one that holds the offset is cut again, until it holds at most ``target_rows`` rows. Where one time alone
holds more, its ids are cut in the same way. The same is done for the last row of the page, and only the rows between
the two are sorted. Every count reads a narrower range of times, which reaches the scan as a filter; the driver sees
at most ``BINS`` counts at a time, whatever the table holds.

Defined results: an offset behind the last row gives no rows; rows with equal time and id stay together and come in any
order; the table must not change while the page is built (it is read once a step).
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.core import epoch_micros, newest_first, ts_ntz
from ledgerline.operators.analytics import PAGE_COLUMNS

BINS = 4096
TARGET_ROWS = 100_000
EPOCH = dt.datetime(1970, 1, 1)


@dataclass(frozen=True)
class _Span:
    """Keys ``lo`` to ``hi`` (both None: the rows without a key), with ``before`` rows in front of them."""
    lo: int | None
    hi: int | None
    before: int
    rows: int


def _bins_of(rows: DataFrame, key: Column, lo: int, step: int) -> list[tuple[int, int]]:
    place = F.call_function("div", key - F.lit(lo).cast("long"), F.lit(step).cast("long"))
    return sorted((r["place"], r["count"]) for r in rows.groupBy(place.alias("place")).count().collect())


def _narrow(rows: DataFrame, key: Column, between, position: int, target_rows: int) -> _Span:
    """The span of ascending keys (NULL first) that holds the row at ``position``."""
    s = rows.agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count(F.lit(1)).alias("n"), F.count(key).alias("known")).first()
    nulls = s["n"] - s["known"]
    if position < nulls:
        return _Span(None, None, 0, nulls)
    lo, hi, before, inside = s["lo"], s["hi"], nulls, s["known"]
    while inside > target_rows and lo < hi:
        step = -(-(hi - lo + 1) // BINS)
        for place, n in _bins_of(rows.where(between(lo, hi)), key, lo, step):
            if position < before + n:
                lo, hi, inside = lo + place * step, min(hi, lo + (place + 1) * step - 1), n
                break
            before += n
    return _Span(lo, hi, before, inside)


def page_at(df: DataFrame, limit: int, offset: int, time_col: str = "created_at", id_col: str = "id",
            target_rows: int = TARGET_ROWS) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of ``df``, newest first (zone-less times, integer ids)."""
    if limit < 1 or offset < 0:
        raise ValueError("limit must be positive and offset not negative")
    time, key, ids = F.col(time_col), -epoch_micros(time_col), F.col(id_col).cast("long")

    def times(lo: int, hi: int) -> Column:         # keys are negated times, so the largest key is the oldest time
        return time.between(_moment(-hi), _moment(-lo))

    def locate(position: int) -> tuple[_Span, _Span | None]:
        span = _narrow(df, key, times, position, target_rows)
        if span.rows <= target_rows:
            return span, None
        same = df.where(time.isNull() if span.lo is None else times(span.lo, span.hi))
        return span, _narrow(same, ids, ids.between, position - span.before, target_rows)

    total = df.count()
    if offset >= total:
        return df.limit(0)
    first, first_ids = locate(offset)
    last, last_ids = locate(min(offset + limit, total) - 1)

    parts = []                                     # from the first row on, and up to the last one
    if first.lo is not None:
        parts.append(time <= _moment(-first.lo))
        if first_ids and first_ids.lo is not None:
            parts.append((ids >= first_ids.lo) | (time < _moment(-first.lo)))
    elif first_ids and first_ids.lo is not None:
        parts.append(time.isNotNull() | (ids >= first_ids.lo))
    end = time.isNull() if last.lo is None else time >= _moment(-last.hi)
    if last_ids:
        to_id = ids.isNull() if last_ids.lo is None else ids.isNull() | (ids <= last_ids.hi)
        end = end & (to_id if last.lo is None else to_id | (time > _moment(-last.hi)))
    parts.append(end if first.lo is not None or last.lo is None else time.isNull() | end)
    skip = offset - first.before - (first_ids.before if first_ids else 0)
    return df.where(reduce(and_, parts)).orderBy(newest_first(time_col), id_col).offset(skip).limit(limit)


def _moment(us: int) -> Column:
    return ts_ntz(EPOCH + dt.timedelta(microseconds=us))


def conversation_page_at(conversations: DataFrame, channel: str | None = None, limit: int = 50, offset: int = 0,
                         target_rows: int = TARGET_ROWS) -> DataFrame:
    """``conversation_page`` for any offset."""
    if not 1 <= limit <= 2000:
        raise ValueError("limit must be in 1..2000")
    rows = conversations.where(F.col("channel") == channel) if channel else conversations
    return page_at(rows.select(*PAGE_COLUMNS), limit, offset, target_rows=target_rows)
