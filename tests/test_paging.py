"""Pages at any offset against the whole order."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import paging as P


def _rows(n, seed, hot=0.0, nulls=0.1):
    rnd, t0 = random.Random(seed), dt.datetime(2024, 1, 1)
    out = []
    for i in range(n):
        t = None if rnd.random() < nulls else t0 if rnd.random() < hot else t0 + dt.timedelta(microseconds=rnd.randrange(-10**15, 10**13))
        out.append((t, None if i == 7 else i, "x"))
    return out


def _order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, -(r[0] - P.EPOCH).total_seconds() if r[0] else 0,
                                       -(r[0] - P.EPOCH).microseconds if r[0] else 0, r[1] is not None, r[1] or 0))


@pytest.mark.parametrize("hot, nulls", [(0.0, 0.1), (0.8, 0.1), (0.2, 0.7), (0.0, 1.0)])
def test_every_page_is_the_one_of_the_whole_order(spark, hot, nulls, monkeypatch):
    monkeypatch.setattr(P, "BINS", 32)
    rows = _rows(300, 5, hot, nulls)
    df = spark.createDataFrame(rows, "created_at timestamp_ntz, id long, clash string").coalesce(2).cache()
    want = _order(rows)
    for offset in (0, 29, 213, 295, 300):
        got = [tuple(r) for r in P.page_at(df, 10, offset, target_rows=12).collect()]
        assert got == want[offset:offset + 10], offset


def test_only_a_narrow_range_is_sorted(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i), i) for i in range(20_000)]
    spark.createDataFrame(rows, "created_at timestamp_ntz, id long").write.parquet(str(tmp_path / "t"))
    page = P.page_at(spark.read.parquet(str(tmp_path / "t")), 5, 10_000, target_rows=50)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(created_at), LessThanOrEqual(created_at" in plan and "Or(" not in plan
    assert [r.id for r in page.collect()] == list(range(9_999, 9_994, -1))


def test_empty_table_and_bad_arguments(spark):
    empty = spark.createDataFrame([], "created_at timestamp_ntz, id long")
    assert P.page_at(empty, 5, 0).count() == 0
    with pytest.raises(ValueError):
        P.page_at(empty, 0, 0)
    with pytest.raises(ValueError):
        P.conversation_page_at(empty.withColumn("channel", F.lit("x")), limit=2001)
