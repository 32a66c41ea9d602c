"""Facet bitmaps and day sketches against plain counts."""

import datetime as dt
import random
from itertools import combinations

from pyspark.sql import functions as F

from ledgerline.operators import facet_index as FI
from ledgerline.operators import trend_sketches as TS

SCHEMA = "doc_id long, category string, risk_level string, materials array<string>, value string"


def _techniques(n, first=0):
    rnd = random.Random(n)
    cat = lambda: rnd.choice(["carving", "carving", "inlay", None])
    return [(first + i * 997, cat(), rnd.choice(["rare", "common"]), rnd.choice([None, [], ["oak"], ["oak", "ash", "oak"], ["ash", None]]), "z")
            for i in range(n)]


def _values(row):
    return {("category", row[1]), ("risk_level", row[2]), *(("material", m) for m in row[3] or [])} - {("category", None), ("material", None)}


def _want(rows, combo):
    return len({r[0] for r in rows if r[0] is not None and set(combo) <= _values(r)})


def test_any_combination_equals_plain_counts(spark):
    rows = _techniques(400) + _techniques(400)[:50] + [(None, "carving", "rare", ["oak"], "z")]
    index = FI.facet_bitmaps(spark.createDataFrame(rows, SCHEMA))
    assert index.agg(F.max("bucket")).first()[0] > 1
    every = [("category", "carving"), ("category", "inlay"), ("risk_level", "rare"), ("material", "oak"), ("material", "ash"),
             ("material", "none such")]
    combos = [c for k in (1, 2, 3) for c in combinations(every, k)]
    wanted = spark.createDataFrame([([*c],) for c in combos] + [([*combos[-1], combos[-1][0]],)], f"combo {FI.COMBO}")
    got = {tuple(tuple(f) for f in r.combo): r.n for r in FI.count_combinations(index, wanted).collect()}
    assert got == {tuple(sorted(c)): _want(rows, c) for c in combos}
    assert any(n > 0 and len(c) == 3 for c, n in got.items())


def test_new_rows_are_merged_and_ids_count_once(spark):
    old, new = _techniques(60), _techniques(90, first=500)
    index = FI.merge_bitmaps(*[FI.facet_bitmaps(spark.createDataFrame(r, SCHEMA)) for r in (old + new[:20], new)])
    combo = [("category", "carving"), ("material", "oak")]
    got = FI.count_combinations(index, spark.createDataFrame([(combo,)], f"combo {FI.COMBO}")).first().n
    assert got == _want(old + new, combo)


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert FI.facet_combinations(none, ["carving"], ["rare"]).count() == 0


def _talks(days, a_day):
    rnd, out = random.Random(3), []
    for d in range(days):
        for _ in range(a_day):
            out.append((dt.datetime(2024, 1, 1) + dt.timedelta(days=d, seconds=rnd.randrange(86_400)), f"c{rnd.randrange(3000)}",
                        rnd.randrange(10**6), rnd.random() < 0.2, rnd.choice([None, 100, 250])))
    return out


TALK = "created_at timestamp_ntz, sender_id string, session_id long, escalated boolean, response_time_ms int"


def test_weeks_from_stored_days(spark, tmp_path):
    rows = _talks(20, 400)
    df, path = spark.createDataFrame(rows, TALK).cache(), str(tmp_path / "days")
    TS.refresh_days(df.where("created_at < '2024-01-15'"), path, "2024-01-01 00:00:00")
    TS.refresh_days(df, path, "2024-01-12 00:00:00")                  # new days, and some once more
    TS.refresh_days(df, path, "2024-01-12 00:00:00")
    days = TS.stored_days(spark, path)
    assert days.count() == 20
    for unit in ("WEEK", "MONTH"):
        got = TS.within_error(df, days, unit, 0.06).collect()
        assert all(r.within_error for r in got) and sum(r.total for r in got) == len(rows)
    weeks = {r.span: (r.total, r.escalated) for r in TS.rollup(days, "WEEK").collect()}
    for span, have in weeks.items():
        mine = [r for r in rows if span <= r[0].date() < span + dt.timedelta(days=7)]
        assert have == (len(mine), sum(r[3] for r in mine))
    few = df.where("created_at < '2024-01-02'").limit(40)              # small counts are exact
    got = TS.rollup(TS.day_sketches(few), "DAY").first()
    assert got.unique_customers == few.select("sender_id").distinct().count()


def test_sketches_of_nulls_and_no_rows(spark):
    rows = [(None, None, None, None, None), (None, "a", 1, True, 5)]
    got = TS.rollup(TS.day_sketches(spark.createDataFrame(rows, TALK)), "WEEK").collect()
    assert [(r.span, r.total, r.escalated, r.unique_customers, r.unique_sessions) for r in got] == [(None, 2, 1, 1, 1)]
    assert TS.rollup(TS.day_sketches(spark.createDataFrame([], TALK)), "WEEK").count() == 0
