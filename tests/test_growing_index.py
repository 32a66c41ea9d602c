"""The index whose lists follow the rows: sizes, appends, crashes, recall."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.operators import growing_index as G
from ledgerline.operators import vectors as V

SCHEMA = "id long, embedding array<double>"


def _frame(spark, n, seed, first=0, spread=0.35, dim=8, groups=40):
    rng = np.random.default_rng(seed)
    centers = np.random.default_rng(99).normal(0, 1, (groups, dim))
    v = centers[rng.integers(0, groups, n)] + rng.normal(0, spread, (n, dim))
    return spark.createDataFrame([(first + i, [float(x) for x in r]) for i, r in enumerate(v)], SCHEMA)


def _queries(kb, step):
    return kb.where(F.col("id") % step == 3).select(F.col("id").cast("string").alias("query_id"),
                                                    F.col("embedding").alias("query_vec"))


def _recall(spark, path, kb, beam, step=37):
    q = _queries(kb, step)
    r = V.recall_at_k(G.search(spark, path, q, k=10, beam=beam), V.nearest(kb, q, 10))
    return r.agg(F.avg("recall")).first()[0]


def _sizes(spark, path):
    return [r["count"] for r in G.lists(spark, path).groupBy("cell").count().collect()]


def test_lists_follow_the_rows_and_appends_split_them(spark, tmp_path):
    path = str(tmp_path / "index")
    kb = _frame(spark, 1200, 1)
    G.build_index(kb, path, list_rows=40, fanout=16)
    first = _sizes(spark, path)
    assert sum(first) == 1200 and len(first) >= 1200 / 40 and max(first) <= 80
    assert _recall(spark, path, kb, beam=12) >= 0.9
    more = _frame(spark, 1500, 2, first=10_000)
    G.append(more, path, list_rows=40, fanout=16)
    both = kb.unionByName(more)
    second = _sizes(spark, path)
    assert sum(second) == 2700 and len(second) > 1.5 * len(first)
    ids = [r.id for r in G.lists(spark, path).select("id").collect()]
    assert len(set(ids)) == len(ids) == 2700
    assert _recall(spark, path, both, beam=24) >= 0.9
    q = _queries(both, 97)
    every = G.search(spark, path, q, k=10, beam=10_000).select("query_id", "rank", "id")     # all lists: exact
    assert every.exceptAll(V.nearest(both, q, 10).select("query_id", "rank", "id")).count() == 0


def test_rows_of_a_generation_without_nodes_do_not_count(spark, tmp_path):
    path = str(tmp_path / "index")
    kb = _frame(spark, 200, 3)
    G.build_index(kb, path, list_rows=50, fanout=8)
    lost = G.lists(spark, path).select("id", "v", "cell", "part")
    lost.write.partitionBy("part").parquet(f"{path}/rows/gen=1")                               # crashed before its nodes
    assert G.lists(spark, path).count() == 200
    G.append(_frame(spark, 30, 4, first=500), path, list_rows=50, fanout=8)                    # writes generation 1 again
    assert G.lists(spark, path).count() == 230


def test_copies_zero_null_and_few_rows(spark, tmp_path):
    rows = [(i, [1.0, 2.0]) for i in range(300)] + [(1000, None), (1001, [0.0, 0.0]), (1002, [2.0, -1.0])]
    kb = spark.createDataFrame(rows, SCHEMA)
    path = str(tmp_path / "copies")
    G.build_index(kb, path, list_rows=20, fanout=4)
    assert G.lists(spark, path).count() == 301
    q = spark.createDataFrame([("a", [1.0, 2.0]), ("z", [0.0, 0.0])], "query_id string, query_vec array<double>")
    got = G.search(spark, path, q, k=2, beam=8).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.id, r.similarity) for r in got] == [("a", 1, 0, 1.0), ("a", 2, 1, 1.0)]
    few = str(tmp_path / "few")
    G.build_index(kb.where("id >= 1000"), few, list_rows=20)
    assert G.search(spark, few, q, k=2).collect()[0].id == 1002
    G.append(kb.where("id < 5"), few, list_rows=20)
    assert G.search(spark, few, q, k=9).count() == 6


def test_a_search_step_gives_one_row_for_each_query_and_node(spark):
    v = np.random.default_rng(5).normal(0, 1, (60, 8))
    kids = spark.createDataFrame([("r", [(f"r/{j}", [float(x) for x in r]) for j, r in enumerate(v)])],
                                 "cell string, kids array<struct<node: string, center: array<double>>>")
    at = spark.createDataFrame([("a", [float(x) for x in v[7]], "r", 0.0), ("a", [float(x) for x in v[7]], "r/9", -0.5)],
                               "query_id string, u array<double>, cell string, far double")
    met = G._kids_met(at, kids, beam=5)
    inner, leaf = sorted(met.collect(), key=lambda r: -len(r.best))
    assert [b.cell for b in inner.best] == [f"r/{j}" for j in np.argsort(-(v @ v[7]))[:5]]
    assert [(b.far, b.cell) for b in leaf.best] == [(-0.5, "r/9")]


def test_far_sorts_like_falling_cosines(spark):
    x = spark.sql("SELECT * FROM VALUES (0.5D), (NULL), (double('NaN')), (-1D), (1D) t(near)")
    order = lambda *by: [str(r.near) for r in x.orderBy(*by).collect()]
    assert order(G._far(F.col("near"))) == order(F.desc("near"))


def test_rows_of_one_list_do_not_meet_in_one_task(spark):
    rows = _frame(spark, 300, 6).select("id", F.col("embedding").alias("v"), F.expr("if(id < 0, 's', 'r')").alias("cell"))
    big = rows.groupBy("cell").agg(F.count("*").alias("n"))
    kids = G._centers(rows, big, 40, 16)
    plan = kids._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "SortMergeJoin" not in plan     # each task keeps its first 16
    ids = sorted((r.id for r in rows.collect()), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())[:8]
    v = {r.id: r.v for r in rows.collect()}
    assert [r.center for r in kids.orderBy("j").collect()] == [v[i] for i in ids]


@pytest.mark.parametrize("sf", ["0.1"])
def test_recall_of_the_registered_search(spark, sf):
    from ledgerline.plans.registry import QUERIES
    r = QUERIES["kb_search_lists_recall"](spark, f"/root/testdata/sf{sf}")
    assert r.agg(F.avg("recall")).first()[0] >= 0.9
