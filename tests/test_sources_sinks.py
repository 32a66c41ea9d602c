"""Feeds (paged JSON), versioned sinks, API formats and the written IVF index."""

import json
import re

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import transforms as T
from ledgerline.operators import vectors as V
from ledgerline.sources import adapters as ad
from ledgerline.sources.feeds import explode_page, page_total, read_feed
from ledgerline.sources.sinks import ConcurrentWrite, _publish, _versions, append, read_version, upsert_version, api_format, clear_table, current_version, read_current, to_json_rows, write_version
from ledgerline.sources.tables import Catalog

from fixture_paths import SF_SMALL


def test_paged_feed_to_services(spark, tmp_path):
    svc = [{"id": f"s{i}", "name": f"n{i}"} for i in range(250)]
    pages = [{"services": svc[i:i + 100], "pagingMetadata": {"total": len(svc)}} for i in range(0, 250, 100)]
    (tmp_path / "p.json").write_text("\n".join(json.dumps(p) for p in pages) + "\n")
    feed = read_feed(spark, str(tmp_path))
    assert page_total(feed).select(F.max("total")).first()[0] == 250
    recs = explode_page(feed, "services")
    got = T.parse_services(recs).select("wix_id", "title").collect()
    assert sorted((r.wix_id, r.title) for r in got) == sorted((s["id"], s["name"]) for s in svc)


def test_versioned_writes_and_clear(spark, tmp_path):
    base = str(tmp_path / "t")
    df = spark.range(5).withColumnRenamed("id", "k")
    assert write_version(df, base) == 1
    assert write_version(df.where("k < 2"), base) == 2
    assert current_version(spark, base) == 2 and read_current(spark, base).count() == 2
    with pytest.raises(ValueError):
        clear_table(spark, base, "students", ("ai_memory_sandbox",))
    assert clear_table(spark, base, "ai_memory_sandbox", ("ai_memory_sandbox",)) == 3
    assert read_current(spark, base).count() == 0
    assert read_version(spark, base, 1).count() == 5              # old versions stay readable


def test_a_failed_write_changes_and_blocks_nothing(spark, tmp_path):
    base = str(tmp_path / "t")
    assert write_version(spark.range(3), base) == 1
    bad = spark.range(3).select(F.when(F.col("id") == 2, F.raise_error(F.lit("boom"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="boom"):
        write_version(bad.select(F.col("id").cast("long").alias("id")), base)
    assert current_version(spark, base) == 1 and read_current(spark, base).count() == 3
    assert write_version(spark.range(7), base) == 2 and read_current(spark, base).count() == 7


def test_a_crash_between_folder_and_publication(spark, tmp_path):
    base = tmp_path / "t"
    write_version(spark.range(3), str(base))
    spark.range(9).write.parquet(str(base / "data-orphan"))              # written, never published
    (base / "_log" / "000000000002.json").write_text('{"parts": {"": "da')  # publication broke off
    assert current_version(spark, str(base)) == 1 and read_current(spark, str(base)).count() == 3
    assert write_version(spark.range(5), str(base)) == 3 and read_current(spark, str(base)).count() == 5


def test_two_writers_cannot_take_the_same_version(spark, tmp_path):
    base = str(tmp_path / "t")
    write_version(spark.range(1), base)
    with pytest.raises(ConcurrentWrite):
        _publish(spark, base, 1, {"parts": {}})
    assert read_current(spark, base).count() == 1


def test_append(spark, tmp_path):
    path = str(tmp_path / "a")
    append(spark.range(3), path)
    append(spark.range(2), path)
    assert spark.read.parquet(path).count() == 5


def test_upsert_rewrites_touched_buckets_and_skips_a_repeated_epoch(spark, tmp_path):
    base = str(tmp_path / "t")
    rows = spark.range(40).select(F.concat(F.lit("k"), "id").alias("k"), F.col("id").alias("o"), F.lit("a").alias("first"),
                                  F.lit("x").alias("last"))
    how = ("k", ["o"], ["o", "first"], ["last"])
    assert upsert_version(rows, base, *how, epoch=0, buckets=8) == 1
    before = _versions(spark, base)[1]["parts"]
    one = spark.createDataFrame([("k7", 100, "b", "y"), (None, 101, "n", "z")], "k string, o long, first string, last string")
    assert upsert_version(one, base, *how, epoch=1, buckets=8) == 2
    assert upsert_version(one, base, *how, epoch=1, buckets=8) is None               # the same micro-batch again
    after = _versions(spark, base)[2]["parts"]
    assert 1 <= sum(after[b] != before.get(b) for b in after) <= 2
    got = {r.k: (r.first, r.last) for r in read_current(spark, base).collect()}
    assert len(got) == 41 and got["k7"] == ("a", "y") and got[None] == ("n", "z") and got["k8"] == ("a", "x")


def test_api_format_and_json_rows(spark):
    df = spark.sql("SELECT CAST(1.5 AS DECIMAL(10,2)) AS amount, DATE'2024-01-02' AS d, "
                   "TIMESTAMP_NTZ'2024-01-02 03:04:05' AS t, 'x' AS s")
    row = api_format(df).first()
    assert (row.amount, row.d, row.t) == (1.5, "2024-01-02", "2024-01-02T03:04:05.000000")
    assert json.loads(to_json_rows(df).first().value) == {"amount": 1.5, "d": "2024-01-02",
                                                          "t": "2024-01-02T03:04:05.000000", "s": "x"}


def test_ivf_index_written_by_cell_and_recall(spark, tmp_path):
    c = Catalog(spark, SF_SMALL)
    kb = ad.knowledge_embeddings(c)
    path = str(tmp_path / "ivf")
    indexed, centers = V.build_ivf_index(kb, lists=4, path=path)
    assert len(centers) == 4
    assert sorted(p.name for p in (tmp_path / "ivf").iterdir() if p.name.startswith("cell="))[:1] == ["cell=0"]
    q = V.centroid_queries(kb)
    approx = V.kb_search_ivf(indexed, centers, q, k=10, n_probe=4)       # probing every cell is exact
    exact = V.nearest(kb, q, 10)
    rec = V.recall_at_k(approx, exact).select(F.min("recall")).first()[0]
    assert rec == 1.0
    some = V.recall_at_k(V.kb_search_ivf(indexed, centers, q, k=10, n_probe=1), exact)
    assert some.count() == q.count()


def test_exact_search_blocks_give_the_same_result(spark):
    c = Catalog(spark, SF_SMALL)
    kb = ad.knowledge_embeddings(c)
    q = kb.where("embedding IS NOT NULL").selectExpr("CAST(id AS STRING) AS query_id",
                                                     "transform(embedding, x -> CAST(x AS DOUBLE)) AS query_vec")
    whole = V.nearest(kb, q, 3).collect()
    split = V.nearest(kb, q, 3, query_block=20).collect()
    key = lambda r: (r.query_id, r.rank)
    a, b = sorted(whole, key=key), sorted(split, key=key)
    assert [(r.query_id, r.rank, r.id) for r in a] == [(r.query_id, r.rank, r.id) for r in b]
    # BLAS may sum in a different order for a different batch shape: last-bit differences only
    assert all(abs(x.similarity - y.similarity) < 1e-12 for x, y in zip(a, b))
    assert len(whole) == 3 * q.count()


def test_exact_search_with_many_queries(spark):
    """A hundred thousand queries against a small base: every one is answered; blocks bound the memory."""
    base = spark.range(64).select("id", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.sin(F.col("id") * 8 + i)).alias("embedding"))
    q = spark.range(100_000).select(F.col("id").cast("string").alias("query_id"),
                                    F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.cos(F.col("id") * 3 + i)).alias("query_vec"))
    got = V.nearest(base, q, 2)
    assert got.count() == 200_000


def test_zero_vectors_are_never_found_and_find_nothing(spark, tmp_path):
    kb = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [1.0, 1.0])], "id long, embedding array<double>")
    q = spark.createDataFrame([("a", [1.0, 0.1]), ("z", [0.0, 0.0])], "query_id string, query_vec array<double>")
    assert [(r.query_id, r.id) for r in V.nearest(kb, q, 9).orderBy("rank").collect()] == [("a", 1), ("a", 5), ("a", 3)]
    indexed, centers = V.build_ivf_index(kb, lists=2, path=str(tmp_path / "ivf"))
    got = V.kb_search_ivf(indexed, centers, q, k=9, n_probe=2)
    assert [(r.query_id, r.id) for r in got.orderBy("rank").collect()] == [("a", 1), ("a", 5), ("a", 3)]
    one = V.kb_search_ivf(indexed, centers, q, k=9, n_probe=1)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*cell", plan)
