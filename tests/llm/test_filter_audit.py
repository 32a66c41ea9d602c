"""The filter audit against every order applied to every document."""
import re
from itertools import permutations
from math import factorial

from pyspark.sql import functions as F

from ledgerline.llm import filter_audit as A
from tests_llm_util import frame

DOCS, LABELS = "doc_id long, text string, source string", "doc_id long, quality int, toxic int"


def fails(docs):
    out = []
    for i, t, _ in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words))
        f += "C" * (100 * len(re.findall("[A-Z]", t)) > 2 * len(t)) + "D" * bool(re.search("[#$%&*|]", t))
        f += "E" * (i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs))
        out.append(set(f))
    return out


def brute(docs, labels):
    """Applies all 120 orders to each part, step by step."""
    failed = fails(docs)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    out, total = {}, {}
    for part in {s or "" for *_, s in docs}:
        mine = [(i, f) for (i, _, s), f in zip(docs, failed) if (s or "") == part]
        for order in permutations("ABCDE"):
            left = mine
            for k, x in enumerate(order):
                gone, left = [d for d in left if x in d[1]], [d for d in left if x not in d[1]]
                total[part, x] = total.get((part, x), 0) + len(gone)
                out[part, "".join(order), k + 1] = [
                    len(left), len(gone), sum(x in f for _, f in mine) - len(gone), sum(f == {x} for _, f in mine),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def compare(df, docs, labels):
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost,
                                              r.shapley) for r in df.collect()}
    assert got == brute(docs, labels)


def test_odd_documents(spark):
    long = " ".join(f"w{i}" for i in range(250))
    docs = [(1, long, "a"), (2, long, "a"), (2, long, "a"), (3, long + " #", "a"), (4, long.upper(), None), (5, None, "b"),
            (6, "", "b"), (7, "x " * 300, ""), (8, "  " + long, "b"), (None, long, "a"), (None, None, None),
            (9, "A\tB\x0bC\x1cD" * 100, "b"), (10, "Ab" * 49 + "\U0001F600 " * 3, "c"), (0, long, "z"), (11, "$", "c"),
            (12, "w " * 199, "c"), (13, ("q" * 98 + "ZZ ") * 1, "c")]
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, None), (3, 1, 1), (9, None, 1), (None, 1, 1), (99, 1, 1)]
    compare(A.filter_audit(frame(spark, docs, DOCS), frame(spark, labels, LABELS)), docs, labels)


def test_fixture_and_a_hot_text(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
            .select("doc_id", "text", "source").collect()]
    docs += [(10_000 + i, docs[0][1], f"src{i % 3}") for i in range(400)]
    labels = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
              .select("doc_id", "quality", "toxic").collect()]
    compare(A.filter_audit(frame(spark, docs, DOCS).repartition(4), frame(spark, labels, LABELS)), docs, labels)


def test_potential_of_games(spark):
    """The Shapley value by its definition over all orders, from any worths of 3 players."""
    worth = [0, 5, 7, 11, 2, 9, 9, 20]
    p = spark.range(1).select(A.potentials(F.array(*[F.lit(w) for w in worth]).cast("array<long>"), 3).alias("p")).first().p
    for i in range(3):
        by_orders = 0
        for order in permutations(range(3)):
            before = sum(1 << j for j in order[:order.index(i)])
            by_orders += worth[before | 1 << i] - worth[before]
        assert p[7] - p[7 & ~(1 << i)] == by_orders
    assert p[1] == factorial(3) * 5


def test_empty_tables_and_clashing_columns(spark):
    docs = [(1, "a b", "s"), (2, "a b", "s")]
    df = frame(spark, docs, DOCS).selectExpr("*", "1 AS failed", "'x' AS digest", "2 AS n", "'p' AS part", "0 AS id")
    labels = frame(spark, [(1, 1, 0)], LABELS).selectExpr("*", "'z' AS good", "5 AS id")
    compare(A.filter_audit(df, labels), docs, [(1, 1, 0)])
    assert A.filter_audit(df.limit(0), labels).count() == 0
    compare(A.filter_audit(df, labels.limit(0)), docs, [])
