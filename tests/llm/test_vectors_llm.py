"""Near-dedup and exact search of vectors against brute force."""
import numpy as np
import pytest

from ledgerline.llm import multi_index as M
from ledgerline.llm import voronoi_topk as V
from pyspark.sql import functions as F
from tests_llm_util import frame


def brute_links(rows, threshold):
    """rows: (id, vector or None, label). -> {position: (links, component)} and the number of links."""
    good = [i for i, (_, v, lab) in enumerate(rows) if lab is not None and v and all(
        x is not None and np.isfinite(x) for x in v) and any(v)]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i
    n = [0] * len(rows)
    for i in good:
        for j in good:
            if i < j and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1]), np.array(rows[j][1])
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold:
                    n[i] += 1
                    n[j] += 1
                    up[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, *_) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(n[i], least.get(find(i))) for i in range(len(rows))]


def cluster_rows(seed, n=240, dim=8):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        if i % 3 and out:
            v = np.array(out[rng.integers(0, len(out))][1]) + rng.normal(0, 0.02, dim)
        else:
            v = rng.normal(0, 1, dim)
        out.append((1000 - i, [float(x) for x in v], int(rng.integers(0, 3))))
    out += [(5000 + i, out[0][1], out[0][2]) for i in range(40)]                  # copies
    return out


@pytest.mark.parametrize("block,cell", [(2048, 1024), (16, 8)])
def test_near_vectors_on_clusters(spark, block, cell):
    rows = cluster_rows(block)
    df = frame(spark, rows, "vec_id long, embedding array<double>, label int").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in
           M.near_vectors(df, block_size=block, vectors_per_cell=cell).collect()}
    want = brute_links(rows, 0.93)
    found, there = sum(g[0] for g in got.values()), sum(w[0] for w in want)
    assert found <= there and found >= 0.97 * there
    assert got == {r[0]: (*w, r[0] == w[1]) for r, w in zip(rows, want)}


def test_near_vectors_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [], 1),
            (7, [0.0, 0.0], 1), (8, [1.0, None], 1), (9, [inf, 1.0], 1), (10, [nan, 1.0], 1), (11, [1.0], 1),
            (12, [3.0], 1), (None, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (13, [1e300, 1e300], 3), (14, [1e-300, 1e-300], 3)]
    df = frame(spark, rows, "vec_id long, embedding array<double>, label int").withColumn("n_links", F.lit("x"))
    got = sorted(((r.vec_id or 0), r.n_links, r.component_id or 0, r.kept) for r in M.near_vectors(df).collect())
    want = [(1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True),
            (6, 0, 6, True), (7, 0, 7, True), (8, 0, 8, True), (9, 0, 9, True), (10, 0, 10, True), (11, 1, 11, True),
            (12, 1, 11, False), (13, 1, 13, True), (14, 1, 13, False), (0, 3, 1, None)]
    assert got == sorted(want)
    assert M.near_vectors(df.limit(0)).count() == 0


def test_recall_on_the_fixture(spark):
    from ledgerline.llm.queries import op8_multi_index
    t = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toArrow()
    v = M._unit(np.array(t["embedding"].to_pylist(), dtype=np.float64))
    lab = t["label"].to_numpy()
    near = (v @ v.T >= 0.93) & (lab[:, None] == lab[None, :])
    np.fill_diagonal(near, False)
    want = dict(zip(t["vec_id"].to_pylist(), near.sum(1).tolist()))
    got = {r.vec_id: r.n_links for r in op8_multi_index(spark, "/root/testdata/sf0.1").collect()}
    assert got.keys() == want.keys() and all(got[i] <= want[i] for i in got)
    assert sum(got.values()) >= 0.99 * sum(want.values())


def test_recall_at_the_threshold():
    rng = np.random.default_rng(5)
    x = M._unit(rng.normal(0, 1, (4000, 64)))
    index = M.MultiIndex(x[:2000], 8, 0.93)
    y = rng.normal(0, 1, x.shape)
    y = M._unit(y - (y * x).sum(1, keepdims=True) * x)
    y = 0.9301 * x + np.sqrt(1 - 0.9301 ** 2) * y
    cx, cy = index.cells(x), index.cells(y)
    (fx, gx), (fy, gy) = index.visit(x), index.visit(y)
    hits = ((fx == cy[:, None]) & gx).any(1) | ((fy == cx[:, None]) & gy).any(1)
    assert hits.mean() >= 0.95


def brute_top(rows, k, divisor=20):
    ints = [(d, None if v is None or any(x is None or not np.isfinite(x) for x in v)
             else [int(np.floor(64 * x)) for x in v], i) for i, (d, v) in enumerate(rows)]
    ints = [r for r in ints if r[0] is not None and r[1] is not None]
    out = []
    for d, v, i in ints:
        if d % divisor == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), e) for e, w, j in ints if j != i)[:k]
            out += [(d, n + 1, e, -s) for n, (s, e) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("qb,cb", [(512, 16384), (3, 37)])
def test_top_k_matches_brute_force(spark, qb, cb):
    rng = np.random.default_rng(qb)
    centers = rng.normal(0, 1, (6, 5))
    rows = [(i, [float(x) for x in centers[i % 6] + rng.normal(0, 0.2, 5)]) for i in range(400)]
    rows += [(400 + i, rows[7][1]) for i in range(60)]                             # one hot vector: ties by id
    rows += [(20, rows[3][1]), (900, None), (901, [None] * 5), (902, [float("nan")] * 5), (None, rows[1][1]),
             (920, [float("inf")] * 5), (940, [0.0] * 5), (960, [1.0, -2.0]), (980, [])]
    df = frame(spark, rows, "vec_id long, embedding array<double>").repartition(4)
    got = V.top_k(df, F.col("vec_id") % 20 == 0, 20, query_block=qb, block=cb).collect()
    assert sorted(tuple(r) for r in got) == brute_top(rows, 20)


def test_top_k_few_rows_empty_and_huge_values(spark):
    schema = "vec_id long, embedding array<double>, score string"
    df = frame(spark, [(0, [1e7 + 1, 2.0], "a"), (1, [1e7 + 3, 1.0], "b"), (2, [-1.0, 0.5], "c")], schema)
    got = [tuple(r) for r in V.top_k(df, F.col("vec_id") % 20 == 0, 20).orderBy("rank").collect()]
    assert got == brute_top([(0, [1e7 + 1, 2.0]), (1, [1e7 + 3, 1.0]), (2, [-1.0, 0.5])], 20)
    assert V.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert V.top_k(df.where("vec_id > 0"), F.col("vec_id") % 20 == 0).count() == 0


def test_replicates_only_what_is_needed(spark):
    """Far groups are not sent to a query group."""
    rows = [(i, [10.0 + i % 7 / 100, 0.0]) for i in range(0, 200)] + [(i, [-10.0, i % 5 / 100]) for i in range(201, 400)]
    df = frame(spark, rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in V.top_k(df, F.col("vec_id") % 20 == 0, 5).collect()) == brute_top(rows, 5)


def test_visits_of_a_grid_of_more_than_4096_cells_reach_the_target():
    rng = np.random.default_rng(8)
    x = rng.standard_normal((400, 32))
    index = M.MultiIndex(x, 128, 0.1)
    assert index.k == [128, 128] and 4_096 < index.visits <= 128 * 128
    u = M._unit(x[:200])
    noise = rng.standard_normal(u.shape)
    noise = M._unit(noise - (noise * u).sum(1, keepdims=True) * u)
    v = 0.1 * u + np.sqrt(1 - 0.01) * noise
    there = [(index.visit(a, bound=False)[0] == index.cells(b)[:, None]).any(1) for a, b in ((u, v), (v, u))]
    assert (there[0] | there[1]).mean() >= 0.95
