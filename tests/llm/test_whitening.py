"""Whitening against numpy on the whole fit list."""
import numpy as np
import pytest

from ledgerline.llm import whitening as W
from tests_llm_util import frame

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, most=16):
    """rows: (id, vector). -> {(id, component): ...}, e, vectors; all in plain numpy and whole numbers."""
    fine = [(i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    lengths = [len(v) for _, v in fine]
    d = max(set(lengths), key=lambda n: (lengths.count(n), n))
    xs = [(i, tuple(int(np.floor(64 * c)) + 1_000_000 for c in v)) for i, v in fine if len(v) == d]
    fit = sorted({x for _, x in xs})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[(n * a - s) / n for a, s in zip(x, sums)] for x in fit])
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1], u[:, ::-1]
    k = min(most, int((e > 1e-18 * e[0]).sum()))
    out = []
    for i, x in xs:
        c = np.array([(n * a - s) / n for a, s in zip(x, sums)])
        dev = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        out.append((i, n, dev, c @ u[:, :k] / np.sqrt(e[:k])))
    return out, e[:k] / e.sum(), u


def compare(got, rows, most=16, rel=1e-7):
    want, explained, _ = brute(rows, most)
    k = len(explained)
    assert len(got) == k * len(want)
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.deviation, r.n), []).append(r)
    signs = None
    for i, n, dev, y in want:
        some = sorted(by[i, dev, n], key=lambda r: r.component)
        some = {r.component: r for r in some}
        have = np.array([some[j + 1].whitened for j in range(k)])
        if signs is None and np.abs(y).min() > 1e-3:
            signs = np.sign(have * y)
        assert [some[j + 1].explained for j in range(k)] == pytest.approx(list(explained), rel=1e-9)
        assert some[1].identity_error <= 1e-9
    assert signs is not None
    for i, n, dev, y in want:
        have = np.array([{r.component: r for r in by[i, dev, n]}[j + 1].whitened for j in range(k)])
        assert have == pytest.approx(signs * y, rel=rel, abs=rel)


def test_against_numpy(spark):
    rng = np.random.default_rng(3)
    mix = rng.normal(0, 1, (20, 20)) * np.logspace(0, -1.2, 20)[:, None]
    rows = [(i, [float(c) for c in rng.normal(0, 3, 20) @ mix]) for i in range(500)]
    rows += [(1000 + i, rows[3][1]) for i in range(300)]                          # copies count once in the fit
    df = frame(spark, rows, SCHEMA).repartition(5)
    compare(W.whiten(df).collect(), rows)


def test_fixture(spark):
    from ledgerline.llm.queries import op13_whitening
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
            .select("vec_id", "embedding").collect()]
    got = op13_whitening(spark, "/root/testdata/sf0.01").collect()
    compare(got, rows)
    assert len(got) == 16 * len(rows)


def test_directions_without_variance_are_no_components(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(0, 4, (60, 2))
    rows = [(i, [float(a), float(a), 1.0, float(b), 7.5]) for i, (a, b) in enumerate(base)]
    got = W.whiten(frame(spark, rows, SCHEMA)).collect()
    assert {r.component for r in got} == {1, 2}
    compare(got, rows)
    assert W.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])], SCHEMA)).count() == 0
    few = [(1, [1.0, 2.0, 0.0]), (2, [3.0, -2.0, 0.5])]
    got = W.whiten(frame(spark, few, SCHEMA)).collect()
    assert {r.component for r in got} == {1} and sorted(abs(r.whitened) for r in got) == pytest.approx([1.0, 1.0])


def test_odd_rows_empty_tables_and_clashing_columns(spark):
    inf, nan = float("inf"), float("nan")
    rng = np.random.default_rng(5)
    rows = [(i, [float(c) for c in rng.normal(0, 1, 3)]) for i in range(30)]
    odd = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [inf, 1.0, 1.0]), (104, [nan, 1.0, 1.0]), (105, [1.0, 2.0]),
           (7, rows[7][1]), (None, rows[8][1])]
    df = frame(spark, rows + odd, SCHEMA).selectExpr("*", "1 AS x", "'a' AS id", "2 AS n", "3 AS component")
    got = W.whiten(df).collect()
    want = brute([r for r in rows + odd if r[0] is not None])[0]
    assert len(got) == 3 * (len(want) + 1) and sum(r.vec_id is None for r in got) == 3
    assert sum(r.vec_id == 7 for r in got) == 6
    assert W.whiten(df.limit(0)).count() == 0 and W.whiten(df.where("vec_id >= 100 AND vec_id < 105")).count() == 0


def test_deviation_is_exact_beyond_doubles_and_too_large_ones_raise(spark):
    rows = [(i, [float(i % 7) * 2e3, float(i % 11) * 4e3]) for i in range(200)]
    got = {r.vec_id: r.deviation for r in W.whiten(frame(spark, rows, SCHEMA)).where("component = 1").collect()}
    assert got == {i: dev for i, _, dev, _ in brute(rows)[0]} and max(got.values()) > 1 << 53
    with pytest.raises(Exception, match="too large"):
        W.whiten(frame(spark, [(1, [1e12, 0.0]), (2, [0.0, 1e12]), (3, [1.0, 1.0])], SCHEMA)).collect()
    with pytest.raises(Exception, match="too large"):
        W.whiten(frame(spark, [(1, [1e300, 0.0]), (2, [0.0, 1.0])], SCHEMA)).collect()


def test_composed_factor_is_triangular_and_orthogonalises(spark):
    rng = np.random.default_rng(6)
    x = rng.integers(-50, 50, (400, 6)) * np.array([1, 1, 1, 1, 1, 1000])
    x[:, 1] = x[:, 0] + (x[:, 1] > 45)                                            # nearly the same direction
    fit = frame(spark, [(r,) for r in {tuple(int(c) for c in r) for r in x}], "x array<long>").repartition(3)
    rows = np.array([r.x for r in fit.collect()], dtype=float)
    sums = np.array([int(s) for s in rows.sum(0)], dtype=object)
    r = W.triangle(fit, len(rows), sums)
    q = W.solved(rows - rows.mean(0), r)
    assert np.abs(np.tril(r, -1)).max() == 0 and np.abs(q.T @ q - np.eye(6)).max() < 1e-12
