"""Whitening of vectors by shifted CholeskyQR.

Entries become whole numbers, x = floor(scale * c) + offset. The fit list is each distinct x vector once, n of them with
sums S by dimension; rows are centred exactly, (n x - S) / n, before anything is multiplied. Three passes over the
list make its rows X = Q R with orthonormal columns of Q: a pass sums the Gram matrix of X R^-1 (each task solves the
triangular systems of its own rows), adds a small shift to its diagonal, takes the Cholesky factor and composes it with
R. The singular value decomposition of R gives the components: e = s^2 / n are the eigenvalues of X's covariance, the
right singular vectors its eigenvectors; the condition of X is never squared into them. A last pass measures the
covariance of the whitened list.

What leaves a task is one d x d matrix; matrices are added in groups of tasks, then the groups on the driver (64 at
most), so memory depends on the dimension only.

Defined results: a vector that is NULL, empty or holds a NULL or non-finite entry takes no part, nor does one of another
length than most have (ties: the longer); a direction whose standard deviation is under 1e-10 of the largest is no
component (a table of equal vectors gives no rows); rows with equal or NULL ids are vectors of their own; an empty table
gives no rows; other columns are ignored. An x beyond 2^53, or a deviation that a long can't hold, raises an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.session import cut_lineage

GROUPS = 64               # partial sums that reach the driver
PASSES = 3
RANK = 1e-10


def whole_numbers(df: DataFrame, id_col: str, vec_col: str, scale: int, offset: int) -> DataFrame:
    """(id, x): the vectors that take part, as arrays of long."""
    def finite(c):
        return F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False))
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
    rows = rows.where(F.coalesce(F.size("v") > 0, F.lit(False))).where(F.forall("v", finite))
    length = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1)
    rows = rows.where(F.size("v") == length.select("d").scalar())

    def entry(c):
        x = F.floor(c.cast("double") * scale)
        return F.when(F.abs(c.cast("double") * scale) < float(1 << 53), x.cast("long") + F.lit(offset).cast("long")
                      ).otherwise(F.raise_error(F.lit("an entry is too large")).cast("long"))
    return rows.select("id", F.transform("v", entry).alias("x"))


def centred(x: pd.Series, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S/n, from the exact whole number n x - S where 64 bits hold it."""
    whole = np.array(x.tolist(), dtype=np.int64).reshape(len(x), len(sums))
    if n * (float(np.abs(whole).max(initial=0)) + 1) < 2 ** 62:
        return (n * whole - sums.astype(np.int64)) / n
    return ((whole.astype(object) * n - sums) / n).astype(np.float64)


def solved(rows: np.ndarray, r: np.ndarray | None) -> np.ndarray:
    """rows R^-1 for an upper triangle R."""
    if r is None:
        return rows
    out = np.empty_like(rows)
    for j in range(r.shape[0]):                       # column by column, from the first: a triangular solve
        out[:, j] = (rows[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
    return out


def gram(fit: DataFrame, shape: int, of: Callable[[pd.Series], np.ndarray]) -> np.ndarray:
    """Sum of Yt Y over the rows Y = of(x) of the fit list."""
    def by_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((shape, shape))
        for b in batches:
            y = of(b["x"])
            total += y.T @ y
        yield pd.DataFrame({"part": [TaskContext.get().partitionId() % GROUPS], "total": [total.tobytes()]})

    def together(b: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(t) for t in b["total"])
        return pd.DataFrame({"part": b["part"].iloc[:1], "total": [total.tobytes()]})

    sums = (fit.mapInPandas(by_task, "part int, total binary").groupBy("part")
            .applyInPandas(together, "part int, total binary").collect())
    total = np.zeros(shape * shape)
    for s in sorted(sums, key=lambda s: s.part):
        total = total + np.frombuffer(s.total)
    return total.reshape(shape, shape)


def triangle(fit: DataFrame, n: int, sums: np.ndarray, passes: int = PASSES) -> np.ndarray:
    """R of the centred fit list by shifted CholeskyQR: (X R^-1)t (X R^-1) is the identity on the list's range."""
    d = len(sums)
    r = None
    for k in range(passes):
        last = r
        g = gram(fit, d, lambda x: solved(centred(x, n, sums), last))
        norm = float(np.linalg.norm(g, 2))
        if norm == 0.0:
            return np.zeros((d, d))
        # The shift covers the rounding of the sum; after the first pass it is the least that keeps the factor whole.
        shift = (11.0 * (d * np.log2(n + 2) + d * (d + 1)) if k == 0 else d) * np.finfo(float).eps * norm
        while True:
            try:
                factor = np.linalg.cholesky(g + shift * np.eye(d)).T
                break
            except np.linalg.LinAlgError:
                shift *= 10
        r = factor if r is None else factor @ r
    return r


class Whitening:
    """Components of a fit list: n, sums, e (falling), vectors (d x k), explained, identity_error."""

    def __init__(self, fit: DataFrame, n: int, sums: np.ndarray, most: int):
        self.n, self.sums = n, sums
        r = triangle(fit, n, sums)
        _, s, right = np.linalg.svd(r)
        k = min(most, int((s > RANK * s[0]).sum())) if s[0] > 0 else 0
        variance = s ** 2 / n
        self.e, self.vectors = variance[:k], right[:k].T
        self.explained = self.e / variance.sum() if k else self.e
        self.identity_error = 0.0
        if k:
            n_, sums_, weights = n, sums, self.weights()
            # a column of ones beside the rows gives their sums, for the covariance of what comes out
            both = gram(fit, k + 1, lambda x: np.hstack([centred(x, n_, sums_) @ weights, np.ones((len(x), 1))]))
            mean = both[:k, k] / n
            self.identity_error = float(np.abs(both[:k, :k] / n - np.outer(mean, mean) - np.eye(k)).max())

    def weights(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.e)


def fit_list(rows: DataFrame) -> tuple[DataFrame, int, np.ndarray]:
    """(each distinct x once, their number, exact sums by dimension)."""
    fit = cut_lineage(rows.select("x").distinct())
    sums = (fit.select(F.posexplode("x").alias("j", "x")).groupBy("j")
            .agg(F.count("*").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("s")).orderBy("j").collect())
    n = sums[0].n if sums else 0
    return fit, n, np.array([int(r.s) for r in sums], dtype=object)


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 16, scale: int = 64,
           offset: int = 1_000_000) -> DataFrame:
    """One row for each vector that takes part and each component (numbered from 1, by falling eigenvalue)."""
    rows = whole_numbers(df, id_col, vec_col, scale, offset)
    kind = df.schema[id_col].dataType.simpleString()
    schema = (f"{id_col} {kind}, component int, n long, deviation long, whitened double, explained double, "
              "identity_error double")
    fit, n, sums = fit_list(rows)
    if n == 0:
        return df.sparkSession.createDataFrame([], schema)
    model = Whitening(fit, n, sums, components)
    weights, explained, error, k = model.weights(), model.explained, model.identity_error, len(model.e)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if k == 0:
                continue
            x = np.array(b["x"].tolist(), dtype=np.int64).reshape(len(b), len(sums))
            far = (n * (x.astype(np.float64) - (sums / n).astype(np.float64))) ** 2
            if n * (float(np.abs(x).max(initial=0)) + 1) < 2 ** 62 and float(far.sum(axis=1).max(initial=0)) < 2 ** 62:
                deviation = ((n * x - sums.astype(np.int64)) ** 2).sum(axis=1)
            else:
                exact = [int(d) for d in ((x.astype(object) * n - sums) ** 2).sum(axis=1)]
                if max(exact) >= 1 << 63:
                    raise OverflowError("a deviation is too large for a long")
                deviation = np.array(exact, dtype=np.int64)
            y = centred(b["x"], n, sums) @ weights
            yield pd.DataFrame({
                id_col: b["id"].repeat(k).to_numpy(), "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(b)),
                "n": n, "deviation": np.repeat(deviation, k), "whitened": y.ravel(),
                "explained": np.tile(explained, len(b)), "identity_error": error})

    return rows.mapInPandas(score, schema)
