"""Exact top-k search by inner product: a Voronoi kNN join.

Vectors are grouped by their nearest pivot. From summaries (for each group the smallest distances to its pivot; for
each query group the largest product with each pivot, the largest norm and the radius) follow a lower bound of a
query group's k-th best score and, for each single vector, an upper bound of its score with any query of the group.
Only vectors whose upper bound reaches the lower bound are replicated to the query group, where the queries are
solved by exact integer products. Groups are cut into blocks of bounded size; the blocks' best are ranked again.

Bounds are computed in double precision with a slack far above its error. Summaries hold at most pivots x (k + 1)
and pivots x pivots numbers. Defined results: vectors that are NULL or hold NULL or non-finite components, and rows
without an id, take no part; a missing component of a shorter vector counts as 0; a row is its own only to itself,
so repeated rows are candidates of each other (ties in score and id in table order).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm import samples
from ledgerline.llm.multi_index import _codebook, _distances
from ledgerline.session import cut_lineage

MAX_PIVOTS = 256
SAMPLE = 8_192
QUERY_BLOCK, BLOCK = 512, 16_384


def integer_vector(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component as bigint; NULL for vectors that take no part."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.when(F.coalesce(fine, F.lit(False)), F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def _matrix(column, dim: int, kind=np.float64) -> np.ndarray:
    out = np.zeros((len(column), dim), dtype=kind)
    for i, v in enumerate(column):
        out[i, :len(v)] = v
    return out


def _scores(queries: pd.Series, vectors: pd.Series, dim: int) -> np.ndarray:
    """Exact inner products: by doubles as far as all sums stay below 2**53, else by 64-bit integers."""
    q, v = _matrix(queries, dim), _matrix(vectors, dim)
    if np.abs(q).sum(1).max(initial=0) * np.abs(v).max(initial=0) < 2 ** 53:
        return (q @ v.T).astype(np.int64)
    return _matrix(queries, dim, np.int64) @ _matrix(vectors, dim, np.int64).T


def _best(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: highest score, then smallest id, then row."""
    if len(scores) > 4 * k:
        least = -np.partition(-scores, k - 1)[k - 1]
        some = np.flatnonzero(scores >= least)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((rows[some], ids[some], -scores[some]))[:k]]


def _teams(centers: np.ndarray, sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Puts query groups that lie next to each other together as long as their queries fit in a block: a vector that
    several of them need is sent once. (first places of the teams in the order, order of the groups)"""
    left, order = list(range(len(centers))), []
    at = 0
    while left:
        order.append(left.pop(at))
        if left:
            at = int(((centers[left] - centers[order[-1]]) ** 2).sum(1).argmin())
    starts, room = [], 0
    for i, g in enumerate(order):
        if sizes[g] > room:
            starts.append(i)
            room = most
        room -= int(sizes[g])
    return np.array(starts), np.array(order)


def top_k(df: DataFrame, is_query: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id",
          vector_col: str = "embedding", query_block: int = QUERY_BLOCK, block: int = BLOCK) -> DataFrame:
    """The k best of all other rows for each row that meets ``is_query``: query_id, rank, vec_id, score."""
    spark = df.sparkSession
    base = (df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("query"),
                      integer_vector(F.col(vector_col), scale).alias("v")).where("id IS NOT NULL AND v IS NOT NULL"))
    base = cut_lineage(base).withColumn("row", F.monotonically_increasing_id())
    size = base.agg(F.count("*").alias("n"), F.count_if("query").alias("q"), F.max(F.size("v")).alias("d")).first()
    n, dim = size["n"], size["d"] or 0
    if not n or not size["q"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    some = base.where(samples.picked(F.xxhash64(F.lit(2), "row"), n, SAMPLE))
    sample = _matrix(some.select("v").toArrow()["v"].to_pylist() or [[0] * dim], dim)
    rng = np.random.default_rng(1)
    pivots = _codebook(sample, int(min(MAX_PIVOTS, max(1, round(math.sqrt(n) / 4)), len(sample))), rng, rounds=5)
    p_count = len(pivots)

    def assign(batches):
        for pdf in batches:
            d = _distances(_matrix(pdf["v"], dim), pivots)
            cell = d.argmin(1)
            yield pdf.assign(cell=cell, dist=np.sqrt(d[np.arange(len(cell)), cell]))

    grouped = cut_lineage(base.mapInPandas(assign, "id long, query boolean, v array<long>, row long, cell int, dist double"))
    per_group = Window.partitionBy("cell").orderBy("dist", "row")
    near = (grouped.select("cell", "dist", "row").withColumn("place", F.row_number().over(per_group))
            .where(F.col("place") <= k + 1).select("cell", "dist").toArrow().to_pandas())       # pivots x (k + 1)
    of = near["cell"].to_numpy()
    reach = near["dist"].to_numpy()

    def bounds(batches):
        """For each query: the (k + 1)-th best lower bound (it may itself be among them)."""
        for pdf in batches:
            for a in range(0, len(pdf), 1_024):
                part = pdf.iloc[a:a + 1_024]
                q = _matrix(part["v"], dim)
                norm = np.sqrt((q * q).sum(1))
                with_pivot = q @ pivots.T
                low = with_pivot[:, of] - norm[:, None] * reach[None, :]
                kth = np.sort(low, axis=1)[:, -(k + 1)] if low.shape[1] > k else np.full(len(q), -np.inf)
                one = pd.DataFrame({"cell": part["cell"].to_numpy(), "low": kth, "norm": norm,
                                    "radius": part["dist"].to_numpy(), "n": 1})
                one = one.groupby("cell", as_index=False).agg({"low": "min", "norm": "max", "radius": "max", "n": "sum"})
                top = pd.DataFrame(with_pivot).groupby(part["cell"].to_numpy()).max()
                yield one.assign(top=[top.loc[c].to_numpy() for c in one["cell"]])

    summary = (grouped.where("query")
               .mapInPandas(bounds, "cell int, low double, norm double, radius double, n long, top array<double>"))
    whole = (summary.groupBy("cell").agg(
        F.min("low").alias("low"), F.max("norm").alias("norm"), F.max("radius").alias("radius"), F.sum("n").alias("n"),
        F.array(*[F.max(F.col("top")[j]) for j in range(p_count)]).alias("top"))
        .toArrow().to_pandas().sort_values("cell"))                                             # pivots x pivots
    starts, order = _teams(pivots[whole["cell"].to_numpy()], whole["n"].to_numpy(), query_block)
    whole = whole.iloc[order]
    groups = whole["cell"].to_numpy()
    low, norm, radius = (whole[c].to_numpy() for c in ("low", "norm", "radius"))
    top = np.stack(whole["top"].to_numpy())
    centers = pivots[groups]
    slack = 1e-6 * (1 + np.abs(top).max())
    q_blocks = np.maximum(1, np.ceil(np.add.reduceat(whole["n"].to_numpy(), starts) / query_block)).astype(np.int64)
    blocks = max(1, math.ceil(n / block))
    place = dict(zip(groups.tolist(), (np.searchsorted(starts, np.arange(len(groups)), "right") - 1).tolist()))

    def replicate(batches):
        for pdf in batches:
            for a in range(0, len(pdf), 2_048):
                part = pdf.iloc[a:a + 2_048]
                v, cell = _matrix(part["v"], dim), part["cell"].to_numpy()
                by_pivot = top[:, cell].T + norm[None, :] * part["dist"].to_numpy()[:, None]
                by_center = v @ centers.T + radius[None, :] * np.sqrt((v * v).sum(1))[:, None]
                need = np.logical_or.reduceat(np.minimum(by_pivot, by_center) + slack >= low[None, :], starts, axis=1)
                mix = part["row"].to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)
                out = []
                for r, c in zip(*(x.tolist() for x in np.nonzero(need))):
                    out += [(r, c, b, int(mix[r] % np.uint64(blocks)), False) for b in range(int(q_blocks[c]))]
                for r in np.flatnonzero(part["query"].to_numpy()).tolist():
                    c = place[int(cell[r])]
                    out += [(r, c, int(mix[r] % np.uint64(q_blocks[c])), b, True) for b in range(blocks)]
                if out:
                    rows, group, qb, cb, asks = zip(*out)
                    got = part.iloc[list(rows)][["id", "row", "v"]].reset_index(drop=True)
                    yield got.assign(group=group, qb=qb, cb=cb, asks=asks)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        asks = pdf["asks"].to_numpy()
        q, c = pdf[asks], pdf[~asks]
        ids, rows = c["id"].to_numpy(), c["row"].to_numpy()
        parts = []
        for a in range(0, len(q), 128):
            some = q.iloc[a:a + 128]
            if not len(c):
                break
            scores = _scores(some["v"], c["v"], dim)
            for s, qid, qrow in zip(scores, some["id"], some["row"]):
                best = _best(np.where(rows == qrow, np.iinfo(np.int64).min, s), ids, rows, k + 1)
                best = best[rows[best] != qrow][:k]
                parts.append(pd.DataFrame({"query_row": qrow, "query_id": qid, "row": rows[best], "vec_id": ids[best],
                                           "score": s[best]}))
        if not parts:
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("query_row", "query_id", "row", "vec_id", "score")})
        return pd.concat(parts, ignore_index=True)

    replicas = grouped.mapInPandas(replicate, "id long, row long, v array<long>, `group` int, qb long, cb long, asks boolean")
    solved = replicas.groupBy("group", "qb", "cb").applyInPandas(
        solve, "query_row long, query_id long, row long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row"))
    return (solved.withColumn("rank", rank).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
