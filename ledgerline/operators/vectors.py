"""Vector search over an embedding column (cosine similarity).

Exact search (V24/V25) scans the knowledge base once. Queries stay distributed:
they are packed into blocks of bounded size, the base into blocks too, and every
base block meets every query block in an equi-join on the block number (a small
query table is broadcast by its measured size, a large one is shuffled). A task
scores a pair of blocks with one BLAS product, keeps a running top-k for each
query and emits it once, so the shuffle never carries all (query, row) pairs.

Approximate search (V26) clusters the base with MLlib KMeans (cosine), maps
each query to its nearest cells and equi-joins on the cell id, then ranks
exactly inside the probed cells. Vectors of length zero have no direction: they
are never found, and as queries find nothing.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

QUERY_BLOCK = 1_024               # queries of a block, about
ROW_BLOCK = 2_048                 # base rows of a block
OPEN_BLOCKS = 16                  # query blocks whose running top-k a task holds


def centroid_queries(kb: DataFrame, group_col: str = "category", vec_col: str = "embedding") -> DataFrame:
    """One query vector per group: the mean of the group's vectors (a partial aggregate of one vector a group)."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    v = kb.where(F.col(vec_col).isNotNull()).select(
        F.col(group_col).cast("string").alias("query_id"),
        array_to_vector(F.col(vec_col).cast("array<double>")).alias("v"))
    return v.groupBy("query_id").agg(Summarizer.mean(F.col("v")).alias("m")).select(
        "query_id", vector_to_array("m").alias("query_vec"))


def _unit(rows) -> np.ndarray:
    """Rows scaled to length one; NaN for rows of length zero."""
    m = np.vstack([np.asarray(r, dtype=np.float64) for r in rows])
    n = np.linalg.norm(m, axis=1, keepdims=True)
    n[n == 0] = np.nan
    return m / n


def _packed_queries(queries: DataFrame, size: int) -> tuple[DataFrame, "F.Column"]:
    """(query blocks: qb, ids, mat; number of blocks). Lazy: the count is a scalar subquery."""
    blocks = F.greatest(F.lit(1), F.ceil(queries.agg(F.count(F.lit(1))).scalar() / F.lit(size))).cast("int")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"qb": [int(pdf["qb"].iloc[0])], "ids": [pdf["query_id"].tolist()],
                             "mat": [_unit(pdf["query_vec"]).tobytes()]})

    numbered = queries.select(F.col("query_id").cast("string").alias("query_id"), "query_vec").withColumn(
        "qb", F.pmod(F.xxhash64("query_id"), blocks).cast("int"))
    return numbered.groupBy("qb").applyInPandas(pack, "qb int, ids array<string>, mat binary"), blocks


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: highest score, then smallest id."""
    some = np.flatnonzero(~np.isnan(scores))
    if len(some) > k:
        least = np.partition(scores[some], len(some) - k)[len(some) - k]
        some = some[scores[some] >= least]                       # every tie at the boundary
    return some[np.lexsort((ids[some], -scores[some]))[:k]]


def nearest(kb: DataFrame, queries: DataFrame, k: int, id_col: str = "id", vec_col: str = "embedding",
            carry: tuple[str, ...] = (), query_block: int = QUERY_BLOCK) -> DataFrame:
    """Exact top-k rows by cosine similarity for every query (query_id, query_vec).
    Output: query_id, rank, id, carried columns, similarity (double)."""
    carry = list(carry)
    kind = {f.name: f.dataType.simpleString() for f in kb.select(id_col, *carry).schema.fields}
    row_type = "struct<" + ",".join(f"`{c}`:{t}" for c, t in kind.items()) + ">"
    packed, blocks = _packed_queries(queries, query_block)

    def pack_rows(batches):
        for pdf in batches:
            for a in range(0, len(pdf), ROW_BLOCK):
                part = pdf.iloc[a:a + ROW_BLOCK]
                yield pd.DataFrame({"base": [part["row"].tolist()], "base_mat": [_unit(part["v"]).tobytes()]})

    base = (kb.where(F.col(vec_col).isNotNull())
            .select(F.struct(id_col, *carry).alias("row"), F.col(vec_col).alias("v"))
            .mapInPandas(pack_rows, f"base array<{row_type}>, base_mat binary")
            .withColumn("nb", blocks).withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).drop("nb"))

    def emit(done):
        out = [(q, *[r[c] for c in kind], s) for ids, best in done for q, rows in zip(ids, best) for s, _, r in rows]
        return pd.DataFrame(out, columns=["query_id", *kind, "similarity"])

    def score(batches):
        held: dict[int, tuple[list, list]] = {}
        for pdf in batches:
            for qb, ids, mat, rows, base_mat in zip(pdf["qb"], pdf["ids"], pdf["mat"], pdf["base"], pdf["base_mat"]):
                q = np.frombuffer(mat).reshape(len(ids), -1)
                x = np.frombuffer(base_mat).reshape(len(rows), -1)
                rid = np.array([r[id_col] for r in rows])
                if qb not in held:
                    if len(held) >= OPEN_BLOCKS:
                        yield emit([held.pop(next(iter(held)))])
                    held[qb] = (list(ids), [[] for _ in ids])
                best = held[qb][1]
                for a in range(0, len(q), 256):
                    sims = q[a:a + 256] @ x.T
                    for j, s in enumerate(sims):
                        old = best[a + j]
                        if len(old) == k and not (s >= old[-1][0]).any():
                            continue
                        new = [(float(s[i]), rid[i], rows[i]) for i in _top(s, rid, k)]
                        best[a + j] = sorted(old + new, key=lambda t: (-t[0], t[1]))[:k]
        if held:
            yield emit(held.values())

    fields = ", ".join(f"`{c}` {t}" for c, t in kind.items())
    local = base.join(packed, "qb").select("qb", "ids", "mat", "base", "base_mat").mapInPandas(
        score, f"query_id string, {fields}, similarity double")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), F.asc(id_col))
    return (local.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", "rank", id_col, *carry, "similarity"))


# ----------------------------------------------------------------------------- V24
def kb_search(kb: DataFrame, queries: DataFrame, k: int = 3, min_similarity: float = 0.12) -> DataFrame:
    """Top k first, then the similarity threshold (so fewer than k may return);
    similarity rounded to 4 places; a zero confidence reads as NULL."""
    if not 1 <= k <= 10:
        raise ValueError("k must be in 1..10")
    top = nearest(kb, queries, k, carry=("question", "answer", "category", "confidence"))
    return (top.where(F.col("similarity") >= min_similarity)
            .select("query_id", "rank", "id", "question", "answer", "category",
                    F.when(F.col("confidence") != 0, F.col("confidence")).alias("confidence"),
                    F.when(F.col("similarity") != 0, F.round("similarity", 4)).alias("similarity")))


# ----------------------------------------------------------------------------- V25
def memory_search(table: DataFrame, queries: DataFrame, k: int = 5, content_col: str = "question") -> DataFrame:
    """Top k memories per query with their score; no threshold."""
    if not 1 <= k <= 50:
        raise ValueError("k must be in 1..50")
    top = nearest(table.withColumnRenamed(content_col, "content"), queries, k, carry=("content",))
    return top.select("query_id", "rank", "id", "content", F.round("similarity", 4).alias("score"))


# ----------------------------------------------------------------------------- V26
def build_ivf_index(kb: DataFrame, lists: int | None = None, seed: int = 7, vec_col: str = "embedding",
                    path: str | None = None):
    """Cluster the vectors (KMeans, cosine) and tag each row with its cell; ``lists`` defaults to the square root of
    the number of rows. With ``path`` the index is written partitioned by cell, so a probe reads only the probed
    cells' files. Returns (indexed DataFrame, centers as numpy)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    some = F.exists(vec_col, lambda x: x != 0)
    base = kb.where(F.col(vec_col).isNotNull() & some).withColumn("_v", array_to_vector(vec_col))
    if lists is None:
        lists = max(2, round(math.sqrt(base.count())))
    model = KMeans(k=lists, seed=seed, distanceMeasure="cosine", featuresCol="_v", predictionCol="cell",
                   maxIter=20).fit(base)
    indexed = model.transform(base).drop("_v")
    if path:
        indexed.write.mode("overwrite").partitionBy("cell").parquet(path)
        indexed = kb.sparkSession.read.parquet(path)
    return indexed, np.array([c for c in model.clusterCenters()], dtype=np.float64)


def ivf_index_of_centers(kb: DataFrame, centers: np.ndarray, vec_col: str = "embedding", path: str | None = None):
    """The index for given centers (one a list) instead of fitted ones: each row goes to the cell of the nearest by
    cosine, of equal ones the first. Returns (indexed DataFrame, centers)."""
    unit = _unit(list(centers))

    def assign(batches):
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(cell=np.nanargmax(_unit(pdf[vec_col]) @ unit.T, axis=1).astype(np.int32))

    some = F.exists(vec_col, lambda x: x != 0)
    base = kb.where(F.col(vec_col).isNotNull() & some)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)
    indexed = base.mapInPandas(assign, f"{fields}, cell int")
    if path:
        indexed.write.mode("overwrite").partitionBy("cell").parquet(path)
        indexed = kb.sparkSession.read.parquet(path)
    return indexed, np.asarray(centers, dtype=np.float64)


def _normalized(c) -> F.Column:
    n = F.sqrt(F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return F.transform(c, lambda x: F.try_divide(x.cast("double"), n))


def kb_search_ivf(indexed: DataFrame, centers: np.ndarray, queries: DataFrame, k: int = 3,
                  n_probe: int = 2, vec_col: str = "embedding") -> DataFrame:
    """Approximate top-k: probe the ``n_probe`` cells nearest each query, rank exactly inside. The numbers of the
    probed cells (at most one for each list) are known before the scan, so that only their files are read."""
    norms = np.linalg.norm(centers, axis=1, keepdims=True)
    cn = centers / np.where(norms > 0, norms, 1)

    def probe(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            q = _unit(pdf["query_vec"])
            fine = ~np.isnan(q).any(axis=1)
            if not fine.any():
                continue
            q, ids = q[fine], pdf["query_id"].to_numpy()[fine]
            best = np.argsort(-(q @ cn.T), axis=1, kind="stable")[:, :n_probe]
            yield pd.DataFrame({"query_id": np.repeat(ids, best.shape[1]), "cell": best.ravel().astype(np.int32),
                                "query_vec": list(np.repeat(q, best.shape[1], axis=0))})

    probes = queries.mapInPandas(probe, "query_id string, cell int, query_vec array<double>")
    cells = [r["cell"] for r in probes.select("cell").distinct().collect()]
    rows = indexed.where(F.col("cell").isin(cells)).select("id", "cell", _normalized(F.col(vec_col)).alias("u"))
    j = rows.join(probes, "cell")
    sim = F.aggregate(F.zip_with("u", "query_vec", lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), F.asc("id"))
    return (j.select("query_id", "id", sim.alias("similarity")).where(F.col("similarity").isNotNull())
            .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", "rank", "id", F.round("similarity", 4).alias("similarity")))


def recall_at_k(approx: DataFrame, exact: DataFrame) -> DataFrame:
    """Per query: share of the exact top-k ids the approximate search returned."""
    hit = exact.select("query_id", "id").join(approx.select("query_id", "id").withColumn("_h", F.lit(1)),
                                              ["query_id", "id"], "left")
    return hit.groupBy("query_id").agg((F.count("_h") / F.count(F.lit(1))).alias("recall"))
