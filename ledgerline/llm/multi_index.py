"""Embedding near-dedup by an inverted multi-index.

Vectors are normalised and cut into halves; each half has its own codebook, and the pairs of codewords form a grid
of cells. A vector lives in the cell of its nearest codewords. As a query it visits cells in the order of the summed
squared distances of the codewords (multi-sequence order) until the target recall: the number of visits is fitted so
that this share of simulated pairs, which lie just at the threshold, is found from one side or the other. A cell
that the distance to its border rules out is left out. What meets in a cell is verified by cosine in double
precision.

Cells are kept apart by label. A cell with many vectors is cut into blocks which meet pairwise; equal vectors of a
label are one class; a task gives sums of links and a spanning forest, not the pairs.

Fitted on a bounded hash sample (``SAMPLE`` vectors); every vector is indexed. Defined results: a vector that is
NULL, empty, zero, or holds NULL or non-finite components, or whose label is NULL, links with nothing; vectors of
different length don't link; repeated rows are links of each other; a NULL id is passed over when the smallest id is
taken.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm import samples
from ledgerline.llm.components import connected_components, salted_join
from ledgerline.llm.simhash_vptree import _Forest
from ledgerline.session import cut_lineage

SAMPLE = 16_384
VECTORS_PER_CELL = 1_024         # over all labels, on average
MAX_CODEWORDS = 256              # of a half; the grid has their square
BLOCK_SIZE = 2_048
TARGET_RECALL = 0.98
FIRST_CELLS = 4_096               # cells of a query that are looked at first when the visits are fitted; then four times as many


def usable(vector: Column) -> Column:
    """True for vectors that can be compared."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(vectors: np.ndarray) -> np.ndarray:
    scale = np.abs(vectors).max(axis=1, keepdims=True)             # no overflow in the squares
    v = vectors / scale
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _distances(points: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.maximum(0, (points * points).sum(1)[:, None] + (words * words).sum(1)[None, :] - 2 * points @ words.T)


def _codebook(points: np.ndarray, k: int, rng, rounds: int = 12) -> np.ndarray:
    words = points[rng.permutation(len(points))[:k]].copy()
    for _ in range(rounds):
        own = _distances(points, words).argmin(1)
        for j in range(len(words)):
            mine = points[own == j]
            if len(mine):
                words[j] = mine.mean(0)
    return words


class MultiIndex:
    """Codebooks of the halves and the number of cells to visit."""

    def __init__(self, sample: np.ndarray, codewords: int, threshold: float, target_recall: float = TARGET_RECALL,
                 seed: int = 3):
        rng = np.random.default_rng(seed)
        self.dim, self.threshold = sample.shape[1], threshold
        self.cut = max(1, self.dim // 2)
        unit = _unit(sample)
        self.words = [_codebook(part, min(codewords, len(part)), rng) if part.shape[1] else np.zeros((1, 0))
                      for part in self._halves(unit)]
        self.k = [len(w) for w in self.words]
        self.borders = [np.sqrt(_distances(w, w)) for w in self.words]
        self.visits = self._fit(unit[rng.permutation(len(unit))[:2_048]], target_recall, rng)

    def _halves(self, unit):
        return unit[:, :self.cut], unit[:, self.cut:]

    def _fit(self, unit, target, rng) -> int:
        """Smallest number of visits that finds the target share of pairs at the threshold."""
        noise = rng.standard_normal(unit.shape)
        noise -= (noise * unit).sum(1, keepdims=True) * unit
        size = np.sqrt((noise * noise).sum(1, keepdims=True))
        c = self.threshold
        other = c * unit + math.sqrt(max(0.0, 1 - c * c)) * noise / np.where(size > 0, size, 1)
        grid, most = self.k[0] * self.k[1], FIRST_CELLS
        while True:                       # the whole grid holds every pair
            most = min(grid, most)
            rank = np.minimum(self._rank(unit, self.cells(other), most), self._rank(other, self.cells(unit), most))
            visits = int(np.quantile(rank, target, method="higher")) + 1
            if visits <= most:
                return visits
            most *= 4

    def _rank(self, unit, cells, most):
        step = len(unit) if most <= FIRST_CELLS else max(1, 512 * FIRST_CELLS // most)
        out = []
        for at in range(0, len(unit), step):
            hit = self.visit(unit[at:at + step], most, bound=False)[0] == cells[at:at + step, None]
            out.append(np.where(hit.any(1), hit.argmax(1), most))
        return np.concatenate(out)

    def cells(self, unit) -> np.ndarray:
        a, b = (_distances(p, w).argmin(1) for p, w in zip(self._halves(unit), self.words))
        return a * self.k[1] + b

    def visit(self, unit: np.ndarray, most: int | None = None, bound: bool = True):
        """(cells in multi-sequence order, whether each is to be visited)."""
        most = most or self.visits
        near, order, limit = [], [], []
        for part, words, border in zip(self._halves(unit), self.words, self.borders):
            d = _distances(part, words)
            o = np.argsort(d, axis=1, kind="stable")[:, :most]
            near.append(np.take_along_axis(d, o, 1))
            order.append(o)
            gap = border[o[:, :1], o]                              # own codeword to the others
            b = np.where(gap > 0, (near[-1] - near[-1][:, :1]) / np.where(gap > 0, 2 * gap, 1), 0)
            limit.append(b * b)
        pairs = [(i, j) for i in range(near[0].shape[1]) for j in range(near[1].shape[1]) if (i + 1) * (j + 1) <= most]
        i, j = (np.array(x) for x in zip(*pairs))
        pick = np.argsort(near[0][:, i] + near[1][:, j], axis=1, kind="stable")[:, :most]
        cells = np.take_along_axis(order[0][:, i] * self.k[1] + order[1][:, j], pick, 1)
        if not bound:
            return cells, None
        reach = np.take_along_axis(limit[0][:, i] + limit[1][:, j], pick, 1)
        return cells, reach <= 2 - 2 * self.threshold + 1e-9


def _matrix(column) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def class_links(classes: DataFrame, threshold: float, dim: int, sample: np.ndarray, n: int,
                block_size: int = BLOCK_SIZE, vectors_per_cell: int = VECTORS_PER_CELL) -> DataFrame:
    """``classes`` (node, label, vector, size) of one vector length -> rows (a, b, n): b NULL: class a has n further
    links; else: a link of a spanning forest."""
    k = 2 ** round(0.5 * math.log2(max(1, n / vectors_per_cell)))
    index = MultiIndex(sample, max(1, min(MAX_CODEWORDS, k)), threshold)
    grid = index.k[0] * index.k[1]
    # share of the vectors in each cell, from the bounded sample: cells that need more than a block
    share = np.bincount(index.cells(_unit(sample)), minlength=grid) / max(1, len(sample))
    blocks = np.maximum(1, np.ceil(share * n / block_size)).astype(np.int64)

    step = max(1, 1_024 * FIRST_CELLS // max(FIRST_CELLS, index.visits))      # rows at once

    def route(batches):
        for pdf in batches:
            for at in range(0, len(pdf), step):
                part = pdf.iloc[at:at + step]
                unit = _unit(_matrix(part["vector"]))
                cells, go = index.visit(unit)
                own = cells[:, 0]
                lists = [c[g].astype(np.int32) for c, g in zip(cells, go)]
                mine = part["node"].to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)
                out = []
                for r, (cell, to) in enumerate(zip(own.tolist(), lists)):
                    nb = int(blocks[cell])
                    out += [(r, cell, int(mine[r] % nb), b, True) for b in range(nb)]
                    for c in to.tolist():
                        nb = int(blocks[c])
                        out += [(r, c, b, int(mine[r] % nb), False) for b in range(nb)]
                rows, cell, hb, gb, home = zip(*out)
                pick = list(rows)
                got = part.iloc[pick].reset_index(drop=True)
                yield got.assign(cell=cell, hb=hb, gb=gb, home=home, own=own[pick], visits=[lists[r] for r in pick])

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        home, here = pdf["home"].to_numpy(), int(pdf["cell"].iloc[0])
        h, g = pdf[home], pdf[~home]
        if not len(h) or not len(g):
            return pd.DataFrame({"a": [], "b": [], "n": []}).astype({"a": "int64", "b": "Int64", "n": "int64"})
        hn, gn = h["node"].to_numpy(), g["node"].to_numpy()
        hs, gs = h["size"].to_numpy(), g["size"].to_numpy()
        go = g["own"].to_numpy()
        hu, gu = _unit(_matrix(h["vector"])), _unit(_matrix(g["vector"]))
        # (home, cell) for the cells that homes visit themselves: a pair that meets twice counts in the smaller cell
        width = grid + 1
        seen = np.sort(np.concatenate([np.asarray(v, dtype=np.int64) + i * width for i, v in enumerate(h["visits"])]))
        names = np.unique(np.concatenate([hn, gn]))
        forest = _Forest(len(names))
        hx, gx = np.searchsorted(names, hn), np.searchsorted(names, gn)
        more = np.zeros(len(names), dtype=np.int64)
        step = max(1, (1 << 20) // len(hn))
        for a in range(0, len(gn), step):
            i, j = np.nonzero(gu[a:a + step] @ hu.T >= threshold)
            i += a
            once = np.where(go[i] == here, gn[i] < hn[j], True)
            if len(i):
                key = j * width + go[i]
                at = np.minimum(np.searchsorted(seen, key), len(seen) - 1)
                once &= (go[i] == here) | (seen[at] != key) | (here < go[i])
            i, j = i[once], j[once]
            np.add.at(more, gx[i], hs[j])
            np.add.at(more, hx[j], gs[i])
            for x, y in zip(gx[i].tolist(), hx[j].tolist()):
                forest.join(x, y)
        roots = np.array([forest.find(x) for x in range(len(names))], dtype=np.int64)
        on, some = roots != np.arange(len(names)), more > 0
        return pd.DataFrame({"a": np.concatenate([names[some], names[on]]),
                             "b": pd.array([None] * int(some.sum()) + names[roots[on]].tolist(), dtype="Int64"),
                             "n": np.concatenate([more[some], np.zeros(int(on.sum()), dtype=np.int64)])})

    kind = dict(classes.dtypes)
    routed = classes.select("node", "label", "vector", "size").mapInPandas(
        route, f"node long, label {kind['label']}, vector {kind['vector']}, size long, cell long, hb long, gb long, "
               "home boolean, own long, visits array<int>")
    return routed.groupBy("label", "cell", "hb", "gb").applyInPandas(meet, "a long, b long, n long")


def near_vectors(df: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding",
                 label_col: str = "label", **how) -> DataFrame:
    """One row per vector: id, n_links, component_id (smallest id reachable by links), kept."""
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), F.col(label_col).alias("label"))
    usable_row = usable(F.col("vector")) & F.col("label").isNotNull()
    fine, rest = rows.where(usable_row), rows.where(~usable_row)
    classes = cut_lineage(fine.groupBy("label", "vector").agg(F.min("id").alias("least"), F.count("*").alias("size")))
    classes = classes.withColumn("node", F.monotonically_increasing_id())
    found = None
    for r in classes.groupBy(F.size("vector").alias("dim")).count().collect():      # one row per vector length
        own = classes.where(F.size("vector") == r["dim"])
        some = own.where(samples.picked(F.xxhash64(F.lit(9), "vector"), r["count"], SAMPLE))
        sample = _matrix(some.select("vector").toArrow().to_pandas()["vector"])
        links = class_links(own, threshold, r["dim"], sample, r["count"], **how)
        found = links if found is None else found.unionAll(links)
    if found is None:
        links_of = classes.select("label", "vector", F.lit(0).cast("long").alias("n_links"), F.col("least").alias("c"))
    else:
        found = cut_lineage(found)
        more = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("more"))
        roots = cut_lineage(connected_components(found.where("b is not null").select("a", "b")))
        least = (roots.join(classes.select("node", "least"), "node").groupBy("root")
                 .agg(F.min("least").alias("group_least")))
        of_linked = salted_join(roots, least, "root").select("node", "group_least")
        links_of = (classes.join(more, "node", "left").join(of_linked, "node", "left").select(
            "label", "vector", (F.col("size") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"),
            F.coalesce("group_least", "least").alias("c")))
    same = fine.alias("r").join(links_of.alias("k"), F.expr("r.label = k.label AND r.vector = k.vector")).select(
        "r.id", "k.n_links", "k.c")
    every = same.unionAll(rest.select("id", F.lit(0).cast("long"), F.col("id")))
    return every.select(F.col("id").alias(id_col), "n_links", F.col("c").alias("component_id"),
                        (F.col("id") == F.col("c")).alias("kept"))
