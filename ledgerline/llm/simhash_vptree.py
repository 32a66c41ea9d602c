"""SimHash near-dedup by vantage-point trees.

Fingerprint: words between white space after A-Z are lower-cased, word shingles (repeats included), XXH64 with seed
42 of each; a bit is 1 if it is set in over half of the hashes. Fingerprints link at ``radius`` or fewer differing
bits.

Linked fingerprints of up to 3 differing bits are within 1 in their upper or in their lower 32 bits (in general
within radius // 2 of one half). So there is one tree for each half: a node has a vantage point and a distance, the
points up to that distance are in the inner branch, the others in the outer one. A point lives in one leaf (shard)
and visits each further leaf that the triangle bound can't rule out for the half's radius; pairs are then verified
on all bits. Trees are fitted on a bounded hash sample and route all points. Within a shard the same partitioning
goes on in memory. A leaf whose points share their bits is cut into blocks, and blocks meet pairwise.

Equal fingerprints are one point; a shard gives a spanning forest of its links, not all pairs.

Defined results: NULL and empty texts have fingerprint zero and are linked like any other; repeated rows each get a
row; a NULL id is passed over when the smallest id of a group is taken.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm import samples
from ledgerline.llm.components import connected_components, salted_join
from ledgerline.session import cut_lineage

SAMPLE_PER_LEAF = 16
MAX_LEAVES = 16_384              # leaves of a tree; its sample holds up to 262,144 fingerprints
LEAF_SIZE = 4_096
BLOCK_SIZE = 8_192               # points of one task from a leaf that is larger than that
PAIR_CELLS = 1 << 18


def simhash(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    words = text.encode().lower().split() if text else []         # bytes: ASCII letters and white space only
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    if len(words) <= shingle:
        starts, stops = [0], [len(joined)]
    else:
        starts, stops = (ends - sizes)[:len(words) - shingle + 1].tolist(), ends[shingle - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, stops)], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 65_536):
        part = hashes[k:k + 65_536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: Column, shingle: int = 3) -> Column:
    @F.pandas_udf("long")
    def prints(texts: pd.Series) -> pd.Series:
        got = np.array([simhash(t if isinstance(t, str) else None, shingle) for t in texts], dtype=np.uint64)
        return pd.Series(got.view(np.int64))
    return prints(text)


# -- trees ----------------------------------------------------------------------------------------

def _half(points: np.ndarray, side: int) -> np.ndarray:
    return (points >> np.uint64(32)) if side == 0 else (points & np.uint64(0xFFFFFFFF))


def _split(values: np.ndarray, rng) -> tuple[int, int] | None:
    """(vantage point, distance) that cut the values into halves as even as possible; None if they are all equal."""
    best = None
    for v in values[rng.integers(0, len(values), 6)]:
        counts = np.cumsum(np.bincount(np.bitwise_count(values ^ v), minlength=65))
        mu = int(np.argmin(np.abs(counts - len(values) / 2)))
        even = min(counts[mu], len(values) - counts[mu])
        if even and (best is None or even > best[0]):
            best = (even, int(v), mu)
    return best[1:] if best else None


class VantageTree:
    """Tree over one half of the fingerprints."""

    def __init__(self, sample: np.ndarray, side: int, leaf_sample: int = SAMPLE_PER_LEAF, seed: int = 7):
        self.side, self.nodes, self.n_leaves = side, [], 0
        rng = np.random.default_rng(seed)
        self._grow(np.sort(_half(sample, side)), leaf_sample, rng)

    def _grow(self, values, leaf_sample, rng) -> int:
        """Returns a node's number; leaves count down from -1."""
        cut = _split(values, rng) if len(values) > leaf_sample else None
        if cut is None:
            self.n_leaves += 1
            return -self.n_leaves
        at = len(self.nodes)
        self.nodes.append(None)
        near = np.bitwise_count(values ^ np.uint64(cut[0])) <= cut[1]
        inner, outer = self._grow(values[near], leaf_sample, rng), self._grow(values[~near], leaf_sample, rng)
        self.nodes[at] = (np.uint64(cut[0]), cut[1], inner, outer)
        return at

    def leaves(self, points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of point, leaf) for all leaves that may hold something within the radius."""
        values = _half(points, self.side)
        out_i, out_leaf = [], []
        todo = [(0 if self.nodes else -1, np.arange(len(points)))]
        while todo:
            node, idx = todo.pop()
            if not len(idx):
                continue
            if node < 0:
                out_i.append(idx)
                out_leaf.append(np.full(len(idx), -node - 1))
                continue
            vantage, mu, inner, outer = self.nodes[node]
            d = np.bitwise_count(values[idx] ^ vantage).astype(np.int16)
            todo += [(inner, idx[d - radius <= mu]), (outer, idx[d + radius > mu])]
        if not out_i:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(out_i), np.concatenate(out_leaf)


# -- pairs within a shard -------------------------------------------------------------------------

class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


def _link_block(points, queries, p_idx, q_idx, radius, forest) -> None:
    near = np.bitwise_count(queries[q_idx][:, None] ^ points[p_idx][None, :]) <= radius
    near &= q_idx[:, None] != p_idx[None, :]
    if not near.any():
        return
    rows, cols = np.nonzero(near)
    if len(rows) <= 8 * (len(p_idx) + len(q_idx)):
        for i, j in zip(q_idx[rows].tolist(), p_idx[cols].tolist()):
            forest.join(i, j)
        return
    # many pairs: spread the smallest label through the block, then join by label
    big = np.iinfo(np.int64).max
    lab_q, lab_p = np.where(near.any(1), q_idx, big), np.where(near.any(0), p_idx, big)
    while True:
        new_q = np.minimum(lab_q, np.where(near, lab_p[None, :], big).min(1))
        new_p = np.minimum(lab_p, np.where(near, new_q[:, None], big).min(0))
        if (new_q == lab_q).all() and (new_p == lab_p).all():
            break
        lab_q, lab_p = new_q, new_p
    for idx, lab in ((q_idx, lab_q), (p_idx, lab_p)):
        for i, j in zip(idx[lab < big].tolist(), lab[lab < big].tolist()):
            forest.join(i, j)


def link_shard(points: np.ndarray, homes: np.ndarray, guests: np.ndarray, side: int, radius: int,
               forest: _Forest, seed: int = 11) -> None:
    """Joins in the forest all pairs of a home and a guest (numbers of points) within the radius. Partitions by the
    half of the side first, with its smaller radius, then by all bits."""
    rng = np.random.default_rng(seed)
    half = _half(points, side)
    todo = [(homes, guests, True)]
    while todo:
        p, q, by_half = todo.pop()
        if not len(p) or not len(q):
            continue
        if len(p) * len(q) <= PAIR_CELLS:
            _link_block(points, points, p, q, radius, forest)
            continue
        values, reach = (half, radius // 2) if by_half else (points, radius)
        cut = _split(values[p], rng) if len(p) > 32 else None
        parts = None
        if cut is not None:
            vantage, mu = np.uint64(cut[0]), cut[1]
            dp = np.bitwise_count(values[p] ^ vantage).astype(np.int16)
            dq = np.bitwise_count(values[q] ^ vantage).astype(np.int16)
            parts = [(p[dp <= mu], q[dq - reach <= mu], by_half), (p[dp > mu], q[dq + reach > mu], by_half)]
            if sum(len(a) * len(b) for a, b, _ in parts) > 0.9 * len(p) * len(q):
                parts = None
        if parts:
            todo += parts
        elif by_half:
            todo.append((p, q, False))
        else:
            step = max(1, PAIR_CELLS // len(p)) if len(p) <= PAIR_CELLS else 1
            for a in range(0, len(q), step):
                for b in range(0, len(p), PAIR_CELLS):
                    _link_block(points, points, p[b:b + PAIR_CELLS], q[a:a + step], radius, forest)


def fingerprint_links(points: DataFrame, radius: int = 3, leaf_size: int = LEAF_SIZE,
                      block_size: int = BLOCK_SIZE) -> DataFrame:
    """Links (a, b) that connect all points within the radius. ``points`` has one bigint column ``fp`` without
    repeats, and should be checkpointed."""
    n = points.count()
    leaves = min(MAX_LEAVES, max(1, 2 ** math.ceil(math.log2(max(1, n / leaf_size)))))
    sample = (points.where(samples.picked(F.xxhash64(F.lit(5), "fp"), n, leaves * SAMPLE_PER_LEAF))
              .toArrow()["fp"].to_numpy().view(np.uint64))
    trees = [VantageTree(sample, side) for side in (0, 1)] if leaves > 1 else [VantageTree(sample[:0], s) for s in (0, 1)]

    def count(batches):
        for pdf in batches:
            fps = pdf["fp"].to_numpy().view(np.uint64)
            for side, tree in enumerate(trees):
                leaf, k = np.unique(tree.leaves(fps, 0)[1], return_counts=True)
                yield pd.DataFrame({"side": side, "leaf": leaf, "n": k})

    # one number for each leaf (bounded by MAX_LEAVES): only leaves over the block size are remembered
    sizes = (points.mapInPandas(count, "side int, leaf long, n long").groupBy("side", "leaf").agg(F.sum("n").alias("n"))
             .where(F.col("n") > block_size).collect())
    blocks = {(r["side"], r["leaf"]): math.ceil(r["n"] / block_size) for r in sizes}
    reach = radius // 2

    def route(batches):
        for pdf in batches:
            fps = pdf["fp"].to_numpy().view(np.uint64)
            own = pd.util.hash_array(fps)
            for side, tree in enumerate(trees):
                hi, hl = tree.leaves(fps, 0)
                gi, gl = tree.leaves(fps, reach)
                for idx, leaf, home in ((hi, hl, True), (gi, gl, False)):
                    cut = np.array([blocks.get((side, k), 1) for k in leaf.tolist()], dtype=np.int64)
                    mine = (own[idx] % cut.astype(np.uint64)).astype(np.int64)
                    for b in range(int(cut.max(initial=1))):
                        on = cut > b
                        other = np.full(int(on.sum()), b, dtype=np.int64)
                        a, c = (mine[on], other) if home else (other, mine[on])
                        yield pd.DataFrame({"side": side, "leaf": leaf[on], "hb": a, "gb": c, "home": home,
                                            "fp": fps[idx[on]].view(np.int64)})

    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        fps = pdf["fp"].to_numpy()
        names, number = np.unique(fps, return_inverse=True)
        home = pdf["home"].to_numpy()
        forest = _Forest(len(names))
        link_shard(names.view(np.uint64), np.unique(number[home]), np.unique(number[~home]), int(pdf["side"].iloc[0]),
                   radius, forest)
        roots = np.array([forest.find(i) for i in range(len(names))], dtype=np.int64)
        on = roots != np.arange(len(names))
        return pd.DataFrame({"a": names[on], "b": names[roots[on]]})

    routed = points.mapInPandas(route, "side int, leaf long, hb long, gb long, home boolean, fp long")
    return routed.groupBy("side", "leaf", "hb", "gb").applyInPandas(shard, "a long, b long")


def near_groups(prints: DataFrame, radius: int = 3, **how) -> DataFrame:
    """``prints`` (id, fp; checkpointed) with ``component``: the smallest id of all rows whose fingerprints are
    connected by links. ``id`` may be of any type that can be ordered."""
    classes = cut_lineage(prints.groupBy("fp").agg(F.min("id").alias("least")))
    roots = cut_lineage(connected_components(fingerprint_links(classes.select("fp"), radius, **how))
                        .select(F.col("node").alias("fp"), "root"))
    linked = roots.join(classes, "fp")
    least = linked.groupBy("root").agg(F.min("least").alias("group_least"))
    of_linked = salted_join(roots, least, "root").select("fp", "group_least")
    # written, so that the last join exchanges either side by fp alone and a hot fingerprint can be split
    of_print = cut_lineage(classes.join(of_linked, "fp", "left")
                           .select("fp", F.coalesce("group_least", "least").alias("component")))
    return prints.join(of_print, "fp", "left").select("id", "fp", "component")


def simhash_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3,
                   **how) -> DataFrame:
    """One row per document: id, fingerprint (16 lowercase hex digits), component_id."""
    prints = cut_lineage(df.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col), shingle).alias("fp")))
    return near_groups(prints, radius, **how).select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"))


def keep_one_of_each_group(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                           radius: int = 3, **how) -> DataFrame:
    """The documents without near-duplicates, with all their columns: of each group the one with the smallest id
    stays (a NULL id comes last), of equal ids the first in the table. ``df`` should be a written table: its rows are
    numbered by place."""
    numbered = df.withColumn("__row", F.monotonically_increasing_id())
    order = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("__row").alias("row"))
    prints = cut_lineage(numbered.select(order.alias("id"), fingerprint(F.col(text_col), shingle).alias("fp")))
    gone = near_groups(prints, radius, **how).where("id.row <> component.row").select(F.col("id.row").alias("__row"))
    return numbered.join(gone, "__row", "left_anti").select(*df.columns)
