"""SimHash groups against brute force; fingerprints against a bit-by-bit version."""
import random

import numpy as np
import pytest
import xxhash

from ledgerline.llm import simhash_vptree as S
from ledgerline.llm.components import connected_components
from tests_llm_util import frame


def slow_print(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, w = [], ""
    for c in t + " ":
        if c in " \t\n\x0b\x0c\r":
            if w:
                words.append(w)
            w = ""
        else:
            w += c
    if not words:
        return 0
    sh = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups(prints, radius=3):
    """prints: list of (id, fp). Smallest reachable id by position."""
    up = list(range(len(prints)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i
    fps = np.array([p for _, p in prints], dtype=np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= radius):
            a, b = find(i), find(int(j))
            up[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(prints):
        r = find(i)
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return [least.get(find(i)) for i in range(len(prints))]


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "a B", "a b c", "É É é É", "x\x85y\xa0z q", "a b c d " * 50,
                                  "Ünder\x1cword b\x0bc d"])
def test_fingerprint(text):
    assert S.simhash(text) == slow_print(text)


def test_query_on_whole_fixture(spark):
    from ledgerline.llm.queries import op6_simhash
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    prints = [(r.doc_id, slow_print(r.text)) for r in docs]
    want = {d: (f"{p:016x}", g) for (d, p), g in zip(prints, groups(prints))}
    assert {r.doc_id: tuple(r)[1:] for r in op6_simhash(spark, "/root/testdata/sf0.001").collect()} == want


@pytest.mark.parametrize("leaf,block", [(16, 8192), (64, 20), (4096, 8192)])
def test_near_groups_on_clusters(spark, leaf, block):
    rng = random.Random(leaf)
    fps = [rng.getrandbits(64) for _ in range(300)]
    for _ in range(8):                                             # chains and balls
        c = rng.getrandbits(64)
        for k in range(40):
            c2 = c
            for b in rng.sample(range(64), rng.randint(0, 3)):
                c2 ^= 1 << b
            fps.append(c2)
            c = c2 if k % 2 else c
    fps += [fps[0]] * 30 + [0, 1, 2**64 - 1]
    rows = [(None if i == 5 else 1000 - i, np.uint64(f).astype(np.int64).item()) for i, f in enumerate(fps)]
    df = frame(spark, rows, "id long, fp long").repartition(4).checkpoint()
    got = sorted((r.id if r.id is not None else -1, r.component) for r in
                 S.near_groups(df, leaf_size=leaf, block_size=block).collect())
    want = groups([(i, f) for (i, _), f in zip(rows, fps)])
    assert got == sorted((i if i is not None else -1, w) for (i, _), w in zip(rows, want))


def test_tree_visits_every_leaf_within_the_radius():
    rng = np.random.default_rng(1)
    pts = rng.integers(0, 2**63, 2000, dtype=np.uint64)
    for side in (0, 1):
        tree = S.VantageTree(pts[:512], side)
        home = dict(zip(*(x.tolist() for x in tree.leaves(pts, 0))))
        assert len(home) == 2000
        bit = np.uint64(1) << rng.integers(0, 32, 2000).astype(np.uint64)
        near = pts ^ (bit << np.uint64(32) if side == 0 else bit)
        visits = set(zip(*(x.tolist() for x in tree.leaves(near, 1))))
        assert all((i, leaf) in visits for i, leaf in home.items())


def test_dense_ball_takes_the_label_path(spark):
    base, n = 0x0123456789ABCDEF, 600
    rng = random.Random(4)
    fps = {base}
    while len(fps) < n:
        f = base
        for b in rng.sample(range(64), 2):
            f ^= 1 << b
        fps.add(f)
    rows = [(i, np.uint64(f).astype(np.int64).item()) for i, f in enumerate(sorted(fps))]
    df = frame(spark, rows, "id long, fp long").checkpoint()
    assert {r.component for r in S.near_groups(df, leaf_size=64).collect()} == {0}


def test_components_of_paths_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 90)] + [(300, 300), (500, 400), (400, 500)]
    df = frame(spark, links, "a long, b long")
    got = {r.node: r.root for r in connected_components(df).collect()}
    want = {**{i: 100 for i in range(100, 161)}, **{i: 0 for i in range(90)}, 400: 400, 500: 400}
    assert got == want


def test_nulls_empty_table_and_clashing_columns(spark):
    df = frame(spark, [(3, None, 1), (2, "", 2), (7, "a b c d e", 3), (7, "a b c d e", 4), (None, "a b c d e", 5)],
               "doc_id long, text string, fingerprint int")
    got = S.simhash_groups(df).collect()
    assert sorted((r.doc_id or -1, r.component_id) for r in got) == [(-1, 7), (2, 2), (3, 2), (7, 7), (7, 7)]
    assert S.simhash_groups(df.limit(0)).count() == 0
