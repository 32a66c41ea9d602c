"""Classifiers: held-out accuracy, the fold rule, odd rows; parts against plain versions."""
import math
import zlib

import numpy as np
import pandas as pd
import pytest
import xxhash

from ledgerline.llm import quality as Q
from ledgerline.llm import toxicity as T
from ledgerline.llm.labelled import labelled_sample
from tests_llm_util import frame

MID = "/root/testdata/sf0.1"


def auc(scores, labels):
    s, y = np.array(scores, float), np.array(labels)
    _, inv, n = np.unique(s, return_inverse=True, return_counts=True)
    rank = (np.cumsum(n) - (n - 1) / 2)[inv]
    return (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


def held_out(spark, query, label, modulus, remainder):
    rows = query(spark, MID).join(spark.read.parquet(f"{MID}/labels.parquet"), "doc_id").collect()
    docs = spark.read.parquet(f"{MID}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == remainder)
        assert 0 <= r.score <= 1
    test = [r for r in rows if r.held_out]
    assert len(test) > 400 and query(spark, MID).count() == docs
    return [r.score for r in test], [r[label] for r in test], [r.predicted for r in test]


def test_toxicity_in_english(spark):
    from ledgerline.llm.queries import op7_toxicity
    docs = spark.read.parquet(f"{MID}/documents.parquet").where("lang = 'en'").select("doc_id")
    labels = spark.read.parquet(f"{MID}/labels.parquet").where("quality = 1")
    rows = op7_toxicity(spark, MID).where("held_out").join(labels, "doc_id").join(docs, "doc_id").collect()
    assert auc([r.score for r in rows], [r.toxic for r in rows]) > 0.9


def test_quality_on_held_out_documents(spark):
    from ledgerline.llm.queries import op1_quality
    score, label, said = held_out(spark, op1_quality, "quality", 5, 0)
    assert auc(score, label) > 0.99
    good = [p for p, y in zip(said, label) if y == 1]
    bad = [p for p, y in zip(said, label) if y == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.2 * len(bad)
    assert said == [int(s >= 0.3) for s in score]


def test_toxicity_on_held_out_documents(spark):
    from ledgerline.llm.queries import op7_toxicity
    score, label, said = held_out(spark, op7_toxicity, "toxic", 3, 1)
    # a few hundred labelled texts, with other toxic words in each language; English has most of them
    assert auc(score, label) > 0.7
    clean = [p for p, y in zip(said, label) if y == 0]
    assert sum(clean) <= 0.03 * len(clean)
    assert said == [int(s >= 0.7) for s in score]


def test_ftrl_follows_the_textbook_steps():
    """Against the same formulas written for single numbers."""
    rng = np.random.default_rng(2)
    data = []
    for _ in range(40):
        at = np.unique(rng.integers(1, 50, 6))
        data.append((at, rng.random(len(at)), int(at[0] % 2)))
    z, n, w = {}, {}, {}
    a, b, l1, l2 = 1.0, 1.0, 1e-4, 1e-4
    for _ in range(2):
        for at, x, y in data:
            pairs = [*zip(at.tolist(), x.tolist()), (0, 1.0)]
            for i, _ in pairs:
                zi = z.get(i, 0.0)
                w[i] = 0.0 if abs(zi) <= l1 else -(zi - math.copysign(l1, zi)) / ((b + math.sqrt(n.get(i, 0.0))) / a + l2)
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in pairs)))
            for i, v in pairs:
                g = (p - y) * v
                s = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / a
                z[i] = z.get(i, 0.0) + g - s * w[i]
                n[i] = n.get(i, 0.0) + g * g
    got = Q.ftrl(data, epochs=2)
    for i, zi in z.items():
        want = 0.0 if abs(zi) <= l1 else -(zi - math.copysign(l1, zi)) / ((b + math.sqrt(n[i])) / a + l2)
        assert got[i] == pytest.approx(want, abs=1e-9)
    assert np.count_nonzero(got) <= len(z)


def test_features_are_whole_text_and_unit_length():
    places, values = Q.features("A b b b " * 5000 + "lastword")
    assert values @ values == pytest.approx(1) and len(np.unique(places)) == len(places)
    assert set(Q.features("lastword")[0]) - set(Q.features("x " * 9)[0]) <= set(places) | {0}
    assert [len(x) for x in Q.features(None)] == [0, 0] == [len(x) for x in Q.features("  ")]


def test_shape_is_of_the_whole_word():
    Q.forget_words()
    for tail in ("9", "X", "=9;X"):
        a, b = (Q._codes["a" * 300 + t] & 0xFFFFFFFF for t in ("", tail))
        assert a != b and b == zlib.crc32(("a" + Q._shape(tail)).encode())
    assert not Q._codes and Q.features("a" * 300)[0].tolist() != Q.features("a" * 300 + "9")[0].tolist()


def test_windows_cover_the_whole_text():
    for text in ("", "x", "é" * 200, "abc " * 1000):
        ws, raw = T.windows(text), text.encode()
        assert len(ws) >= 1 and ws[-1] == raw[(len(ws) - 1) * T.STEP:][:T.WINDOW] and raw.endswith(ws[-1])
        assert b"".join(w[:T.STEP] for w in ws[:-1]) + ws[-1] == raw


def test_a_phrase_of_16_bytes_is_whole_in_some_window():
    raw = "".join(f"{i:04x}" for i in range(500))
    ws = T.windows(raw)
    assert all(any(raw[a:a + 16].encode() in w for w in ws) for a in range(len(raw) - 15))


def test_compression_distance_finds_a_phrase():
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(400)]

    def text(bad):
        ws = [str(w) for w in rng.choice(words, 80)]
        for i in rng.integers(0, 80, 6 if bad else 0):
            ws[i] = "zzyzxqu"
        return " ".join(ws)
    labels = [i % 4 == 0 for i in range(400)]
    m = T.train_model([text(b) for b in labels], [int(b) for b in labels])
    s = T._Scorer(m)
    assert auc([s(text(i % 2 == 0)) for i in range(100)], [int(i % 2 == 0) for i in range(100)]) > 0.95
    assert all(b"zzyzxqu" in toxic and b"zzyzxqu" not in ordinary for toxic, ordinary in m.pairs)


def test_sample_rules(spark):
    docs = frame(spark, [(i, f"t{i}") for i in range(300)] + [(7, "a7"), (None, "x"), (8, None)], "doc_id long, text string")
    labels = frame(spark, [(i, i % 2) for i in range(300)] + [(7, 0), (None, 1), (9, None)], "doc_id long, toxic int")
    rows = labelled_sample(docs, labels, "toxic", 3, 1, {0: 20, 1: 30}).collect()
    assert sum(r.label == 0 for r in rows) == 20 and sum(r.label == 1 for r in rows) == 30
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 != 1 for r in rows) and len({r.doc_id for r in rows}) == 50
    every = labelled_sample(docs, labels, "toxic", 3, 1, {0: 999, 1: 999}).collect()
    assert {r.doc_id: (r.text, r.label) for r in every}.get(7, ("a7", 1)) == ("a7", 1)


@pytest.mark.parametrize("scores", [Q.quality_scores, T.toxicity_scores])
def test_odd_rows_no_labels_and_empty_tables(spark, scores):
    docs = frame(spark, [(1, None, "q"), (2, "", "q"), (2, "", "q"), (None, "a b", "q"), (3, "w " * 50_000, "q")],
                 "doc_id long, text string, score string")
    none = frame(spark, [], "doc_id long, quality int, toxic int")
    one = frame(spark, [(i, 1, 1) for i in range(1, 4)], "doc_id long, quality int, toxic int")
    both = frame(spark, [(2, 1, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")
    for labels in (none, one, both):
        rows = scores(docs, labels).collect()
        assert len(rows) == 5 and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
        assert [r.held_out for r in rows if r.doc_id is None] == [False]
    assert scores(docs.limit(0), both).count() == 0


def _plain_quality(docs, labels, threshold=0.3):
    """The quality classifier with dicts and single numbers: sample, shards, features, steps, average, scores."""
    mask = 2**64 - 1

    def grams(text):
        words = (text or "").split()
        code = lambda w: zlib.crc32(w.encode())
        word = [code(w.lower().strip("!?.,;:*%$&#|'\"()[]{}<>-_=+/\\~`@^")) for w in words]
        shape = [code(Q._shape(w)) for w in words]
        a, b, c = 0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D
        all_ = [w * c for w in word] + [2 if v == w else v * a + w * b + 1 for v, w in zip(word, word[1:])]
        two = [v * a + w * b + 3 for v, w in zip(shape, shape[1:])]
        all_ += [s * c + 5 for s in shape] + two + [t * a + s * c + 4 for t, s in zip(two, shape[2:])]
        counts = {}
        for g in all_:
            g &= mask
            g = (g ^ g >> 29) * 0xBF58476D1CE4E5B9 & mask
            counts[g >> 46] = counts.get(g >> 46, 0) + 1
        size = math.sqrt(sum((1 + math.log(k)) ** 2 for k in counts.values()))
        return [(max(at, 1), (1 + math.log(k)) / size) for at, k in sorted(counts.items())]

    def score(w, x):
        return 1 / (1 + math.exp(-max(-35, min(35, w.get(0, 0.0) + sum(w.get(at, 0.0) * v for at, v in x)))))

    def spark_hash(seed, i):
        first = xxhash.xxh64_intdigest(seed.to_bytes(4, "little"), seed=42)
        return xxhash.xxh64_intdigest(i.to_bytes(8, "little"), seed=first)

    shards = {}
    for i, y in labels.items():
        if zlib.crc32(str(i).encode()) % 5 and i in docs and docs[i] is not None:
            shards.setdefault(spark_hash(23, i) % 4, []).append((i, y))
    total = {}
    for rows in shards.values():
        order = pd.util.hash_array(np.array([i for i, _ in rows]))
        rows = [r for _, r in sorted(zip(order, rows), key=lambda t: (t[0], t[1][0]))]
        z, n, w = {}, {}, {}
        xs = {i: grams(docs[i]) for i, _ in rows}
        for _ in range(4):
            for i, y in rows:
                x, p = xs[i], score(w, xs[i])
                for at, v in [*x, (0, 1.0)]:
                    g = (p - y) * v
                    old = n.get(at, 0.0)
                    z[at] = z.get(at, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) * w.get(at, 0.0)
                    n[at] = old + g * g
                    w[at] = (-(z[at] - math.copysign(1e-4, z[at])) / (1 + math.sqrt(n[at]) + 1e-4) if abs(z[at]) > 1e-4 else 0.0)
        for at, v in w.items():
            total[at] = total.get(at, 0.0) + v / 4
    return {i: (s := score(total, grams(t)), int(s >= threshold)) for i, t in docs.items()}


def test_quality_query_against_a_plain_version(spark):
    from ledgerline.llm.queries import op1_quality
    small = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect() if r.quality is not None}
    want = _plain_quality(docs, labels)
    got = op1_quality(spark, small).collect()
    assert len(got) == len(want) == len(docs)
    for r in got:
        s, p = want[r.doc_id]
        assert abs(r.score - s) < 1e-4 and (r.predicted == p or abs(s - 0.3) < 1e-4)


@pytest.mark.parametrize("scores", [Q.quality_scores, T.toxicity_scores])
def test_text_ids_and_other_column_names(spark, scores):
    names = "k string, body string, doc_id int, text int"
    rows = [(f"d-{i}", ("vile awful rot " if i % 2 else "fine good words ") * (3 + i % 5) + str(i), 1, 2) for i in range(60)]
    docs = frame(spark, rows + [(None, "x", 1, 2), ("d-none", None, 1, 2)], names)
    labels = frame(spark, [(f"d-{i}", i % 2, i % 2) for i in range(60)], "k string, quality int, toxic int")
    got = {r.doc_id: r for r in scores(docs, labels, id_col="k", text_col="body").collect()}
    assert len(got) == 62 and not got[None].held_out
    label1, label0 = ([got[f"d-{i}"].score for i in range(60) if i % 2 == odd] for odd in (1, 0))
    assert sum(label1) > sum(label0)
    numbers = frame(spark, [("7", "a b c", 1), ("8", "d e f", 1)], "doc_id string, text string, label int")
    assert len(scores(numbers, frame(spark, [(7, 1, 1), (8, 0, 0)], "doc_id long, quality int, toxic int")).collect()) == 2
    kept = Q.keep_quality if scores is Q.quality_scores else T.drop_toxic
    assert kept(docs, labels, id_col="k", text_col="body").columns == docs.columns
