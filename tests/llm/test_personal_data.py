"""Personal data: base spans against plain Python, the model against the formulas, planted wider spans."""
import hashlib
import itertools
import math
import re

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import personal_data as P
from tests_llm_util import frame, rows_of

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def good(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in hit.split(".")),
            "card": lambda: 13 <= len(digits) <= 19 and luhn(digits),
            "phone": lambda: 9 <= len(digits) <= 15}[kind]()


def brute(text):
    """Base spans as (kind, start, stop) by kind, then start."""
    return [(k, m.start(), m.end()) for k, regex in PLAIN.items() for m in re.finditer(regex, text or "")
            if good(k, m[0])]


def shown(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def check(rows, texts):
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r.doc_id])
        assert [r[f"n_{k}"] for k in P.KINDS] == [sum(w[0] == k for w in want) for k in P.KINDS], r.doc_id
        assert r.base_sha256 == hashlib.sha256(shown(want).encode()).hexdigest(), r.doc_id
        have = [(s.split(":")[0], int(s.split(":")[1]), int(s.split(":")[2])) for s in r.spans.split(",") if s]
        assert set(want) <= set(have) and have == sorted(have, key=lambda s: (P.KINDS.index(s[0]), *s[1:]))


TEXTS = [
    None, "", "   ", "no data here", "a@b.c", "x@y", "a@b.c_d@e.f", "a.b+c%d@x-y.co.uk.", "a@b@c.d", "@x.y", "é@x.y aé@x.y",
    "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "0.0.0.255 00255.1.1.0001", "1..2.3.4.5", "999.1.2.3.4", "12.3.4",
    "4111 1111 1111 1111", "4111-1111-1111-1111-", "4111111111111112", "4111111111111111 4111111111111111", "1 2 3",
    "+1 (743) 555-3824", "+1 (743) 555-3824 4845168114407329", "+12", "+123", "+1 234 567 890 123 456 7", "++49 30 1234567.",
    "\U0001F600 me@x.org \U0001F600 10.0.0.1", "\x01a@b.c\x01 \x03 9.9.9.9", "mail: 34@mail7.example.com geiever",
    "+1.........2", "a" * 3000 + "@b.c", "1" * 5000, "1." * 4000, "a@" * 3000, "x@" + "a." * 3000, "+" * 2000,
]


def test_base_spans_of_odd_texts(spark):
    df = frame(spark, list(enumerate(TEXTS)), "doc_id long, text string")
    check(rows_of(P.personal_digest(df)), dict(enumerate(TEXTS)))


def test_base_spans_of_random_texts(spark):
    import random
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("ab1234567890.@+-() é_") for _ in range(rnd.randint(0, 90))) for _ in range(1500)]
    texts += ["".join(rnd.choice("0123456789. +-") for _ in range(60)) for _ in range(500)]
    df = frame(spark, list(enumerate(texts)), "doc_id long, text string")
    check(rows_of(P.personal_digest(df)), dict(enumerate(texts)))


def test_whole_fixture(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(rows_of(P.personal_digest(docs)), {r.doc_id: r.text for r in docs.collect()})


def test_a_text_with_a_hundred_thousand_spans(spark):
    text = "a@b.c " * 100_000
    r = P.personal_digest(frame(spark, [(1, text)], "doc_id long, text string")).first()
    assert r.n_email == 100_000 and r.spans.endswith(f"email:{6 * 99_999}:{6 * 99_999 + 5}")


def python_model(rows, rounds=30, steps=150, ridge=0.1):
    """rows: (votes, features, n). The same estimates in plain Python."""
    voters = range(len(P.VOTERS))
    prior, yes, no = 0.5, [0.9] * len(P.VOTERS), [0.3] * len(P.VOTERS)
    sig = lambda z: 1 / (1 + math.exp(-z))

    def chance(votes):
        z = math.log(prior / (1 - prior))
        for v in voters:
            z += {1: math.log(yes[v] / no[v]), 0: math.log((1 - yes[v]) / (1 - no[v])), -1: 0.0}[votes[v]]
        return sig(z)

    for _ in range(rounds):
        q = [chance(v) for v, _, _ in rows]
        total = sum(n for *_, n in rows)
        rate = lambda w, p0, v: ((sum(n * x for (vs, _, n), x in zip(rows, w) if vs[v] == 1) + 10 * p0)
                                 / (sum(n * x for (vs, _, n), x in zip(rows, w) if vs[v] >= 0) + 10))
        other = [1 - x for x in q]
        prior, yes, no = ((sum(n * x for (*_, n), x in zip(rows, q)) + 1) / (total + 2),
                          [rate(q, 0.9, v) for v in voters], [rate(other, 0.3, v) for v in voters])
    q = [chance(v) for v, _, _ in rows]
    w = [0.0] * len(P.FEATURES)
    bound = [sum(0.25 * n * f[j] * sum(f) for _, f, n in rows) + ridge for j in range(len(w))]
    for _ in range(steps):
        miss = [n * (x - sig(sum(a * b for a, b in zip(w, f)))) for (_, f, n), x in zip(rows, q)]
        w = [w[j] + (sum(m * f[j] for m, (_, f, _) in zip(miss, rows)) - ridge * w[j]) / bound[j] for j in range(len(w))]
    return prior, yes, no, w


def test_model_against_plain_python(spark):
    import random
    rnd = random.Random(5)
    rows = {}
    for _ in range(400):
        real = rnd.random() < 0.4
        votes = tuple(-1 if rnd.random() < 0.2 else int((rnd.random() < 0.85) == real) for _ in P.VOTERS)
        features = (1, *(int((rnd.random() < 0.8) == real) for _ in P.FEATURES[1:]))
        rows[votes, features] = rows.get((votes, features), 0) + 1
    want = python_model([(*k, n) for k, n in rows.items()])
    spans = [(1, i, i + 1, 1, list(v), list(f)) for i, (v, f) in enumerate(itertools.chain.from_iterable(
        [k] * n for k, n in rows.items()))]
    df = frame(spark, [(1, spans[:100]), (2, spans[100:]), (3, [])], f"doc_id long, found array<{P.SPAN}>")
    got = P.span_model(df).collect()
    assert len(got) == 1 and got[0].kind == 1
    flat = [got[0].prior, *got[0].yes, *got[0].no, *got[0].weights]
    assert flat == pytest.approx([want[0], *want[1], *want[2], *want[3]], rel=1e-9)
    reliable = [y - n for y, n in zip(got[0].yes, got[0].no)]
    assert min(reliable) > 0.3                                                   # every labeler is worth something


def test_wider_spans_are_found_and_plain_numbers_are_not(spark):
    texts = [f"thon reor in {a}.{b}.7.9 the" for a, b in itertools.product(range(11, 15), range(40, 50))]
    texts += [f"write to u{i}@mail.example.com now" for i in range(40)]
    texts += [f"call me +1 (743) 555-{1000 + i} 4845168114407329 today" for i in range(20)]
    texts += [f"the +1 (213) 555-{1000 + i} is" for i in range(40)]
    cards = [c for c in (f"48451681144073{i:02d}" for i in range(100)) if luhn(c)]
    texts += [f"paid by {c} there" for c in cards]
    n = len(texts)
    texts += ["paid 7536784127813050 4845168114407329 both", "write to jo (at) mail (dot) org soon",
              "in the year 2019 2020 2021 we sold 12345 of 678", "id=12345678901234567890123 and v1.2.3",
              "order 1234567890123"]
    df = frame(spark, list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in P.personal_digest(df).collect()}
    assert "phone:8:25" in got[80] and "card:26:42" in got[80]
    assert "card:22:38" in got[n]
    assert got[n + 1] == "email:9:31"
    assert got[n + 2] == got[n + 3] == got[n + 4] == ""


def test_nulls_repeats_empty_tables_and_clashing_columns(spark):
    schema = "doc_id string, text string, spans int, found string, kind string, __t string"
    df = frame(spark, [("a", "x@y.z", 1, "f", "k", "t"), ("a", "x@y.z", 1, "f", "k", "t"), (None, None, 1, "f", "k", "t")], schema)
    got = rows_of(P.personal_digest(df))
    assert [(r.doc_id, r.n_email, r.spans) for r in got] == [(None, 0, ""), ("a", 1, "email:0:5"), ("a", 1, "email:0:5")]
    assert P.personal_digest(df.limit(0)).count() == 0
    other = df.withColumnRenamed("doc_id", "k").withColumnRenamed("text", "body")
    assert P.personal_digest(other, "k", "body").where("n_email = 1").count() == 2
    assert sorted(tuple(r) for r in P.span_rows(df).select("doc_id", "start", "stop", "kind", "base").collect()) == [
        ("a", 0, 5, "email", True)] * 2


def test_no_python_in_the_plan(spark):
    from ledgerline.llm.queries import op11_pii
    plan = op11_pii(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
