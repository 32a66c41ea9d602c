"""License scans against a plain Python version of the rules."""
import re

from ledgerline.llm import license_scan as L
from tests_llm_util import frame, rows_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text, rules):
    words = WORD.findall((text or "").translate(str.maketrans(L.UPPER, L.LOWER)))
    padded = "".join(f" {w}" for w in words) + " "
    got = []
    for i, r in enumerate(rules):
        for m in re.finditer(r.regex, padded):
            start = padded[:m.start()].count(" ")
            got.append((start, start + m[0].count(" "), r.priority, i, r))
    kept = [d for d in got if d[4].base or not any(
        e is not d and e[0] <= d[0] and e[1] >= d[1] and e[2] >= d[2]
        and ((e[0], e[1]) != (d[0], d[1]) or (e[2], -e[3]) > (d[2], -d[3])) for e in got)]
    base = [d for d in got if d[4].base]
    join = lambda ds: ",".join(sorted({d[4].label for d in ds}))
    return (len(words), len(base), min((d[0] for d in base), default=None), max((d[0] for d in base), default=None),
            join(base), join(kept), max((d[4].confidence for d in kept), default=0.0), len(got))


TEXTS = [
    None, "", "   ", "no licence here", "Licensed under CC BY-NC 4.0. CC BY cc by! cc, by 3.0", "All rights reserved",
    "This work is licensed under the GNU General Public License, version 3.",
    "GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or "
    "(at your option) any later version.", "Released under the MIT License. Released under the MIT License.",
    "SPDX-License-Identifier: GPL-2.0-or-later", "Licensed under the Apache License, Version 2.0.",
    "Copyright (c) 2019 2020 by X. All rights reserved. All Rights Reserved", "ÉCC BY cc by cc by CC  BY",
    "dedicated it to the public domain", "Permission is hereby granted, free of charge, to any person obtaining a copy",
    "general public license " * 400, "distributed under a b c licence cc by cc by cc by",
    "Lesser General Public License version 2.1 or any later version", "BSD 3-Clause License new bsd license",
]


def test_matches_brute_force(spark):
    rules = L.default_rules()
    assert len(rules) > 200
    df = frame(spark, [(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    got = rows_of(L.scan_digest(df))
    assert [tuple(r)[1:] for r in got] == [brute(t, rules) for t in TEXTS]


def test_whole_fixture(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rules = L.default_rules()
    for r in rows_of(L.scan_digest(docs)):
        assert tuple(r)[1:] == brute(texts[r.doc_id], rules), r.doc_id


def test_containment_keeps_the_priority(spark):
    rules = (L.Rule("wide", "a b", "a b c d", 1, 0.2), L.Rule("high", "b", "b c", 3, 0.9),
             L.Rule("low", "b", "b c d", 1, 0.3), L.Rule("same", "b", "b c", 3, 0.8))
    rules = tuple(L.Rule(r.label, r.keyword, r.pattern, r.priority, r.confidence) for r in rules)
    old, L.ROOTS = L.ROOTS, (*L.ROOTS, "a", "b")
    try:
        got = L.scan_digest(frame(spark, [(1, "x a b c d")], "doc_id long, text string"), rules=rules).first()
    finally:
        L.ROOTS = old
    assert got.labels == "high,wide" and got.score == 0.9


def test_repeated_rows_empty_table_and_extra_columns(spark):
    df = frame(spark, [(1, "cc by", "x", 9), (1, "cc by", "y", 8)], "doc_id long, text string, labels string, score int")
    got = rows_of(L.scan_digest(df))
    assert [r.base_labels for r in got] == ["cc-by", "cc-by"]
    assert L.scan_digest(df.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    from ledgerline.llm.queries import op5_license_scan
    plan = op5_license_scan(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_a_hundred_thousand_places_in_one_text(spark):
    n = 100_000
    r = L.scan_digest(frame(spark, [(1, "cc by " * n + "all rights reserved")], "doc_id long, text string")).first()
    assert (r.n_base, r.first_word, r.last_word, r.n_words) == (n + 1, 0, 2 * n, 2 * n + 3)
    assert r.base_labels == "cc-by,reserved"
