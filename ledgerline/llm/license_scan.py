"""License scans by ordered signature rules (DataFrame functions only).

A text becomes its words (``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased) joined by single
spaces. A rule is a regular expression over those words with a label, a priority, a confidence and a literal
keyword that each of its matches holds; a rule runs only on texts that hold its keyword. Detections are word
intervals. A detection inside the interval of another one of the same or a higher priority is suppressed; of equal
intervals the higher priority, then the earlier rule stays. The three base phrases are never suppressed.

Defined results: NULL and empty texts have no words and no detections; repeated rows give repeated results; extra
columns are not read. Everything happens within a row: no shuffle, and no group to be skewed. The work on n detections
of one text grows with n to the power 1.5 at most (``prefix_scan``).
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.prefix_scan import let, prefixes, running_sums

NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Starts of words; a text without any of them holds no keyword, so the keywords are looked for in few texts only.
ROOTS = ("licen", "copyright", "reserved", "cc", "creative", "apache", "gpl", "lgpl", "agpl", "bsd", "mit", "clause",
         "public", "permission", "redistribution", "proprietary", "unauthorized", "unlicense", "wtfpl", "cecill",
         "ncsa", "zlib", "spdx", "warrant", "under", "terms", "opensource", "gnu", "mozilla", "eclipse", "boost",
         "scripts")

# The base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str           # literal that every match holds (of words joined by spaces)
    pattern: str           # words joined by single spaces; no leading or trailing space
    priority: int          # 1 to 3; 3 suppresses all
    confidence: float
    base: bool = False

    @property
    def regex(self) -> str:
        return f" (?:{self.pattern})(?= )"


def _words(text: str) -> str:
    return " ".join(w for w in re.split(NON_WORD, text.translate(str.maketrans(UPPER, LOWER))) if w)


def _versions(label: str, keyword: str, name: str, versions: str, *, plain: str | None = None,
              notice: bool = False) -> list[Rule]:
    """Rules for a license family: each version in full notation, as a short id, and the family alone."""
    out = []
    for v in versions.split():
        w = _words(v)
        tail = f"{w}(?: 0)?" if " " not in w and not v.endswith(".0") else w.replace(" 0", "(?: 0)?")
        out.append(Rule(f"{label}-{v}", keyword, f"{name}(?: license)?(?: as published by(?: [^ ]+){{1,6}})?"
                                                 f"(?: either)?(?: version| v)? v?{tail}", 3, 0.98))
        if notice:
            out.append(Rule(f"{label}-{v}-or-later", keyword,
                            f"{name}(?: license)?(?: [^ ]+){{0,8}}? version {tail}(?: of the license)? or"
                            f"(?: at your option)? any later version", 3, 0.99))
    out.append(Rule(plain or label, keyword, name, 2, 0.8))
    return out


def _spdx(names: str) -> list[Rule]:
    """``SPDX-License-Identifier: X`` lines."""
    return [Rule(n.lower(), "spdx license identifier", f"spdx license identifier {_words(n)}", 3, 1.0)
            for n in names.split()]


def _urls(pairs: str) -> list[Rule]:
    """License texts named by address."""
    out = []
    for pair in pairs.split():
        label, _, url = pair.partition("=")
        w = _words(url)
        out.append(Rule(label, w, w, 3, 0.95))
    return out


def _creative_commons() -> list[Rule]:
    parts = {"by": "attribution", "sa": "share ?alike", "nc": "non ?commercial", "nd": "no ?deriv(?:ative)?s?(?: works)?"}
    out = []
    for kind in ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd"):
        label = "cc-" + kind.replace(" ", "-")
        long = " ".join(parts[k] for k in kind.split())
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            w = _words(v)
            out.append(Rule(f"{label}-{v}", f"cc {kind} {w}", f"(?:licensed under )?cc {kind} {w}(?: [a-z]{{2}})?", 3, 0.99))
            out.append(Rule(f"{label}-{v}", "creative commons", f"creative commons {long}(?: license)? {w}"
                                                                 r"(?: international| unported| generic)?", 3, 0.99))
            out.append(Rule(f"{label}-{v}", "creativecommons org licenses",
                            f"creativecommons org licenses {kind} {w}", 3, 0.97))
        out.append(Rule(label, f"cc {kind}", f"cc {kind}", 2, 0.9))
        out.append(Rule(label, "creative commons", f"creative commons {long}", 2, 0.85))
    out.append(Rule("cc0-1.0", "cc0", "cc0(?: 1 0)?(?: universal)?", 3, 0.97))
    out.append(Rule("cc0-1.0", "creativecommons org publicdomain zero", "creativecommons org publicdomain zero 1 0", 3, 0.97))
    out.append(Rule("cc", "creative commons", "creative commons(?: license)?", 1, 0.5))
    return out


def _bsd() -> list[Rule]:
    out = []
    for n, word in (("0", "zero"), ("1", "one"), ("2", "two"), ("3", "three"), ("4", "four")):
        out.append(Rule(f"bsd-{n}-clause", "clause", f"(?:bsd (?:{n}|{word}) clause|(?:{n}|{word}) clause bsd)(?: license)?", 3, 0.97))
    out += [
        Rule("bsd-2-clause", "simplified bsd", "simplified bsd(?: license)?", 3, 0.9),
        Rule("bsd-3-clause", "bsd", "(?:new|modified|revised) bsd(?: license)?", 3, 0.9),
        Rule("bsd", "bsd license", "(?:licensed under the )?bsd license", 2, 0.85),
        Rule("bsd", "redistribution and use in source and binary forms",
             "redistribution and use in source and binary forms with or without modification are permitted", 2, 0.9),
    ]
    return out


def default_rules() -> tuple[Rule, ...]:
    """All rules in order; the families expand to a few hundred expressions."""
    rules = [Rule(label, phrase, phrase, 2, 0.9, base=True) for phrase, label in BASE]
    rules += _versions("apache", "apache", "(?:licensed under the )?apache(?: software)?(?: license)?", "1.0 1.1 2.0")
    gnu = "(?:licensed under the )?(?:gnu )?"
    rules += _versions("gpl", "general public license", gnu + "general public license", "1 2 3", notice=True)
    rules += _versions("lgpl", "lesser general public license", gnu + "lesser general public license", "2.1 3", notice=True)
    rules += _versions("lgpl", "library general public license", gnu + "library general public license", "2", notice=True)
    rules += _versions("agpl", "affero general public license", gnu + "affero general public license", "1 3", notice=True)
    rules += _versions("gfdl", "free documentation license", gnu + "free documentation license", "1.1 1.2 1.3", notice=True)
    for short, versions in (("gpl", "1.0 2.0 3.0"), ("lgpl", "2.0 2.1 3.0"), ("agpl", "1.0 3.0")):
        for v in versions.split():
            w = _words(v)
            rules.append(Rule(f"{short}-{v}", short, f"{short}(?: version)? v?{w}", 3, 0.9))
            rules.append(Rule(f"{short}-{v}-only", short, f"{short} {w} only", 3, 0.97))
            rules.append(Rule(f"{short}-{v}-or-later", short, f"{short} {w} or later", 3, 0.97))
        major = sorted({v.split(".")[0] for v in versions.split()})
        rules += [Rule(f"{short}-{m}", f"{short}v{m}", f"{short}v{m}", 3, 0.9) for m in major]
        rules += [Rule(f"{short}-{m}-or-later", f"{short}v{m}", f"{short}v{m} or later", 3, 0.95) for m in major]
    rules += _versions("mpl", "mozilla public license", "mozilla public license", "1.0 1.1 2.0")
    rules += _versions("epl", "eclipse public license", "eclipse public license", "1.0 2.0")
    rules += _versions("cddl", "common development and distribution license",
                       "common development and distribution license", "1.0 1.1")
    rules += _versions("cpl", "common public license", "common public license", "1.0")
    rules += _versions("eupl", "european union public licen", "european union public licen[cs]e", "1.0 1.1 1.2")
    rules += _versions("osl", "open software license", "open software license", "1.0 2.0 2.1 3.0")
    rules += _versions("afl", "academic free license", "academic free license", "1.2 2.0 2.1 3.0")
    rules += _versions("artistic", "artistic license", "artistic license", "1.0 2.0")
    rules += _versions("ofl", "open font license", "(?:sil )?open font license", "1.0 1.1")
    rules += _versions("zpl", "zope public license", "zope public license", "1.1 2.0 2.1")
    rules += _versions("bsl", "boost software license", "boost software license", "1.0")
    rules += _versions("busl", "business source license", "business source license", "1.0 1.1")
    rules += _versions("sspl", "server side public license", "server side public license", "1")
    rules += _versions("odbl", "open database license", "open (?:data commons open )?database license", "1.0")
    rules += _versions("php", "php license", "php license", "3.0 3.01")
    rules += _versions("python", "python software foundation license", "python software foundation license", "2")
    rules += _versions("unicode", "unicode license", "unicode license", "3")
    rules += _versions("ms-pl", "microsoft public license", "microsoft public license", "1")
    rules += _versions("ecl", "educational community license", "educational community license", "1.0 2.0")
    rules += _versions("upl", "universal permissive license", "universal permissive license", "1.0")
    rules += _versions("qpl", "q public license", "q public license", "1.0")
    rules += _versions("cecill", "cecill", "cecill(?: free software)?(?: license)?(?: agreement)?", "1.0 2.0 2.1")
    rules += _creative_commons() + _bsd()
    rules += [
        Rule("mit", "mit license", "(?:released|licensed|distributed) under the mit license", 3, 0.99),
        Rule("mit", "mit license", "(?:the )?mit license", 2, 0.9),
        Rule("mit", "permission is hereby granted free of charge",
             "permission is hereby granted free of charge to any person obtaining a copy", 2, 0.95),
        Rule("mit", "x11 license", "x11 license", 2, 0.8),
        Rule("isc", "isc license", "(?:the )?isc license", 2, 0.95),
        Rule("isc", "permission to use copy modify and or distribute this software",
             "permission to use copy modify and or distribute this software for any purpose", 2, 0.95),
        Rule("zlib", "zlib", "zlib(?: libpng)? license", 2, 0.95),
        Rule("unlicense", "unlicense", "(?:the )?unlicense", 2, 0.9),
        Rule("wtfpl", "wtfpl", "wtfpl", 2, 0.9),
        Rule("wtfpl", "do what the fuck you want to public license", "do what the fuck you want to public license", 3, 0.99),
        Rule("postgresql", "postgresql license", "postgresql license", 2, 0.95),
        Rule("openssl", "openssl license", "openssl license", 2, 0.95),
        Rule("ncsa", "ncsa", "(?:university of illinois )?ncsa(?: open source)? license", 2, 0.9),
        Rule("beerware", "beer ware license", "beer ware license", 2, 0.95),
        Rule("public-domain", "public domain",
             "(?:released|dedicated|placed)(?: [^ ]+){0,4} (?:in )?(?:in|into|to) the public domain", 3, 0.95),
        Rule("public-domain", "public domain", "(?:in|into|to) the public domain", 2, 0.7),
        Rule("copyright", "copyright", "copyright(?: c)? (?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})*(?: by)?", 2, 0.8),
        Rule("copyright", "copyright", "copyright(?: c)?", 1, 0.4),
        Rule("proprietary", "proprietary and confidential", "proprietary and confidential", 3, 0.9),
        Rule("proprietary", "unauthorized copying of this file",
             "unauthorized copying of this file(?: via any medium)? is strictly prohibited", 3, 0.95),
        Rule("reserved", "some rights reserved", "some rights reserved", 2, 0.8),
        Rule("reserved", "no part of this publication may be reproduced",
             "no part of this publication may be reproduced", 2, 0.9),
        Rule("no-warranty", "without warranty of any kind", "(?:as is )?without warranty of any kind", 1, 0.4),
        Rule("no-warranty", "without warranties or conditions of any kind",
             "without warranties or conditions of any kind", 1, 0.4),
        Rule("unknown-license", "licensed under", "licensed under(?: the)?(?: [^ ]+){1,6}? licen[cs]e", 1, 0.5),
        Rule("unknown-license", "released under", "released under(?: the)?(?: [^ ]+){1,6}? licen[cs]e", 1, 0.5),
        Rule("unknown-license", "distributed under", "distributed under(?: the)?(?: [^ ]+){1,6}? licen[cs]e", 1, 0.5),
        Rule("terms-of-use", "subject to the terms", "subject to the terms(?: and conditions)? of", 1, 0.3),
    ]
    rules += _spdx("MIT Apache-1.1 Apache-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause ISC Zlib GPL-1.0 GPL-2.0 GPL-3.0 "
                   "LGPL-2.0 LGPL-2.1 LGPL-3.0 AGPL-3.0 MPL-1.1 MPL-2.0 EPL-1.0 EPL-2.0 CDDL-1.0 CC0-1.0 CC-BY-4.0 "
                   "CC-BY-SA-4.0 CC-BY-NC-4.0 OFL-1.1 BSL-1.0 Unlicense WTFPL Artistic-2.0 PostgreSQL EUPL-1.2 "
                   "BUSL-1.1 SSPL-1.0 NCSA OpenSSL")
    rules += _urls("apache-2.0=apache.org/licenses/LICENSE-2.0 mit=opensource.org/licenses/MIT "
                   "gpl=gnu.org/licenses/gpl lgpl=gnu.org/licenses/lgpl agpl=gnu.org/licenses/agpl "
                   "mpl-2.0=mozilla.org/MPL/2.0 epl=eclipse.org/legal/epl unlicense=unlicense.org "
                   "bsl-1.0=boost.org/LICENSE_1_0.txt ofl-1.1=scripts.sil.org/OFL")
    for r in rules:
        if not 1 <= r.priority <= 3 or not any(f" {root}" in f" {r.keyword}" for root in ROOTS):
            raise ValueError(f"priority or keyword of {r}")
    return tuple(rules)


def words_text(text: Column) -> Column:
    """The words of a text joined by single spaces."""
    plain = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NON_WORD, " ")
    return F.trim(plain)


def _spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


MARK = "\x01"                                    # no word holds it
DETECTION = "struct<start:int,neg_end:int,neg_priority:int,rule:int,label:string,confidence:double,base:boolean>"


def detections(padded: Column, rules=None) -> tuple[Column, Column]:
    """(all matches of all rules in words padded by one space on each side, an unsorted array of DETECTION; the
    keywords held, to be put in column ``__held`` first). A rule's matches don't overlap; words count from 0; an interval's end is exclusive and stored negated, so that the
    natural order of the structs is start, longest, highest priority, earliest rule."""
    rules = default_rules() if rules is None else rules
    keywords = list(dict.fromkeys(r.keyword for r in rules))
    at = {k: i for i, k in enumerate(keywords)}
    table = F.array(*[F.struct(
        F.lit(i).alias("rule"), F.lit(at[r.keyword]).alias("keyword"), F.lit(r.regex).alias("regex"),
        F.lit(r.label).alias("label"), F.lit(r.priority).alias("priority"),
        F.lit(float(r.confidence)).alias("confidence"), F.lit(r.base).alias("base"))
        for i, r in enumerate(rules)])
    words = F.array(*[F.struct(F.lit(i).alias("keyword"), F.lit(f" {k}").alias("word"))
                      for i, k in enumerate(keywords)])
    rooted = reduce(or_, [F.contains(padded, F.lit(f" {root}")) for root in ROOTS])
    held = F.when(rooted, F.transform(F.filter(words, lambda k: F.contains(padded, k["word"])),
                                      lambda k: k["keyword"])).otherwise(F.array().cast("array<int>"))

    def found(r: Column) -> Column:
        # words between matches, match, words, match, ..., words: one pass of the expression, positions by running sums
        cut = F.split(F.regexp_replace(padded, r["regex"], F.lit(f"{MARK}$0{MARK}")), MARK, -1)

        def placed(pieces):
            def all_of(starts):
                return F.transform(F.sequence(F.lit(1), F.size(pieces) - 2, F.lit(2)), lambda i: F.struct(
                    F.get(starts, i).alias("start"), (-F.get(starts, i + 1)).alias("neg_end"),
                    (-r["priority"]).alias("neg_priority"), r["rule"].alias("rule"), r["label"].alias("label"),
                    r["confidence"].alias("confidence"), r["base"].alias("base")))
            return F.when(F.size(pieces) > 1, let(running_sums(F.transform(pieces, _spaces)), all_of)).otherwise(
                F.array().cast(f"array<{DETECTION}>")).cast(f"array<{DETECTION}>")

        return let(cut, placed)

    return (F.flatten(F.transform(F.filter(table, lambda r: F.array_contains(F.col("__held"), r["keyword"])), found)),
            held)


def scan(df: DataFrame, text_col: str = "text", keep: tuple = ("doc_id",), rules=None) -> DataFrame:
    """Columns of ``keep``, ``n_words``, ``found`` (all detections, sorted) and ``kept`` (after suppression)."""
    out = df.select(*keep, words_text(F.col(text_col)).alias("__words"))
    out = out.withColumn("__padded", F.concat(F.lit(" "), F.col("__words"), F.lit(" ")))
    found, held = detections(F.col("__padded"), rules)
    empty = F.array().cast(f"array<{DETECTION}>")
    out = out.withColumn("__held", held)
    out = out.withColumn("found", F.when(F.size("__held") > 0, F.sort_array(found)).otherwise(empty))

    # what reaches furthest among the detections before, by least priority
    ends = F.transform("found", lambda d: F.struct(
        (-d["neg_end"]).alias("m1"), F.when(d["neg_priority"] <= -2, -d["neg_end"]).otherwise(-1).alias("m2"),
        F.when(d["neg_priority"] <= -3, -d["neg_end"]).otherwise(-1).alias("m3")))
    nowhere = F.struct(*[F.lit(-1).alias(m) for m in ("m1", "m2", "m3")])
    furthest = prefixes(ends, nowhere, lambda a, b: F.struct(*[F.greatest(a[m], b[m]).alias(m) for m in ("m1", "m2", "m3")]),
                        "struct<m1:int,m2:int,m3:int>")

    def stays(d, reach):
        mine = F.when(d["neg_priority"] == -3, reach["m3"]).when(d["neg_priority"] == -2, reach["m2"]).otherwise(reach["m1"])
        return d["base"] | (mine < -d["neg_end"])

    out = out.withColumn("__reach", F.when(F.size("found") > 1, furthest))
    out = out.withColumn("kept", F.when(F.size("found") > 1, F.filter(
        "found", lambda d, i: stays(d, F.get(F.col("__reach"), i)))).otherwise(F.col("found")))
    n = F.when(F.col("__words") == "", F.lit(0)).otherwise(_spaces(F.col("__words")) + 1)
    return out.select(*keep, n.cast("long").alias("n_words"), "found", "kept")


def scan_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=None) -> DataFrame:
    """One row per document: base places, labels and a score (the highest confidence of a kept detection)."""
    out = scan(df, text_col, (id_col,), rules)
    base = F.filter("found", lambda d: d["base"])
    starts = F.transform("__base", lambda d: d["start"])
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda d: d["label"]))), ",")
    return out.withColumn("__base", base).select(
        id_col, "n_words", F.size("__base").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        labels("__base").alias("base_labels"), labels("kept").alias("labels"),
        F.coalesce(F.array_max(F.transform("kept", lambda d: d["confidence"])), F.lit(0.0)).alias("score"),
        F.size("found").cast("long").alias("n_detections"))
