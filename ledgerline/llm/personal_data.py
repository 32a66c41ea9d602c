"""Personal data in texts by weak supervision: labelers vote, expectation-maximisation weighs them, a classifier decides.

Candidates are matches of the base expressions (one per kind: email, ip, card, phone) and of wider ones over what the
base spans of the kind leave. Each candidate gets a vote (1 personal, 0 not, -1 no opinion) from every labeler:
expressions, gazetteers (domain endings, card issuers, calling codes, special address ranges), checks of numbers, and
the words and characters around it. Candidates with the same kind, votes and features are counted over all documents;
the number of different ones is bounded by what votes and features can be, whatever the number of documents. On these
counts, expectation-maximisation estimates how reliable each labeler is and how likely each combination is personal,
and a logistic span classifier is trained on these likelihoods. Base spans that pass their check are always kept; the
classifier decides on the wider ones.

DataFrame functions only. Texts are read once: the candidates are checkpointed, the model is one row.

Defined results: a NULL text counts as empty; rows with equal or NULL ids are separate documents, one row each; an
empty table gives no rows; other columns are ignored, whatever their names; positions are code points, ends exclusive.
A text's work grows with its length (expressions can't run back over what they have passed).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.prefix_scan import let, running_sums
from ledgerline.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
MARK, MASK = "\x01", "\x03"

# The base expressions. Runs are possessive and begin where the run does (or where the match before ended), which
# finds the same matches as trying every position.
_ADDRESS = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:\G|(?<![{_ADDRESS}]))[{_ADDRESS}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Wider expressions, over the text without the base spans of the kind.
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_DOT = r"(?:\[\.\]|\(\.\)|\x20dot\x20)"
WIDE = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}(?:@|\x20?(?:\(at\)|\[at\]|\{at\})\x20?)[\p{L}\p{N}-]{1,63}"
             r"(?:(?:\.|\x20?(?:\(dot\)|\[dot\]|\{dot\})\x20?)[\p{L}\p{N}-]{1,63}){1,8}",
    "ip": rf"(?<![0-9A-Za-z:.]){_OCTET}(?:{_DOT}{_OCTET}){{3}}(?![0-9A-Za-z])"
          r"|(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])[0-9]{13,19}(?![0-9])"
            r"|(?<![0-9])[0-9]{4}([\x20-])[0-9]{4}\2[0-9]{4}\2[0-9]{1,7}(?![0-9])"
            r"|(?<![0-9])3[47][0-9]{2}([\x20-])[0-9]{6}\3[0-9]{5}(?![0-9])",
    "phone": r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?(?:[\x20.-]?[0-9]{2,4}){2,3}(?![0-9])"
             r"|(?<![0-9A-Za-z.+-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9]|[.-][0-9])"
             r"|(?<![0-9A-Za-z.+-])00[1-9][0-9](?:[\x20.-]?[0-9]{2,4}){3,4}(?![0-9])",
}
# A text without these can't hold a wider match of the kind.
GATE = {"email": r"@|[(\[{]at[)\]}]", "ip": r"\[\.\]|\(\.\)|\x20dot\x20|[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:",
        "card": r"[0-9]{13}|[0-9]{4}[\x20-][0-9]{4}[\x20-]|3[47][0-9]{2}[\x20-][0-9]{6}",
        "phone": r"\+[0-9]|[0-9]{3}\)?[\x20.-]?[0-9]{3}[.-][0-9]{4}|00[1-9][0-9]"}

# Gazetteers and words around a span: fixed values.
ENDINGS = ("com org net edu gov mil int info biz io co me dev app de fr es it nl be at ch uk us ca au jp cn in br ru "
           "pl se no dk fi pt ie eu mx ar cl")
FILE_ENDINGS = "png jpg jpeg gif svg js css html py java txt md json xml"
CALLING_CODES = ("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 "
                 "66 81 82 84 86 90 91 92 93 94 95 98")
NEAR = {
    "email": "e-?mail|mail|contact|write|reach|address|kontakt|courriel|correo",
    "ip": "ip|host|server|address|login|logged|client|from|adresse|servidor",
    "card": "card|visa|master|amex|credit|debit|payment|paid|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|cell|fax|whatsapp|dial|ring|telefon|appel|llam",
}
FAR = {
    "email": "example of|syntax|git|ssh|scp|package|version",
    "ip": "version|release|section|chapter|build|v",
    "card": "isbn|issn|order|serial|sku|doi|hash|id|tracking",
    "phone": "version|section|isbn|order|serial|sku|id|figure|table",
}

VOTERS = ("shape", "check", "gazetteer", "words", "edges", "filler")
FEATURES = ("bias", "shape", "check", "gazetteer", "near", "far", "clean_left", "clean_right", "marks", "long")
SPAN = "struct<kind:int,start:int,stop:int,state:int,votes:array<int>,features:array<int>>"
PASSED, WIDER, FAILED = 2, 1, 0


def _pieces(text: Column, regex: str) -> Column:
    """Text between matches, match, text, match, ..., text."""
    return F.split(F.regexp_replace(text, regex, f"{MARK}$0{MARK}"), MARK, -1)


def _hits(pieces: Column, starts: Column) -> Column:
    """(start, stop, hit, left, right) of every match; left and right are the 32 and 8 code points around it."""
    def one(i):
        return F.struct(F.get(starts, i).alias("start"), F.get(starts, i + 1).alias("stop"),
                        F.get(pieces, i).alias("hit"), F.substring(F.get(pieces, i - 1), -32, 32).alias("left"),
                        F.substring(F.get(pieces, i + 1), 1, 8).alias("right"))
    nothing = F.array().cast("array<struct<start:int,stop:int,hit:string,left:string,right:string>>")
    return F.when(F.size(pieces) > 1, F.transform(F.sequence(F.lit(1), F.size(pieces) - 2, F.lit(2)), one)
                  ).otherwise(nothing)


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]+", "")


def _luhn(digits: Column) -> Column:
    """13 to 19 digits whose weighted sum ends in 0."""
    def weigh(rev):
        def add(acc, i):
            d = F.substring(rev, i, F.lit(1)).cast("int")
            return acc + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.aggregate(F.sequence(F.lit(1), F.lit(19)), F.lit(0), lambda acc, i: F.when(
            i <= F.length(rev), add(acc, i)).otherwise(acc)) % 10 == 0
    return F.when(F.length(digits).between(13, 19), let(F.reverse(digits), weigh)).otherwise(F.lit(False))


def passes(kind: str, hit: Column) -> Column:
    """Whether a match of a base expression passes its check."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return F.rlike(hit, F.lit(rf"^{part}(?:\.{part}){{3}}$"))
    if kind == "card":
        return _luhn(_digits(hit))
    return F.length(_digits(hit)).between(9, 15)


def _any(words: str) -> str:
    return "(?:" + "|".join(words.split()) + ")"


def _vote(yes: Column, no: Column | None = None) -> Column:
    """1 where ``yes``; 0 where ``no`` (everywhere else, if not given); -1 where neither."""
    return F.when(yes, 1).when(F.lit(True) if no is None else no, 0).otherwise(-1)


def _labels(kind: str, h: Column) -> tuple[Column, Column]:
    """(votes of VOTERS, FEATURES) of a candidate (start, stop, hit, left, right)."""
    hit, left, right = h["hit"], h["left"], h["right"]
    digits = _digits(hit)
    like = lambda c, regex: F.rlike(c, F.lit(regex))
    if kind == "email":
        shape = like(hit, r"^[^.@][^@]{0,63}@[A-Za-z0-9-][A-Za-z0-9.-]*\.[A-Za-z]{2,}$")
        check = F.length(hit).between(6, 254) & ~like(hit, r"\.\.|--|@-|-$")
        known, unknown = like(hit, rf"(?i)[.\x20)\]}}]{_any(ENDINGS)}$"), like(hit, rf"(?i)\.{_any(FILE_ENDINGS)}$")
        filler = like(hit, r"(?i)^(?:foo|bar|user|name|you)[.@]")
        marks = like(hit, r"[(\[{]")
    elif kind == "ip":
        shape = like(hit, rf"^{_OCTET}(?:\.{_OCTET}){{3}}$|^[0-9A-Fa-f:]+$")
        check = passes("ip", F.regexp_replace(hit, _DOT, ".")) | F.contains(hit, F.lit(":"))
        known = like(hit, r"^(?:[1-9][0-9]?|1[0-9]{2}|2[0-4][0-9]|25[0-5])\D")
        unknown = like(hit, r"^(?:0|127|255)\.|^(?:[0-9]\.){3}[0-9]$")
        filler = like(hit, r"^([0-9]+)(?:\.\1){3}$")
        marks = like(hit, r"[(\[x]| dot ")
    elif kind == "card":
        shape = like(hit, r"^[0-9]{13,19}$|^[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}$|^[0-9]{4}([ -])[0-9]{6}\2[0-9]{5}$")
        check = _luhn(digits)
        known, unknown = like(digits, r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5|4[4-9])|35)"), like(digits, r"^[0179]")
        filler = like(digits, r"^([0-9])\1+$|^(?:0?123456789)++0*$")
        marks = like(hit, r"[ -]")
    else:
        shape = like(hit, r"^\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,3}$|^\(?[0-9]{3}[)][ ]?[0-9]{3}[.-][0-9]{4}$")
        check = F.length(digits).between(9, 15)
        known = like(hit, rf"^(?:\+|00){_any(CALLING_CODES)}|^\([2-9]")
        unknown = like(hit, r"^(?:\+0|\(?[01][0-9]{2}[).-])")
        filler = like(digits, r"^[0-9]?([0-9])\1+$|^[0-9]?1234567")
        marks = like(hit, r"[(.-]")
    near = like(left, rf"(?i)(?<![\p{{L}}]){_any(NEAR[kind].replace('|', ' '))}[\p{{L}}]{{0,6}}[^\p{{L}}\p{{N}}]{{0,3}}(?:[\p{{L}}]{{1,8}}[^\p{{L}}\p{{N}}]{{1,3}})?$")
    far = like(left, rf"(?i)(?<![\p{{L}}])(?:{FAR[kind]})[^\p{{L}}\p{{N}}]{{0,3}}$")
    clean_left = ~like(left, r"[\p{L}\p{N}_=/+.-]$")
    clean_right = ~like(right, r"^(?:[\p{L}\p{N}_=/]|[.-][0-9])")
    votes = F.array(_vote(shape), _vote(check), _vote(known, unknown), _vote(near, far),
                    _vote(clean_left & clean_right), _vote(F.lit(False), filler))
    features = F.array(*[c.cast("int") for c in (
        F.lit(True), shape, check, known, near, far, clean_left, clean_right, marks, F.length(hit) > 20)])
    return votes, features


def candidates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, found): all candidates of a text, an array of SPAN by kind and start.

    ``state``: PASSED for a base span, WIDER for a match of a wider expression that passes the kind's check, FAILED
    for a match of either whose check fails (only the fit reads it)."""
    text = F.replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(MARK), F.lit("\x02"))
    out = df.select(F.col(id_col), text.alias("__t"))
    plain = {"email": F.contains("__t", F.lit("@")), "ip": F.rlike("__t", F.lit(r"[0-9]\.[0-9]")),
             "card": F.rlike("__t", F.lit(r"[0-9][\x20-]?[0-9]")), "phone": F.contains("__t", F.lit("+"))}
    keep = [id_col]

    def labelled(number, kind):
        def one(h):
            votes, features = _labels(kind, h)
            check = F.get(votes, F.lit(VOTERS.index("check"))) == 1
            state = F.when(h["ok"], PASSED).when(h["ok"].isNull() & check, WIDER).otherwise(FAILED)
            return F.struct(F.lit(number).alias("kind"), h["start"].alias("start"), h["stop"].alias("stop"),
                            state.alias("state"), votes.alias("votes"), features.alias("features"))
        wider = F.transform(_hits(F.col(f"__p_{kind}"), lengths(F.col(f"__p_{kind}"))),
                            lambda h: h.withField("ok", F.lit(None).cast("boolean")))
        both = F.concat(F.col(f"__h_{kind}"), wider)
        return F.array_sort(F.transform(both, one).cast(f"array<{SPAN}>"))

    def checked(kind):
        return F.transform(_hits(F.col(f"__p_{kind}"), F.col(f"__o_{kind}")),
                           lambda h: h.withField("ok", passes(kind, h["hit"])))

    def without_base(kind):
        hits = F.col(f"__h_{kind}")
        return F.array_join(F.transform(F.col(f"__p_{kind}"), lambda p, i: F.when(
            (i % 2 == 1) & F.get(hits, F.floor((i - 1) / 2).cast("int"))["ok"], F.repeat(F.lit(MASK), F.length(p))
        ).otherwise(p)), "")

    one_piece = lambda c: F.array(c)
    lengths = lambda c: running_sums(F.transform(c, F.length))
    out = out.select(*keep, "__t", *[F.when(plain[k], _pieces(F.col("__t"), BASE[k])).otherwise(one_piece(F.col("__t")))
                                     .alias(f"__p_{k}") for k in KINDS])
    out = out.select("*", *[lengths(F.col(f"__p_{k}")).alias(f"__o_{k}") for k in KINDS])
    out = out.select("*", *[checked(k).alias(f"__h_{k}") for k in KINDS])
    out = out.select(*keep, *[f"__h_{k}" for k in KINDS], *[
        F.when(F.rlike("__t", F.lit(GATE[k])), F.when(F.size(f"__p_{k}") > 1, without_base(k)).otherwise(F.col("__t"))
               ).alias(f"__m_{k}") for k in KINDS])
    # The whole wider expression is group 1, so that the references inside count from 2.
    out = out.select(*keep, *[f"__h_{k}" for k in KINDS], *[
        F.when(F.rlike(f"__m_{k}", F.lit(GATE[k])), _pieces(F.col(f"__m_{k}"), f"({WIDE[k]})"))
        .otherwise(F.array(F.lit(""))).alias(f"__p_{k}") for k in KINDS])
    return out.select(*keep, F.concat(*[labelled(number, k) for number, k in enumerate(KINDS)]).alias("found"))


def _sum(items: Column, value) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda acc, x: acc + value(x))


def _sigmoid(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-z))


def reliabilities(patterns: Column, rounds: int = 30) -> Column:
    """Expectation-maximisation over counted votes: struct(prior, yes, no).

    ``patterns``: array of (votes, features, n). ``yes[l]`` is the probability that labeler l votes 1 on a personal
    span if it votes, ``no[l]`` on another one. Weak priors (ten votes: 0.9 and 0.3) keep the two classes apart and
    few votes sane."""
    voters = F.sequence(F.lit(0), F.lit(len(VOTERS) - 1))
    same = lambda p: F.array(*[F.lit(float(p))] * len(VOTERS))
    state = lambda prior, yes, no: F.struct(prior.alias("prior"), yes.alias("yes"), no.alias("no"))

    def step(m, _):
        def again(scored):
            def rate(weight, prior):
                return F.transform(voters, lambda v: (
                    _sum(scored, lambda p: F.when(F.get(p["votes"], v) == 1, p["n"] * weight(p)).otherwise(0.0)) + 10 * prior)
                    / (_sum(scored, lambda p: F.when(F.get(p["votes"], v) >= 0, p["n"] * weight(p)).otherwise(0.0)) + 10))
            prior = (_sum(scored, lambda p: p["n"] * p["q"]) + 1) / (_sum(scored, lambda p: p["n"]) + 2)
            return state(prior, rate(lambda p: p["q"], 0.9), rate(lambda p: 1 - p["q"], 0.3))
        return let(F.transform(patterns, lambda p: F.struct(p["votes"].alias("votes"), p["n"].alias("n"),
                                                            likelihood(p["votes"], m).alias("q"))), again)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), state(F.lit(0.5), same(0.9), same(0.3)), step)


def likelihood(votes: Column, m: Column) -> Column:
    """Probability that a candidate with these votes is personal, by ``reliabilities``."""
    def opinion(acc, v):
        vote, yes, no = F.get(votes, v), F.get(m["yes"], v), F.get(m["no"], v)
        return acc + F.when(vote == 1, F.log(yes / no)).when(vote == 0, F.log((1 - yes) / (1 - no))).otherwise(0.0)
    return _sigmoid(F.aggregate(F.sequence(F.lit(0), F.lit(len(VOTERS) - 1)),
                                F.log(m["prior"] / (1 - m["prior"])), opinion))


def _dot(weights: Column, features: Column) -> Column:
    return F.aggregate(F.zip_with(weights, features, lambda w, x: w * x), F.lit(0.0), lambda a, b: a + b)


def classifier(patterns: Column, m: Column, rounds: int = 150, ridge: float = 0.1) -> Column:
    """Weights of FEATURES: logistic regression on the likelihoods of ``reliabilities``.

    Each step divides the gradient by a bound of the curvature, so the objective never falls."""
    places = F.sequence(F.lit(0), F.lit(len(FEATURES) - 1))

    def train(rows):
        curvature = F.transform(places, lambda j: _sum(rows, lambda p: 0.25 * p["n"] * F.get(p["features"], j)
                                                       * p["held"]) + ridge)

        def fit(bound):
            def step(w, _):
                return let(F.transform(rows, lambda p: F.struct(
                    p["features"].alias("features"),
                    (p["n"] * (p["q"] - _sigmoid(_dot(w, p["features"])))).alias("miss"))),
                    lambda missed: F.transform(places, lambda j: F.get(w, j) + (
                        _sum(missed, lambda p: p["miss"] * F.get(p["features"], j)) - ridge * F.get(w, j))
                        / F.get(bound, j)))
            return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.array(*[F.lit(0.0)] * len(FEATURES)), step)

        return let(curvature, fit)

    return let(F.transform(patterns, lambda p: F.struct(
        p["features"].alias("features"), p["n"].alias("n"), likelihood(p["votes"], m).alias("q"),
        F.aggregate(p["features"], F.lit(0), lambda a, b: a + b).alias("held"))), train)


def span_model(found: DataFrame) -> DataFrame:
    """(kind, prior, yes, no, weights): one row for each kind that has candidates, fitted on all of them.

    The counted combinations of votes and features go into one row a kind: at most 3^6 votes (each 1, 0 or none) times
    2^9 features, and some hundreds in practice, whatever the number of documents."""
    counted = (found.select(F.explode("found").alias("s")).select("s.kind", "s.votes", "s.features")
               .groupBy("kind", "votes", "features").agg(F.count("*").cast("double").alias("n")))
    rows = counted.groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("votes", "features", "n"))).alias("patterns"))
    rows = rows.withColumn("m", reliabilities(F.col("patterns")))
    rows = rows.withColumn("weights", classifier(F.col("patterns"), F.col("m")))
    return rows.select("kind", "m.prior", "m.yes", "m.no", "weights")


def personal_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(id, spans): all base spans and the wider ones that the classifier takes, by kind and start: an array of
    (kind, start, stop, base, score)."""
    found = cut_lineage(candidates(df, id_col, text_col))
    by_kind = F.map_from_entries(F.collect_list(F.struct("kind", "weights")))
    model = cut_lineage(span_model(found).groupBy().agg(by_kind.alias("by_kind")).select(
        F.transform(F.sequence(F.lit(0), F.lit(len(KINDS) - 1)),
                    lambda k: F.try_element_at("by_kind", k)).alias("weights")))
    names = F.array(*[F.lit(k) for k in KINDS])
    scored = F.transform("found", lambda s: F.struct(
        F.get(names, s["kind"]).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"),
        (s["state"] == PASSED).alias("base"),
        F.coalesce(_sigmoid(_dot(F.get(F.col("__weights"), s["kind"]), s["features"])), F.lit(0.0)).alias("score"),
        s["state"].alias("state")))
    out = found.select(id_col, "found", model.scalar().alias("__weights"))
    kept = F.filter(scored, lambda s: (s["state"] == PASSED) | ((s["state"] == WIDER) & (s["score"] >= threshold)))
    return out.select(id_col, F.transform(kept, lambda s: s.dropFields("state")).alias("spans"))


def personal_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per document: counts and digest of the base spans, and all spans as kind:start:stop."""
    out = personal_spans(df, id_col, text_col, threshold)
    base = F.filter("spans", lambda s: s["base"])
    shown = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("__base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return out.withColumn("__base", base).select(
        id_col, *[count(k) for k in KINDS], F.sha2(shown("__base").cast("binary"), 256).alias("base_sha256"),
        shown("spans").alias("spans"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("top_score"))


def span_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(id, start, stop, kind, base, score): the spans as rows, one each."""
    spans = personal_spans(df, id_col, text_col, threshold)
    return spans.select(id_col, F.explode("spans").alias("s")).select(
        id_col, "s.start", "s.stop", "s.kind", "s.base", "s.score")
