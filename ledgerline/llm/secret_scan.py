"""Secret scans: base expressions, and a linear-chain conditional random field that adds spans.

The base kinds (``assign``, ``access``, ``hex``) are regular expressions. The field tags the tokens of a whole text
as begin, inside or outside of a secret. Its features are a token's shape, length, kinds of characters and key word,
the same of the two tokens before and the one after it, and features of the file (share of digits and marks, whether
it has assignments or key words). It is trained by gradient steps on the log-likelihood of token windows from a
bounded sample, with what the base expressions find as tags and with altered copies of such windows (other secrets,
no assignment), and decoded by Viterbi.

Decoding is exact: where "outside" leads by more than any change of the transitions could win back, it is certain,
and the best path between such places is found on its own.

Defined results: NULL counts as the empty text; repeated rows give repeated results; extra columns are not read;
places are code points, ends exclusive. A span of the field that lies within base spans is left out; one that reaches
further stays whole, beside the base spans.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm import samples
from ledgerline.llm.memory import claim
from ledgerline.llm.tokens import _forget
from ledgerline.session import cut_lineage

# The base kinds in order, their expressions and least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex")

SAMPLE = 16_384                   # bound of the documents that the field is trained on
WINDOW = 12                       # tokens on each side of a tagged one that are trained on
EPOCHS, RATE, RIDGE = 8, 0.3, 1e-3
REMEMBERED = 200_000              # tokens whose features a worker remembers

OUT, BEGIN, INSIDE = 0, 1, 2
TOKEN = re.compile(r"[A-Za-z0-9_+/.-]+|[^\sA-Za-z0-9_+/.-]+")
KEY = re.compile(r"pass(?:word|wd|phrase|code)?|pwd|secret|token|api_?key|key|credential|auth|bearer|login|private", re.I | re.A)
PLACES = ("own", "before", "before2", "after")


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    """(start, end, kind, start of the secret itself) by start, then kind."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), m.end(), "assign", m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access", m.start()) for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex", m.start()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


# -- features -------------------------------------------------------------------------------------

def _entropy(token: str) -> float:
    n = len(token)
    return -sum(c / n * math.log2(c / n) for c in Counter(token).values())


def token_features(token: str) -> tuple[str, ...]:
    """What the field sees of a token; many tokens share one tuple."""
    n = len(token)
    size = f"n{min(n, 8) if n < 12 else 12 if n < 16 else 16 if n < 20 else 20 if n < 32 else 32}"
    if token.isalpha():
        key = KEY.fullmatch(token)
        case = "lower" if token.islower() else "upper" if token.isupper() else "title" if token.istitle() else "mixed"
        return (case, size, f"{case}{size}", *((f"key:{key[0].lower()}", "key") if key else ()))
    if not any(c.isalnum() for c in token):
        return ("mark", *sorted({f"has{c}" for c in token}), *(("assigns",) if token[0] in "=:" or token[-1] in "=:" else ()))
    out = [size]
    kinds = (("a" if any("a" <= c <= "z" for c in token) else "") + ("A" if any("A" <= c <= "Z" for c in token) else "")
             + ("0" if any(c.isdigit() for c in token) else "") + ("-" if not token.isalnum() else ""))
    turns = sum(a.isdigit() != b.isdigit() for a, b in zip(token, token[1:]))
    e = _entropy(token)
    out += [f"kinds:{kinds}", f"kinds:{kinds}{size}", f"turns{min(turns, 6)}", f"bits{min(int(2 * e), 10)}",
            f"bits{min(int(2 * e), 10)}{size}"]
    if re.fullmatch(r"[0-9a-f]+", token):
        out.append("hex")
    if re.fullmatch(r"[0-9.+/-]+", token):
        out.append("number")
    if KEY.search(token):
        out.append("keyish")
    if token[0].isalpha() and token[-1:] in ".-" and token[:-1].isalpha():
        out += ["wordend", f"wordend{size}"]
    return tuple(out)


def file_features(text: str) -> tuple[str, ...]:
    n = max(1, len(text))
    marks = sum(text.count(c) for c in "=:{}[]();\"'<>|*%$#&!")
    return (f"marks{min(int(50 * marks / n), 5)}", *(("assigns",) if "=" in text else ()),
            *(("keys",) if "token" in text or "key" in text or "password" in text or "secret" in text else ()))


# -- the field ------------------------------------------------------------------------------------

class Field:
    """Weights: (place, feature) -> three numbers; transitions 3 x 3; start 3."""

    def __init__(self, weights: dict[str, list[float]], moves, start):
        self.weights = weights
        self.moves = np.asarray(moves, dtype=np.float64)
        self.start = np.asarray(start, dtype=np.float64)
        m = self.moves
        # most that the transitions can win when a token is not outside (a neighbour may be missing)
        self.lead = max(m[a, y] + m[y, b] - m[a, OUT] - m[OUT, b] for a in range(3) for y in (1, 2) for b in range(3))
        self.lead = max(self.lead, *(self.start[y] + m[y, b] - self.start[OUT] - m[OUT, b] for y in (1, 2) for b in range(3)),
                        *(m[a, y] - m[a, OUT] for a in range(3) for y in (1, 2)),
                        *(self.start[y] - self.start[OUT] for y in (1, 2))) + 1e-9
        self._known = {name.split(" ", 1)[1] for name in weights}
        self._rows: dict[tuple, int] = {}
        self._table = np.zeros((64, 4, 3))
        self._of: dict[str, int] = {}

    def _row(self, token: str) -> int:
        feats = tuple(f for f in token_features(token) if f in self._known)      # others weigh nothing
        row = self._rows.get(feats)
        if row is None:
            row = self._rows[feats] = len(self._rows)
            if row >= len(self._table):
                self._table = np.concatenate([self._table, np.zeros_like(self._table)])
            for k, place in enumerate(PLACES):
                for f in feats:
                    self._table[row, k] += self.weights.get(f"{place} {f}", (0, 0, 0))
        if len(token) <= 64:
            self._of[token] = row
        return row

    def emissions(self, text: str, tokens: list[str]) -> np.ndarray:
        of, row = self._of, self._row
        rows = np.array([r if (r := of.get(t)) is not None else row(t) for t in tokens], dtype=np.int64)
        _forget(self._of, REMEMBERED)
        t = self._table
        e = t[rows, 0]
        e[1:] += t[rows[:-1], 1]
        e[2:] += t[rows[:-2], 2]
        e[:-1] += t[rows[1:], 3]
        for f in file_features(text):
            e += self.weights.get(f"file {f}", (0, 0, 0))
        return e

    def decode(self, e: np.ndarray) -> list[tuple[int, int]]:
        """Viterbi: runs (first, behind last) of tokens that are tagged as secret; each begin starts one."""
        sure = e[:, OUT] - np.maximum(e[:, BEGIN], e[:, INSIDE]) > self.lead
        unsure = np.flatnonzero(~sure)
        if not len(unsure):
            return []
        cuts = np.flatnonzero(np.diff(unsure) > 1) + 1
        runs = []
        for part in np.split(unsure, cuts):
            a, b = int(part[0]), int(part[-1]) + 1
            tags = self._viterbi(e[a:b], a == 0, b == len(e))
            begin = None
            for i, y in enumerate([*tags, OUT]):
                if begin is not None and y != INSIDE:
                    runs.append((a + begin, a + i))
                    begin = None
                if y == BEGIN or (y == INSIDE and begin is None):
                    begin = i
        return runs

    def _viterbi(self, e: np.ndarray, first: bool, last: bool) -> list[int]:
        """Best tags of a stretch; outside it every neighbour is certainly OUT."""
        m = self.moves
        score = e[0] + (self.start if first else m[OUT])
        back = []
        for x in e[1:]:
            whole = score[:, None] + m
            back.append(whole.argmax(0))
            score = whole.max(0) + x
        if not last:
            score = score + m[:, OUT]
        tags = [int(score.argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return tags[::-1]

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Code point ranges that the field tags as secrets in a whole text."""
        tokens = TOKEN.findall(text)
        if not tokens:
            return []
        runs = self.decode(self.emissions(text, tokens))
        if not runs:
            return []
        places = [m.span() for m in TOKEN.finditer(text)]
        return [(places[a][0], places[b - 1][1]) for a, b in runs]


# -- training -------------------------------------------------------------------------------------

def training_windows(text: str):
    """(features by token, tags) of windows around tagged tokens, and one from elsewhere."""
    places = [m.span() for m in TOKEN.finditer(text)]
    if not places:
        return
    tokens = [text[a:b] for a, b in places]
    tags = [OUT] * len(tokens)
    starts = [a for a, _ in places]
    for _, end, _, secret in base_spans(text):
        k = int(np.searchsorted(starts, secret, "right")) - 1
        state = BEGIN
        while k < len(tokens) and places[k][0] < end:
            if places[k][1] > secret:
                tags[k] = state if tags[k] == OUT else tags[k]
                state = INSIDE
            k += 1
    hits = [i for i, y in enumerate(tags) if y]
    middles = hits + [steady_place(text, len(tokens))]
    for f in dict.fromkeys(max(0, i - WINDOW) for i in middles):
        stop = min(len(tokens), f + 2 * WINDOW + 1)
        yield tokens[max(0, f - 2):f], tokens[f:stop], tokens[stop:stop + 1], tags[f:stop]


def steady_place(text: str, n: int) -> int:
    """A place in a text that depends on the text only."""
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "big") % n


def altered(tokens, tags, rng: np.random.Generator) -> tuple[list[str], list[int]]:
    """A tagged window with other secrets, and often without the assignment before them: what the base expressions
    can't show the field."""
    letters = ("0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
               "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
               "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-")
    chars = letters[rng.integers(0, len(letters))]
    bare = rng.random() < 0.6
    out, kept = [], []
    for i, (t, y) in enumerate(zip(tokens, tags)):
        if y and len(t) >= 6:
            t = "".join(chars[j] for j in rng.integers(0, len(chars), int(rng.integers(16, 45))))
        elif bare and not y and any(tags[i + 1:i + 3]) and set(t) <= set("=:"):
            continue
        out.append(t)
        kept.append(y)
    return out, kept


def window_features(before, tokens, after, filed) -> list[list[str]]:
    whole = [*before, *tokens, *after]
    feats = [token_features(t) for t in whole]
    out = []
    for i in range(len(before), len(before) + len(tokens)):
        near = (("own", i), ("before", i - 1), ("before2", i - 2), ("after", i + 1))
        out.append([f"{p} {f}" for p, j in near if 0 <= j < len(whole) for f in feats[j]] + [f"file {f}" for f in filed])
    return out


def log_likelihood(e: np.ndarray, moves: np.ndarray, start: np.ndarray, tags) -> tuple[float, np.ndarray, np.ndarray]:
    """(log-likelihood of the tags, its gradient by the emissions, by the transitions); forward-backward."""
    n = len(e)
    fwd, bwd = np.zeros((n, 3)), np.zeros((n, 3))
    fwd[0] = start + e[0]
    for i in range(1, n):
        x = fwd[i - 1][:, None] + moves
        top = x.max(0)
        fwd[i] = e[i] + top + np.log(np.exp(x - top).sum(0))
    for i in range(n - 2, -1, -1):
        x = moves + (e[i + 1] + bwd[i + 1])[None, :]
        top = x.max(1)
        bwd[i] = top + np.log(np.exp(x - top[:, None]).sum(1))
    top = fwd[-1].max()
    z = top + math.log(np.exp(fwd[-1] - top).sum())
    grad = -np.exp(fwd + bwd - z)
    gm = np.zeros((3, 3))
    value = start[tags[0]] - z
    for i, y in enumerate(tags):
        grad[i, y] += 1
        value += e[i, y]
        if i:
            value += moves[tags[i - 1], y]
            gm[tags[i - 1], y] += 1
    if n > 1:
        pair = fwd[:-1, :, None] + moves[None] + (e[1:] + bwd[1:])[:, None, :] - z
        gm -= np.exp(pair).sum(0)
    return value, grad, gm


def train_field(windows, epochs: int = EPOCHS, seed: int = 5) -> Field:
    """Gradient steps with a rate for each weight. ``windows``: (features by token, tags)."""
    names: dict[str, int] = {}
    data = [([np.array([names.setdefault(f, len(names)) for f in fs], dtype=np.int64) for fs in feats], list(tags))
            for feats, tags in windows]
    w, seen = np.zeros((len(names) + 1, 3)), np.full((len(names) + 1, 3), 1e-3)
    moves, seen_m, start = np.zeros((3, 3)), np.full((3, 3), 1e-3), np.array([0.0, 0.0, -3.0])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(data)):
            feats, tags = data[k]
            e = np.array([w[f].sum(0) for f in feats])
            _, ge, gm = log_likelihood(e, moves, start, tags)
            at = np.concatenate(feats)
            g = np.zeros_like(w)
            np.add.at(g, at, np.repeat(ge, [len(f) for f in feats], axis=0))
            at = np.unique(at)
            step = g[at] - RIDGE * w[at]
            seen[at] += step * step
            w[at] += RATE * step / np.sqrt(seen[at])
            gm = gm - RIDGE * moves
            seen_m += gm * gm
            moves += RATE * gm / np.sqrt(seen_m)
    return Field({f: w[i].tolist() for f, i in names.items()}, moves, start)


def secret_field(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> Field | None:
    """The field fitted on a bounded hash sample of different texts; None if nothing in it is a secret."""
    n = docs.count()
    mark = F.xxhash64(F.lit(31), F.col(text_col))
    picked = (docs.where(F.col(text_col).isNotNull() & samples.picked(mark, n, sample))
              .groupBy(mark.alias("mark")).agg(F.min(text_col).alias("text")))

    def cut(batches):
        for pdf in batches:
            rows = [(m, k, *(list(x) for x in win), list(file_features(t)))
                    for m, t in zip(pdf["mark"], pdf["text"]) for k, win in enumerate(training_windows(t))]
            yield pd.DataFrame(rows, columns=["mark", "k", "before", "tokens", "after", "tags", "filed"])

    kind = "mark long, k int, before array<string>, tokens array<string>, after array<string>, tags array<int>, filed array<string>"
    windows = cut_lineage(picked.mapInPandas(cut, kind))
    tagged = F.exists("tags", lambda y: y > 0)
    half = sample // 16               # bound of the windows with and of those without a tag
    chosen = (windows.where(tagged).orderBy("mark", "k").limit(half)
              .unionAll(windows.where(~tagged).orderBy("mark", "k").limit(half)))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["mark", "k"])
        if not any(max(y) for y in pdf["tags"]):
            return pd.DataFrame({"name": [], "w": []}, dtype=object)
        rng = np.random.default_rng(1)
        data = []
        for b, t, a, y, f in zip(pdf["before"], pdf["tokens"], pdf["after"], pdf["tags"], pdf["filed"]):
            data.append((window_features(b, t, a, f), y))
            if max(y):
                other, tags = altered(list(t), list(y), rng)
                data.append((window_features(b, other, a, f), tags))
        field = train_field(data)
        rows = {**field.weights, "moves": field.moves.ravel().tolist(), "start": field.start.tolist()}
        return pd.DataFrame({"name": list(rows), "w": list(rows.values())})

    got = {r["name"]: list(r["w"]) for r in chosen.withColumn("whole", F.lit(0)).groupBy("whole")
           .applyInPandas(fit, "name string, w array<double>").collect()}         # a few hundred features
    if not got:
        return None
    return Field({k: v for k, v in got.items() if k not in ("moves", "start")}, np.reshape(got["moves"], (3, 3)), got["start"])


# -- scanning -------------------------------------------------------------------------------------

def all_spans(text: str, field: Field | None) -> tuple[list, list]:
    """(base spans, base spans and the field's) as (start, end, kind) by start, then kind."""
    base = [s[:3] for s in base_spans(text)]
    if field is None:
        return base, base
    order = {k: i for i, k in enumerate((*KINDS, "crf"))}
    covered: list[list[int]] = []     # base spans, those that overlap or touch as one
    for s, e, _ in base:
        if covered and s <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], e)
        else:
            covered.append([s, e])
    more = [(a, b, "crf") for a, b in field.spans(text) if not any(s <= a and b <= e for s, e in covered)]
    return base, sorted(base + more, key=lambda s: (s[0], order[s[2]]))


def redact(text: str, spans, mark: str = "[SECRET]") -> str:
    """The text with each run of overlapping spans replaced by a mark."""
    out, at = [], 0
    for a, b, _ in sorted(spans):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:]


@lru_cache(maxsize=2)
def _field(key) -> Field | None:
    """One field, with what it remembers of tokens, for each Python worker."""
    if key is None:
        return None
    weights, moves, start = key
    return Field({k: list(v) for k, v in weights}, np.reshape(moves, (3, 3)), start)


def _key(field: Field | None):
    if field is None:
        return None
    return tuple((k, tuple(v)) for k, v in field.weights.items()), tuple(field.moves.ravel()), tuple(field.start)


def _joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def secret_digest(docs: DataFrame, field: Field | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: numbers of base spans by kind, digest of them, all spans."""
    key = _key(field)

    @F.pandas_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long")
    def scan(texts: pd.Series) -> pd.DataFrame:
        claim("secrets", _field.cache_clear)
        f = _field(key)
        rows = []
        for t in texts:
            base, every = all_spans(t if isinstance(t, str) else "", f)
            rows.append((*(sum(s[2] == k for s in base) for k in KINDS), hashlib.sha256(_joined(base).encode()).hexdigest(),
                         _joined(every), len(every) - len(base)))
        return pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_added"])

    return docs.select(id_col, scan(text_col).alias("__r")).select(id_col, "__r.*")


def redacted(field: Field | None):
    """Column function: a text without its secrets (NULL stays NULL)."""
    key = _key(field)

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        claim("secrets", _field.cache_clear)
        f = _field(key)
        return pd.Series([redact(t, all_spans(t, f)[1]) if isinstance(t, str) else None for t in texts], dtype=object)
    return clean


def remove_secrets(docs: DataFrame, text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """Documents with secrets replaced by a mark; the number of characters follows the text."""
    clean: Column = redacted(secret_field(docs, text_col))(F.col(text_col))
    out = docs.withColumn(text_col, clean)
    if size_col in docs.columns:
        kind = dict(docs.dtypes)[size_col]
        out = out.withColumn(size_col, F.when(F.col(text_col).isNull(), F.col(size_col))
                             .otherwise(F.length(text_col)).cast(kind))
    return out
