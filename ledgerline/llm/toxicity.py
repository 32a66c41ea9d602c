"""Toxicity by compression distance: a window of text is compressed once with a zstandard dictionary of toxic text and
once with one of ordinary text; toxic phrases save bytes with the first one only.

Both dictionaries are trained on labelled windows and stand before a common part, trained on ordinary text, so that
ordinary words cost the same in both. They are trained in rounds: first on the windows that the common part
compresses worst, then on those that the dictionaries of the other half of the sample tell apart best (for ordinary
text: the windows that look toxic by mistake). The two pairs, of all rounds and sizes, that rank other labelled
documents best are kept. A document's differences are summed up for each pair as mean, maximum, mean of the five
largest and shares above thresholds; a logistic calibration on other labelled documents turns these into a score.

All training data are a bounded sample (``SAMPLE``). Labels, language, source and id are never inputs of a score.
Defined results: a NULL or empty text is one empty window; without labels of both classes every score is the share
of label 1 (0 without labels); repeated rows and extra columns don't matter.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.labelled import in_fold, labelled_sample
from ledgerline.llm.memory import claim

WINDOW, STEP = 64, 48             # bytes; what neighbours share keeps a phrase of 16 bytes whole
COMMON, OWN = 1 << 18, 1 << 12    # bytes of the common dictionary part and of each class's own
SIZES = (1 << 10, 1 << 11, 1 << 12)     # of the final own parts: the one that ranks other documents best is taken
TRIAL = 400                       # documents of each class for that
PAIRS = 2                         # pairs of dictionaries that are kept: each happens to hold other ordinary words
ROUNDS, WORST, HARDEST = 5, 0.3, 0.1
THRESHOLDS = (1, 2, 3, 4, 5, 6, 8)
SAMPLE = {0: 8_000, 1: 4_000}     # bound of the labelled documents, by label
PER_TEXT = 64                     # windows of a text that dictionaries are trained on, from all over it
LEVEL = 7


@dataclass(frozen=True)
class Model:
    pairs: tuple = ()             # (toxic, ordinary) dictionaries
    mean: tuple = ()
    scale: tuple = ()
    weights: tuple = ()
    prior: float = 0.0            # score of all texts if there is nothing to learn from


def windows(text: str | None, size: int = WINDOW, step: int = STEP) -> list[bytes]:
    raw = text.encode() if text else b""
    return [raw[a:a + size] for a in range(0, max(1, len(raw) - size + step), step)]


def _compressor(content: bytes, size: int = WINDOW):
    par = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, source_size=size, dict_size=COMMON + OWN, min_match=4, write_content_size=False, write_checksum=False,
        write_dict_id=False)
    kind = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    kind.precompute_compress(compression_params=par)
    return zstandard.ZstdCompressor(dict_data=kind, compression_params=par).compress


def _dictionary(size: int, samples: list[bytes]) -> bytes:
    """A trained dictionary. The trainer stops early when little repeats; samples then fill up the front."""
    try:
        trained = zstandard.train_dictionary(size, samples, k=16, d=6, steps=4).as_bytes()
    except zstandard.ZstdError:
        trained = b""
    return (b"".join(samples)[:size - len(trained)] + trained).ljust(8, b" ")


def _largest(samples, values, share: float) -> list[bytes]:
    order = np.argsort(-np.asarray(values), kind="stable")[:max(200, int(share * len(samples)))]
    return [samples[i] for i in np.sort(order)]


def spread(some: list[bytes], most: int = PER_TEXT) -> list[bytes]:
    """At most ``most`` windows, evenly from all over a text, so that no long text rules a dictionary."""
    return some if len(some) <= most else [some[int(i * len(some) / most)] for i in range(most)]


def _contrast(folds, parts, common, saved) -> list[list[list[bytes]]]:
    """For each class and fold the windows that the other fold's dictionaries tell apart best (ordinary ones: worst).
    ``saved`` adds up the bytes over the rounds, which evens out what single dictionaries happen to hold."""
    out = [[None, None], [None, None]]
    for f in (0, 1):
        toxic, plain = (_compressor(parts[c][1 - f] + common) for c in (0, 1))
        for c in (0, 1):
            ws = folds[c][f]
            saved[c][f] = saved[c][f] + np.array([len(plain(w)) - len(toxic(w)) for w in ws])
            out[c][f] = _largest(ws, saved[c][f], HARDEST)
    return out


def distances(text: str | None, compressors) -> np.ndarray:
    """Bytes that a toxic dictionary saves against its ordinary one: a row a pair, a column a window."""
    ws = windows(text)

    def sizes(compress) -> np.ndarray:
        return np.fromiter(map(len, map(compress, ws)), dtype=np.float64, count=len(ws))

    return np.array([sizes(ordinary) - sizes(toxic) for toxic, ordinary in compressors])


def summary(of_pairs: np.ndarray) -> np.ndarray:
    return np.array([x for d in of_pairs for x in (
        d.mean(), d.max(), np.sort(d)[-5:].mean(), *((d >= t).mean() for t in THRESHOLDS))])


def _summaries(rows, pairs) -> tuple[np.ndarray, np.ndarray]:
    compressors = [tuple(_compressor(p) for p in pair) for pair in pairs]
    return (np.array([summary(distances(t, compressors)) for t, _ in rows]),
            np.array([y for _, y in rows], dtype=np.float64))


def _ranked(score: np.ndarray, y: np.ndarray) -> float:
    """Share of pairs of a toxic and an ordinary text in the right order."""
    plain = np.sort(score[y == 0])
    return float(np.mean((np.searchsorted(plain, score[y == 1], "left")
                          + np.searchsorted(plain, score[y == 1], "right")) / 2 / len(plain)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-1, steps: int = 40, unscaled: bool = False):
    mean, scale = x.mean(0), x.std(0) + 1e-9
    a = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        move = np.linalg.solve(h, a.T @ (p - y) + ridge * w)
        w -= move * min(1.0, 3 / max(1e-9, np.abs(move).max()))
    return w[:-1] / scale if unscaled else (mean, scale, w)


def train_model(texts: list[str], labels: list[int]) -> Model:
    """Dictionaries from two thirds of a bounded sample, calibration on the rest."""
    toxic, plain = ([t for t in dict.fromkeys(t for t, y in zip(texts, labels) if bool(y) == c)] for c in (True, False))
    if not toxic or not plain:
        return Model(prior=float(bool(toxic)) if texts else 0.0)
    for_words, calibrate = (lambda ts: ts[:max(1, 2 * len(ts) // 3)]), (lambda ts: ts[2 * len(ts) // 3:])
    half = max(1, len(for_words(plain)) // 2)
    common = _dictionary(COMMON, [w for t in for_words(plain)[:half] for w in spread(windows(t, 256, 256))])
    cost = _compressor(common)
    # [class][fold] of training windows; a fold's windows are chosen by what the other fold has taught, as a
    # dictionary always looks good on the windows that it was trained on
    texts_of = for_words(toxic), for_words(plain)[half:] or plain
    folds = [[[w for t in ts[f::2] or ts for w in spread(windows(t))] for f in (0, 1)] for ts in texts_of]
    parts = [[_dictionary(OWN, _largest(ws, [len(cost(w)) for w in ws], WORST)) for ws in c] for c in folds]
    rest = [(t, 1) for t in calibrate(toxic)] + [(t, 0) for t in calibrate(plain)]
    if len({y for _, y in rest}) < 2:
        rest = [(t, 1) for t in toxic] + [(t, 0) for t in plain]
    trial = [r for y in (1, 0) for r in [r for r in rest if r[1] == y][:TRIAL]]
    saved, tried = [[0, 0], [0, 0]], []
    for _ in range(ROUNDS):
        chosen = _contrast(folds, parts, common, saved)
        parts = [[_dictionary(OWN, ws) for ws in c] for c in chosen]
        for size in SIZES:
            pair = tuple(_dictionary(size, c[0] + c[1]) + common for c in chosen)
            x, y = _summaries(trial, [pair])
            tried.append((_ranked(x @ _logistic(x, y, unscaled=True), y), pair))
    pairs = tuple(pair for _, pair in sorted(tried, key=lambda t: -t[0])[:PAIRS])
    x, y = _summaries(rest, pairs)
    mean, scale, w = _logistic(x, y)
    return Model(pairs, tuple(mean), tuple(scale), tuple(w))


def toxicity_model(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", modulus: int = 3, remainder: int = 1,
                   most: dict[int, int] = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Trained by one task on the bounded sample; the model is about a megabyte."""
    sample = labelled_sample(docs, labels, label_col, modulus, remainder, most, id_col, text_col)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(o=pd.util.hash_array(pdf["doc_id"].to_numpy())).sort_values(["o", "doc_id"])
        m = train_model(pdf["text"].tolist(), pdf["label"].tolist())
        return pd.DataFrame({"dictionaries": [[d for pair in m.pairs for d in pair]], "mean": [list(m.mean)],
                             "scale": [list(m.scale)], "weights": [list(m.weights)], "prior": [m.prior]})

    rows = sample.withColumn("whole", F.lit(0)).groupBy("whole").applyInPandas(
        one, "dictionaries array<binary>, mean array<double>, scale array<double>, weights array<double>, prior double"
    ).collect()
    if not rows:
        return Model()
    r = rows[0]
    kept = [bytes(d) for d in r["dictionaries"]]
    return Model(tuple(zip(kept[::2], kept[1::2])), tuple(r["mean"]), tuple(r["scale"]), tuple(r["weights"]), r["prior"])


class _Scorer:
    def __init__(self, model: Model):
        self.model = model
        if model.weights:
            self.compressors = [tuple(_compressor(p) for p in pair) for pair in model.pairs]

    def __call__(self, text: str | None) -> float:
        m = self.model
        if not m.weights:
            return m.prior
        x = (summary(distances(text, self.compressors)) - m.mean) / m.scale
        return float(1 / (1 + np.exp(-np.clip(x @ np.array(m.weights[:-1]) + m.weights[-1], -35, 35))))


@lru_cache(maxsize=2)
def _scorer(model: Model) -> _Scorer:
    """Digested dictionaries, once for each Python worker."""
    return _Scorer(model)


def scorer(model: Model):
    """Column function: score of a text."""
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        claim("toxicity", _scorer.cache_clear)
        s = _scorer(model)
        return pd.Series([s(t if isinstance(t, str) else None) for t in texts], dtype="float64")
    return score


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, text_col: str = "text",
                    id_col: str = "doc_id", modulus: int = 3, remainder: int = 1) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    score = scorer(toxicity_model(docs, labels, modulus=modulus, remainder=remainder, id_col=id_col, text_col=text_col))
    return (docs.select(F.col(id_col).alias("doc_id"), in_fold(id_col, modulus, remainder).alias("held_out"),
                        score(F.col(text_col)).alias("score"))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, text_col: str = "text",
               id_col: str = "doc_id") -> DataFrame:
    """Documents that the classifier doesn't reject, with all their columns."""
    score = scorer(toxicity_model(docs, labels, id_col=id_col, text_col=text_col))(F.col(text_col))
    return docs.where(score < threshold)
