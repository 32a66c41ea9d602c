"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader steps.

Features of a text: unigrams and bigrams of its words (lower case, without marks at the ends; a repeated word makes
one and the same bigram) and n-grams of up to three word shapes (runs of upper, lower, digits; other characters as
they are), hashed to ``DIM`` places; the value is 1 + log(count), scaled to unit length. Training is
FTRL-proximal with a learning rate for each place, by several tasks over shards of a bounded sample, whose weights
are averaged. A score is the logistic of a sparse dot product.

Labels, language, source and id are never inputs of a score. Defined results: NULL and empty texts have no features
and get the score of the bias alone; without any label of one of the classes every score is the share of label 1
(0.5 without labels); repeated rows and extra columns don't matter.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.labelled import in_fold, labelled_sample
from ledgerline.llm.memory import claim
from ledgerline.llm.tokens import _forget

DIM = 1 << 18
BIAS = 0                          # place of the bias
SAMPLE = {0: 4_000, 1: 8_000}     # bound of the labelled documents that it is trained on, by label
SHARDS, EPOCHS = 4, 4
SEEN_ONCE = 150_000               # words whose codes a worker remembers

_GRAMS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint64)


def _shape(word: str) -> str:
    out = []
    for c in word:
        k = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out)


class _Codes(dict):
    """Word -> hash of the word and hash of its shape."""

    def __missing__(self, word: str) -> int:
        core = word.lower().strip("!?.,;:*%$&#|'\"()[]{}<>-_=+/\\~`@^")
        code = zlib.crc32(core.encode()) << 32 | zlib.crc32(_shape(word).encode())
        if len(word) <= 256:          # longer ones are hardly met again
            self[word] = code
        return code


_codes = _Codes()


def forget_words() -> None:
    _codes.clear()


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(places, values) of a text; the bias is not among them."""
    words = text.split() if text else []
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    codes = np.fromiter(map(_codes.__getitem__, words), dtype=np.uint64, count=len(words))
    _forget(_codes, SEEN_ONCE)
    word, shape = codes >> np.uint64(32), codes & np.uint64(0xFFFFFFFF)
    pair = word[:-1] * _GRAMS[0] + word[1:] * _GRAMS[1] + np.uint64(1)
    pair[word[:-1] == word[1:]] = 2
    two = shape[:-1] * _GRAMS[0] + shape[1:] * _GRAMS[1] + np.uint64(3)
    three = two[:-1] * _GRAMS[0] + shape[2:] * _GRAMS[2] + np.uint64(4)
    grams = np.concatenate([word * _GRAMS[2], pair, shape * _GRAMS[2] + np.uint64(5), two, three])
    grams ^= grams >> np.uint64(29)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    places, counts = np.unique(grams >> np.uint64(64 - 18), return_counts=True)
    values = 1 + np.log(counts)
    return np.maximum(places.astype(np.int64), 1), values / np.sqrt((values * values).sum())


def ftrl(examples, epochs: int = EPOCHS, alpha: float = 1.0, beta: float = 1.0, l1: float = 1e-4,
         l2: float = 1e-4) -> np.ndarray:
    """Weights after follow-the-regularised-leader steps over (places, values, label) in order."""
    z, n = np.zeros(DIM), np.zeros(DIM)

    def weight(at):
        over = np.abs(z[at]) > l1
        return np.where(over, -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2), 0.0)

    for _ in range(epochs):
        for at, x, label in examples:
            at, x = np.append(at, BIAS), np.append(x, 1.0)
            w = weight(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    return weight(np.arange(DIM))


def train(sample: DataFrame, shards: int = SHARDS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights averaged over shards of a bounded sample (doc_id, text, label)."""
    shares = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    weights = np.zeros(DIM, dtype=np.float32)
    if len(shares) < 2:
        share = np.clip(shares.get(1, 0) / max(1, sum(shares.values())) if shares else 0.5, 0.01, 0.99)
        weights[BIAS] = np.log(share / (1 - share))
        return weights

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(o=pd.util.hash_array(pdf["doc_id"].to_numpy())).sort_values(["o", "doc_id"])
        w = ftrl([(*features(t), y) for t, y in zip(pdf["text"], pdf["label"])], epochs)
        at = np.flatnonzero(w)
        return pd.DataFrame({"place": at, "w": w[at]})

    shard = F.pmod(F.xxhash64(F.lit(23), "doc_id"), F.lit(shards))
    parts = (sample.groupBy(shard.alias("shard")).applyInPandas(one, "place long, w double")
             .groupBy("place").agg((F.sum("w") / shards).alias("w")).toArrow())     # at most DIM rows
    weights[parts["place"].to_numpy()] = parts["w"].to_numpy()
    return weights


def scorer(weights: np.ndarray):
    """Column function: score of a text."""
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        claim("quality", forget_words)
        out = []
        for t in texts:
            at, x = features(t if isinstance(t, str) else None)
            out.append(1 / (1 + np.exp(-np.clip(weights[BIAS] + weights[at] @ x, -35, 35))))
        return pd.Series(out, dtype="float64")
    return score


def quality_model(docs: DataFrame, labels: DataFrame, label_col: str = "quality", modulus: int = 5, remainder: int = 0,
                  most: dict[int, int] = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    return train(labelled_sample(docs, labels, label_col, modulus, remainder, most, id_col, text_col))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, text_col: str = "text",
                   id_col: str = "doc_id", modulus: int = 5, remainder: int = 0) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    score = scorer(quality_model(docs, labels, modulus=modulus, remainder=remainder, id_col=id_col, text_col=text_col))
    return (docs.select(F.col(id_col).alias("doc_id"), in_fold(id_col, modulus, remainder).alias("held_out"),
                        score(F.col(text_col)).alias("score"))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, text_col: str = "text",
                 id_col: str = "doc_id") -> DataFrame:
    """Documents that the classifier accepts, with all their columns."""
    score: Column = scorer(quality_model(docs, labels, id_col=id_col, text_col=text_col))(F.col(text_col))
    return docs.where(score >= threshold)
