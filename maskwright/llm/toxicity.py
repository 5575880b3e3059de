"""Toxicity (operator 10): logistic regression by FTRL-proximal over hashed n-grams and skip-grams.

Features of a text are the distinct hashes of its words and their beginnings, of pairs of
neighbours and of pairs with one word between them. FTRL-proximal (McMahan et al., 2013) learns with a rate for each coordinate
and L1 sparsity, so the weights that are sent to the executors are few.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType

BITS = 20
#: Labelled documents of each class that are learned from, in expectation; chosen by a hash.
DOCS_PER_CLASS = 3000
EPOCHS = 6
THRESHOLD = 0.3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 3.0, 0.01
#: Lengths of the word beginnings that count as words too, so that inflected forms share what is learned.
PREFIXES = (4, 5, 6, 7)
_WORD = re.compile(r"\w+")
_MEMO_WORDS = 300_000
_PIECE = 100_000


class _Memo(dict):
    """Row numbers of words in ``hashes``: of the word, then of its beginnings. Bounded; it only saves time."""

    def __init__(self) -> None:
        self.hashes = np.zeros((1024, 1 + len(PREFIXES)), np.uint64)

    def __missing__(self, word: str) -> int:
        row = len(self)
        if row == len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
        parts = [word, *(word[:n] + "*" if len(word) >= n else word for n in PREFIXES)]
        self.hashes[row] = [xxhash.xxh64_intdigest(x.encode("utf-8", "replace")) for x in parts]
        self[word] = row
        return row


_memo = _Memo()


def _hashes(words: list[str]) -> np.ndarray:
    """For each word the hash of the word and of its beginnings."""
    global _memo
    if len(_memo) > _MEMO_WORDS:
        _memo = _Memo()
    rows = [_memo[x] for x in words]
    return _memo.hashes[rows]


def _mixed(a: np.ndarray, b: np.ndarray, kind: int) -> np.ndarray:
    return (a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * kind)) >> np.uint64(64 - BITS)


def _coordinates(text: str | None) -> Iterator[np.ndarray]:
    """The text's coordinates, piece by piece, each perhaps more than once."""
    words = _WORD.findall((text or "").lower())
    for start in range(0, len(words), _PIECE):
        own = _hashes(words[start : start + _PIECE + 2])
        yield own[:_PIECE].ravel() >> np.uint64(64 - BITS)
        h = own[:, 0]
        if len(h) > 1:
            yield _mixed(h[:-1], h[1:], 1)[:_PIECE]
        if len(h) > 2:
            yield _mixed(h[:-2], h[2:], 2)[:_PIECE]


def features(text: str | None) -> np.ndarray:
    """The distinct coordinates of a text, sorted."""
    parts = [np.unique(x) for x in _coordinates(text)]
    return np.unique(np.concatenate(parts)).astype(np.int64) if parts else np.zeros(0, np.int64)


class Ftrl:
    """FTRL-proximal; coordinate 2**BITS is the intercept, which has no L1."""

    def __init__(self, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def bias(self) -> float:
        return float(-self.z[-1] / ((self.beta + np.sqrt(self.n[-1])) / self.alpha))

    def learn(self, at: np.ndarray, label: int, weight: float = 1.0) -> None:
        w = self.weights(at)
        g = weight * (_sigmoid(w.sum() + self.bias()) - label)
        for place, old in ((at, w), (np.array([1 << BITS]), np.array([self.bias()]))):
            sigma = (np.sqrt(self.n[place] + g * g) - np.sqrt(self.n[place])) / self.alpha
            self.z[place] += g - sigma * old
            self.n[place] += g * g


def _sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -40, 40))))


class Model:
    """The nonzero weights and the intercept."""

    def __init__(self, places: np.ndarray, weights: np.ndarray, bias: float):
        self.places, self.values, self.bias = places, weights, bias
        self._dense: np.ndarray | None = None

    def __getstate__(self) -> tuple:
        return self.places, self.values, self.bias

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    def score(self, text: str | None) -> float:
        if self._dense is None:
            self._dense = np.zeros(1 << BITS)
            self._dense[self.places] = self.values
        hit: set[int] = set()
        for part in _coordinates(text):
            hit.update(part[self._dense[part.astype(np.int64)] != 0].tolist())
        return _sigmoid(float(self._dense[sorted(hit)].sum()) + self.bias if hit else self.bias)


def held_out(doc_id: Column) -> Column:
    """Whether a document's labels are kept for testing: those with remainder 2 of 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@F.pandas_udf(ArrayType(IntegerType()))
def _features(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([features(x).astype(np.int32) for x in batch])


def train(docs: DataFrame, labels: DataFrame, docs_per_class: int = DOCS_PER_CLASS) -> Model:
    """The model of labelled documents that aren't held out.

    Rows without an id, label or text teach nothing; a document that is labelled both ways counts
    as toxic. Each class gives about ``docs_per_class`` documents at most, chosen by a hash; the
    driver keeps one and the same order on every run. Without documents of both classes all scores
    are the intercept of what there is.
    """
    marked = (
        labels.where("doc_id is not null and toxic is not null")
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max((F.col("toxic") != 0).cast("int")).alias("label"))
    )
    sizes = {r["label"]: r["count"] for r in marked.groupBy("label").count().collect()}
    shares = {label: min(1.0, docs_per_class / n) for label, n in sizes.items()}
    share = F.when(F.col("label") == 1, shares.get(1, 1.0)).otherwise(shares.get(0, 1.0))
    draw = F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 30) - 1)) / float(1 << 30)
    chosen = marked.where(draw < share)
    sample = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = sample.select("doc_id", "label", _features("text").alias("at")).toPandas()
    rows["order"] = [xxhash.xxh64_intdigest(f"{d}:{len(a)}") for d, a in zip(rows["doc_id"], rows["at"], strict=True)]
    rows = rows.sort_values(["order", "doc_id"], kind="stable")
    learner = Ftrl()
    for _ in range(EPOCHS):
        for at, label in zip(rows["at"], rows["label"], strict=True):
            learner.learn(np.asarray(at, np.int64), int(label))
    weights = learner.weights(slice(0, 1 << BITS))
    places = np.flatnonzero(weights)
    # What is left out of either class changes the odds by its share.
    return Model(places, weights[places], learner.bias() + float(np.log(shares.get(0, 1.0) / shares.get(1, 1.0))))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score``, the probability of label 1 given the whole text.

    Null and empty texts and texts without words have the intercept's score. Every row keeps its
    own place, repeated or not; other columns stay, but for one of the name ``score``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(DoubleType())
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([shared.value.score(x) for x in batch], dtype="float64")

    return docs.withColumn("score", of(F.col("text")))
