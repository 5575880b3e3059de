"""Language identification by prediction by partial matching (operator 6).

For each language a variable-order byte context tree of depth three is counted once and frozen.
A byte's code length comes from the longest context that was seen: method C escape probabilities
lead to shorter contexts, and at last to a uniform code of eight bits. The language whose tree
codes a text in the fewest bits is predicted.

The counts are made by Spark over a bounded, documented sample of labelled rows; what reaches the
driver is the table of distinct four-byte sequences in it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

#: Documents of a language that are learned from, in expectation: they are chosen by a hash of the
#: id. This bounds the sample; which texts are scored has no bound.
DOCS_PER_LANGUAGE = 1500
#: Byte pairs with a row of their own in the table of code lengths; others are coded from the counts.
PAIRS = 1024
#: Bytes of text whose mean code lengths the score compares.
EVIDENCE = 8
UNKNOWN = "und"
#: Bytes scored at once.
_PIECE = 1 << 20
_PAD = b"\n\n\n"
_OUT = StructType(
    [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("bits_per_byte", DoubleType())]
)


@dataclass
class Contexts:
    """What one language's tree holds: for each order, contexts with their totals and symbols."""

    grams: list[np.ndarray] = field(default_factory=list)  # by order: sorted context+symbol keys
    counts: list[np.ndarray] = field(default_factory=list)
    nodes: list[np.ndarray] = field(default_factory=list)  # by order: sorted contexts
    totals: list[np.ndarray] = field(default_factory=list)
    kinds: list[np.ndarray] = field(default_factory=list)  # distinct symbols that followed

    @classmethod
    def of(cls, grams: np.ndarray, counts: np.ndarray) -> Contexts:
        """From the counts of all four-byte sequences, each a big-endian number."""
        tree = cls()
        for order in range(4):
            keys, where = np.unique(grams & ((1 << 8 * (order + 1)) - 1), return_inverse=True)
            sums = np.bincount(where, counts, len(keys)).astype(np.int64)
            nodes, at = np.unique(keys >> 8, return_inverse=True)
            tree.grams.append(keys)
            tree.counts.append(sums)
            tree.nodes.append(nodes)
            tree.totals.append(np.bincount(at, sums, len(nodes)).astype(np.int64))
            tree.kinds.append(np.bincount(at, minlength=len(nodes)))
        return tree

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each four-byte sequence, given the three before it."""
        out, open_ = np.zeros(len(grams)), np.arange(len(grams))
        for order in (3, 2, 1, 0):
            key = grams[open_] & ((1 << 8 * (order + 1)) - 1)
            node = _find(self.nodes[order], key >> 8)
            seen = node >= 0
            total = np.where(seen, self.totals[order][node], 0).astype(float)
            kinds = np.where(seen, self.kinds[order][node], 0)
            gram = _find(self.grams[order], key)
            known = gram >= 0
            weight = np.where(known, self.counts[order][gram], kinds)
            out[open_[seen]] -= np.log2(weight[seen] / (total + kinds)[seen])
            open_ = open_[~known]
        out[open_] += 8.0
        return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Positions in sorted ``keys``, -1 where absent."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


class Model:
    """The frozen trees of all languages. The table over frequent byte pairs is made where it is used."""

    def __init__(self, languages: list[str], trees: list[Contexts], pairs: np.ndarray):
        self.languages, self.trees, self.pairs = languages, trees, pairs

    @classmethod
    def of(cls, rows: pd.DataFrame) -> Model:
        """From (lang, gram, n): how often each four-byte sequence stood in a language's texts."""
        languages = sorted(rows["lang"].unique())
        trees = []
        for lang in languages:
            own = rows[rows["lang"] == lang]
            trees.append(Contexts.of(own["gram"].to_numpy(np.int64), own["n"].to_numpy(np.int64)))
        pairs = np.zeros(0, np.int64)
        if languages:
            last = np.bincount(rows["gram"].to_numpy(np.int64) & 0xFFFF, rows["n"], 1 << 16)
            most = max(16, min(PAIRS, int((4 * PAIRS * PAIRS / len(languages)) ** 0.5)))
            order = np.lexsort((np.arange(1 << 16), -last))[:most]
            pairs = np.sort(order[last[order] > 0])
        return cls(languages, trees, pairs)

    def __getstate__(self) -> tuple:
        return self.languages, self.trees, self.pairs

    def __setstate__(self, state: tuple) -> None:
        self.languages, self.trees, self.pairs = state

    def _table(self) -> tuple[np.ndarray, np.ndarray]:
        if not hasattr(self, "_made"):
            n = len(self.pairs)
            place = np.full(1 << 16, n, np.int64)
            place[self.pairs] = np.arange(n)
            grams = ((self.pairs[:, None] << 16) | self.pairs[None, :]).ravel()
            costs = np.empty((len(grams), len(self.languages)))
            for k, tree in enumerate(self.trees):
                costs[:, k] = tree.bits(grams)
            self._made = place, costs
        return self._made

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text under each language's tree."""
        out = np.zeros((len(texts), len(self.languages)))
        start = 0
        while start < len(texts):
            end, held = start, 0
            while end < len(texts) and (end == start or held + len(texts[end]) <= _PIECE):
                held += len(texts[end]) + len(_PAD)
                end += 1
            if held > 2 * _PIECE:
                text = texts[start]
                for at in range(0, len(text), _PIECE):
                    before = text[max(0, at - 3) : at].rjust(3, b"\n")
                    out[start] += self._coded([text[at : at + _PIECE]], before)[0]
            else:
                out[start:end] = self._coded(texts[start:end], _PAD)
            start = end
        return out

    def _coded(self, texts: list[bytes], before: bytes) -> np.ndarray:
        out = np.zeros((len(texts), len(self.languages)))
        sizes = np.array([len(x) for x in texts])
        if not sizes.sum():
            return out
        place, costs = self._table()
        data = np.frombuffer(before + before.join(texts), np.uint8).astype(np.int64)
        pairs = (data[:-1] << 8) | data[1:]
        starts = np.concatenate(([0], np.cumsum(sizes + 3)[:-1]))
        first = np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
        old, new = pairs[first], pairs[first + 2]
        n = len(self.pairs)
        a, b = place[old], place[new]
        rare = (a == n) | (b == n)
        lengths = costs[np.where(rare, 0, a * n + b)].astype(np.float64)
        if rare.any():
            grams, where = np.unique((old[rare] << 16) | new[rare], return_inverse=True)
            lengths[rare] = np.stack([tree.bits(grams) for tree in self.trees], axis=1)[where]
        full = sizes > 0
        at = (np.cumsum(sizes) - sizes)[full]
        out[full] = np.add.reduceat(lengths, at, axis=0)
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """(language, its share among all languages by mean code length, bits a byte) of each text."""
        coded = [(x or "").encode("utf-8", "replace") for x in texts]
        bits = self.code_lengths(coded) if self.languages else None
        out = []
        for k, text in enumerate(texts):
            if bits is None or not text or not any(map(str.isalpha, text)):
                out.append((UNKNOWN, 0.0, float("nan")))
                continue
            best = int(np.argmin(bits[k]))
            # Weighed as a text of EVIDENCE bytes at most, or any text of some length would score one.
            scale = min(1.0, EVIDENCE / len(coded[k]))
            share = 1.0 / float(np.exp2(np.minimum(0.0, (bits[k][best] - bits[k]) * scale)).sum())
            out.append((self.languages[best], share, float(bits[k][best]) / len(coded[k])))
        return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        frame = batch.to_pandas()
        for lang, texts in frame.groupby("lang")["text"]:
            data = np.frombuffer(b"".join(_PAD + x.encode("utf-8", "replace") for x in texts), np.uint8).astype(np.int64)
            grams = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
            sizes = np.array([len(x.encode("utf-8", "replace")) for x in texts])
            pads = np.concatenate(([0], np.cumsum(sizes + 3)[:-1]))
            inside = np.ones(len(grams) + 3, bool)
            for k in range(3):  # sequences that end in a pad belong to no text
                inside[pads + k] = False
            keys, n = np.unique(grams[inside[3:]], return_counts=True)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(keys), "gram": keys, "n": n.astype(np.int64)})


def held_out(doc_id: Column) -> Column:
    """Whether a document's labels are kept for testing: every fifth by a checksum of its id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE) -> Model:
    """The model of the labelled rows of ``docs(doc_id, text, lang)`` that aren't held out.

    Rows without an id, a text or a language teach nothing. A language with more rows than
    ``docs_per_language`` is learned from about so many, chosen by a hash of id and text.
    """
    usable = docs.where("doc_id is not null and text is not null and lang is not null").where(~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not sizes:
        return Model.of(pd.DataFrame({"lang": [], "gram": [], "n": []}))
    share = F.lit(1.0)
    for lang, n in sizes.items():
        if n > docs_per_language:
            share = F.when(F.col("lang") == lang, docs_per_language / n).otherwise(share)
    draw = (F.xxhash64("doc_id", F.length("text")).bitwiseAND(F.lit((1 << 30) - 1))) / float(1 << 30)
    grams = (
        usable.where(draw < share).select("lang", "text").mapInArrow(_count, "lang string, gram long, n long")
    )
    return Model.of(grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas())


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred, score and bits_per_byte, computed from whole texts alone.

    A text that is null or has no letter is ``und`` with score 0, and so is every text if no
    language was learned. Ties go to the first language by name. Empty tables stay empty; other
    columns stay as they are, unless they have the names of these three.
    """
    kept = [F.col("row").getField(x).alias(x) for x in docs.columns if x.lower() not in _OUT.names]
    return _told(docs, model).select(*kept, "told.*")


def _told(docs: DataFrame, model: Model) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(_OUT)
    def code(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame(shared.value.predict(batch.tolist()), columns=_OUT.names)

    # Rows travel as one struct, so no column of theirs can have the name of one made here.
    return docs.select(F.struct(*docs.columns).alias("row"), code(F.col("text")).alias("told"))


def accept(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that are in some learned language, unchanged.

    Rejected are texts without a letter and texts for which even the best tree needs eight bits a
    byte or more, no fewer than no model at all.
    """
    fits = (F.col("told.lang_pred") != UNKNOWN) & (F.col("told.bits_per_byte") < 8.0)
    return _told(docs, model).where(fits).select("row.*")
