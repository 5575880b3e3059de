"""Exact token counts at every prefix by dynamic programming (operator 8).

For a byte-pair vocabulary whose words end in a marker, the encoding of a prefix is the encoding
of its longest proper prefix that ends before the last token, and that token. Which token is last
is unique, and it is found from the pairs that a byte-pair encoder leaves apart. So one pass over
a text gives the count at each of its positions, and truncation and budgets need no encoding.

A vocabulary of that kind drops white space and never joins tokens over it: runs of other
characters are counted on their own, and a bounded memo holds the counts of those that return.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType

LIMIT = 2048
_RUN = re.compile(r"\S+")
_MEMO_RUNS = 300_000
_MEMO_PREFIXES = 300_000
#: Plain words up to this length are counted by the program below, others by the tokenizer itself.
_PLAIN = 64


class PrefixCounter:
    """Counts tokens of prefixes for one tokenizer file (``.json`` of the ``tokenizers`` library)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        model = held["model"]
        self.special = [x["content"] for x in held.get("added_tokens", [])]
        self.end = model.get("end_of_word_suffix") or ""
        self._merges(model)
        self.byte = byte_symbols()
        self.memo: dict[str, np.ndarray] = {}
        self.inner: dict[str, tuple[str, int]] = {}
        self.ended: dict[str, int] = {}
        self.sums: dict[str, int] = {}

    def _merges(self, model: dict) -> None:
        """Tokens by the order in which merging makes them: single characters, then by rank."""
        merges = [tuple(x) if not isinstance(x, str) else tuple(x.split(" ")) for x in model["merges"]]
        made = {a + b for a, b in merges}
        self.order: dict[str, int] = {x: k for k, x in enumerate(sorted(set(model["vocab"]) - made))}
        first = len(self.order)
        self.pair: dict[tuple[str, str], int] = {}
        self.halves: dict[str, tuple[str, str]] = {}
        for k, (a, b) in enumerate(merges):
            self.pair.setdefault((a, b), first + k)
            if self.order.setdefault(a + b, first + k) == first + k:
                self.halves[a + b] = a, b
        self.longest = max(map(len, self.order), default=1)
        self.neighbours: dict[tuple[str, str], bool] = {}

    def apart(self, a: str, b: str) -> bool:
        """Whether an encoder leaves tokens ``a`` and ``b`` as they are when they stand together.

        They join only if some merge over the border comes before the merges that made the ends
        of both: the pieces at the border are taken apart again, the later made first.
        """
        key = a, b
        known = self.neighbours.get(key)
        if known is None:
            if len(self.neighbours) > _MEMO_PREFIXES:
                self.neighbours.clear()
            known = self.neighbours[key] = self._apart(a, b)
        return known

    def _apart(self, a: str, b: str) -> bool:
        order, halves, pair = self.order, self.halves, self.pair
        before = 1 << 60
        while True:
            if pair.get((a, b), before) < before:
                return False
            late_a, late_b = (order[x] if x in halves else -1 for x in (a, b))
            if late_a < 0 and late_b < 0:
                return True
            # A merge on the left wins over an equal one on the right, as the encoder goes from left.
            if late_a > late_b:
                before, a = late_a, halves[a][1]
            else:
                before, b = late_b + 1, halves[b][0]

    def _reach(self, text: str) -> None:
        """``inner`` for all prefixes of ``text``: the last token and the count inside a word."""
        inner, order, apart, longest = self.inner, self.order, self.apart, self.longest
        known = len(text)
        while known and text[:known] not in inner:
            known -= 1
        for i in range(known + 1, len(text) + 1):
            for j in range(max(0, i - longest), i):
                token = text[j:i]
                if token in order:
                    if j == 0:
                        inner[token] = token, 1
                        break
                    last, n = inner[text[:j]]
                    if apart(last, token):
                        inner[text[:i]] = token, n + 1
                        break

    def _close(self, text: str) -> int:
        """The count of ``text`` as a whole word, when all before its end is in ``inner``."""
        ended = self.ended.get(text)
        if ended is None:
            inner, order, end = self.inner, self.order, self.end
            for j in range(max(0, len(text) - self.longest), len(text)):
                token = text[j:] + end
                if token in order:
                    if j == 0:
                        ended = 1
                        break
                    last, n = inner[text[:j]]
                    if self.apart(last, token):
                        ended = n + 1
                        break
            self.ended[text] = ended
        return ended

    def _bytes(self, word: str) -> str:
        if len(self.inner) > _MEMO_PREFIXES:
            self.inner.clear()
        if len(self.ended) > _MEMO_PREFIXES:
            self.ended.clear()
        return word if word.isascii() else "".join([self.byte[x] for x in word.encode()])

    def word(self, word: str) -> list[int]:
        """Counts of all prefixes of a word of letters in lower case, each ended as a word of its own.

        ``inner`` keeps what prefixes met before gave, so a word that shares its beginning with
        others only adds what is new.
        """
        text = self._bytes(word)
        self._reach(text[:-1])
        out, size = [], 0
        for c in word:
            size += len(c.encode())
            out.append(self._close(text[:size]))
        return out

    def _last(self, run: str) -> int:
        """The count of a whole run: the last of its prefixes'."""
        total = 0
        for piece in self._pieces(run):
            n = self.sums.get(piece)
            if n is None:
                lower = self._lower(piece) if len(piece) <= _PLAIN else None
                if lower is not None:
                    text = self._bytes(lower)
                    self._reach(text[:-1])
                    n = self._close(text)
                else:
                    n = self._whole(piece)
            total += n
        if len(run) <= _PLAIN:
            if len(self.sums) > _MEMO_RUNS:
                self.sums.clear()
            self.sums[run] = total
        return total

    def _lower(self, run: str) -> str | None:
        """``run`` in lower case if it is plain: letters in normal form, each with one lower form."""
        if not run.isalpha():
            return None
        if run.isascii():
            return run.lower()
        lower = "".join(map(str.lower, run))
        return lower if len(lower) == len(run) and unicodedata.is_normalized("NFC", run) else None

    def _asked(self, run: str) -> np.ndarray:
        """Counts of all prefixes as the tokenizer gives them, one question each."""
        parts = [run[:i] for i in range(1, len(run) + 1)]
        found = self.tokenizer.encode_batch(parts, add_special_tokens=False)
        return np.array([len(x.ids) for x in found], np.int32)

    def _pieces(self, run: str) -> list[str]:
        """A run cut between characters that no token and no normal form can join.

        A cut stands before an ASCII letter or digit that follows a digit or other ASCII sign but
        the quotation mark, and before an ASCII sign that follows a letter or digit; never where a
        special token stands.
        """
        if run.isalpha() or any(x in run for x in self.special):
            return [run]
        pieces, start = [], 0
        for i in range(1, len(run)):
            b = run[i]
            if not b.isascii():
                continue
            a = run[i - 1]
            if b.isalnum():
                cut = a.isascii() and not a.isalpha() and a != "'"
            else:
                cut = a.isalpha() or (a.isascii() and a.isdigit())
            if cut:
                pieces.append(run[start:i])
                start = i
        return [*pieces, run[start:]]

    def run(self, run: str) -> np.ndarray:
        """Counts of all prefixes of characters without white space."""
        got = self.memo.get(run)
        if got is not None:
            return got
        lower = self._lower(run) if len(run) <= _PLAIN else None
        if lower is not None:
            got = np.array(self.word(lower), np.int32)
        elif len(pieces := self._pieces(run)) > 1:
            done, parts = 0, []
            for piece in pieces:
                own = self.run(piece)
                parts.append(own + done)
                done += int(own[-1])
            got = np.concatenate(parts)
        elif len(run) <= _PLAIN:
            got = self._asked(run)
        else:
            got = self._long(run)
        if len(run) <= _PLAIN:
            if len(self.memo) >= _MEMO_RUNS:
                self.memo.clear()
            self.memo[run] = got
        return got

    def _long(self, run: str) -> np.ndarray:
        """A long run without a cut, by questions in bounded batches."""
        out = np.empty(len(run), np.int32)
        for start in range(0, len(run), 64):
            parts = [run[:i] for i in range(start + 1, min(start + 64, len(run)) + 1)]
            out[start : start + len(parts)] = [len(x.ids) for x in self.tokenizer.encode_batch(parts, add_special_tokens=False)]
        return out

    def total(self, text: str) -> int:
        """Tokens of a whole text: the sum of the last prefix counts of its runs."""
        if not _settled(text) or any(x in text for x in self.special):
            return self._whole(text)
        sums, total = self.sums, 0
        for run in text.split():
            n = sums.get(run)
            total += self._last(run) if n is None else n
        return total

    def _whole(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def prefixes(self, text: str) -> np.ndarray:
        """``counts[i]``: tokens of the first i characters, for i from 0 to the text's length."""
        if not _settled(text) or any(x in text for x in self.special):
            return np.concatenate(([0], self._long(text))).astype(np.int32) if text else np.zeros(1, np.int32)
        out, done, at = np.zeros(len(text) + 1, np.int32), 0, 0
        for m in _RUN.finditer(text):
            start, end = m.span()
            out[at + 1 : start + 1] = done
            own = self.run(m.group())
            out[start + 1 : end + 1] = own + done
            done += int(own[-1])
            at = end
        out[at + 1 :] = done
        return out


#: White space to Python but not to the tokenizers.
_ODD = re.compile("[\x1c-\x1f]")


def _settled(text: str) -> bool:
    """Whether ``str.split`` cuts where the tokenizer does."""
    return not _ODD.search(text)


def byte_symbols() -> list[str]:
    """The character that byte-level vocabularies write for each byte.

    Bytes that print stand for themselves; the others follow from 256 on, in order.
    """
    prints = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b if b in prints else next(others)) for b in range(256)]


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """This worker's counter for a tokenizer file."""
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def token_counts(text: Column, path: str) -> Column:
    """The tokens of a whole text, null counting as empty."""

    @F.pandas_udf(LongType())
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = counter(path)
        for batch in texts:
            yield pd.Series([own.total(x or "") for x in batch], dtype="int64")

    return count(text)


def prefix_counts(text: Column, path: str) -> Column:
    """The tokens of every prefix: element i+1 of the array is the count of the first i characters."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = counter(path)
        for batch in texts:
            yield pd.Series([own.prefixes(x or "") for x in batch])

    return count(text)


def longest_prefix(counts: Column, budget: int) -> Column:
    """From stored prefix counts: the most characters of a prefix with ``budget`` tokens or fewer."""
    last = F.size(counts) - 1
    fits = F.transform(counts, lambda n, i: F.when(n <= budget, i))
    return F.when(F.element_at(counts, -1) <= budget, last).otherwise(F.array_max(fits))
