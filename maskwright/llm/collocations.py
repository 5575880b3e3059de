"""Phrase collocation mining (operator 12): suffix automata per shard, reduced to corpus-wide counts.

A shard is what one task reads until it holds ``SHARD_WORDS`` words. Its generalised suffix automaton is built level by
level up to the depth of the longest phrase: level k numbers the distinct k-word strings by sorting pairs of (number of
the string without its last word, last word), which is the automaton's transition; the string without its first word is
where a suffix link leads. Strings of equal end positions are one state: as all end positions of a string are also
its suffix's, that is so just if both occur equally often. States give their strings, longest first, with one count.

Three passes read the texts. The first counts words and bigrams by hash in a table, the second longer strings within what is
left. A count of a hash is never below the counts of its strings, and a phrase occurs no more often than its parts, so
nothing frequent is lost by leaving out what is certainly rare: rare words and bigrams end the fragments that automata are
built of, and rare strings are not given out. Tables grow with the texts up to ``TABLE_BITS``; what shares a place in a full
one is given out and summed for nothing, and no result depends on it.

Counts are summed by phrase over all shards. What is frequent then forms one automaton of the corpus as a table: a
phrase's two parents are its string without the last word and, by its suffix link, without the first. A longer phrase
that covers another one step by step occurs no less often at each step, so comparing with direct parents is enough.
"""

from __future__ import annotations

import itertools
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.llm.tables import cut, stored

DEPTH = 4
LEAST = 30
COVERS = 80  # a phrase goes if a longer one has this many hundredths of its occurrences or more
BEST = 2000
UNKNOWN = "und"
#: Words of a shard.
SHARD_WORDS = 400_000
#: A table of hashed counts has a place for each ``BYTES_PER_PLACE`` bytes of text, rounded up to a power of two: at most
#: 2 ** TABLE_BITS places, of one byte in a task and of one bit in what is broadcast (16 MB).
TABLE_BITS = 27
LEAST_BITS = 12
BYTES_PER_PLACE = 64
_PAGE_BITS = 14
_FULL = 255

#: A-Z in lower case, tabs as spaces, and everything that ends a piece as a line feed.
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz \n\n\n\n\n\n\n\n\n")


@dataclass(frozen=True)
class Automaton:
    """States of a generalised suffix automaton of bounded depth, over rows of words that 0 separates.

    State s stands for the strings that end at ``end[s]``, of ``shortest[s]`` to ``longest[s]`` words; each of them
    occurs ``count[s]`` times, at the same places. ``link[s]`` is the state of the longest string that they end in and
    that occurs elsewhere too, -1 for the empty one.
    """

    words: np.ndarray
    end: np.ndarray
    shortest: np.ndarray
    longest: np.ndarray
    count: np.ndarray
    link: np.ndarray

    def strings(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each length: where its strings end, and how often they occur."""
        for k in range(1, int(self.longest.max(initial=0)) + 1):
            own = (self.shortest <= k) & (k <= self.longest)
            yield k, self.end[own], self.count[own]


def automaton(words: np.ndarray, depth: int = DEPTH) -> Automaton:
    """The automaton of ``words``: numbers from 1 on, and 0 between rows."""
    words = np.asarray(words, np.int64)
    wide = int(words.max(initial=0)) + 1
    ends = np.flatnonzero(words)
    level = words[ends]  # number of the string of k words that ends here
    state_of: list[np.ndarray] = []
    first: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    suffix: list[np.ndarray] = []
    before = np.zeros(0, np.int64)
    for k in range(1, depth + 1):
        if not len(ends):
            break
        _, at, number, count = np.unique(level, return_index=True, return_inverse=True, return_counts=True)
        first.append(ends[at])
        counts.append(count)
        # The string of k - 1 words that ends at the same place.
        suffix.append(before[ends[at]] if k > 1 else np.full(len(at), -1))
        full = np.full(len(words), -1, np.int64)
        full[ends] = number
        before = full
        onward = ends[:-1][ends[1:] == ends[:-1] + 1] + 1
        level = full[onward - 1] * wide + words[onward]
        ends = onward
    # A string is in its suffix's state if both occur equally often; the longest of a state stands for it.
    new: list[np.ndarray] = []
    total = 0
    for k in range(len(first)):
        same = counts[k] == counts[k - 1][suffix[k]] if k else np.zeros(len(first[k]), bool)
        own = np.where(same, state_of[k - 1][suffix[k]] if k else 0, total + np.cumsum(~same) - 1)
        new.append(~same)
        state_of.append(own)
        total += int((~same).sum())
    end, shortest, longest = np.zeros(total, np.int64), np.zeros(total, np.int64), np.zeros(total, np.int64)
    count, link = np.zeros(total, np.int64), np.full(total, -1, np.int64)
    for k in range(len(first)):
        own = state_of[k]
        end[own], longest[own], count[own] = first[k], k + 1, counts[k]
        made = own[new[k]]
        shortest[made] = k + 1
        if k:
            link[made] = state_of[k - 1][suffix[k][new[k]]]
    return Automaton(words, end, shortest, longest, count, link)


class _Shard:
    """Words of one language's texts: their numbers, a row for each piece, and hashes that all tasks agree on."""

    def __init__(self) -> None:
        # A counter of its own: with its length for a factory the table would hold itself and outlive its shard.
        self.vocab: dict[bytes, int] = defaultdict(itertools.count().__next__)
        for mark in (b"\n", b""):  # 0 between pieces; 1 is dropped
            self.vocab[mark]
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, text: bytes) -> int:
        number = self.vocab.__getitem__
        ids = np.fromiter(map(number, text.translate(_PLAIN).replace(b"\n", b" \n ").split(b" ")), np.int64)
        ids = ids[ids != 1]
        self.parts += [ids, np.zeros(1, np.int64)]
        self.size += len(ids) + 1
        return len(ids) + 1

    def words(self) -> np.ndarray:
        return np.concatenate(self.parts)

    def hashes(self, lang: str) -> np.ndarray:
        seed = xxhash.xxh64_intdigest(lang.encode())
        return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in self.vocab), np.uint64, len(self.vocab))


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, _Shard]]:
    """Shards of a task's (lang, text) rows, one language each; the largest ends when all hold too many words."""
    open_: dict[str, _Shard] = {}
    size = 0
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        for lang, text in zip(batch.column(0).to_pylist(), texts, strict=True):
            shard = open_.get(lang) or open_.setdefault(lang, _Shard())
            size += shard.add(text.as_py())
            if size >= SHARD_WORDS:
                most = max(open_, key=lambda x: open_[x].size)
                size -= open_[most].size
                yield most, open_.pop(most)
    batch = texts = text = None  # not held while the last shards are worked on
    while open_:
        yield open_.popitem()


def _slots(hashes: np.ndarray, words: np.ndarray, bits: int, lengths: range) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each of ``lengths``: where strings of so many words end, and their places in the table."""
    ends, of = np.flatnonzero(words), hashes[words]
    held = of[ends]
    for k in range(1, lengths.stop):
        if k > 1:
            onward = ends[1:] == ends[:-1] + 1
            ends, held = ends[1:][onward], held[:-1][onward]
            held = (held * np.uint64(0x9E3779B97F4A7C15) + (of[ends] ^ (of[ends] >> np.uint64(29)))) * np.uint64(0xBF58476D1CE4E5B9)
            held ^= held >> np.uint64(32)
        if k in lengths:
            yield k, ends, (held >> np.uint64(64 - bits)).astype(np.int64)


class _Filter:
    """What may be frequent by a table's bits."""

    def __init__(self, held: bytes, bits: int):
        self.held, self.bits = np.frombuffer(held, np.uint8), bits

    def good(self, slots: np.ndarray) -> np.ndarray:
        return (self.held[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8)) & 1 > 0

    def fragments(self, hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
        """``words`` without rare ones, with a 0 between two that are rare together."""
        apart = []
        for k, ends, slots in _slots(hashes, words, self.bits, range(1, 3)):
            rare = ends[~self.good(slots)]
            if k == 1:
                words = words.copy()
                words[rare] = 0
            else:
                apart = rare[(words[rare] > 0) & (words[rare - 1] > 0)]
        return np.insert(words, apart, 0)


def _sketch(bits: int, lengths: range, shorter: Broadcast[bytes] | None):
    """Per task: counts of strings by hash, up to 255, as pages of the table that are not empty."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << bits, np.uint8)
        for lang, shard in _shards(batches):
            words, hashes = shard.words(), shard.hashes(lang)
            if shorter is not None:
                words = _Filter(shorter.value, bits).fragments(hashes, words)
            for _, _, slots in _slots(hashes, words, bits, lengths):
                at, n = np.unique(slots, return_counts=True)
                table[at] = np.minimum(table[at] + np.minimum(n, _FULL), _FULL)
        pages = table.reshape(-1, 1 << min(_PAGE_BITS, bits))
        for start in range(0, len(pages), 64):
            some = start + np.flatnonzero(pages[start : start + 64].any(axis=1))
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([zlib.compress(pages[k], 1) for k in some], pa.binary())], names=["page", "held"])

    return count


def _summed(pages: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of a page's counts, up to 255; rows come in order of their pages, so one page is held at a time."""
    last, total = None, None
    for batch in pages:
        for page, held in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own = np.frombuffer(zlib.decompress(held.as_buffer()), np.uint8).astype(np.uint16)
            if page == last:
                total = np.minimum(total + own, _FULL)
                continue
            if last is not None:
                yield _page(last, total)
            last, total = page, own
    if last is not None:
        yield _page(last, total)


def _page(page: int, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([page], pa.int32()), pa.array([total.astype(np.uint8).tobytes()], pa.binary())], names=["page", "held"])


def _may_be_frequent(texts: DataFrame, least: int, bits: int, lengths: range, shorter: Broadcast[bytes] | None = None) -> Broadcast[bytes]:
    """A bit for each hash that ``least`` or more strings of ``lengths`` words may have: 2 ** bits bits."""
    counted = texts.mapInArrow(_sketch(bits, lengths, shorter), "page int, held binary")
    pages = counted.repartition("page").sortWithinPartitions("page").mapInArrow(_summed, "page int, held binary")

    def bit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [np.packbits(np.frombuffer(x.as_buffer(), np.uint8) >= min(least, _FULL)).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(told, pa.binary())], names=["page", "held"])

    size = 1 << min(_PAGE_BITS, bits)
    out = bytearray((1 << bits) // 8 or 1)
    for row in pages.mapInArrow(bit, "page int, held binary").collect():
        out[row.page * size // 8 : row.page * size // 8 + len(row.held)] = row.held
    return texts.sparkSession.sparkContext.broadcast(bytes(out))


#: A phrase and its language as one string, so that a row that is shuffled has little besides. No phrase holds a line feed.
_GRAMS = "key string, f long"


def _grams(short: Broadcast[bytes], long: Broadcast[bytes], bits: int, depth: int):
    """Per shard: the strings of its automaton with their counts, and by an empty phrase how many words it has."""

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, shard in _shards(batches):
            yield from _mined(lang, shard, _Filter(short.value, bits), _Filter(long.value, bits), depth)

    return mine


def _mined(lang: str, shard: _Shard, short: _Filter, long: _Filter, depth: int) -> Iterator[pa.RecordBatch]:
    words, hashes = shard.words(), shard.hashes(lang)
    yield _told(lang, [b""], np.array([(words > 0).sum()]))
    found = automaton(short.fragments(hashes, words), depth)
    names = np.array(list(shard.vocab), object)
    often = np.zeros(len(found.words), bool)
    slots = {k: (ends, held) for k, ends, held in _slots(hashes, found.words, long.bits, range(3, depth + 1))}
    for k, ends, counts in found.strings():
        if k in slots:
            often[slots[k][0]] = long.good(slots[k][1])
            ends, counts = ends[often[ends]], counts[often[ends]]
        for start in range(0, len(ends), 100_000):
            end = ends[start : start + 100_000]
            parts = [names[found.words[end - j]] for j in range(k - 1, -1, -1)]
            phrases = parts[0].tolist() if k == 1 else list(map(b" ".join, zip(*parts, strict=True)))
            yield _told(lang, phrases, counts[start : start + 100_000])


def _told(lang: str, phrases: list[bytes], counts: np.ndarray) -> pa.RecordBatch:
    keys = pc.binary_join_element_wise(pa.array(phrases, pa.binary()), lang.encode(), b"\n")
    return pa.RecordBatch.from_arrays([keys.cast(pa.string()), pa.array(counts.astype(np.int64))], names=["key", "f"])


def counted(docs: DataFrame, least: int = LEAST, depth: int = DEPTH, bits: int | None = None, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, k, phrase, f): phrases of up to ``depth`` words that occur ``least`` times or more, and with k = 0 all words' number."""
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if bits is None:
        size = texts.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first().n or 0
        bits = min(max(LEAST_BITS, (size // BYTES_PER_PLACE).bit_length()), TABLE_BITS)
    short = _may_be_frequent(texts, least, bits, range(1, 3))
    long = _may_be_frequent(texts, least, bits, range(3, depth + 1), short)
    grams = texts.mapInArrow(_grams(short, long, bits, depth), _GRAMS)
    summed = grams.groupBy("key").agg(F.sum("f").alias("f")).where(F.col("key").startswith("\n") | (F.col("f") >= least))
    phrase = F.substring_index("key", "\n", 1)
    spaces = F.length(phrase) - F.length(F.replace(phrase, F.lit(" "), F.lit("")))
    k = F.when(phrase == "", 0).otherwise(spaces + 1).cast("int")
    return summed.select(F.col("key").substr(F.length(phrase) + 2, F.length("key")).alias("lang"), k.alias("k"), phrase.alias("phrase"), "f")


def _parents(grams: DataFrame) -> DataFrame:
    """For each phrase of three words or more, what it covers: without its last word, and where its suffix link leads."""
    n = F.length("phrase")
    start = F.call_function("substring_index", F.col("phrase"), F.lit(" "), F.col("k") - 1)
    rest = F.col("phrase").substr(F.length(F.substring_index("phrase", " ", 1)) + 2, n)
    return grams.where("k > 2").select("lang", F.explode(F.array(start, rest)).alias("phrase"), F.col("f").alias("longer"))


def _exact(c: Column) -> Column:
    return c.cast("decimal(20,0)")


def collocations(docs: DataFrame, least: int = LEAST, best: int = BEST, depth: int = DEPTH, bits: int | None = None, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The ``best`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    ``a``: occurrences of the phrase, overlaps included; ``l``, ``r``: of its first words and of the rest, at the cut with the
    least score (of equal ones that after fewest words); ``n``: all words of the language; ``score``: 2,000,000 a / (l + r),
    rounded down. Phrases have two to ``depth`` words, occur ``least`` times or more, and are not covered by a longer one with
    80 % of their occurrences. Ties of score go by ``a``, then by the phrase's bytes.

    Null texts are empty, null languages are ``und``. Repeated rows count as often as they stand. Texts and words may have any
    length. No rows, or no phrase frequent enough, give no rows. Columns other than the two named are not read.
    """
    grams = stored(counted(docs, least, depth, bits, text_col, lang_col))
    longer = _parents(grams).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    phrases = grams.where("k > 1").join(longer, ["lang", "phrase"], "left")
    covered = 100 * _exact(F.col("longer")) >= COVERS * _exact(F.col("f"))
    phrases = phrases.where(~F.coalesce(covered, F.lit(False)))
    # All parts of all cuts are frequent phrases too, so they are looked up in the same table.
    cuts = phrases.select("lang", "phrase", F.col("f").alias("a"), "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    first = F.call_function("substring_index", F.col("phrase"), F.lit(" "), F.col("cut"))
    cuts = cuts.withColumn("first", first).withColumn("rest", F.col("phrase").substr(F.length("first") + 2, F.length("phrase")))
    known = grams.where("k > 0")
    for part, name in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(known.select("lang", F.col("phrase").alias(part), F.col("f").alias(name)), ["lang", part])
    score = F.expr("(CAST(2000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(20,0))) DIV (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("m"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.select("lang", "phrase", "a", "m.l", "m.r", "m.score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    # One row for each language.
    totals = grams.where("k = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
