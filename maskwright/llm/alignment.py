"""Cross-tokenizer alignment (operator 11): which tokens of two vocabularies stand for the same bytes.

A text is cut into units at spaces that follow another character; neither tokenizer joins tokens over such a place, so
a unit is encoded and aligned once and a bounded memo keeps it. Where a vocabulary breaks that rule, or a text
ends in spaces, whole texts are encoded.

How often an id pair is linked in the corpus is a cogroup of postings. Documents give their own pair multiplicities;
these are packed into blocks of one side id and dealt to a grid: by ``SIDES`` groups of side ids, and by as many sets of
documents as there is work for. Sorted within its partition, a side id brings the summed counts of its pairs first and
its postings after them, so a task streams: it holds the counts of one side id (no more than the other vocabulary has
ids), looks postings up in them and sums what its documents gain. A document stands in one set, so it has ``SIDES`` sums
at most, however many tasks there are. Spark's external sort spills what does not fit.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.tables import cut, stored

#: Units that a worker remembers and that it aligns together, and bytes of text that it works on at a time.
MEMO_UNITS = 250_000
LEARNT_UNITS = 4096
CHUNK_BYTES = 2 << 20
#: Postings that are sorted together, that stand in one block, and that one place of the grid has, about.
SORTED_POSTINGS = 2_000_000
BLOCK_POSTINGS = 1024
SPLIT_POSTINGS = 4_000_000
#: Groups of side ids that postings are dealt by.
SIDES = 16
#: Blocks that are worked on together, and documents whose sums a task holds.
STREAMED_BLOCKS = 1024
HELD_SUMS = 1_000_000

#: A blank before a space, or spaces at the end: what stands between such blanks is not cut.
_BLANKS = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S)(?= )")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


class Aligner:
    """Both tokenizers, and the alignments of the units met so far."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        # Tasks are what runs side by side; threads of the library's own would spin between short batches.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.n_a, self.n_b = self.a.get_vocab_size(), self.b.get_piece_size()
        self.bytes_a = _byte_level(self.a.get_vocab(), self.n_a)
        self.bytes_b = [self._piece(k) for k in range(self.n_b)]
        self.len_a, self.len_b = (np.array([len(x) for x in held], np.int64) for held in (self.bytes_a, self.bytes_b))
        self.said = np.array([[f"{k}{mark}" for k in range(max(self.n_a, self.n_b))] for mark in ",|;\n"], object)
        # Cuts hold for the first vocabulary by its pattern; for the second if no piece has a space after another character.
        inner = re.compile("[^▁]▁")
        self.units = not any(inner.search(self.b.id_to_piece(k)) for k in range(self.n_b))
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = defaultdict()
        self.index.default_factory = self.index.__len__
        self.groups: list[str] = []
        # For each unit: tokens of A, of B, groups, and whether the bytes are the text's; its pairs stand in one array.
        self.numbers = np.zeros((4, 0), np.int64)
        self.pairs, self.at = np.zeros(0, np.int64), np.zeros(1, np.int64)
        # How often each was met since the memo was last thinned out.
        self.used = np.zeros(0, np.int64)

    def thin(self) -> None:
        """Keep the units that were met repeatedly, half of what the memo may hold at most."""
        kept = np.flatnonzero(self.used > 1)
        if len(kept) > MEMO_UNITS // 2:
            kept = kept[np.sort(np.argsort(-self.used[kept], kind="stable")[: MEMO_UNITS // 2])]
        units, groups, numbers, pairs, at = list(self.index), self.groups, self.numbers, self.pairs, self.at
        self.clear()
        for k in kept.tolist():
            self.index[units[k]]
        self.groups = [groups[k] for k in kept.tolist()]
        width = at[kept + 1] - at[kept]
        self.numbers, self.pairs = numbers[:, kept], pairs[_spread(at[kept], width)]
        self.at, self.used = np.concatenate(([0], np.cumsum(width))), np.zeros(len(kept), np.int64)

    def _piece(self, k: int) -> bytes:
        piece = self.b.id_to_piece(k)
        if self.b.is_byte(k):
            return bytes([int(_BYTE.fullmatch(piece)[1], 16)])
        return piece.replace("▁", " ").encode()

    def cut(self, text: str) -> list[str]:
        """The units of a space and ``text``, each without its first space."""
        if not self.units or text.endswith(" "):
            return [text]
        if text.startswith(" ") or _BLANKS.search(text):
            return [x[1:] for x in _CUT.split(" " + text)]
        return text.split(" ")

    def learn(self) -> None:
        """Align the units that the index has and that were not aligned yet."""
        units = list(islice(self.index, len(self.groups), None))
        told = [self._align(units[start : start + LEARNT_UNITS]) for start in range(0, len(units), LEARNT_UNITS)]
        if told:
            numbers, pairs, widths = zip(*told, strict=True)
            self.numbers = np.hstack([self.numbers, *numbers])
            self.pairs = np.concatenate((self.pairs, *pairs))
            self.at = np.concatenate((self.at, self.at[-1] + np.cumsum(np.concatenate(widths))))
            self.used = np.concatenate((self.used, np.zeros(len(units), np.int64)))

    def _align(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of units, their links and how many each has; what they are cut into goes to ``groups``.

        Units are laid end to end. Tokens overlap once between any two neighbouring token ends.
        """
        raw = [b" " + x.encode() for x in units]
        tokens_a = [x.ids for x in self.a.encode_batch_fast([" " + x for x in units], add_special_tokens=False)]
        tokens_b = self.b.encode(units, num_threads=1)
        good = self._whole(raw, tokens_a, self.bytes_a) & self._whole(raw, tokens_b, self.bytes_b)
        kept = np.flatnonzero(good)
        (a, of_a), (b, of_b) = ((_joined([x[k] for k in kept.tolist()]), np.repeat(kept, [len(x[k]) for k in kept.tolist()])) for x in (tokens_a, tokens_b))
        end_a, end_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        ends = np.union1d(end_a, end_b)
        i, j = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        widths = np.bincount(of_a[i], minlength=len(units))
        both_a, both_b = np.isin(end_a, end_b), np.isin(end_b, end_a)
        counts = [np.bincount(x, minlength=len(units)) for x in (of_a, of_b, of_a[both_a])]
        # A token is written with what follows it: another of its side, the other side, the next group or the next unit.
        last = np.concatenate((of_b[1:] != of_b[:-1], np.ones(min(1, len(b)), bool)))
        written = np.concatenate((self.said[both_a.astype(int), a], self.said[np.where(last, 3, 2 * both_b), b]))
        group = np.concatenate((2 * (np.cumsum(both_a) - both_a), 2 * (np.cumsum(both_b) - both_b) + 1))
        lines = iter("".join(written[np.argsort(group, kind="stable")].tolist()).split("\n"))
        self.groups += [next(lines) if ok else "" for ok in good.tolist()]
        return np.array([*counts, good.astype(np.int64)], np.int64), b[j] * self.n_a + a[i], widths

    @staticmethod
    def _whole(raw: list[bytes], tokens: list[list[int]], held: list[bytes]) -> np.ndarray:
        """Of which units the tokens give the bytes back."""
        return np.fromiter((b"".join([held[k] for k in x]) == y for x, y in zip(tokens, raw, strict=True)), bool, len(raw))


def _joined(lists: list[list[int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(lists), np.int64, sum(map(len, lists)))


def _byte_level(vocab: dict[str, int], size: int) -> list[bytes]:
    """The bytes of each entry of a byte-level vocabulary; entries of other characters have none."""
    from maskwright.llm.tokens import byte_symbols

    byte = {c: k for k, c in enumerate(byte_symbols())}
    out = [b""] * size
    for entry, k in vocab.items():
        if all(c in byte for c in entry):
            out[k] = bytes(byte[c] for c in entry)
    return out


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """This worker's aligner for two tokenizer files."""
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


_ALIGNED = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of bounded size; a longer text is a range of its own."""
    start = size = 0
    for k, text in enumerate(texts):
        size += len(text or "")
        if size > CHUNK_BYTES and k > start:
            yield start, k
            start, size = k, len(text or "")
    if start < len(texts):
        yield start, len(texts)


def _spread(start: np.ndarray, width: np.ndarray) -> np.ndarray:
    """The places of ranges, one range after the other."""
    return np.arange(int(width.sum())) + np.repeat(start - np.cumsum(width) + width, width)


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the exact sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, bool))
    return keys[first], np.add.reduceat(values, first) if len(first) else values


def _aligned(texts: list[str | None], own: Aligner) -> pa.RecordBatch:
    """What each text's alignment gives, in the columns of ``_ALIGNED``."""
    if len(own.groups) > MEMO_UNITS:
        own.thin()
    number = own.index.__getitem__
    met = [list(map(number, own.cut(x))) if x else [] for x in texts]
    own.learn()
    sizes = np.array([len(x) for x in met], np.int64)
    ends = np.cumsum(sizes)
    units = _joined(met)
    own.used += np.bincount(units, minlength=len(own.used))
    sums = np.hstack([np.zeros((4, 1), np.int64), np.cumsum(own.numbers[:, units], axis=1)])
    told = sums[:, ends] - sums[:, ends - sizes]
    good = (sizes > 0) & (told[3] == sizes)
    told = told * good
    digests = [hashlib.sha256(";".join([own.groups[k] for k in x]).encode()).hexdigest() if ok else "" for x, ok in zip(met, good.tolist(), strict=True)]
    # Units of a text, then pairs of its units, each with how often they stand in it.
    of = np.repeat(np.arange(len(texts)), sizes)
    kept = good[of]
    many = max(1, len(own.groups))
    held, often = _summed(of[kept] * many + units[kept], np.ones(int(kept.sum()), np.int64))
    of, unit = held // many, held % many
    width = own.at[unit + 1] - own.at[unit]
    place = _spread(own.at[unit], width)
    space = own.n_a * own.n_b
    held, times = _summed(np.repeat(of, width) * space + own.pairs[place], np.repeat(often, width))
    of, pair = held // space, held % space
    at = np.searchsorted(of, np.arange(len(texts) + 1)).astype(np.int32)
    links = np.concatenate(([0], np.cumsum(times)))
    columns = [pa.array(x) for x in (*told[:3], links[at[1:]] - links[at[:-1]])] + [pa.array(digests, pa.string())]
    columns += [pa.ListArray.from_arrays(at, pa.array(x)) for x in ((pair // own.n_a << 32) | pair % own.n_a, times.astype(np.int32))]
    return pa.RecordBatch.from_arrays(columns, names=["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])


def _tokenized(docs: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str) -> DataFrame:
    """A row for each document, with a number of its own, its alignment and its linked pairs."""
    own = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(path_a, path_b)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for start, end in _chunks(texts):
                found = _aligned(texts[start:end], both)
                kept = [batch.column(k).slice(start, end - start) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*kept, *found.columns], names=["id", "row", *found.schema.names])

    kind = docs.schema[id_col].dataType.simpleString()
    return own.mapInArrow(align, f"id {kind}, row long, {_ALIGNED}")


def _flat(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column, and how many each row has."""
    column = batch.column(batch.schema.get_field_index(name))
    sizes = np.diff(column.offsets.to_numpy(zero_copy_only=False))
    return column.flatten().to_numpy(zero_copy_only=False), sizes


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links and postings of the pairs of each batch."""
    for batch in batches:
        keys, _ = _flat(batch, "pairs")
        times, _ = _flat(batch, "times")
        pairs, links = _summed(keys, times.astype(np.int64))
        _, held = _summed(keys, np.ones(len(keys), np.int64))
        yield pa.RecordBatch.from_arrays(
            [pa.array((pairs >> 32).astype(np.int32)), pa.array((pairs & 0xFFFFFFFF).astype(np.int32)), pa.array(links), pa.array(held)],
            names=["b", "a", "links", "held"],
        )


_BLOCK = "b int, pack long, a array<int>, row array<long>, times array<int>"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of several documents, sorted by pair and cut into blocks of one side id."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        keys, sizes = _flat(batch, "pairs")
        times, _ = _flat(batch, "times")
        rows = np.repeat(batch.column(batch.schema.get_field_index("row")).to_numpy(zero_copy_only=False), sizes)
        held.append((keys, rows, times))
        size += len(keys)
        if size >= SORTED_POSTINGS:
            yield _packed(held)
            held, size = [], 0
    if size:
        yield _packed(held)


def _packed(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    keys, rows, times = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(keys, kind="stable")
    keys, rows, times = keys[order], rows[order], times[order]
    side = keys >> 32
    first = np.concatenate(([True], side[1:] != side[:-1]))
    begin = np.flatnonzero(first)
    since = np.arange(len(keys)) - np.repeat(begin, np.diff(np.append(begin, len(keys))))
    start = np.flatnonzero(since % BLOCK_POSTINGS == 0)
    at = np.append(start, len(keys)).astype(np.int32)
    lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in ((keys & 0xFFFFFFFF).astype(np.int32), rows, times)]
    # All postings of a document are in one pack, which its first document tells from others.
    pack = np.full(len(start), held[0][1][0])
    return pa.RecordBatch.from_arrays([pa.array(side[start].astype(np.int32)), pa.array(pack), *lists], names=["b", "pack", "a", "row", "times"])


def _gains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What documents gain, from rows in order of (b, split, kind, first a): counts of pairs, then blocks of postings.

    Gains of a document are summed over the whole task, unless it has more than ``HELD_SUMS`` documents.
    """
    last: tuple[int, int] | None = None
    seen_a, seen_f = np.zeros(0, np.int64), np.zeros(0, np.int64)
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0
    for batch in (x.slice(k, STREAMED_BLOCKS) for x in batches for k in range(0, x.num_rows, STREAMED_BLOCKS)):
        b, split, kind = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
        ids, sizes = _flat(batch, "a")
        times, _ = _flat(batch, "times")
        rows, _ = _flat(batch, "row")  # of postings; counts have none
        change = np.concatenate(([(b[0], split[0]) != last], (b[1:] != b[:-1]) | (split[1:] != split[:-1])))
        group = np.cumsum(change)  # 0: the group that the batch before ended with
        of, posting = np.repeat(group, sizes), np.repeat(kind == 1, sizes)
        told = ~posting
        count_a = np.concatenate((seen_a, ids[told].astype(np.int64)))
        count_f = np.concatenate((seen_f, times[told].astype(np.int64)))
        count_g = np.concatenate((np.zeros(len(seen_a), np.int64), of[told]))
        if posting.any():
            begin = np.flatnonzero(np.concatenate(([True], count_g[1:] != count_g[:-1])))
            best = np.zeros(group[-1] + 1, np.int64)
            best[count_g[begin]] = np.maximum.reduceat(count_f, begin)
            mine = of[posting]
            found = np.searchsorted((count_g << 32) | count_a, (mine << 32) | ids[posting].astype(np.int64))
            f, m = count_f[found], times[posting].astype(np.int64)
            held.append(_gained(rows, np.where(f == best[mine], m, 0), f * m))
            size += len(held[-1][0])
            if size > 2 * HELD_SUMS:
                held = [_gained(*map(np.concatenate, zip(*held, strict=True)))]
                size = len(held[0][0])
                if size > HELD_SUMS:
                    yield _sums(held)
                    held, size = [], 0
        last = int(b[-1]), int(split[-1])
        mine = count_g == group[-1]
        seen_a, seen_f = count_a[mine], count_f[mine]
    if held:
        yield _sums(held)


def _gained(rows: np.ndarray, n_best: np.ndarray, count_sum: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows with their sums."""
    row, best = _summed(rows, n_best)
    return row, best, _summed(rows, count_sum)[1]


def _sums(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in _gained(*map(np.concatenate, zip(*held, strict=True)))], names=["row", "n_best", "count_sum"])


def _streamed(pairs: DataFrame) -> DataFrame:
    """(row, n_best, count_sum): up to ``SIDES`` rows for each document of ``pairs(row, pairs, times)``, to be summed."""
    counts = pairs.mapInArrow(_pair_counts, "b int, a int, links long, held long")
    counts = cut(counts.groupBy("b", "a").agg(F.sum("links").alias("links"), F.sum("held").alias("held")))
    many = counts.agg(F.sum("held").alias("n")).first().n or 0
    sets = max(1, -(-many // (SIDES * SPLIT_POSTINGS)))
    # One row for each id of B, with no more ids than A has.
    told = counts.groupBy("b").agg(F.array_sort(F.collect_list(F.struct("a", "links"))).alias("x")).select(
        "b",
        F.explode(F.sequence(F.lit(0), F.lit(sets - 1))).alias("split"),
        F.lit(0).alias("kind"),
        F.col("x.a").alias("a"),
        F.array().cast("array<long>").alias("row"),
        F.col("x.links").alias("times"),
    )
    postings = pairs.mapInArrow(_blocks, _BLOCK).select(
        "b",
        F.pmod(F.hash("pack"), F.lit(sets)).alias("split"),
        F.lit(1).alias("kind"),
        "a",
        "row",
        F.col("times").cast("array<long>").alias("times"),
    )
    side = F.pmod(F.hash("b"), F.lit(SIDES))
    streams = told.unionByName(postings).repartition(side, "split").sortWithinPartitions("b", "split", "kind", F.col("a")[0])
    return streams.mapInArrow(_gains, "row long, n_best long, count_sum long")


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's alignment between a byte-level vocabulary A (``.json``) and pieces B (``.model``).

    Returns ``doc_id`` (the id, of any type), ``n_a`` and ``n_b`` (tokens), ``n_groups`` (cuts where tokens of both end),
    ``n_links`` (token pairs whose bytes overlap), ``n_best`` (links whose pair is linked most often of all pairs of its B
    id, corpus-wide, ties included), ``count_sum`` (the counts of its links' pairs, summed) and ``groups_sha256``.

    Null and empty texts, and texts whose tokens do not give their bytes back, have no tokens: zeros and an empty digest.
    Rows with equal or null ids stay rows of their own; repeated rows count as often as they stand. No rows give no rows.
    Texts of any length are aligned whole. Columns other than the two named are not read.
    """
    read = stored(_tokenized(docs, path_a, path_b, id_col, text_col))
    gains = _streamed(read.select("row", "pairs", "times"))
    gains = gains.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    none = F.lit(0).cast("long")
    return read.drop("pairs", "times").join(gains, "row", "left").select(
        F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links",
        F.coalesce("n_best", none).alias("n_best"), F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256",
    )
