"""Cross-tokenizer alignment against token ranges compared one by one."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest

from maskwright.llm import alignment, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def ranges(libraries, text):
    """(id, start, end) of both tokenizers over the bytes of a space and the text, or None where bytes differ."""
    a, b = libraries
    byte = {c: k for k, c in enumerate(alignment_symbols())}
    raw = (" " + text).encode()
    out = []
    ids = a.encode(" " + text, add_special_tokens=False)
    pieces_a = [bytes(byte[c] for c in t) for t in ids.tokens]
    held = b.encode(text)
    pieces_b = [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in held]
    for numbers, pieces in ((ids.ids, pieces_a), (held, pieces_b)):
        if b"".join(pieces) != raw:
            return None
        at, own = 0, []
        for k, piece in zip(numbers, pieces, strict=True):
            own.append((k, at, at + len(piece)))
            at += len(piece)
        out.append(own)
    return out


def alignment_symbols():
    prints = {*range(33, 127), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(k if k in prints else next(rest)) for k in range(256)]


def brute(libraries, texts):
    """The operator's columns for each text, by comparing all tokens of a text with all."""
    links, told = [], []
    for text in texts:
        both = ranges(libraries, text) if text else None
        if both is None:
            links.append(Counter())
            told.append((0, 0, 0, 0, ""))
            continue
        a, b = both
        met = Counter((x, y) for x, s, e in a for y, t, f in b if max(s, t) < min(e, f))
        ends = sorted({e for _, _, e in a} & {f for _, _, f in b})
        groups = []
        for start, end in zip([0, *ends], ends, strict=False):
            groups.append("|".join(",".join(str(k) for k, s, e in own if start <= s and e <= end) for own in both))
        links.append(met)
        told.append((len(a), len(b), len(ends), sum(met.values()), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    counts = sum(links, Counter())
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    out = []
    for (n_a, n_b, n_groups, n_links, digest), met in zip(told, links, strict=True):
        top = sum(n for (x, y), n in met.items() if counts[x, y] == best[y])
        out.append((n_a, n_b, n_groups, n_links, top, sum(n * counts[p] for p, n in met.items()), digest))
    return out


ODD = [
    "", None, " ", "  ", "a", " a", "a ", "a  b", "a\n b", "\n", "\n\n  x", "x\n", "tab\there", "a b c", "日本語 テキスト", "x ▁ y", "x▁", "<s>a</s>",
    "<0x41> <0x0A>", "<|endoftext|> end<|endoftext|>", "don't  we'll\r\n go", "naïve café Ünïcödé", "a\x1c b", "\x00 zero", "😀 👩‍👩‍👧 é", "12345 67 8", "x" * 300,
    "the the the the", "the", "   lead", "trail   \n ",
]


def check(spark, libraries, texts, docs=None):
    docs = docs or spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r[0]: tuple(r[1:]) for r in alignment.align(docs, A, B).collect()}
    want = dict(enumerate(brute(libraries, texts)))
    assert got == want


def test_odd_texts_equal_brute_force(spark, libraries):
    check(spark, libraries, ODD)


def test_documents_equal_brute_force(spark, libraries, sf_dir):
    texts = [r[0] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").select("text").collect()]
    check(spark, libraries, [t if t is None or len(t) < 3000 else t[:3000] for t in texts])


def test_split_side_ids_equal_whole_ones(spark, libraries, monkeypatch):
    # Small blocks and splits: one side id is streamed by many tasks, each with the id's counts.
    for name, value in (("BLOCK_POSTINGS", 2), ("SPLIT_POSTINGS", 5), ("SORTED_POSTINGS", 7)):
        monkeypatch.setattr(alignment, name, value)
    texts = [f"the thing number {k % 7} of the things, thé {'the ' * (k % 5)}end" for k in range(60)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        check(spark, libraries, texts)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_document_has_a_sum_for_each_group_of_side_ids_at_most(spark, monkeypatch):
    for name, value in (("BLOCK_POSTINGS", 2), ("SPLIT_POSTINGS", 40), ("SORTED_POSTINGS", 50), ("SIDES", 2), ("STREAMED_BLOCKS", 2)):
        monkeypatch.setattr(alignment, name, value)
    docs = spark.createDataFrame([(k, f"the thing number {k % 7} of all these other things, ends") for k in range(60)], "doc_id long, text string")
    read = alignment._tokenized(docs, A, B, "doc_id", "text").select("row", "pairs", "times").cache()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        got = alignment._streamed(read).groupBy("row").count().collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 60 and max(r["count"] for r in got) <= 2


def test_a_thinned_memo_keeps_what_was_met_repeatedly(libraries, monkeypatch):
    monkeypatch.setattr(alignment, "MEMO_UNITS", 6)
    own = alignment.Aligner(A, B)
    for text in ("one two one three four five six seven two", "one eight two eight"):
        found = alignment._aligned([text], own)
        assert tuple(found.column(c)[0].as_py() for c in ("n_a", "groups_sha256")) == (brute(libraries, [text])[0][0], brute(libraries, [text])[0][-1])
    assert list(own.index) == ["one", "two", "eight"]


def test_memo_may_be_cleared(libraries, monkeypatch):
    monkeypatch.setattr(alignment, "MEMO_UNITS", 4)
    own = alignment.Aligner(A, B)
    for text in ("a b c d e f", "g h a b", "a b c d e f"):
        found = alignment._aligned([text], own)
        assert tuple(found.column(c)[0].as_py() for c in ("n_a", "groups_sha256")) == (brute(libraries, [text])[0][0], brute(libraries, [text])[0][-1])


def test_units_are_cut_where_both_tokenizers_do(libraries):
    own = alignment.Aligner(A, B)
    assert own.units
    for text in ("a b", "a  b", " a", "\na \n b"):
        assert "".join(" " + u for u in own.cut(text)) == " " + text


def test_repeated_rows_null_ids_and_clashing_columns(spark, libraries):
    rows = [("x", "the end", 1, 2), ("x", "the end", 1, 2), (None, "the end", 3, 4), (None, None, 5, 6)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, row int, pairs int")
    got = sorted(alignment.align(docs, A, B).collect(), key=lambda r: (r[0] is None, r[1]))
    want = brute(libraries, ["the end"] * 3)
    assert [tuple(r[1:]) for r in got if r.n_a] == want
    assert [r.doc_id for r in got] == ["x", "x", None, None] and sum(r.n_a == 0 for r in got) == 1


def test_no_rows(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []


def test_query_returns_every_document(spark, sf_dir):
    got = queries.op11_alignment(spark, sf_dir)
    assert [n for n, _ in got.dtypes] == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert got.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
