"""Collocations against counting every phrase, and automata against sets of end positions."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from maskwright.llm import collocations as C
from maskwright.llm import queries


def brute(rows, least, best, depth=4):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n-\r]", low):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, depth + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, own in f.items():
        good = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        gone = set()
        for q, b in good.items():
            for k in range(2, len(q)):
                for i in range(len(q) - k + 1):
                    if 100 * b >= 80 * good.get(q[i : i + k], 10**9):
                        gone.add(q[i : i + k])
        found = []
        for p, a in good.items():
            if p not in gone:
                cuts = [(2000000 * a // (own[p[:k]] + own[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                found.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:best], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def got(docs, **options):
    columns = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    return sorted(tuple(r[c] for c in columns) for r in C.collocations(docs, **options).collect())


def endings(words, depth):
    """End positions of every string."""
    out = defaultdict(set)
    for i in range(len(words)):
        for k in range(1, depth + 1):
            if i - k + 1 >= 0 and all(words[i - k + 1 : i + 1]):
                out[tuple(words[i - k + 1 : i + 1])].add(i)
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=40), st.integers(1, 5))
def test_states_are_classes_of_equal_end_positions(words, depth):
    want = endings(words, depth)
    found = C.automaton(np.array(words, np.int64), depth)
    own = {}
    for s in range(len(found.end)):
        for k in range(found.shortest[s], found.longest[s] + 1):
            own[tuple(words[found.end[s] - k + 1 : found.end[s] + 1])] = s
    assert own.keys() == want.keys()
    assert all(found.count[s] == len(want[x]) for x, s in own.items())
    assert len(found.end) == len({frozenset(v) for v in want.values()})
    for x, s in own.items():
        ends = [x[i:] for i in range(1, len(x)) if want[x[i:]] != want[x]]
        assert found.link[s] == (own[ends[0]] if ends else -1)
    told = {(tuple(words[e - k + 1 : e + 1])): n for k, at, counts in found.strings() for e, n in zip(at, counts, strict=True)}
    assert told == {x: len(v) for x, v in want.items()}


def test_empty_automaton():
    assert len(C.automaton(np.zeros(3, np.int64)).end) == 0 and list(C.automaton(np.zeros(0, np.int64)).strings()) == []


@pytest.mark.parametrize("bits", [3, 8, 16])
def test_documents_equal_brute_force(spark, sf_dir, monkeypatch, bits):
    """Tables too small for their words let more through, and change no result; nor do small shards."""
    monkeypatch.setattr(C, "SHARD_WORDS", 2000 if bits == 8 else 1_000_000)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang")
    assert got(docs, bits=bits, best=50) == brute(docs.collect(), 30, 50)


def test_odd_rows(spark):
    rows = [
        (None, "en"), ("", "en"), ("a b c d e " * 9, None), ("A b C d. e; F\tg  h", "und"), ("x\x0by\x0cz\rw a b", "en"),
        ("ÄB äb Äb äb,äb c \u0085 d" * 3, "de"), ("a " * 50, "en"), ("a b c" * 3, ""), ("the end the end the end", "en"), ("the end the end the end", "en"),
        ("w" * 5000 + " " + "w" * 5000 + " x", "en"), ("one two three four five. " * 4, "fr"), ("one two three four six. " * 1, "fr"),
    ]
    docs = spark.createDataFrame([(t, lang, 1, "p") for t, lang in rows], "text string, lang string, f int, phrase string")
    for least in (1, 2, 3):
        assert got(docs, least=least, best=1000, bits=10) == brute(rows, least, 1000)


def test_counts_above_the_table_and_shared_hashes(spark):
    rows = [("alpha beta gamma " * 200, "en"), ("beta gamma. " * 400, "en")]
    docs = spark.createDataFrame(rows, "text string, lang string")
    assert got(docs, least=500, bits=4) == brute(rows, 500, 2000)


def test_products_pass_64_bits(spark):
    """A score over counts near 64 bits, by the expression that the operator uses."""
    a = (1 << 62) + 12345
    row = spark.range(1).selectExpr(f"(CAST(2000000 AS DECIMAL(7,0)) * CAST({a}L AS DECIMAL(20,0))) DIV (CAST({a}L AS DECIMAL(20,0)) + CAST({a + 5}L AS DECIMAL(20,0))) AS s").first()
    assert row.s == 2000000 * a // (2 * a + 5)


def test_no_rows_and_nothing_frequent(spark):
    none = spark.createDataFrame([], "text string, lang string")
    assert got(none) == [] and got(spark.createDataFrame([("a b", "en")], none.schema)) == []


def test_query_takes_whole_texts(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang").collect()
    found = queries.op12_collocations(spark, sf_dir)
    assert sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in found.collect()) == brute(rows, 30, 2000)


def test_phrases_are_shuffled_under_one_key_that_gives_back_their_language(spark):
    docs = spark.createDataFrame([("A b a b", "x\ny "), ("a b", None), ("é c.é c", "")], "text string, lang string")
    done = C.counted(docs, least=2)
    assert "hashpartitioning(key" in done._jdf.queryExecution().toString()
    want = {("x\ny ", 0, "", 4), ("x\ny ", 1, "a", 2), ("x\ny ", 1, "b", 2), ("x\ny ", 2, "a b", 2), ("und", 0, "", 2)}
    want |= {("", 0, "", 4), ("", 1, "é", 2), ("", 1, "c", 2), ("", 2, "é c", 2)}
    assert {tuple(r) for r in done.collect()} == want
