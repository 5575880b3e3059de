import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from maskwright.llm import tokens

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ask(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


ODD = [
    "", " ", "a", "The cat's don't 'll 're 'x", "<|endoftext|>", "x<|endoftext|>y <|endoftext", "É́tait éa",
    "Straße ΣΊΣΥΦΟΣ İstanbul ﬁne", "a\x1cb\x1fc", "１２3 4５", "日本語のテキスト、です", "🙂🙂 ok👍🏽", "a b c​d",
    "token = \"0641917ea4e9fe\"", "foo.12@mail3.example.com +1 (988) 555-2485 1.2.3.4", "--...''''s!!1a", "a" * 300, "x1" * 150, "é" * 100,
]


def test_every_prefix_of_odd_texts(library):
    own = tokens.PrefixCounter(PATH)
    for text in ODD:
        want = [ask(library, text[:i]) for i in range(len(text) + 1)]
        assert own.prefixes(text).tolist() == want, text
        assert own.total(text) == want[-1], text


@pytest.mark.parametrize("seed", range(4))
def test_every_prefix_of_random_texts(library, seed, monkeypatch):
    monkeypatch.setattr(tokens, "_MEMO_PREFIXES", 50)
    monkeypatch.setattr(tokens, "_MEMO_RUNS", 20)
    rng, own = random.Random(seed), tokens.PrefixCounter(PATH)
    letters = ["abcdefghijklmnopqrstuvwxyz", "aeiou thn", "AbÉéß'1 .-<|>"][seed % 3]
    for _ in range(25):
        text = "".join(rng.choices(letters, k=rng.randrange(60)))
        assert own.prefixes(text).tolist() == [ask(library, text[:i]) for i in range(len(text) + 1)], text


def test_whole_documents_in_spark(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(None, None), (-1, ""), (-1, ""), (-2, "word " * 40_000), (-3, "a" * 90_000), (-4, "x1" * 45_000)], "doc_id long, text string")
    for r in docs.union(extra).withColumn("n", tokens.token_counts(docs.text, PATH)).collect():
        assert r.n == ask(library, r.text or "")
    assert docs.limit(0).withColumn("n", tokens.token_counts(docs.text, PATH)).count() == 0


def test_budget_questions_without_encoding(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("n_chars < 900").limit(10)
    stored = docs.withColumn("counts", tokens.prefix_counts(docs.text, PATH))
    for r in stored.withColumn("most", tokens.longest_prefix(stored.counts, 50)).collect():
        counts = [ask(library, r.text[:i]) for i in range(len(r.text) + 1)]
        assert r.counts == counts
        assert r.most == max(i for i, n in enumerate(counts) if n <= 50)
    assert np.array_equal(tokens.counter(PATH).prefixes(""), [0])
