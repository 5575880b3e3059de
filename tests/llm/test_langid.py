import math
from collections import Counter, defaultdict

import numpy as np
import pandas as pd

from maskwright.llm import langid

SCHEMA = "doc_id long, text string, lang string, score string"


def brute_bits(training, text):
    """Code length by counting every context of every training text anew."""
    counts = [defaultdict(Counter) for _ in range(4)]
    for one in training:
        data = b"\n\n\n" + one.encode()
        for i in range(3, len(data)):
            for order in range(4):
                counts[order][data[i - order : i]][data[i]] += 1
    data, bits = b"\n\n\n" + text.encode(), 0.0
    for i in range(3, len(data)):
        for order in (3, 2, 1, 0):
            seen = counts[order][data[i - order : i]]
            if not seen:
                continue
            total = sum(seen.values()) + len(seen)
            if data[i] in seen:
                bits -= math.log2(seen[data[i]] / total)
                break
            bits -= math.log2(len(seen) / total)
        else:
            bits += 8
    return bits


def counted(texts_by_lang):
    rows = []
    for lang, texts in texts_by_lang.items():
        grams = Counter()
        for t in texts:
            data = b"\n\n\n" + t.encode()
            grams.update(int.from_bytes(data[i - 3 : i + 1], "big") for i in range(3, len(data)))
        rows += [(lang, g, n) for g, n in grams.items()]
    return pd.DataFrame(rows, columns=["lang", "gram", "n"])


def test_code_lengths_equal_brute_force(monkeypatch):
    monkeypatch.setattr(langid, "PAIRS", 24)  # so that rare pairs take the other way
    monkeypatch.setattr(langid, "_PIECE", 37)  # and long texts go in pieces
    training = {"a": ["the cat sat", "on the mat\nand"], "b": ["der Hund läuft schnell"]}
    model = langid.Model.of(counted(training))
    texts = ["the dog", "", "ß€ the", "x" * 90 + "the cat", "läuft der Hund und der Hund " * 7]
    got = model.code_lengths([t.encode() for t in texts])
    want = [[brute_bits(training[lang], t) for lang in ("a", "b")] for t in texts]
    np.testing.assert_allclose(got, want, rtol=1e-5)


def test_counting_in_spark_equals_counting_here(spark):
    rows = [(i, t, lang, "s") for i, (t, lang) in enumerate([("abca", "x"), ("", "x"), ("ba b", "x"), ("éé", "y"), (None, "y"), ("q", None)])]
    docs = spark.createDataFrame(rows, SCHEMA)
    used = [r for r in rows if r[1] is not None and r[2] and __import__("zlib").crc32(str(r[0]).encode()) % 5]
    by = defaultdict(list)
    for r in used:
        by[r[2]].append(r[1])
    got, want = langid.train(docs), langid.Model.of(counted(by))
    assert got.languages == [x for x in want.languages if any(by[x])] and np.array_equal(got.pairs, want.pairs)
    for a, b in zip(got.trees, want.trees, strict=True):
        assert all(np.array_equal(x, y) for x, y in zip(a.grams + a.counts, b.grams + b.counts, strict=True))


def test_accuracy_on_held_out_rows_and_edge_cases(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs.select("doc_id", "text", "lang"))
    told = langid.predict(docs, model).where("crc32(cast(doc_id as string)) % 5 = 0")
    right = told.selectExpr("avg(cast(lang = lang_pred as int)) a").first().a
    assert right > 0.97
    odd = [(1, None, "en", "x"), (1, "", None, "x"), (2, "12 + 3 !", "en", "x"), (None, "the that and", "en", "x"), (3, "the that " * 30_000, "en", "x")]
    frame = spark.createDataFrame(odd, SCHEMA)
    got = langid.predict(frame, model).collect()
    assert [r.lang_pred for r in got] == ["und", "und", "und", "en", "en"] and all(0 <= r.score <= 1 for r in got)
    kept = langid.accept(frame, model)
    assert kept.columns == frame.columns and sorted(map(str, (r.doc_id for r in kept.collect()))) == ["3", "None"]
    noise = spark.createDataFrame([(1, "".join(chr(0x4E00 + (i * i * 7919) % 20000) for i in range(500)), "zh", "x")], SCHEMA)
    assert langid.accept(noise, model).count() == 0


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    model = langid.train(docs)
    assert model.languages == [] and langid.predict(docs, model).count() == 0
    one = spark.createDataFrame([(1, "text", None, "s")], SCHEMA)
    assert langid.predict(one, model).first().lang_pred == "und"


def test_any_names_of_columns(spark):
    docs = spark.sql("select 2L as doc_id, 'some words' as text, 'en' as lang, 7 as __told, 8 as told, 9 as row, 'old' as score, map('a', 1) as m")
    model = langid.train(docs)
    got = langid.predict(docs, model)
    assert got.columns == ["doc_id", "text", "lang", "__told", "told", "row", "m", "lang_pred", "score", "bits_per_byte"]
    assert (got.first()["__told"], got.first().told, got.first().row, got.first().m) == (7, 8, 9, {"a": 1})
    assert langid.accept(docs, model).columns == docs.columns
