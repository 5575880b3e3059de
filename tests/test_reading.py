"""Spans in readings against trying every run of words, and readers that fail."""

import difflib
import random
import re

import numpy as np
import pytest

from maskwright.operators import reading as R

LOOK = str.maketrans("OoIlZzSBG", "001122586")


def norm(s):
    return re.sub("[^0-9A-ZÄÖÜß]", "", s.upper())


def folded(s):
    return "".join(re.sub("[^0-9]", "", w.translate(LOOK) if re.search("[0-9]", w) else w) for w in s.split())


def ratio(a, b):
    return difflib.SequenceMatcher(None, a, b).ratio() if a and b else 0.0


def brute(value, reading):
    """The span by trying every run; amounts are left to the cases that name them."""
    text = reading.strip()
    tokens = list(re.finditer(r"[^\s|]+", text))
    most, tried = max(1, len(value.split())) + 2, []
    for a in range(len(tokens)):
        for b in range(a, min(len(tokens), a + most)):
            run = " ".join(t.group() for t in tokens[a : b + 1])
            fv, fr = folded(value), folded(run)
            score = ratio(norm(value), norm(run))
            if score >= 0.75 and (not fv or (fr and ratio(fv, fr) >= 0.75)):
                tried.append((-score, b - a, a))
    if not tried:
        return None
    _, n, a = min(tried)
    start, end = tokens[a].start(), tokens[a + n].end()
    raw, edge = text[start:end], " \t:;,=-–—|("
    bare = raw.strip(edge)
    if not bare:
        return None
    printed = value if norm(bare) == norm(value) else bare
    return printed, raw[: len(raw) - len(raw.lstrip(edge))], raw[len(raw.rstrip(edge)) :], start / len(text), end / len(text)


def spans(spark, pairs):
    rows = [(k, v, r) for k, (v, r) in enumerate(pairs)]
    got = R.read_spans(spark.createDataFrame(rows, "k int, value string, reading string"), ["k"]).collect()
    return [None if r.span is None else tuple(r.span) for r in sorted(got, key=lambda r: r.k)]


def test_named_cases(spark):
    pairs = [
        ("EMN-260712-4194", "EMN-260712-4194|Datum:"), ("Leon Hartmann", "Leon Hartmann,"), ("1. Juli 2026", ": 1. Juli 2026"), ("Hartmann", "Hartmann,"),
        ("0000", "0,00%"), ("x", None), (None, "x"), ("", "a b"), ("abc", ""), ("10117 Berlin", "  10117 BERLN (Mitte)  "), ("12.07.", "am 12 07: 3"), ("same word", "same word same word"),
    ]
    got = spans(spark, pairs)
    assert got[0][0] == "EMN-260712-4194" and got[0][3] == 0 and got[0][4] < 0.75
    assert got[1][:3] == ("Leon Hartmann", "", ",") and got[2][:2] == ("1. Juli 2026", "") and got[2][3] > 0 and got[3][2] == ","
    assert got[4:9] == [None] * 5
    assert [got[k] for k in (9, 11)] == [brute(*pairs[k]) for k in (9, 11)]


def test_mutated_words_of_documents_equal_brute_force(spark, sf_dir):
    rng, pairs = random.Random(5), []
    for row in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(60).collect():
        words = row.text.split()[:40]
        at = rng.randrange(len(words))
        value = list(" ".join(words[at : at + rng.randint(1, 3)]))
        for _ in range(rng.randint(0, 3)):
            value[rng.randrange(len(value))] = rng.choice("aeO0I1 -")
        pairs.append(("".join(value), rng.choice([" ", "|", " | "]).join(words)))
    got = spans(spark, pairs)
    money = re.compile(r"[0-9.,]+(%|€|EUR)?$")
    for found, (value, reading) in zip(got, pairs, strict=True):
        want = brute(value, reading)
        assert found == want or (want and money.search(want[0]) and found is None), (value, reading)
    assert sum(x is not None for x in got) > 30


def crops(spark, n):
    rows = [(k, 4, 2, bytearray([k] * 8)) for k in range(n)]
    return spark.createDataFrame(rows, "k int, width int, height int, gray binary").coalesce(1)


def test_readers_fail_alone(spark):
    def reader(images):
        if any(x[0, 0] == 3 for x in images):
            raise ValueError("cannot read 3")
        if len(images) > 1 and any(x[0, 0] == 17 for x in images):
            return ["one text too few"]
        return [f"{x[0, 0]}:{x.shape[0]}x{x.shape[1]}" for x in images]

    rows = {r.k: r for r in R.read(crops(spark, 20), reader, batch=5, attempts=2).collect()}
    assert {k for k, r in rows.items() if r.error} == {3} and rows[3].reading is None and "cannot read 3" in rows[3].error
    assert all(rows[k].reading == f"{k}:2x4" for k in rows if k != 3) and set(rows) == set(range(20))
    assert "gray" not in rows[0].asDict()


def test_readers_are_not_called_without_crops(spark):
    def reader(images):
        raise AssertionError("called")

    assert R.read(crops(spark, 3).where("k > 5"), reader).collect() == []


@pytest.mark.parametrize("fails", [1, 2])
def test_readers_are_tried_again(spark, tmp_path, fails):
    path = str(tmp_path / "calls")

    def reader(images):
        with open(path, "a") as f:
            f.write("x")
        if len(open(path).read()) <= fails:
            raise OSError("busy")
        return ["text"] * len(images)

    assert [r.reading for r in R.read(crops(spark, 1), reader, attempts=3).collect()] == ["text"]
    assert np.array(len(open(path).read())) == fails + 1
