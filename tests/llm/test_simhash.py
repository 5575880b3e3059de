import random

import pytest
import xxhash

from maskwright.llm import simhash
from maskwright.llm.components import components

SCHEMA = "doc_id long, text string, lang string, fp string"


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    value = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in hashes) > len(hashes))
    return value - (1 << 64) if value >> 63 else value


def brute_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def hamming_links(prints):
    prints = sorted(prints)
    return [(a, b) for i, a in enumerate(prints) for b in prints[:i] if bin((a ^ b) & (2**64 - 1)).count("1") <= 2]


@pytest.mark.parametrize("seed", range(5))
def test_fingerprint_equals_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(50):
        text = rng.choice([" ", "\t", "\n"]).join(rng.choices("A b Cé d e f g \x0b h".split(" "), k=rng.randrange(40)))
        assert simhash.fingerprint(text) == brute_print(text)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


def test_components_of_chain_star_and_repeats(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (3, 2), (2, 3), (None, 1)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{100 + i: 100 for i in range(30)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("crowd", [0, 64])
def test_links_connect_exactly_what_hamming_distance_connects(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng, prints = random.Random(1), set()
    for _ in range(40):
        base = rng.getrandbits(64)
        prints.add(base)
        for _ in range(rng.randrange(12)):
            base ^= sum({1 << rng.randrange(64) for _ in range(rng.randrange(1, 5))})
            prints.add(base)
    prints = {x - (1 << 64) if x >> 63 else x for x in prints} | {0, 1, 3, 7, -1, -2}
    got = simhash.links(spark.createDataFrame([(x,) for x in prints], "fp long")).collect()
    assert all(1 <= bin((r.a ^ r.b) & (2**64 - 1)).count("1") <= 2 for r in got)
    if crowd:
        assert {(r.a, r.b) for r in got} == set(hamming_links(prints))
    assert brute_components(prints, [(r.a, r.b) for r in got]) == brute_components(prints, hamming_links(prints))


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    rows = [(None, None, None, "x"), (5, "", "en", "x"), (5, "", "en", "x"), (9, "one two", None, None), (8, "one two", None, None)]
    for i in range(60):
        text = rng.choices(words, k=rng.choice([5, 60, 400]))
        rows.append((100 + i, " ".join(text), "en", "y"))
        for j in range(rng.randrange(4)):
            copy = list(text)
            for _ in range(j % 3):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((1000 + 10 * i + j, " ".join(copy), "en", "z"))
    rows.append((77, "long " * 30_000, "en", "z"))
    docs = spark.createDataFrame(rows, SCHEMA)
    prints = {brute_print(r[1]) for r in rows}
    root = brute_components(prints, hamming_links(prints))
    least = {}
    for doc, text, *_ in rows:
        if doc is not None:
            key = root[brute_print(text)]
            least[key] = min(doc, least.get(key, doc))
    want = sorted(((r[0], brute_print(r[1]), least.get(root[brute_print(r[1])])) for r in rows), key=str)
    got = simhash.near_duplicates(docs).collect()
    assert sorted(((r.doc_id, r.fp, r.component_id) for r in got), key=str) == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(least.values())


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(docs).count() == 0
    assert simhash.keep_one(docs).count() == 0


def test_any_names_and_map_columns(spark):
    docs = spark.sql(
        "select * from values (1L, 'a b c d', map('k', 1), 'x'), (1L, 'a b c d', map('k', 1), 'x'), (1L, 'a b c d', map('k', 2), 'x'),"
        " (2L, 'other words stand here', null, 'y') as t(doc_id, text, m, __row)"
    )
    kept = simhash.keep_one(docs.withColumns({x: docs["__row"] for x in ("row", "all", "plain", "mine")}))
    assert kept.columns == ["doc_id", "text", "m", "__row", "row", "all", "plain", "mine"]
    assert sorted((r.doc_id, r["__row"], r.mine) for r in kept.collect()) == [(1, "x", "x"), (2, "y", "y")]
