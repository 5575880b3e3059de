import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from maskwright.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, draws int"


def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(order)}
    out, left, open_ = {}, float(sum(sizes.values())), set(order)
    while True:
        level = left / sum(weight[s] for s in open_) if open_ else 0
        full = {s for s in open_ if 3 * sizes[s] <= level * weight[s]}
        if not full:
            return out | {s: level * weight[s] for s in open_}
        for s in full:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
        open_ -= full


def check(rows, docs):
    sizes = [len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in docs]
    by = Counter()
    for r, n in zip(docs, sizes, strict=True):
        by[r[2]] += n
    want, taken = brute_targets(dict(by)), Counter()
    assert sorted((str(r.doc_id), r.size) for r in rows) == sorted((str(r[0]), n) for r, n in zip(docs, sizes, strict=True))
    for r in rows:
        assert r.source_size == by[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r.size and r.taken == sum(x.words for x in r.draws)
        assert all(0 <= x.shard < 16 and 0 < x.words <= r.size for x in r.draws)
        taken[r.source] += r.taken
    for s, n in taken.items():
        assert abs(n - want[s]) <= 1


def test_mix_meets_its_targets(spark):
    rng = random.Random(1)
    docs = [(None, None, None, "x", 1), (None, "a b", None, "x", 1), (1, "", "s1", "x", 1), (1, "a", "s1", "x", 1), (1, "a", "s1", "x", 1)]
    docs += [(10 + i, "w " * rng.randrange(60), f"s{min(i % 9, 4)}", "x", 0) for i in range(400)]
    docs += [(5000, "long " * 30_000, "é", "x", 0), (5001, "one", "empty", "x", 0), (5002, "\t\n ", "void", "x", 0)]
    frame = spark.createDataFrame(docs, SCHEMA)
    mixed = mixing.mix(frame)
    rows = mixed.collect()
    check(rows, docs)
    again = mixing.mix(frame.repartition(7)).collect()
    assert sorted(map(str, ((r.doc_id, r.size, r.draws) for r in rows))) == sorted(map(str, ((r.doc_id, r.size, r.draws) for r in again)))
    drawn = mixing.shuffled(mixed).collect()
    assert sorted((str(r.doc_id), r.shard, r.epoch, r.words, r.order) for r in drawn) == sorted((str(r.doc_id), d.shard, d.epoch, d.words, d.order) for r in rows for d in r.draws)
    assert [(r.shard, r.order) for r in drawn] == sorted((r.shard, r.order) for r in drawn)
    assert len({r.shard for r in drawn}) > 10
    one = mixing.mix(frame.limit(0))
    assert one.count() == 0


def test_blocks_are_permuted(spark):
    frame = spark.range(mixing.BLOCKS).select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("source"), F.col("id").cast("int").alias("block"))
    places = {}
    for r in frame.select("source", "block", mixing._place(F.col("source"), F.col("block"), 1).alias("p")).collect():
        places.setdefault(r.source, {})[r.block] = r.p
    for p in places.values():
        assert sorted(p.values()) == list(range(mixing.BLOCKS))
        # Neighbours part, and low bits don't keep their pattern.
        assert sum(abs(p[k + 1] - p[k]) < 64 for k in range(mixing.BLOCKS - 1)) < 300
        assert 1800 < sum(p[k] % 2 == k % 2 for k in p) < 2300
    assert places["a"] != places["b"]


def test_hypergeometric_has_its_distribution(spark):
    for good, total, draws in ((7, 20, 9), (40, 41, 20), (300, 1000, 500)):
        frame = spark.range(4000).select(
            mixing.hypergeometric(F.lit(good).cast("long"), F.lit(total).cast("long"), F.lit(draws).cast("long"), (F.col("id") + 0.5) / 4000).alias("x")
        )
        got = Counter(r.x for r in frame.collect())
        below, seen = 0.0, 0
        for x in range(max(0, draws - total + good), min(good, draws) + 1):
            below += math.comb(good, x) * math.comb(total - good, draws - x) / math.comb(total, draws)
            seen += got[x]
            assert abs(seen / 4000 - below) < 0.001


def test_shards_split_every_quota_exactly(spark):
    quotas = {"a": 5000, "b": 0, "c": 17, None: 12_000}
    frame = spark.createDataFrame(list(quotas.items()), "source string, quota long")
    rows = mixing.shard_quotas(frame, shards=6).collect()
    assert {r.source: r.ends[-1] for r in rows} == quotas
    parts = {r.source: [b - a for a, b in zip([0, *r.ends], r.ends)] for r in rows}
    assert all(len(p) == 6 and min(p) >= 0 for p in parts.values())
    whole = [sum(p[k] for p in parts.values()) for k in range(6)]
    assert max(whole) - min(whole) <= 3


def test_the_plan_of_the_tree_is_small(spark, monkeypatch):
    """The driver holds the plan of all draws: bounds of a draw's sum are not written out for each of their uses."""
    seen = []
    keep = mixing.cut
    monkeypatch.setattr(mixing, "cut", lambda df: seen.append(len(df._jdf.queryExecution().optimizedPlan().toString())) or keep(df))
    mixing.shard_quotas(spark.createDataFrame([("a", 10), ("b", 7)], "source string, quota long"), shards=2).collect()
    assert seen[0] < 25_000
