import itertools
import random

import pytest
from pyspark.sql import functions as F

from maskwright.functions import arrays as A
from maskwright.functions import barcode
from maskwright.functions import boxes as B


def flags(text):
    return [c == "1" for c in text]


def test_bands_and_runs(spark):
    rows = [flags("0110100" + "1"), flags("01101001"), [], flags("000"), flags("1")]
    frame = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "n int, f array<boolean>")
    got = frame.select("n", A.bands(F.col("f")).alias("a"), A.bands(F.col("f"), 2).alias("b"), A.runs(F.col("f")).alias("r"), A.longest_true_run(F.col("f")).alias("m")).orderBy("n").collect()
    assert [tuple(x) for x in got[0].a] == [(1, 3), (4, 5), (7, 8)]
    assert [tuple(x) for x in got[0].b] == [(1, 5), (7, 8)]
    assert got[0].r == [2, 1, 1, 2, 1] and got[0].m == 2
    assert got[2].a == [] and got[2].r == [] and got[3].m == 0 and got[4].r == [1]


def test_levels_and_heights(spark):
    frame = spark.createDataFrame([(1, list(range(1, 11)), [10, 20, 12, 0]), (2, [], []), (3, [5], [2]), (4, [0] + [255] * 9, [7, 3])], "n int, g array<int>, h array<int>")
    got = frame.select(A.paper_level(F.col("g")).alias("p"), A.line_height(F.col("h")).alias("l"), A.upper_median(F.col("h")).alias("u")).collect()
    assert [(r.p, r.l, r.u) for r in got] == [(10, 12, 12), (255, 12, None), (5, 4, 2), (255, 5, 7)]


@pytest.mark.parametrize("number", ["842607130031480842", "1234567890123456789012345678901", "07", "7", "000"])
def test_code_128_round_trip_and_damage(spark, number):
    frame = spark.createDataFrame([(number,)], "d string").select("d", barcode.symbols(F.col("d")).alias("s"), barcode.widths(F.col("d")).alias("w"))
    row = frame.select("*", barcode.decode(F.col("w")).alias("back")).first()
    assert row.back == number and sum(row.w) == 11 * len(row.s) + 13
    body = row.s[:-1]
    assert row.s[-1] == (body[0] + sum(i * s for i, s in enumerate(body))) % 103
    rng = random.Random(1)
    bad = []
    for _ in range(10):
        w = list(row.w)
        k = rng.randrange(len(w))
        w[k] = w[k] % 4 + 1
        bad.append((w,))
    bad += [(row.w[:-1],), ([],), ([2] * 13,)]
    assert [r.b for r in spark.createDataFrame(bad, "w array<int>").select(barcode.decode(F.col("w")).alias("b")).collect()] == [None] * len(bad)


def test_what_is_not_digits_has_no_barcode(spark):
    frame = spark.createDataFrame([("12a",), ("",), (None,)], "d string")
    assert [r.s for r in frame.select(barcode.widths(F.col("d")).alias("s")).collect()] == [None] * 3


def test_boxes(spark):
    frame = spark.createDataFrame([((0, 0, 10, 10), (7, 0, 17, 10)), ((0, 0, 10, 10), (8, 0, 18, 10)), ((0, 0, 10, 10), (0, 12, 10, 20)), ((0, 0, 0, 5), (0, 0, 5, 5))], "a struct<x0:int,y0:int,x1:int,y1:int>, b struct<x0:int,y0:int,x1:int,y1:int>")
    got = frame.select(B.overlaps(F.col("a"), F.col("b")).alias("o"), B.below(F.col("a"), F.col("b"), 12).alias("d"), B.centre_distance(F.col("a"), F.col("b")).alias("c")).collect()
    assert [r.o for r in got] == [True, False, False, False]
    assert [r.d for r in got] == [False, False, True, False] and got[0].c == 7.0


def test_running_sums(spark):
    rows = [([],), ([3],), (list(range(256)),), (list(range(257)),), ([1] * 1000 + [-5],), (None,)]
    frame = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, v array<int>")
    for r in frame.select("v", A.running(frame.v).alias("s")).collect():
        assert r.s == list(itertools.accumulate(r.v or []))
