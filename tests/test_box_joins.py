"""Joins of boxes, held to brute force, with equal boxes and lines of several boxes."""

import random

from maskwright.operators import location as L

SCHEMA = "page int, {0} int, box struct<x0:int,y0:int,x1:int,y1:int>"


def drawn(n, seed=1):
    r = random.Random(seed)
    out = []
    for k in range(n):
        x, y = r.randrange(-20, 120), r.randrange(-20, 120)
        out.append((k % 2, k, (x, y, x + r.choice((1, 5, 20, 300)), y + r.choice((0, 4, 12)))))
    return out


def overlap(a, b, least):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    area = lambda x: max(0, x[2] - x[0]) * max(0, x[3] - x[1])
    return w > 0 and h > 0 and w * h >= least * min(area(a), area(b))


def test_overlapping_pairs_are_those_of_brute_force(spark):
    rows = drawn(150) + [(0, 1000 + k, (3, 3, 30, 15)) for k in range(L.NAMES + 5)]
    got = sorted(tuple(x) for x in L.overlapping_pairs(spark.createDataFrame(rows, SCHEMA.format("id")), ["page"]).collect())
    want = sorted((p, i, j) for p, i, a in rows for q, j, b in rows if p == q and i < j and overlap(a, b, 0.3))
    assert got == want


def test_equal_boxes_are_compared_once(spark):
    rows = [(0, k, (3, 3, 30, 15)) for k in range(2 * L.NAMES)]
    held = L._named(spark.createDataFrame(rows, SCHEMA.format("id")), ["page"], "id").collect()
    assert sorted((x["part"], len(x["names"])) for x in held) == [(0, L.NAMES), (1, L.NAMES)]


def test_next_lines_are_those_of_brute_force_each_once(spark):
    rows = drawn(150, 2) + [(0, 200, (3, 3, 30, 15)), (0, 200, (3, 40, 30, 52)), (0, 200, (40, 3, 60, 15))] + [(0, 300 + k, (3, 16, 50, 28)) for k in range(L.NAMES + 5)]
    got = sorted(tuple(x) for x in L.next_lines(spark.createDataFrame(rows, SCHEMA.format("line")), ["page"], 12).collect())
    below = lambda a, b: -6 <= b[1] - a[3] <= 12 and b[0] < a[2] and a[0] < b[2]
    assert got == sorted({(p, i, j) for p, i, a in rows for q, j, b in rows if p == q and i < j and below(a, b)})


def test_next_lines_of_one_box_are_not_told_apart_as_pairs(spark):
    found = L.next_lines(spark.createDataFrame(drawn(20), SCHEMA.format("line")), ["page"], 12)
    assert found._jdf.queryExecution().optimizedPlan().nodeName() == "Union"


def test_nearest_lines_look_equal_hints_up_once(spark, monkeypatch):
    lines = [(p, k, b) for p, k, b in drawn(60, 3) if b[3] > b[1]]
    values = [(p, k % 20, lines[k % 7][2]) for k, (p, _, _) in enumerate(lines)]
    asked, ranked = [], L._ranked

    def counted(hints, placed, keys, most, reach):
        if reach == 1:
            asked.append(hints.count())
        return ranked(hints, placed, keys, most, reach)

    monkeypatch.setattr(L, "_ranked", counted)
    own = spark.createDataFrame(values, SCHEMA.format("value").replace("box struct", "hint struct"))
    got = sorted((x.page, x.value, x["rank"], x.line) for x in L.nearest_lines(own, spark.createDataFrame(lines, SCHEMA.format("line")), ["page"]).collect())
    want, centre = [], lambda b: ((b[0] + b[2]) / 2, (b[1] + b[3]) / 2)
    for p, v in sorted({x[:2] for x in values}):
        near = sorted((((centre(h)[0] - centre(b)[0]) ** 2 + (centre(h)[1] - centre(b)[1]) ** 2) ** 0.5, k) for q, w, h in values if (q, w) == (p, v) for r, k, b in lines if r == p)
        want += [(p, v, n + 1, k) for n, (_, k) in enumerate(near[:12])]
    assert got == want
    assert asked == [len({(p, h) for p, _, h in values})]
