"""Kernels of measures against pixel-by-pixel brute force over random pages."""

import numpy as np

from maskwright.operators import measures as M
from maskwright.operators import votes
from maskwright.operators.pixels import INK


def _page(rng, height=40, width=70):
    page = rng.integers(225, 246, (height, width)).astype(np.uint8)
    for _ in range(int(rng.integers(0, 9))):
        y, x = int(rng.integers(0, height)), int(rng.integers(0, width))
        page[y : y + int(rng.integers(1, 6)), x : x + int(rng.integers(1, 12))] = int(rng.integers(0, 120))
    return page


def test_levels_equal_sorted_pixels():
    rng = np.random.default_rng(1)
    images = [_page(rng) for _ in range(40)] + [rng.integers(0, 256, (3, n)).astype(np.uint8) for n in range(1, 12)] + [np.full((2, 2), 7, np.uint8)]
    for image in images:
        data, counts = sorted(image.ravel().tolist()), M.levels(image)
        paper = data[min(len(data) - 1, int(len(data) * 0.9))]
        assert M.paper_of(counts) == paper
        apart = sorted(abs(v - paper) for v in data if v >= paper - 30)
        assert M.noise_of(counts, paper) == 1.4826 * apart[len(apart) // 2]
        dark, light = data[len(data) // 20], data[min(len(data) - 1, len(data) * 9 // 10)]
        assert M.cut_of(counts) == ((dark + light) // 2 if light - dark > 40 else dark - 1)
        below = [v for v in data if v < paper - INK]
        third = below[: max(1, len(below) // 3)]
        assert M.ink_of(counts, paper - INK) == (int(sum(third) / len(third)) if third else 15)
    none = M.levels(np.zeros((0, 3), np.uint8))
    assert (M.paper_of(none), M.noise_of(none, 255), M.cut_of(none), M.ink_of(none, 100)) == (255, 0.0, 128, 15)
    assert M.ink_of(M.levels(np.zeros((2, 2), np.uint8)), -70) == 15


def test_colour_of_the_darkest_third():
    rng = np.random.default_rng(2)
    for _ in range(30):
        rgb = rng.integers(0, 60, (4, 9, 3)).astype(np.uint8) * int(rng.integers(1, 5))
        cut = int(rng.integers(0, 200))
        ink = sorted((p for p in map(tuple, rgb.reshape(-1, 3).tolist()) if sum(p) / 3 < cut), key=sum)
        third = ink[: max(1, len(ink) // 3)]
        assert M.ink_colour(rgb, cut) == (tuple(int(sum(c) / len(third)) for c in zip(*third, strict=True)) if third else (15, 15, 15))


def test_rows_and_room_equal_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(150):
        gray, cut = _page(rng), 150
        height, width = gray.shape
        x0, y0 = int(rng.integers(0, width - 8)), int(rng.integers(0, height - 8))
        x1, y1 = x0 + int(rng.integers(1, 8)), y0 + int(rng.integers(1, 8))
        columns = [x for x in range(x0, x1) if not (gray[max(0, y0 - 3), x] < cut and gray[min(height - 1, y1 + 2), x] < cut)]
        rows = [y for y in range(y0, y1) if any(gray[y, x] < cut for x in columns)]
        assert M.value_rows(gray, (x0, y0, x1, y1), cut) == ((rows[0], rows[-1] + 1) if rows else (y0, y1))
        for gap in (1, 3):
            want, blank = min(width, x1 + 20), 0
            for x in range(x1, min(width, x1 + 20)):
                if (gray[y0:y1, x] < cut).any():
                    if blank >= gap:
                        want = x
                        break
                    blank = 0
                else:
                    blank += 1
            assert M.free_right(gray, (x0, y0, x1, y1), cut, gap, 20) == want
        for up in (True, False):
            want, y = 0, y0 - 1 if up else y1
            while 0 <= y < height and want < 12:
                if (gray[y, x0:x1] < cut).any():
                    want = max(0, want - 1)
                    break
                want, y = want + 1, y - 1 if up else y + 1
            assert M.free_rows(gray, (x0, y0, x1, y1), cut, up) == want


def test_shapes():
    rng = np.random.default_rng(4)
    for _ in range(40):
        a, b = rng.random((2, 7, 9)) < 0.15
        near = lambda m, y, x: m[max(0, y - 1) : y + 2, max(0, x - 1) : x + 2].any()
        cells = [(near(a, y, x), near(b, y, x)) for y in range(7) for x in range(9)]
        either = sum(p or q for p, q in cells)
        assert M.alike(a, b) == (sum(p and q for p, q in cells) / either if either else 0.0)
        each = a.sum(axis=1).tolist()
        body = [y for y, n in enumerate(each) if max(each) and n >= 0.25 * max(each)]
        assert M.body_height(a) == (body[-1] - body[0] + 1 if body else 0)
    assert M.alike(np.zeros((2, 2), bool), np.zeros((2, 2), bool)) == 0.0
    assert M.shape(np.full((3, 4), 200, np.uint8), 100).shape == (3, 4) and M.body_height(np.zeros((3, 4), bool)) == 0


def test_styles_are_voted_by_what_reproduces_the_samples(spark):
    gray = np.full((20, 60), 240, np.uint8)
    gray[5:15, 5:25:2] = 0
    gray[5:15, 30:50] = 0
    def drawn(text, option, body, size):
        mask = np.zeros(size, bool)
        mask[:, :: 2 if option == "striped" else 5] = True
        return mask, size[1] * (2 if option == "wide" else 1)

    page = spark.createDataFrame([(1, 60, 20, bytearray(gray.tobytes()))], "page int, width int, height int, gray binary")
    page = page.selectExpr("*", "array(named_struct('text', 'a', 'box', named_struct('x0', 5, 'y0', 5, 'x1', 25, 'y1', 15))) as samples")
    scores = M.style_scores(page, ["page"], ["wide", "striped"], drawn)
    got = {r.option: r.score for r in scores.collect()}
    assert got["striped"] == 1.0 and got["wide"] < 0.7
    assert votes.winner(scores, ["page"]).first().option == "striped"


def test_outlines(spark):
    page = spark.createDataFrame([(1, 12, 10, bytearray(b"\xf0" * 120)), (2, 1, 1, bytearray(b"\x05"))], "page int, width int, height int, gray binary")
    page = page.selectExpr("*", "if(page = 1, array(named_struct('x0', 1, 'y0', 1, 'x1', 8, 'y1', 7, 'how', 'ocr'), named_struct('x0', 9, 'y0', 6, 'x1', 40, 'y1', 40, 'how', 'new')), null) as places")
    got = {r.page: np.frombuffer(r.rgb, np.uint8).reshape(r.height, r.width, 3) for r in M.outlined(page, ["page"]).collect()}
    want = np.full((10, 12, 3), 240, np.uint8)
    for box, colour in (((1, 1, 8, 7), (220, 30, 30)), ((9, 6, 40, 40), (230, 140, 0))):
        for y in range(box[1], min(9, box[3]) + 1):
            for x in range(box[0], min(11, box[2]) + 1):
                if x - box[0] < 2 or box[2] - x < 2 or y - box[1] < 2 or box[3] - y < 2:
                    want[y, x] = colour
    assert (got[1] == want).all() and got[2].tolist() == [[[5, 5, 5]]]
