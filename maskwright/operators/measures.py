"""Measures of a printed value: levels by counting, rows of its own, room around it, and how alike shapes are.

All order statistics of a box come from one count of its 256 gray levels, so nothing is sorted. Spark deals out the pages, as in
``pixels``; a page's values are measured in one kernel call on the page as it was scanned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame

from maskwright.operators.pixels import BOX, INK, Box, pages_to_rows

# What a measure is when there is nothing to measure, and the limits that results have to share.
NO_PAPER, NO_CUT, NO_INK = 255, 128, 15
#: Levels below the paper that are its grain; from a median deviation to a standard one.
GRAIN, SPREAD = 30, 1.4826
#: Least distance of ink and paper that is halved.
CONTRAST = 40
#: Columns and rows around a line that count as its surroundings; pixels to the right, rows up and down that are looked at.
SIDE, ROWS, RIGHT, UP_DOWN = 20, 10, 400, 12
#: Share of the busiest row's ink that makes a row part of the letters' body.
BODY = 0.25
#: What a shape loses for each unit of the logarithm of its stretch.
STRETCH = 0.5


def levels(gray: np.ndarray) -> np.ndarray:
    """How many pixels have each level."""
    return np.bincount(gray.ravel(), minlength=256)


def at(counts: np.ndarray, place: int) -> int:
    """The level of the pixel at ``place`` if all stood in order."""
    return int(np.searchsorted(np.cumsum(counts), place, "right"))


def paper_of(counts: np.ndarray) -> int:
    n = int(counts.sum())
    return at(counts, min(n - 1, int(n * 0.9))) if n else NO_PAPER


def noise_of(counts: np.ndarray, paper: int) -> float:
    """The paper's grain: the upper median of how far levels near the paper are from it, as a standard deviation."""
    low = max(0, paper - GRAIN)
    apart = np.bincount(np.abs(np.arange(low, len(counts)) - paper), counts[low:], 256)
    n = int(apart.sum())
    return SPREAD * at(apart, n // 2) if n else 0.0


def cut_of(counts: np.ndarray) -> int:
    """The level halfway between ink and paper; just below the ink where the two are hardly apart."""
    n = int(counts.sum())
    if not n:
        return NO_CUT
    dark, light = at(counts, n // 20), at(counts, min(n - 1, n * 9 // 10))
    return (dark + light) // 2 if light - dark > CONTRAST else dark - 1


def ink_of(counts: np.ndarray, cut: int) -> int:
    """The mean level of the darkest third of what is below ``cut``."""
    below = counts[: max(0, cut)]
    n = int(below.sum())
    if not n:
        return NO_INK
    third = max(1, n // 3)
    upto = np.minimum(np.cumsum(below), third)
    return int((np.diff(upto, prepend=0) * np.arange(len(below))).sum() / third)


def ink_colour(rgb: np.ndarray, cut: int) -> tuple[int, int, int]:
    """The mean colour of the darkest third of the ink; of equally dark pixels the first count."""
    flat = rgb.reshape(-1, 3)
    sums = flat.sum(axis=1, dtype=np.int64)
    own = flat[sums < 3 * cut]
    if not len(own):
        return (NO_INK,) * 3
    sums, third = own.sum(axis=1, dtype=np.int64), max(1, len(own) // 3)
    last = at(np.bincount(sums, minlength=766), third - 1)
    darker, same = sums < last, np.flatnonzero(sums == last)
    darker[same[: third - int(darker.sum())]] = True
    return tuple(int(x) for x in own[darker].sum(axis=0) / third)


def value_rows(gray: np.ndarray, run: Box, cut: int) -> tuple[int, int]:
    """The rows that a run's own ink takes; columns whose ink goes on above and below are cell lines and don't count."""
    x0, y0, x1, y1 = run
    dark = gray[:, x0:x1] < cut
    lines = dark[max(0, y0 - 3)] & dark[min(len(gray) - 1, y1 + 2)]
    rows = np.flatnonzero(dark[y0:y1, ~lines].any(axis=1))
    return (y0 + int(rows[0]), y0 + int(rows[-1]) + 1) if len(rows) else (y0, y1)


def free_right(gray: np.ndarray, box: Box, cut: int, gap: int = 1, limit: int = RIGHT) -> int:
    """Where the next ink to the right begins behind ``gap`` blank columns; the end of what is looked at if none does."""
    _, y0, x1, y1 = box
    end = min(gray.shape[1], x1 + limit)
    inked = np.flatnonzero((gray[y0:y1, x1:end] < cut).any(axis=0))
    blanks = np.diff(inked, prepend=-1) - 1
    far = np.flatnonzero(blanks >= gap)
    return x1 + int(inked[far[0]]) if len(far) else end


def free_rows(gray: np.ndarray, box: Box, cut: int, up: bool, limit: int = UP_DOWN) -> int:
    """Blank rows next to a box, one fewer if ink ends them, ``limit`` at most."""
    x0, y0, x1, y1 = box
    near = gray[max(0, y0 - limit) : y0, x0:x1][::-1] if up else gray[y1 : y1 + limit, x0:x1]
    inked = np.flatnonzero((near < cut).any(axis=1))
    return max(0, int(inked[0]) - 1) if len(inked) else len(near)


def shape(gray: np.ndarray, cut: int) -> np.ndarray:
    """What is darker than ``cut``, without the blank rows and columns around it; all of it if nothing is."""
    dark = gray < cut
    rows, columns = np.flatnonzero(dark.any(axis=1)), np.flatnonzero(dark.any(axis=0))
    return dark[rows[0] : rows[-1] + 1, columns[0] : columns[-1] + 1] if len(rows) else dark


def body_height(mask: np.ndarray, share: float = BODY) -> int:
    """Rows from the first to the last that have ``share`` of the busiest row's ink."""
    each = mask.sum(axis=1)
    body = np.flatnonzero(each >= share * each.max()) if mask.any() else ()
    return int(body[-1] - body[0]) + 1 if len(body) else 0


def grown(mask: np.ndarray) -> np.ndarray:
    """A shape and the pixels around it, within the same frame."""
    wide = np.pad(mask, 1)
    tall = wide[:-2] | wide[1:-1] | wide[2:]
    return tall[:, :-2] | tall[:, 1:-1] | tall[:, 2:]


def alike(a: np.ndarray, b: np.ndarray) -> float:
    """The shared part of two shapes of one size, both grown by a pixel; 0 if both are blank."""
    a, b = grown(a), grown(b)
    either = int((a | b).sum())
    return int((a & b).sum()) / either if either else 0.0


def _surroundings(gray: np.ndarray, line: Box) -> np.ndarray:
    x0, y0, x1, y1 = line
    return gray[max(0, y0 - ROWS) : y1 + ROWS, max(0, x0 - SIDE) : x1 + SIDE]


MEASURES = f"value string, {BOX}, cut int, paper int, noise double, ink int, shape_cut int, body int, right int, above int, below int"


def measured(pages: DataFrame, keys: list[str], values: str = "values") -> DataFrame:
    """(*keys, value, x0, y0, x1, y1, cut, paper, noise, ink, shape_cut, body, right, above, below): a row for each value of a page.

    ``values`` is an array column of (value, line, run), the last two boxes. The box returned has the run's columns and the rows
    of its own ink; paper, noise and ``cut`` are those of the line's surroundings; ``ink`` and ``shape_cut`` are levels of the
    value itself, ``body`` its height without sparse rows; ``right`` is where other ink begins, ``above`` and ``below`` are blank
    rows. Runs without ink keep the rows of their line and have the ink of ``NO_INK``. Null and empty arrays give no rows.
    """

    def measure(gray: np.ndarray, wanted: object) -> Iterator[tuple]:
        for one in [] if wanted is None else wanted:
            line, run = ((b["x0"], b["y0"], b["x1"], b["y1"]) for b in (one["line"], one["run"]))
            around = levels(_surroundings(gray, line))
            paper = paper_of(around)
            cut = paper - INK
            top, bottom = value_rows(gray, (run[0], line[1], run[2], line[3]), cut)
            box = (run[0], top, run[2], bottom)
            crop = gray[top:bottom, run[0] : run[2]]
            own = levels(crop)
            half = cut_of(own)
            room = free_right(gray, box, cut), free_rows(gray, box, cut, up=True), free_rows(gray, box, cut, up=False)
            yield (one["value"], *box, cut, paper, noise_of(around, paper), ink_of(own, cut), half, body_height(shape(crop, half)), *room)

    return pages_to_rows(pages, keys, measure, MEASURES, [values])


def level_statistics(pages: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, paper, noise, shape_cut, ink) of whole images; an empty image has the values that stand for nothing."""

    def told(gray: np.ndarray) -> Iterator[tuple]:
        counts = levels(gray)
        paper = paper_of(counts)
        yield paper, noise_of(counts, paper), cut_of(counts), ink_of(counts, paper - INK)

    return pages_to_rows(pages, keys, told, "paper int, noise double, shape_cut int, ink int")


#: Draws a text in one of the options, its body so high: the shape stretched to (height, width), and the width that it had before.
Renderer = Callable[[str, str, int, tuple[int, int]], tuple[np.ndarray, int]]


def style_scores(pages: DataFrame, keys: list[str], options: list[str], render: Renderer, samples: str = "samples") -> DataFrame:
    """(*keys, option, place, score): how well each option reproduces each of a page's ``samples``, for ``votes.winner``.

    ``samples`` is an array column of (text, box); ``place`` is the option's. A score is the likeness of the two shapes without
    what the option would have to be stretched. ``render`` is the user's, since drawing letters takes a font library.
    """

    def scored(gray: np.ndarray, wanted: object) -> Iterator[tuple]:
        for one in [] if wanted is None else wanted:
            b = one["box"]
            crop = gray[b["y0"] : b["y1"], b["x0"] : b["x1"]]
            own = shape(crop, cut_of(levels(crop)))
            height, width = own.shape
            for place, option in enumerate(options):
                drawn, before = render(one["text"], option, body_height(own), (height, width))
                yield option, place, alike(own, drawn) - STRETCH * abs(float(np.log(max(1, width) / max(1, before))))

    return pages_to_rows(pages, keys, scored, "option string, place int, score double", [samples])


COLOURS = {"ocr": (220, 30, 30), "ocr+read": (150, 40, 200), "pixels": (230, 140, 0)}


def outlined(pages: DataFrame, keys: list[str], places: str = "places") -> DataFrame:
    """(*keys, width, height, rgb): pages in colour with a frame of two pixels around each place, its colour by ``how`` it was found.

    ``places`` is an array column of (x0, y0, x1, y1, how). Frames include the box's last column and row and are cut at the
    page's edges; what isn't known by name has the colour of ``pixels``. Null and empty arrays leave the page as it is.
    """

    def drawn(gray: np.ndarray, found: object) -> Iterator[tuple]:
        out = np.repeat(gray[:, :, None], 3, axis=2)
        for p in [] if found is None else found:
            x0, y0, x1, y1 = p["x0"], p["y0"], p["x1"] + 1, p["y1"] + 1
            frame = np.zeros(gray.shape, bool)
            frame[max(0, y0) : y1, max(0, x0) : x1] = True
            frame[max(0, y0 + 2) : max(0, y1 - 2), max(0, x0 + 2) : max(0, x1 - 2)] = False
            out[frame] = COLOURS.get(p["how"], COLOURS["pixels"])
        yield gray.shape[1], gray.shape[0], out.tobytes()

    return pages_to_rows(pages, keys, drawn, "width int, height int, rgb binary", [places])
