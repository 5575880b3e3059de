"""Array functions: runs and bands of flags, and order statistics with the formulas of page analysis."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_BAND = "array<struct<start:int,end:int>>"
#: Numbers that are summed in one fold; a fold copies what it has at each step.
_CHUNK = 256


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used: as the element of an array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column) -> Column:
    """The sum up to each number of an array, as longs; none for null.

    Numbers are summed within chunks and then over the chunks, so the time grows little more than the length.
    """
    none = F.array().cast("array<bigint>")

    def sums(v: Column) -> Column:
        return F.aggregate(v, none, lambda out, x: F.concat(out, F.array(F.coalesce(F.try_element_at(out, F.lit(-1)), F.lit(0).cast("bigint")) + x)))

    def joined(v: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(v), F.lit(1)), F.lit(_CHUNK))
        return once(F.transform(starts, lambda i: sums(F.slice(v, i, _CHUNK))), spread)

    def spread(parts: Column) -> Column:
        before = F.concat(F.array(F.lit(0).cast("bigint")), sums(F.transform(parts, lambda p: F.coalesce(F.try_element_at(p, F.lit(-1)), F.lit(0).cast("bigint")))))
        return F.flatten(F.zip_with(parts, F.slice(before, 1, F.size(parts)), lambda p, b: F.transform(p, lambda x: x + b)))

    return once(F.coalesce(values.cast("array<bigint>"), none), joined)


def bands(flags: Column, min_gap: int = 1) -> Column:
    """Runs of true as (start, end), end exclusive; runs with a gap below ``min_gap`` are one."""
    gap = max(min_gap, 1)

    def pairs(at: Column) -> Column:
        # A band begins where the true before is too far away, and ends where the next is.
        begins = F.filter(at, lambda x, i: F.coalesce(x - F.get(at, i - 1) > gap, F.lit(True)))
        ends = F.filter(at, lambda x, i: F.coalesce(F.get(at, i + 1) - x > gap, F.lit(True)))
        return F.zip_with(begins, ends, lambda x, y: F.struct(x.alias("start"), (y + 1).alias("end")))

    places = F.filter(F.transform(flags, lambda f, i: F.when(f, i)), lambda x: x.isNotNull())
    return once(places, pairs).cast(_BAND)


def longest_true_run(flags: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(bands(flags), lambda b: b["end"] - b["start"])), F.lit(0))


def runs(flags: Column) -> Column:
    """Lengths of alternating runs from the first true to the last."""
    text = F.array_join(F.transform(flags, lambda f: F.when(f, "1").otherwise("0")), "")
    trimmed = F.regexp_extract(text, "1(?:.*1)?", 0)
    return F.transform(F.regexp_extract_all(trimmed, F.lit("1+|0+"), F.lit(0)), lambda r: F.length(r))


def paper_level(grays: Column) -> Column:
    """The value at nine tenths of the sorted grays, 255 if there is none."""
    n = F.size(grays)
    at = F.least(n, F.floor(n * 0.9).cast("int") + 1)
    return F.when(n > 0, F.element_at(F.sort_array(grays), F.greatest(at, F.lit(1)))).otherwise(F.lit(255))


def upper_median(values: Column) -> Column:
    """The middle value, of two the higher; null if there is none."""
    return F.get(F.sort_array(values), F.floor(F.size(values) / 2).cast("int"))


def line_height(heights: Column) -> Column:
    """The median of the positive heights, cut to a whole number, at least 4; 12 if there is none."""
    h = F.sort_array(F.filter(heights, lambda x: x > 0))
    n = F.size(h)
    low, high = F.get(h, F.floor((n - 1) / 2).cast("int")), F.get(h, F.floor(n / 2).cast("int"))
    return F.when(n > 0, F.greatest(F.lit(4), ((low + high) / 2).cast("int"))).otherwise(F.lit(12))
