"""Values found in noisy lines of words: a similarity join, blocked before the ratio is computed."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from maskwright.functions import text as T
from maskwright.functions.arrays import running

SCORE = 0.85
CLOSE_DIGITS = 0.75


@F.pandas_udf(DoubleType())
def ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Ratcliff-Obershelp similarity of two texts, as ``difflib`` has it; 0 if either is empty."""
    for a, b in pairs:
        yield pd.Series([difflib.SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(a, b, strict=True)], dtype="float64")


def similarity(a: Column, b: Column) -> Column:
    return ratio(T.norm(a), T.norm(b))


def may_reach(a: Column, b: Column, least: float) -> Column:
    """Whether two normal forms can have a ratio of ``least``.

    The ratio is at most 2 min / (a + b) by their lengths. What it matches is a common subsequence,
    so the edit distance is at most what it leaves over of both: (1 - ratio) (a + b).
    """
    both = F.length(a) + F.length(b)
    shorter = F.least(F.length(a), F.length(b))
    most = F.floor(both * F.lit(1 - least) + 1e-9).cast("int")
    near = F.call_function("levenshtein", a, b, most) >= 0
    return F.when((shorter > 0) & (2.0 * shorter >= least * both), near).otherwise(False)


def _tries(values: DataFrame, lines: DataFrame, keys: list[str], least: float, strict: bool) -> DataFrame:
    """Runs of words, up to two more than the value has, that reach the score and fit by their digits.

    Lines meet the values of their page once, whole; runs are made and dropped within that stage, first by the lengths of their
    normal forms, which running totals give without writing a run out, then by digits and edit distance.
    """
    most = F.greatest(F.size(F.filter(F.split(F.trim(F.col("value")), r"\s+"), lambda w: w != "")), F.lit(1)) + 2
    v = values.select(*keys, "value").distinct()
    v = v.select(*keys, "value", most.alias("most"), T.norm(F.col("value")).alias("nv"), T.digits(F.col("value")).alias("dv"))
    v = v.where("nv <> ''").groupBy(*keys).agg(F.collect_list(F.struct("value", "most", "nv", "dv")).alias("v"))
    # Only lines of pages that have a value are brought to their normal forms.
    own = lines.select(*keys, "line", "words").where(F.size("words") > 0).join(v, keys)
    own = own.withColumn("forms", F.transform("words", T.norm))
    own = own.withColumn("upto", running(F.transform("forms", F.length)))
    tried = own.select(*keys, "line", "words", "forms", "upto", F.inline("v")).withColumn("first", F.explode(F.sequence(F.lit(0), F.size("words") - 1)))
    # How long a normal form can be that reaches the score.
    size, wide = F.length("nv"), F.lit((2 - least) / least)
    begin = F.coalesce(F.get("upto", F.col("first") - 1), F.lit(0))
    ends = F.filter(F.sequence(F.lit(1), F.col("most")), lambda n: (F.get("upto", F.col("first") + n - 1) - begin).between(F.floor(size / wide), F.ceil(size * wide)))
    # Outer, or what is unfolded would be computed for a filter on its size as well.
    both = tried.withColumn("n", F.explode_outer(ends)).where("n is not null").withColumn("nr", F.array_join(F.slice("forms", F.col("first") + 1, F.col("n")), ""))
    if strict:
        # Equal digits, if the value has any.
        both = both.where((F.col("dv") == "") | (T.digits(F.col("nr")) == F.col("dv")))
    both = both.where(may_reach(F.col("nv"), F.col("nr"), least))
    if not strict:
        run = F.array_join(F.slice("words", F.col("first") + 1, F.col("n")), " ")
        both = both.withColumns({"fa": T.folded_digits(F.col("value")), "fb": T.folded_digits(run)}).where("fa = '' or fb <> ''")
        both = both.withColumn("close", F.when(F.col("fa") == "", 1.0).otherwise(ratio("fa", "fb"))).where(F.col("close") >= CLOSE_DIGITS)
    both = both.select(*keys, "value", "line", "first", "n", "nv", "nr").withColumn("score", ratio("nv", "nr")).where(F.col("score") >= least)
    return both.select(*keys, "value", "line", "first", (F.col("first") + F.col("n") - 1).alias("last"), "score")


def find_value(values: DataFrame, lines: DataFrame, keys: list[str], least: float = SCORE, strict: bool = True) -> DataFrame:
    """The best run for each value on each page: the highest score, then fewest words, then the first."""
    found = _tries(values, lines, keys, least, strict)
    order = Window.partitionBy(*keys, "value").orderBy(F.desc("score"), F.col("last") - F.col("first"), "line", "first")
    return found.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def find_all(values: DataFrame, lines: DataFrame, keys: list[str], least: float = SCORE, strict: bool = True) -> DataFrame:
    """All places of each value: per line the best runs that don't overlap."""
    found = _tries(values, lines, keys, least, strict)
    run = F.struct((-F.col("score")).alias("s"), (F.col("last") - F.col("first")).alias("n"), "first", "last")
    listed = found.groupBy(*keys, "value", "line").agg(F.array_sort(F.collect_list(run)).alias("runs"))
    none = F.filter("runs", lambda r: F.lit(False))
    free = lambda kept, r: ~F.exists(kept, lambda k: (k["first"] <= r["last"]) & (r["first"] <= k["last"]))
    kept = F.aggregate("runs", none, lambda k, r: F.when(free(k, r), F.concat(k, F.array(r))).otherwise(k))
    rows = listed.select(*keys, "value", "line", F.explode(kept).alias("r"))
    return rows.select(*keys, "value", "line", "r.first", "r.last", (-F.col("r.s")).alias("score"))


def _windows(reading: Column, value: Column) -> Column:
    n = F.length(value)
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(reading) - n + 1, F.lit(1))), lambda i: F.substring(reading, i, n))


def contains(pairs: DataFrame, keys: list[str], least: float = SCORE) -> DataFrame:
    """``pairs(*keys, reading, value)`` with ``contained``: whether the value stands in the reading, slips allowed.

    Keys name a row. Only pairs that no native test settles are handed to the ratio.
    """
    nr, nv = T.norm(F.col("reading")), T.norm(F.col("value"))
    own = pairs.withColumns({"nr": nr, "nv": nv})
    sure = (F.col("nv") == "") | F.contains("nr", F.col("nv"))
    settled = own.where(sure).withColumn("contained", F.col("nv") != "")
    tried = own.where(~sure).withColumn("w", F.explode(F.when(F.length("nr") < F.length("nv"), F.array("nr")).otherwise(_windows(F.col("nr"), F.col("nv")))))
    scores = tried.withColumn("score", ratio("w", "nv")).groupBy(*keys).agg(F.max("score").alias("score"))
    rest = own.where(~sure).join(scores, keys).withColumn("contained", F.col("score") >= least)
    return settled.unionByName(rest.drop("score")).drop("nr", "nv")
