"""Leaks and values in lines: pages meet their values once, and only pages that have some are brought to normal forms."""

from pyspark.sql import functions as F

from maskwright.functions import text as T
from maskwright.operators import leak, matching


def _below_join(df):
    """The optimized plan below its first join."""
    lines = df._jdf.queryExecution().optimizedPlan().toString().split("\n")
    at = next(i for i, line in enumerate(lines) if "Join Inner" in line)
    return "\n".join(lines[at + 1 :])


def test_leaks_of_pages(spark):
    pages = spark.createDataFrame([(1, "Anna Berg, 12345678", ""), (1, "the Meier page", "MEIER"), (2, "Karl", ""), (3, None, "")], "page int, text string, context string")
    old = spark.createDataFrame([(1, "person", "Anna Meier"), (1, "id", "1234-5678"), (1, "person", "Karl"), (2, "city", "Karl"), (3, "person", "Karl"), (2, "person", None)], "page int, type string, text string")
    found = leak.leaks(pages, old, ["page"])
    assert "regexp_replace" not in _below_join(found)
    rows = sorted((r.page, r.type, r.text, r.pieces) for r in found.collect())
    assert rows == [(1, "id", "1234-5678", ["12345678"]), (1, "person", "Anna Meier", ["ANNA", "MEIER"]), (2, "city", "Karl", ["KARL"])]


def test_plain_words_are_their_only_part(spark):
    own = spark.createDataFrame([("Anna",), ("Ann",), ("Anna\n",), ("anna berg",), ("Anna1",), (None,)], "t string")
    told = own.select(T.pieces(F.col("t"), F.lit("person")).alias("p"))
    assert [r.p for r in told.collect()] == [["ANNA"], [], ["ANNA"], ["ANNA", "ANNABERG", "BERG"], ["ANNA", "ANNA1"], None]


def test_lines_of_pages_without_values_have_no_forms(spark):
    lines = spark.createDataFrame([(1, 0, ["Anna", "Berg"]), (2, 0, ["Anna", "Berg"])], "page int, line int, words array<string>")
    values = spark.createDataFrame([(1, "Anna Berg"), (1, "--")], "page int, value string")
    found = matching.find_all(values, lines, ["page"])
    below = _below_join(found).split("words#")
    assert all("lambdafunction(regexp_replace(upper(" not in part for part in below)
    assert [(r.page, r.value, r.line, r["first"], r["last"]) for r in found.collect()] == [(1, "Anna Berg", 0, 0, 1)]


def test_crowded_pages_are_joined_and_told_the_same(spark, monkeypatch):
    text = "Anna Berg 12 34-56 78 tel 4711, 99 A123456 Meier 4 7 1 2 and 1234"
    pages = spark.createDataFrame([(1, text, "Berg"), (1, "Karl 5555 Berg", "")], "page int, text string, context string")
    words = ["Anna Berg", "12345678", "345678", "2345", "4711", "4712", "1234", "123456", "5555", "Karl Meier", "Otto", "47 11", "A123456", "nna"]
    old = spark.createDataFrame([(1, t, w) for t in ("person", "id", "city") for w in words], "page int, type string, text string")
    new = spark.createDataFrame([(1, "Karlsson")], "page int, new string")
    told = lambda: sorted((r.type, r.text, r.pieces) for r in leak.leaks(pages, old, ["page"], new, crowded=True).collect())
    searched = told()
    monkeypatch.setattr(leak, "MANY", 0)
    assert told() == searched and len(searched) > 20
