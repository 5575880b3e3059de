"""Work is dealt out whatever the size of a table's file, and what a function of elements mentions is computed once."""

import pytest
from pyspark.sql import functions as F

from maskwright.functions import barcode
from maskwright.functions import text as T
from maskwright.plans import registry



def written(spark, column):
    """How often a plan that is analyzed says reverse(s)."""
    df = spark.createDataFrame([("0123",)], "s string").select(column(F.reverse("s")).alias("x"))
    return df._jdf.queryExecution().analyzed().toString().count("reverse(")


def test_characters_compute_their_text_once(spark):
    assert written(spark, T.characters) == 1


def test_barcodes_are_read_from_widths_computed_once(spark):
    assert written(spark, lambda s: barcode.decode(T.characters(s).cast("array<int>"))) == 1


def test_barcodes_are_dealt_out(spark, sf_dir):
    assert registry.queries()["barcodes"](spark, sf_dir).rdd.getNumPartitions() > 8


def test_erased_pages_are_dealt_out_and_drawn_once(spark, sf_dir):
    done = registry.queries()["values_erased"](spark, sf_dir)
    assert done.rdd.getNumPartitions() > 8 and "Join" not in done._jdf.queryExecution().optimizedPlan().toString()


def test_redrawn_barcodes_are_dealt_out_and_drawn_once(spark, sf_dir):
    done = registry.queries()["barcodes_redrawn"](spark, sf_dir)
    assert done.rdd.getNumPartitions() > 8 and "Join" not in done._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["places_by_pixels", "ink_measures", "ink_lines", "same_shapes"])
def test_rows_of_parts_are_dealt_out_before_pages_are_drawn(spark, sf_dir, name, monkeypatch):
    seen = []
    keep = registry.dealt
    monkeypatch.setattr(registry, "dealt", lambda *a: seen.append(a[2:]) or keep(*a))
    registry.queries()[name](spark, sf_dir)
    assert seen == [("part", "p_partkey")]


def test_raw_pages_are_dealt_out_before_their_layers_are_made(spark, sf_dir):
    assert registry.queries()["text_layers"](spark, sf_dir).rdd.getNumPartitions() > 8
