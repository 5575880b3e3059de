"""Synthetic copies of analysed documents: what changes, what may be shown of it, and what may not.

Analyses are two tables: ``values(*doc, page, pos, owner, type, text)`` and
``places(*doc, page, pos, place, how, printed, words)``, a row for each place a value is printed at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.operators import replace

UNCHANGED = "(unchanged)"


def accepted(values: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """``values`` with the values that a reviewer added, ``more(*keys, owner, type, text)``, after all others of their page.

    What a page has already, by text and type, isn't added again.
    """
    new = more.dropDuplicates([*keys, "type", "text"]).join(values.select(*keys, "type", "text").distinct(), [*keys, "type", "text"], "left_anti")
    last = values.groupBy(*keys).agg(F.max("pos").alias("last"))
    rank = F.row_number().over(replace.Window.partitionBy(*keys).orderBy("type", "text"))
    placed = new.join(last, keys, "left").withColumn("pos", F.coalesce("last", F.lit(-1)) + rank)
    return values.unionByName(placed.select(*values.columns))


def copies(values: DataFrame, places: DataFrame, doc: list[str], n: int, seed: int) -> DataFrame:
    """(*doc, seed, page, pos, owner, type, old, new, located, n_places): every value in each of ``n`` copies.

    What is printed of a value counts as the old text, where it was read; one owner's values change
    alike on all pages of a copy, and seeds follow one another from ``seed`` on.
    """
    keys = [*doc, "page", "pos"]
    printed = replace.printed_text(places, keys)
    counts = places.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_places"))
    own = values.join(printed, keys, "left").join(counts, keys, "left").withColumn("text", F.coalesce("printed", "text")).drop("printed")
    seeds = values.sparkSession.range(seed, seed + n).select(F.col("id").cast("int").alias("seed"))
    changed = replace.changes(own, seeds, doc)
    many = F.coalesce("n_places", F.lit(0))
    return changed.select(*doc, "seed", "page", "pos", "owner", "type", F.col("text").alias("old"), "new", (many > 0).alias("located"), many.alias("n_places"))


def public_key(changed: DataFrame) -> DataFrame:
    """What may be shown of copies: no column holds an old value; a value that couldn't change isn't told either."""
    told = F.when(F.col("new") == F.col("old"), F.lit(UNCHANGED)).otherwise(F.col("new"))
    return changed.withColumn("new", told).drop("old")


def unchanged(changed: DataFrame, doc: list[str]) -> DataFrame:
    """(*doc, seed, page, type): values that no copy could change, which are leaks."""
    return changed.where("new = old").select(*doc, "seed", "page", "type").distinct()


def summary(changed: DataFrame, doc: list[str], leaked: DataFrame) -> DataFrame:
    """(*doc, seed, n_values, n_edited, n_not_located, verdict): one line for each copy; ``leaked(*doc, seed, type)``."""
    edited = F.col("located") & (F.col("new") != F.col("old"))
    counts = changed.groupBy(*doc, "seed").agg(
        F.count(F.lit(1)).alias("n_values"), F.count_if(edited).alias("n_edited"), F.count_if(~F.col("located")).alias("n_not_located")
    )
    types = leaked.groupBy(*doc, "seed").agg(F.array_join(F.array_sort(F.collect_set("type")), ", ").alias("leaks"))
    both = counts.join(types, [*doc, "seed"], "left")
    verdict = F.when(F.col("leaks").isNull(), "leak check passed").otherwise(F.concat(F.lit("leak of "), "leaks"))
    return both.withColumn("verdict", verdict).drop("leaks")


def write(changed: DataFrame, doc: list[str], out: str, private: str) -> None:
    """The public keys to ``out`` and the old values to ``private``, as JSON in a folder for each document and copy.

    Only the folders of the documents and copies that are written are replaced; what stands beside them stays.
    """
    hidden = changed.select(*doc, "seed", "page", "pos", "owner", "type", "old", "new", "located")
    for rows, folder in ((public_key(changed), out), (hidden, private)):
        rows.write.partitionBy(*doc, "seed").mode("overwrite").option("partitionOverwriteMode", "dynamic").json(f"{folder}/keys")


def document_report(values: DataFrame, places: DataFrame, open_: DataFrame, doc: list[str]) -> DataFrame:
    """(*doc, page, values, unconfirmed): pages with their values and the candidates no value covers, as nested rows.

    ``open_(*doc, page, text, entity, score)`` are the unconfirmed candidates.
    """
    keys = [*doc, "page"]
    found = places.select(*keys, "pos").distinct().withColumn("located", F.lit(True))
    rows = values.join(found, [*keys, "pos"], "left").withColumn("located", F.coalesce("located", F.lit(False)))
    told = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "text", "type", "owner", "located"))).alias("values"))
    rest = open_.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("text", "entity", "score"))).alias("unconfirmed"))
    return told.join(rest, keys, "full")
