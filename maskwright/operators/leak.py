"""Whether anything of the original values is still on a finished page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions import text as T
from maskwright.functions.arrays import once


#: Values of a page up to which it is searched for each of their pieces.
MANY = 200


def _joined(met: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, type, text, pieces) of ``met(*keys, __pages, __fresh, __old)``, by joining pieces to all that stands on a page in their lengths."""
    number = lambda piece: piece.rlike("^[0-9]+$")
    parts = met.select(*keys, F.inline("__old")).withColumn("piece", F.explode_outer(T.pieces(F.col("text"), F.col("type")))).where("piece is not null")
    parts = parts.withColumn("number", number(F.col("piece")))
    sizes = parts.select(*keys, "number", F.length("piece").alias("size")).distinct()
    pages = met.select(*keys, "__fresh", F.posexplode(F.sort_array("__pages")).alias("__n", "p")).where("p.text is not null")
    pages = pages.select(*keys, "__n", "__fresh", T.norm(F.col("p.text")).alias("norm"), T.number_line(F.col("p.text")).alias("numbers"), T.norm(F.col("p.context")).alias("shared"))
    here = F.explode_outer(F.array_distinct(T.windows(F.col("number"), F.col("size"), F.col("norm"), F.col("numbers"))))
    held = pages.join(sizes, keys).select(*keys, "__n", "number", here.alias("piece")).where("piece is not null")
    # Pieces of an alphabet of two kinds can be equal, so the kind is part of the key.
    found = parts.join(held, [*keys, "number", "piece"]).join(pages.select(*keys, "__n", "__fresh", "shared"), [*keys, "__n"])
    excused = F.col("type").isin(*T.PLACE_TYPES) & F.contains("shared", "piece")
    found = found.where(~F.exists("__fresh", lambda n: F.contains(n, F.col("piece"))) & ~excused)
    return found.groupBy(*keys, "type", "text").agg(F.array_sort(F.collect_set("piece")).alias("pieces"))


def leaks(pages: DataFrame, old: DataFrame, keys: list[str], new: DataFrame | None = None, unchanged: bool = False, crowded: bool = False) -> DataFrame:
    """(*keys, type, text, pieces): the old values of which pieces are found on their page.

    ``pages(*keys, text, context)``, ``old(*keys, type, text)``, ``new(*keys, new)``. Pieces within a
    new value are meant to be there; pieces of a city or street that the context holds are excused.
    With ``unchanged``, values that are among the new ones themselves leak as a whole. With ``crowded``, pages of more
    than ``MANY`` values are not searched once for each piece: pieces are joined to what stands on the page, at the price of
    planning what is given twice.
    """
    none = F.array().cast("array<string>")
    seen = pages.groupBy(*keys).agg(F.collect_set(F.struct("text", "context")).alias("__pages"))
    if new is not None:
        listed = new.groupBy(*keys).agg(F.collect_set(T.norm(F.col("new"))).alias("__fresh"))
        seen = seen.join(listed, keys, "left").withColumn("__fresh", F.coalesce("__fresh", none))
    else:
        seen = seen.withColumn("__fresh", none)
    # A page meets its values once, and only pages that have some are brought to their normal forms.
    values = old.groupBy(*keys).agg(F.collect_set(F.struct("type", "text")).alias("__old"))

    def normal(p: Column) -> Column:
        numbers = F.when(F.exists("__old", lambda v: v["text"].rlike("[0-9]")), T.number_line(p["text"]))
        return F.struct(T.norm(p["text"]).alias("norm"), numbers.alias("numbers"), T.norm(p["context"]).alias("shared"))

    def left(p: Column, v: Column) -> Column:
        excused = lambda piece: v["type"].isin(*T.PLACE_TYPES) & F.contains(p["shared"], piece)
        meant = lambda piece: F.exists("__fresh", lambda n: F.contains(n, piece))
        return F.filter(T.pieces(v["text"], v["type"]), lambda piece: T.on_page(piece, p["norm"], p["numbers"]) & ~meant(piece) & ~excused(piece))

    def told(ps: Column) -> Column:
        pieces = lambda v: F.sort_array(F.array_distinct(F.flatten(F.transform(ps, lambda p: left(p, v)))))
        return F.transform("__old", lambda v: F.struct(v["type"].alias("type"), v["text"].alias("text"), pieces(v).alias("pieces")))

    # Outer, or what is unfolded would be computed for a filter on its size as well.
    met = seen.join(values, keys)
    few = met.where(F.size("__old") <= MANY) if crowded else met
    both = few.select(*keys, F.inline_outer(once(F.transform("__pages", normal), told)))
    found = both.where(F.size("pieces") > 0).select(*keys, "type", "text", "pieces")
    if crowded:
        found = found.union(_joined(met.where(F.size("__old") > MANY), keys))
    if not unchanged or new is None:
        return found
    same = old.select(*keys, "type", "text").distinct().join(new.select(*keys, F.col("new").alias("text")).distinct(), [*keys, "text"], "left_semi")
    found = found.union(same.select(*keys, "type", "text", F.array(T.norm(F.col("text"))).alias("pieces")))
    return found.groupBy(*keys, "type", "text").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("pieces")))).alias("pieces"))


def verdicts(pages: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, passed, leaked_types): public, since it names types and no values."""
    told = found.groupBy(*keys).agg(F.array_sort(F.collect_set("type")).alias("leaked_types"))
    both = pages.select(*keys).distinct().join(told, keys, "left")
    none = F.array().cast("array<string>")
    return both.select(*keys, F.col("leaked_types").isNull().alias("passed"), F.coalesce("leaked_types", none).alias("leaked_types"))
