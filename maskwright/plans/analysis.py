"""Analyses of pages in a cache that grows: only pages that are new or changed are read and located.

``pages(*keys, lines)`` hold ``lines`` as an array of (line, words, word_boxes, box); with ``width``, ``height``, ``gray`` and
``line_height`` a reader may look for values in their ink. The cache is a private Parquet folder to which runs append: a row is a
version of a page's analysis under the hash of what it was made from, and the latest version stands. Nothing is rewritten, so a run
that ends early leaves what was there. One writer at a time may work on a page. Keys must not be null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from maskwright.functions import arrays as A
from maskwright.functions import boxes as B
from maskwright.functions import text as T
from maskwright.operators import candidates, location, reading

BOX = "struct<x0:int,y0:int,x1:int,y1:int>"
LINES = f"array<struct<line:int,words:array<string>,word_boxes:array<{BOX}>,box:{BOX}>>"
VALUES = f"array<struct<pos:int,owner:string,type:string,text:string,hint:{BOX}>>"
PLACES = (
    f"array<struct<pos:int,place:int,how:string,printed:string,before:string,after:string,words:struct<first:int,last:int>,line_box:{BOX},run_box:{BOX},next_x:int>>"
)
IMAGE = ("width", "height", "gray", "line_height")
#: Takes pages, gives (*keys, pos, owner, type, text), with ``hint`` (a box) where it has one.
Finder = Callable[[DataFrame], DataFrame]


def by_rules(keys: list[str]) -> Finder:
    """Finds what the recognizers know, the first of each text on a page; a value's owner is its entity."""

    def find(pages: DataFrame) -> DataFrame:
        text = F.array_join(F.transform("lines", lambda x: F.array_join(x["words"], " ")), "\n")
        found = candidates.find(pages.select(*keys, text.alias("text")), keys)
        first = F.row_number().over(Window.partitionBy(*keys, "text").orderBy("pos"))
        rows = found.withColumn("__n", first).where("__n = 1")
        return rows.select(*keys, F.col("pos").cast("int").alias("pos"), F.col("entity").alias("owner"), candidates.value_type(F.col("entity")).alias("type"), "text")

    return find


def content_of(pages: DataFrame, options: str = "") -> Column:
    """A hash of what a page's analysis is made from: its lines, its pixels if it has any, and the options."""
    lines = F.to_json(F.struct("lines"), {"ignoreNullFields": "false"})
    parts = [F.sha2(lines, 256), F.sha2(F.lit(options), 256)]
    parts += [F.coalesce(F.sha2(F.col(c).cast("string") if c != "gray" else F.col(c), 256), F.lit("-")) for c in IMAGE if c in pages.columns]
    return F.sha2(F.concat(*parts), 256)


def latest(spark: SparkSession, cache: str, schema: StructType, keys: list[str]) -> DataFrame:
    """(*keys, content, version, values, places): the last analysis of each page in the cache, none if there is no cache yet."""
    own = ", ".join(f"`{k}` {schema[k].dataType.simpleString()}" for k in keys)
    all_ = f"{own}, content string, version int, values {VALUES}, places {PLACES}"
    try:
        rows = spark.read.schema(all_).parquet(cache)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], all_)
    last = F.max_by(F.struct("content", "version", "values", "places"), "version").alias("last")
    return rows.groupBy(*keys).agg(last).select(*keys, "last.*")


def located(values: DataFrame, pages: DataFrame, keys: list[str], line_height: int = 12, reader: reading.Reader | None = None) -> DataFrame:
    """(*keys, pos, place, how, printed, before, after, words, line_box, run_box, next_x): where values are printed.

    Of equal texts on a page the first has the places. ``words`` are the value's words that one part of a wrapped value prints, null
    for whole ones; ``before`` and ``after`` are punctuation around it, ``next_x`` where the next word of its line begins.
    """
    hint = F.min_by("hint", "pos") if "hint" in values.columns else F.lit(None).cast(BOX)
    texts = values.where("text is not null").groupBy(*keys, F.col("text").alias("value")).agg(F.min("pos").alias("pos"), hint.alias("hint"))
    lines = pages.select(*keys, F.inline("lines"))
    seen = reader is not None and set(IMAGE) <= set(pages.columns)
    found = location.locate(texts, lines, keys, line_height, pages.select(*keys, *IMAGE) if seen else None, reader if seen else None)
    both = found.withColumnRenamed("box", "run_box").join(lines.withColumnRenamed("box", "line_box"), [*keys, "line"], "left").join(texts.select(*keys, "value", "pos"), [*keys, "value"])
    size = F.col("last") - F.col("first") + 1
    # Pixels say where a value is, not how its line is written.
    raw = F.when(F.col("line").isNotNull(), F.array_join(F.slice("words", F.col("first") + 1, size), " "))
    both = both.withColumn("raw", raw).withColumn("bare", T.strip_edges(F.col("raw")))
    edge = F.lit(T.EDGE_PUNCTUATION)
    before = F.substring("raw", F.lit(1), F.length("raw") - F.length(F.ltrim("raw", edge)))
    after = F.substring("raw", F.length(F.rtrim("raw", edge)) + 1, F.length("raw"))
    whole = F.coalesce(T.norm(F.col("bare")) == T.norm(F.col("value")), F.lit(True)) | (F.col("bare") == "")
    end = F.sum(size).over(Window.partitionBy(*keys, "pos", "how").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    part = F.when(F.col("how") == "wrapped", F.struct((end - size).cast("int").alias("first"), end.cast("int").alias("last")))
    order = Window.partitionBy(*keys, "pos").orderBy(F.col("line").asc_nulls_last(), "first", "last")
    return both.select(
        *keys, "pos", (F.row_number().over(order) - 1).alias("place"), "how",
        F.when(whole & (F.col("how") != "wrapped"), F.col("value")).otherwise(F.col("bare")).alias("printed"),
        F.coalesce(before, F.lit("")).alias("before"), F.coalesce(F.when(F.col("bare") != "", after), F.lit("")).alias("after"),
        part.alias("words"), F.coalesce("line_box", "run_box").alias("line_box"), "run_box", F.get("word_boxes", F.col("last") + 1)["x0"].cast("int").alias("next_x"),
    )


def _nested(rows: DataFrame, keys: list[str], name: str, shape: str) -> DataFrame:
    names = StructType.fromDDL(f"x {shape}")["x"].dataType.elementType.names
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*names))).cast(shape).alias(name))


def _gathered(pages: DataFrame, values: DataFrame, places: DataFrame, keys: list[str]) -> DataFrame:
    """``pages(*keys, ...)`` with ``values`` and ``places``, empty where a page has none."""
    out = pages.join(_nested(values, keys, "values", VALUES), keys, "left").join(_nested(places, keys, "places", PLACES), keys, "left")
    return out.withColumns({"values": F.coalesce("values", F.array().cast(VALUES)), "places": F.coalesce("places", F.array().cast(PLACES))})


def _hinted(values: DataFrame) -> DataFrame:
    return values if "hint" in values.columns else values.withColumn("hint", F.lit(None).cast(BOX))


def analysed(pages: DataFrame, keys: list[str], find: Finder, cache: str, options: str = "", line_height: int = 12, reader: reading.Reader | None = None) -> DataFrame:
    """(*keys, content, version, values, places) of ``pages``, one row each: out of the cache, or made now and put there.

    ``find`` and ``reader`` see only pages that the cache doesn't hold with the same content and ``options`` (a name for what they do).
    A page without values is kept with empty arrays, so it isn't read again; repeated keys are an error of the caller.
    """
    spark = pages.sparkSession
    own = pages.withColumn("content", content_of(pages, options))
    known = latest(spark, cache, pages.schema, keys).select(*keys, F.col("content").alias("__content"), F.col("version").alias("__version"))
    fresh = reading.once(own.join(known, keys, "left").where(~F.col("content").eqNullSafe(F.col("__content"))).drop("__content"))
    if not fresh.isEmpty():
        asked = fresh.drop("content", "__version")
        values = reading.once(_hinted(find(asked)))
        places = located(values, asked, keys, line_height, reader)
        head = fresh.select(*keys, "content", (F.coalesce("__version", F.lit(0)) + 1).cast("int").alias("version"))
        _gathered(head, values, places, keys).write.mode("append").parquet(cache)
    return latest(spark, cache, pages.schema, keys).join(own.select(*keys, "content"), [*keys, "content"], "left_semi")


def values_of(analyses: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, pos, owner, type, text, hint), a row for each value."""
    return analyses.select(*keys, F.inline("values"))


def places_of(analyses: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, pos, place, how, printed, ...), a row for each place."""
    return analyses.select(*keys, F.inline("places"))


def accept(pages: DataFrame, more: DataFrame, keys: list[str], cache: str, options: str = "", line_height: int = 12, reader: reading.Reader | None = None) -> DataFrame:
    """(*keys, owner, type, text, located, error): values that a reviewer adds, ``more(*keys, owner, type, text)``, and what came of each.

    Only the pages of ``more`` are located, and on them only the new values; a value that is printed nowhere is kept, so a leak
    check still looks for it. A type that no value has, a blank text and a page that isn't analysed are errors and change nothing; what a
    page has already, by text and type, isn't added again. Repeated rows count once.
    """
    spark = pages.sparkSession
    more = more.select(*keys, "owner", "type", "text").dropDuplicates([*keys, "type", "text"])
    touched = pages.join(more.select(*keys).distinct(), keys, "left_semi")
    touched = touched.withColumn("content", content_of(touched, options))
    before = latest(spark, cache, pages.schema, keys).join(touched.select(*keys, "content"), [*keys, "content"], "left_semi")
    before = reading.once(before)
    there = before.select(*keys, F.lit(True).alias("__there"))
    error = (
        F.when(~F.coalesce(F.col("type").isin(*T.VALUE_TYPES), F.lit(False)), F.concat(F.lit("no type of values: "), F.coalesce("type", F.lit("null"))))
        .when(F.coalesce(F.trim("text"), F.lit("")) == "", "no text")
        .when(F.col("__there").isNull(), "page not analysed")
    )
    asked = reading.once(more.join(there, keys, "left").withColumn("error", error).drop("__there"))
    has = values_of(before, keys).select(*keys, "type", "text").distinct()
    new = asked.where("error is null").join(has, [*keys, "type", "text"], "left_anti")
    last = before.select(*keys, F.coalesce(F.array_max(F.transform("values", lambda v: v["pos"])), F.lit(-1)).alias("__last"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("type", "text"))
    new = reading.once(_hinted(new.join(last, keys).withColumn("pos", (F.col("__last") + rank).cast("int")).drop("__last", "error")))
    if not new.isEmpty():
        places = located(new, touched.drop("content"), keys, line_height, reader)
        head = before.join(new.select(*keys).distinct(), keys, "left_semi")
        head = head.select(*keys, "content", (F.col("version") + 1).alias("version"), F.col("values").alias("__v"), F.col("places").alias("__p"))
        grown = _gathered(head, new, places, keys)
        grown = grown.withColumns({"values": F.concat("__v", "values"), "places": F.concat("__p", "places")}).drop("__v", "__p")
        grown.write.mode("append").parquet(cache)
    now = latest(spark, cache, pages.schema, keys).join(touched.select(*keys, "content"), [*keys, "content"], "left_semi")
    spots = places_of(now, keys).select(*keys, "pos").distinct()
    found = values_of(now, keys).join(spots, [*keys, "pos"], "left_semi").select(*keys, "type", "text").distinct().withColumn("located", F.lit(True))
    told = asked.join(found, [*keys, "type", "text"], "left")
    yes = F.when(F.col("error").isNull(), F.coalesce("located", F.lit(False)))
    return told.select(*keys, "owner", "type", "text", yes.alias("located"), "error")


# -- the analysis of a page as JSON ---------------------------------------------------------------

# The fixed form: values in order, and for each the list of its places.
_JSON = (
    "struct<values:array<struct<text:string,type:string,owner:string,hint:array<int>>>,"
    "located:array<array<struct<line_box:array<int>,run_box:array<int>,next_x:int,how:string,printed:string,words:array<int>,before:string,after:string>>>>"
)


def _sides(b: Column) -> Column:
    return F.when(b.isNotNull(), F.array(*[b[n] for n in B.SIDES]))


def to_text(values: Column, places: Column) -> Column:
    """A page's analysis as JSON, values by their place in order, boxes as lists of four numbers."""

    def place(p: Column) -> Column:
        words = F.when(p["words"].isNotNull(), F.array(p["words"]["first"], p["words"]["last"]))
        plain = [p[n].alias(n) for n in ("how", "printed", "before", "after", "next_x")]
        return F.struct(_sides(p["line_box"]).alias("line_box"), _sides(p["run_box"]).alias("run_box"), words.alias("words"), *plain)

    ordered = F.array_sort(values)
    told = F.transform(ordered, lambda v: F.struct(v["text"].alias("text"), v["type"].alias("type"), v["owner"].alias("owner"), _sides(v["hint"]).alias("hint")))
    spots = F.transform(ordered, lambda v: F.transform(F.filter(F.array_sort(places), lambda p: p["pos"] == v["pos"]), place))
    return F.to_json(F.struct(told.alias("values"), spots.alias("located")), {"ignoreNullFields": "false"})


def from_text(text: Column) -> Column:
    """(values, places) of :func:`to_text`; null for null, and an error that names what is wrong for anything else than its form.

    A value without a hint has none; a scalar where a string belongs is read as its text.
    """
    wrong_box = lambda b: b.isNull() | (F.size(b) != 4) | F.exists(b, lambda n: n.isNull())
    lost = lambda x, *names: F.exists(F.array(*[x[n] for n in names]), lambda s: s.isNull())
    any_place = lambda d, f: F.coalesce(F.exists(F.flatten(d["located"]), lambda p: F.coalesce(f(p), F.lit(False))), F.lit(False))
    any_value = lambda d, f: F.coalesce(F.exists(d["values"], lambda v: F.coalesce(f(v), F.lit(False))), F.lit(False))

    def checked(d: Column) -> Column:
        values = F.transform(d["values"], lambda v, i: F.struct(i.alias("pos"), v["owner"].alias("owner"), v["type"].alias("type"), v["text"].alias("text"), _box(v["hint"]).alias("hint")))

        def place(p: Column, i: Column, k: Column) -> Column:
            words = F.when(p["words"].isNotNull(), F.struct(p["words"][0].alias("first"), p["words"][1].alias("last")))
            written = [F.coalesce(p[n], F.lit("")).alias(n) for n in ("before", "after")]
            boxes = [_box(p[n]).alias(n) for n in ("line_box", "run_box")]
            return F.struct(i.alias("pos"), k.alias("place"), p["how"].alias("how"), p["printed"].alias("printed"), *written, words.alias("words"), *boxes, p["next_x"].alias("next_x"))

        places = F.flatten(F.transform(d["located"], lambda ps, i: F.transform(ps, lambda p, k: place(p, i, k))))
        error = (
            F.when(d.isNull() | d["values"].isNull() | d["located"].isNull() | F.coalesce(F.exists(d["located"], lambda x: x.isNull()), F.lit(False)), "malformed analysis")
            .when(F.size(d["values"]) != F.size(d["located"]), "not a list of places for each value")
            .when(any_value(d, lambda v: v.isNull() | lost(v, "text", "type", "owner")) | any_place(d, lambda p: p.isNull() | lost(p, "how", "printed")), "not a string")
            .when(any_value(d, lambda v: v["hint"].isNotNull() & wrong_box(v["hint"])) | any_place(d, lambda p: wrong_box(p["line_box"]) | wrong_box(p["run_box"])), "not a box")
            .when(any_place(d, lambda p: p["words"].isNotNull() & ((F.size(p["words"]) != 2) | F.exists(p["words"], lambda n: n.isNull()))), "not a word span")
        )
        whole = F.struct(values.cast(VALUES).alias("values"), places.cast(PLACES).alias("places"))
        return F.when(error.isNotNull(), F.raise_error(error).cast(f"struct<values:{VALUES},places:{PLACES}>")).otherwise(whole)

    read = F.from_json(text, _JSON, {"mode": "FAILFAST"})
    return F.when(text.isNotNull(), A.once(read, checked))


def _box(b: Column) -> Column:
    return F.when(b.isNotNull(), F.struct(*[F.get(b, F.lit(i)).alias(n) for i, n in enumerate(B.SIDES)]))
