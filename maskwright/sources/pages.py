"""Sources of page text: recognizer tables, text layers, image listings, image files and caches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from maskwright.functions import boxes as B
from maskwright.functions.arrays import once

# What readers make of cell borders, and the suffixes that are read as images.
JUNK = "|[]\\{}"
IMAGE_SUFFIXES = ("png", "jpg", "jpeg", "tif", "tiff", "webp", "bmp")
TSV = StructType(
    [StructField(n, IntegerType()) for n in ("level", "page_num", "block_num", "par_num", "line_num", "word_num", "left", "top", "width", "height")]
    + [StructField("conf", StringType()), StructField("text", StringType())]
)


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """A recognizer's table of words: tab-separated, with a header and no quoting."""
    return spark.read.schema(TSV).csv(path, sep="\t", header=True, quote="", mode="PERMISSIVE").withColumn("path", F.input_file_name())


def words(table: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, block, par, line, text, box): words cut at ``|``, which share the box by their characters."""
    bare = F.trim(F.coalesce("text", F.lit("")))
    rows = table.withColumn("text", bare).where("text <> ''")
    rows = rows.withColumn("n", F.length("text")).select("*", F.posexplode(F.split("text", r"\|")).alias("k", "part"))
    before = F.aggregate(F.slice(F.split("text", r"\|"), 1, F.col("k")), F.lit(0), lambda a, p: a + F.length(p) + 1)
    rows = rows.withColumn("at", before).withColumn("clean", F.btrim("part", F.lit(JUNK))).where("clean <> ''")
    share = lambda at: F.col("left") + F.floor(F.col("width") * at / F.col("n"))
    return rows.select(
        *keys,
        F.col("block_num").alias("block"),
        F.col("par_num").alias("par"),
        F.col("line_num").alias("row"),
        F.col("clean").alias("text"),
        B.box(share(F.col("at")), F.col("top"), share(F.col("at") + F.length("part")), F.col("top") + F.col("height")).alias("box"),
    )


def group_lines(found: DataFrame, keys: list[str], gap_factor: float = 3.0) -> DataFrame:
    """(*keys, line, words, word_boxes, box): rows of words, cut at wide gaps, from the top to the bottom."""
    row = [*keys, "block", "par", "row"]
    order = Window.partitionBy(*row).orderBy("box.x0", "box.x1", "text")
    whole = Window.partitionBy(*row)
    tall = F.sort_array(F.collect_list(F.col("box.y1") - F.col("box.y0")).over(whole))
    height = F.greatest(F.lit(1), F.get(tall, F.floor(F.size(tall) / 2).cast("int")))
    # Dealt out by page once; rows, lines and their order all are within a page.
    found = found.repartition(*keys)
    cut = F.col("box.x0") - F.lag("box.x1").over(order) > gap_factor * height
    own = found.withColumn("cut", F.coalesce(cut, F.lit(False)).cast("int"))
    own = own.withColumn("part", F.sum("cut").over(order))
    word = F.struct(F.col("box.x0").alias("x"), F.col("box.x1").alias("x1"), "text", "box")
    lines = own.groupBy(*row, "part").agg(
        F.array_sort(F.collect_list(word)).alias("w"),
        B.box(F.min("box.x0"), F.min("box.y0"), F.max("box.x1"), F.max("box.y1")).alias("box"),
    )
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("box.y0", "box.x0", "block", "par", "row", "part")) - 1
    return lines.select(
        *keys, place.alias("line"), F.transform("w", lambda x: x["text"]).alias("words"), F.transform("w", lambda x: x["box"]).alias("word_boxes"), "box"
    )


def text_layer(layers: DataFrame, keys: list[str], xml: str = "xml", scale: float = 150 / 72) -> DataFrame:
    """(*keys, page, line, words, word_boxes, box) of a PDF's text layer, as word boxes in XHTML.

    Boxes go from points to pixels; empty words and lines without words are left out.
    """
    flat = F.regexp_replace(xml, r"[\r\n]+", " ")
    parts = lambda text, name: F.regexp_extract_all(text, F.lit(rf"(?s)<{name}\b.*?</{name}>"), F.lit(0))

    def word(w: Column) -> Column:
        number = lambda name: F.regexp_extract(w, f'{name}="([0-9.eE+-]+)"', 1).cast("double")
        text = F.regexp_extract(w, "(?s)>(.*)</word>", 1)
        for written, meant in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
            text = F.replace(text, F.lit(written), F.lit(meant))
        return F.struct(F.trim(text).alias("text"), B.scaled(number("xMin"), number("yMin"), number("xMax"), number("yMax"), scale).alias("box"))

    def line(told: Column, place: Column) -> Column:
        found = F.filter(F.transform(parts(told, "word"), word), lambda w: w["text"] != "")
        side = lambda words, name, pick: pick(F.transform(words, lambda w: w["box"][name])).alias(name)
        edges = (("y0", F.array_min), ("x0", F.array_min), ("x1", F.array_max), ("y1", F.array_max))
        # In order of the upper left corner, then as they are written.
        return once(found, lambda w: F.struct(*[side(w, *e) for e in edges[:2]], place.alias("l"), *[side(w, *e) for e in edges[2:]], w.alias("w")))

    # A page is one row from its text to its lines, so nothing is shuffled.
    pages = layers.select(*keys, F.posexplode(parts(flat, "page")).alias("p", "page_xml"))
    lines = F.array_sort(F.filter(F.transform(parts(F.col("page_xml"), "line"), line), lambda x: F.size(x["w"]) > 0))
    rows = pages.select(*keys, (F.col("p") + 1).alias("page"), F.posexplode(lines).alias("line", "t"))
    texts = F.transform("t.w", lambda x: x["text"]).alias("words")
    boxes = F.transform("t.w", lambda x: x["box"]).alias("word_boxes")
    return rows.select(*keys, "page", "line", texts, boxes, B.box(*[F.col(f"t.{x}") for x in B.SIDES]).alias("box"))


def scanned_pages(listings: DataFrame, keys: list[str], listing: str = "listing") -> DataFrame:
    """(*keys, page): pages with exactly one row of type ``image`` in a listing with two header rows."""
    rows = listings.select(*keys, F.posexplode(F.split(listing, r"\r?\n")).alias("n", "row")).where("n >= 2")
    parts = F.split(F.trim(F.col("row")), r"\s+")
    rows = rows.select(*keys, F.get(parts, F.lit(0)).alias("page"), F.get(parts, F.lit(2)).alias("kind"))
    rows = rows.where("page rlike '^[0-9]+$' and kind = 'image'").withColumn("page", F.col("page").cast("int"))
    return rows.groupBy(*keys, "page").agg(F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")


def page_text(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, text): words joined by spaces and lines by line feeds, in order."""
    line = F.struct("line", F.array_join("words", " ").alias("t"))
    listed = lines.groupBy(*keys).agg(F.array_sort(F.collect_list(line)).alias("l"))
    return listed.select(*keys, F.array_join(F.transform("l", lambda x: x["t"]), "\n").alias("text"))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, stem, page, kind, image) of image files; other files are rows with an ``error``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    known = suffix.isin(*IMAGE_SUFFIXES)
    images = spark.read.format("image").option("recursiveFileLookup", True).option("dropInvalid", False).load(path)
    # The two readers write the same file's address with one slash or three.
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    both = files.select("path", plain("path").alias("__at")).join(images.select(plain("image.origin").alias("__at"), "image"), "__at", "left")
    return both.select(
        "path",
        stem(F.col("path")).alias("stem"),
        F.lit(1).alias("page"),
        F.lit("scan").alias("kind"),
        F.when(known, F.col("image")).alias("image"),
        F.when(~known, F.concat(F.lit("not an image or a PDF: "), F.col("path"))).alias("error"),
    )


PDF_PAGE = "page int, kind string, width int, height int, gray binary, layer string, error string"
#: Turns a file's bytes into pages of (page, kind, width, height, gray, layer); ``layer`` is XHTML of the words, null for a scan.
Decoder = Callable[[bytes], Iterable[tuple]]


def read_pdfs(spark: SparkSession, path: str, decode: Decoder, tries: int = 2) -> DataFrame:
    """(path, stem, page, kind, width, height, gray, layer, error): the pages of PDF files, by a decoder of the user's.

    Files are dealt out by Spark and decoded where they are read, one at a time; pages come out as the decoder yields them. A
    file that fails ``tries`` times is one row with its error, without pages of the last try's beginning; other files go on.
    """
    names = StructType.fromDDL(PDF_PAGE).names

    def pages(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at, content in zip(frame["path"], frame["content"], strict=True):
                for left in reversed(range(tries)):
                    try:
                        rows = [(*found, None) for found in decode(bytes(content))]
                        break
                    except Exception as error:
                        if not left:
                            rows = [(None,) * 6 + (f"{type(error).__name__}: {error}",)]
                yield pd.DataFrame([(at, *r) for r in rows], columns=["path", *names])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[pP][dD][fF]").load(path)
    found = files.select("path", "content").mapInPandas(pages, f"path string, {PDF_PAGE}")
    return found.select("path", stem(F.col("path")).alias("stem"), *names)


def stem(path):
    """A file's name without folders and its last suffix."""
    return F.regexp_replace(F.regexp_extract(path, "([^/]+)$", 1), r"(?<=.)\.[^.]*$", "")


def write_cache(df: DataFrame, path: str) -> None:
    """A cache as JSON lines, apart from anything public."""
    df.write.mode("overwrite").json(path)


def read_cache(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A cache with the schema that it must have; a malformed one fails."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
