"""Finished copies: edits applied to pages in order, read back, and the keys that say what was done.

Analyses are those of ``analysis``: ``values(*doc, page, pos, owner, type, text)`` and ``places(*doc, page, pos, place, how, printed,
before, after, words, line_box, run_box, next_x)``. What a value is drawn with is a callable of the user's; without one, values
are erased. Readers are the user's too (``reading.Reader``); without them nothing is read back and there is no leak check.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.functions import barcode
from maskwright.functions import boxes as B
from maskwright.functions import text as T
from maskwright.operators import leak, matching, pixels, reading, replace
from maskwright.plans import copies

BOX = "struct<x0:int,y0:int,x1:int,y1:int>"
# The types of numbers that have barcodes, and the fewest digits of one.
BARCODE_TYPES = ("id", "card")
BARCODE_DIGITS = 8
LINE_HEIGHT = 12
#: Takes a grey page, the box of an erased value and the new text; gives the page with it and the box that it covers.
Writer = Callable[[np.ndarray, pixels.Box, str], tuple[np.ndarray, pixels.Box]]

_CROPS = "array<struct<pos:int,place:int,text:string,width:int,height:int,gray:binary>>"
_BARS = f"array<struct<pos:int,place:int,box:{BOX},valid:boolean>>"


def context(pages: DataFrame, values: DataFrame, places: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, context): the text of ``pages(*keys, text)`` without the values and what is printed of them.

    Values go in their order, each before its places, so that what a longer one left isn't cut by a shorter one out of turn.
    """
    own = values.select(*keys, "pos", F.lit(-1).alias("place"), "text").union(places.select(*keys, "pos", "place", "printed")).where("text <> ''")
    listed = own.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "place", "text"))).alias("__gone"))
    rest = F.aggregate(F.coalesce("__gone", F.array().cast("array<struct<pos:int,place:int,text:string>>")), F.col("text"), lambda t, g: F.replace(t, g["text"], F.lit(" ")))
    return pages.join(listed, keys, "left").select(*keys, rest.alias("context"))


def edits(changed: DataFrame, places: DataFrame, doc: list[str]) -> DataFrame:
    """(*doc, seed, page, pos, place, box, text, number): what each copy prints where; ``number`` is what a barcode beside it encodes, else null.

    Parts of a wrapped value get their share of the new one; what could not change isn't edited.
    """
    keys = [*doc, "page", "pos"]
    whole = replace.printed_text(places, keys).select(*keys, F.size(F.filter(F.split("printed", r"\s+"), lambda w: w != "")).alias("__total"))
    both = changed.where("new <> old").join(places, keys).join(whole, keys)
    part = replace.part_of(F.col("new"), F.col("words.first"), F.col("words.last"), F.col("__total"))
    number = T.digits(F.col("new"))
    has = F.col("type").isin(*BARCODE_TYPES) & (F.length(number) >= BARCODE_DIGITS)
    return both.select(*doc, "seed", "page", "pos", "place", F.col("run_box").alias("box"), F.concat("before", part, "after").alias("text"), F.when(has, number).alias("number"))


def edited(pages: DataFrame, todo: DataFrame, keys: list[str], write: Writer | None = None, keep: str | None = None) -> DataFrame:
    """(*keys, width, height, gray, crops, bars, barcodes_scrambled): pages with their edits, one kernel call a page.

    ``pages(*keys, width, height, gray, line_height, seed)``, ``todo(*keys, pos, place, box, text, number)``, done in the order of
    (pos, place). Each value's ink is erased from the page as it is by then, the new text written, and what now covers its place
    cut out for reading back. Barcodes beside changed numbers are redrawn after that; all others are scrambled, but for the pixels of
    boxes in the array column ``keep``. Pages without edits have only their barcodes scrambled; edits without a page are left out.
    """
    steps = todo.withColumn("modules", barcode.widths(F.col("number")))
    steps = steps.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "place", "box", "text", "modules"))).alias("__steps"))
    side = ("x0", "y0", "x1", "y1")

    def done(scan: np.ndarray, height: int, seed: int, found: object, *more: object) -> Iterator[tuple]:
        out, crops, numbers = scan, [], []
        level = pixels.paper(scan)
        for step in [] if found is None else found:
            (box,) = pixels._boxes([step["box"]])
            out = pixels.erased(out, box, level)
            area = box
            if write is not None:
                out, area = write(out.copy(), box, step["text"])
            x0, y0, x1, y1 = max(0, area[0]), max(0, area[1]), area[2], area[3]
            crop = out[y0:y1, x0:x1]
            crops.append({"pos": step["pos"], "place": step["place"], "text": step["text"], "width": crop.shape[1], "height": crop.shape[0], "gray": crop.tobytes()})
            numbers.append({**dict(zip(side, box, strict=True)), "seed": seed, "modules": step["modules"]})
        out, bars = pixels.redraw(scan, out, height, numbers)
        told = [{"pos": c["pos"], "place": c["place"], "box": dict(zip(side, b[0], strict=True)), "valid": b[1]} for c, b in zip(crops, bars, strict=True) if b is not None]
        held = [tuple(n[s] for s in side) for n in numbers] + pixels._boxes(more[0] if more else None)
        out, n = pixels.scramble(scan, out, height, seed, [tuple(t["box"].values()) for t in told], held)
        yield scan.shape[1], scan.shape[0], out.tobytes(), crops, told, n

    schema = f"width int, height int, gray binary, crops {_CROPS}, bars {_BARS}, barcodes_scrambled int"
    own = pages.join(steps, keys, "left").withColumn("__seed", F.col("seed"))
    return pixels.pages_to_rows(own, keys, done, schema, ["line_height", "__seed", "__steps", *([keep] if keep else [])])


def read_back(done: DataFrame, keys: list[str], reader: reading.Reader) -> DataFrame:
    """(*keys, pos, place, read_back_ok): whether the new text of each edit can be read where it was printed; a failed reading is a no."""
    crops = done.select(*keys, F.inline("crops"))
    own = [*keys, "pos", "place"]
    read = reading.once(reading.read(crops, reader))
    asked = read.select(*own, F.coalesce("reading", F.lit("")).alias("reading"), F.col("text").alias("value"))
    return matching.contains(asked, own).select(*own, F.col("contained").alias("read_back_ok"))


def page_keys(changed: DataFrame, spots: DataFrame, pages: DataFrame, old: DataFrame, doc: list[str]) -> DataFrame:
    """(*doc, seed, page, changes, barcodes_scrambled, leak_check, leaks): what was done on each page of each copy.

    ``changed`` is of ``copies.copies``; ``spots(*doc, seed, page, pos, place, box, read_back_ok, barcode, barcode_valid)`` are the edits, with nulls
    for what wasn't read or has no bars; ``pages(*doc, seed, page, barcodes_scrambled, text, context)`` are all finished pages, ``text``
    being null where none was read; ``old(*doc, page, type, text)`` are all writings of all values. A change is read back if it has places and
    none was read wrongly. A page leaks by pieces of old values that aren't meant to be there, and by values that could not change.
    ``leaks`` names pieces: it is for the private key alone, as is ``old`` in ``changes``.
    """
    keys = [*doc, "seed", "page"]
    place = F.struct("place", "box", "read_back_ok", "barcode", "barcode_valid")
    listed = spots.groupBy(*keys, "pos").agg(F.array_sort(F.collect_list(place)).alias("places"))
    none = F.array().cast(listed.schema["places"].dataType)
    rows = changed.join(listed, [*keys, "pos"], "left").withColumn("places", F.coalesce("places", none))
    ok = (F.size("places") > 0) & F.forall("places", lambda p: F.coalesce(p["read_back_ok"], F.lit(True)))
    change = F.struct("pos", "type", "owner", "old", "new", "located", "places", ok.alias("read_back_ok"))
    by_page = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(change), _by_pos).alias("changes"))
    # Leaks are looked for on pages that were read.
    read = pages.where("text is not null").select(*keys, "text", F.coalesce("context", F.lit("")).alias("context"))
    sought = read.select(*keys).join(old.select(*doc, "page", "type", "text").distinct(), [*doc, "page"]).select(*keys, "type", "text")
    fresh = changed.where("new <> old").select(*keys, "new")
    found = leak.leaks(read, sought, keys, fresh, crowded=True).select(*keys, "type", "pieces")
    stuck = changed.where("new = old").join(read.select(*keys), keys, "left_semi").select(*keys, "type", F.array(F.lit(copies.UNCHANGED)).alias("pieces"))
    leaks = found.union(stuck).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("type", "pieces"))).alias("leaks"))
    out = pages.join(by_page, keys, "left").join(leaks, keys, "left")
    leaks_ = F.coalesce("leaks", F.array().cast(leaks.schema["leaks"].dataType))
    types = F.array_sort(F.array_distinct(F.transform(leaks_, lambda x: x["type"])))
    check = F.when(F.col("text").isNotNull(), F.struct((F.size(leaks_) == 0).alias("passed"), types.alias("leaked_types")))
    changes = F.coalesce("changes", F.array().cast(by_page.schema["changes"].dataType))
    return out.select(*keys, changes.alias("changes"), "barcodes_scrambled", check.alias("leak_check"), F.when(F.col("text").isNotNull(), leaks_).alias("leaks"))


def _by_pos(a, b):
    return F.when(a["pos"] < b["pos"], -1).when(a["pos"] > b["pos"], 1).otherwise(0)


def public(keys_: DataFrame) -> DataFrame:
    """The page keys that may be shown: no old value, no piece of one; a value that couldn't change isn't told either."""
    sides = lambda b: F.when(b.isNotNull(), F.array(*[b[n] for n in B.SIDES]))

    def place(p):
        return F.struct(sides(p["box"]).alias("box"), p["read_back_ok"].alias("read_back_ok"), sides(p["barcode"]).alias("barcode"), p["barcode_valid"].alias("barcode_valid"))

    def change(c):
        new = F.when(c["new"] == c["old"], F.lit(copies.UNCHANGED)).otherwise(c["new"])
        return F.struct(c["type"].alias("type"), c["owner"].alias("owner"), new.alias("new"), c["located"].alias("located"), F.transform(c["places"], place).alias("places"), c["read_back_ok"].alias("read_back_ok"))

    return keys_.withColumn("changes", F.transform("changes", change)).drop("leaks")


def private(keys_: DataFrame) -> DataFrame:
    """The page keys that never leave the private folder: old and new values, and the pieces that leaked."""
    change = lambda c: F.struct(*[c[n].alias(n) for n in ("type", "owner", "old", "new", "located")])
    return keys_.withColumn("changes", F.transform("changes", change)).drop("barcodes_scrambled", "leak_check")


def summaries(shown: DataFrame, doc: list[str]) -> DataFrame:
    """(*doc, seed, summary): a line on each copy from its public page keys."""
    edits_ = F.filter("changes", lambda c: F.size(c["places"]) > 0)
    own = shown.select(*doc, "seed", F.size(edits_).alias("n"), F.size(F.filter(edits_, lambda c: c["read_back_ok"])).alias("ok"), F.exists(edits_, lambda c: F.exists(c["places"], lambda p: p["read_back_ok"].isNotNull())).alias("read"), "barcodes_scrambled", "leak_check")
    told = own.groupBy(*doc, "seed").agg(
        F.sum("n").alias("n"), F.sum("ok").alias("ok"), F.bool_or("read").alias("read"), F.sum("barcodes_scrambled").alias("bars"),
        F.count("leak_check").alias("checked"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("leak_check.leaked_types")))).alias("leaked"),
    )
    back = F.when(F.col("read"), F.concat(F.col("ok").cast("string"), F.lit(" read back correctly"))).otherwise("not read back")
    verdict = F.when(F.col("checked") == 0, "no leak check").when(F.size("leaked") == 0, "leak check passed").otherwise(F.concat(F.lit("leak of "), F.array_join("leaked", ", ")))
    line = F.concat(F.col("n").cast("string"), F.lit(" values replaced, "), back, F.lit(", "), F.coalesce("bars", F.lit(0)).cast("string"), F.lit(" barcodes scrambled, "), verdict)
    return told.select(*doc, "seed", line.alias("summary"))


def finish(
    pages: DataFrame, values: DataFrame, places: DataFrame, doc: list[str], n: int, seed: int,
    write: Writer | None = None, reader: reading.Reader | None = None, page_reader: reading.Reader | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(images, keys) of ``n`` copies of all documents: (*doc, seed, page, width, height, gray), and the rows of :func:`page_keys`.

    ``pages(*doc, page, text, width, height, gray)``, ``text`` being that of the page's own layer. The line height of a page is the upper
    median height of its places, 12 where it has none. Pages are taken once for each copy; images are written before they are read.
    """
    one, keys = [*doc, "page"], [*doc, "seed", "page"]
    changed = reading.once(copies.copies(values, places, doc, n, seed))
    todo = reading.once(edits(changed, places, doc))
    height = F.col("run_box.y1") - F.col("run_box.y0")
    own = places.groupBy(*one).agg(F.sort_array(F.collect_list(height)).alias("__h"), F.collect_list("run_box").alias("__keep"))
    middle = F.get("__h", F.floor(F.size("__h") / 2).cast("int"))
    scans = pages.select(*one, "width", "height", "gray").join(own, one, "left").withColumn("line_height", F.coalesce(middle, F.lit(LINE_HEIGHT)))
    scans = scans.withColumn("seed", F.explode(F.sequence(F.lit(seed), F.lit(seed + n - 1))))
    done = reading.once(edited(scans, todo, keys, write, "__keep"))
    spots = todo.select(*keys, "pos", "place", "box")
    spots = spots.join(read_back(done, keys, reader), [*keys, "pos", "place"], "left") if reader else spots.withColumn("read_back_ok", F.lit(None).cast("boolean"))
    bars = done.select(*keys, F.inline("bars")).select(*keys, "pos", "place", F.col("box").alias("barcode"), F.col("valid").alias("barcode_valid"))
    spots = spots.join(bars, [*keys, "pos", "place"], "left")
    counted = done.select(*keys, "barcodes_scrambled")
    if page_reader:
        read = reading.read(done.select(*keys, "width", "height", "gray"), page_reader).select(*keys, F.coalesce("reading", F.lit("")).alias("text"))
        # A page that could not be read is checked by nothing, and says so.
        counted = counted.join(read.where("text <> ''"), keys, "left")
    else:
        counted = counted.withColumn("text", F.lit(None).cast("string"))
    finished = counted.join(context(pages.select(*one, "text"), values, places, one), one, "left")
    old = values.select(*one, "type", "text").union(places.join(values.select(*one, "pos", "type"), [*one, "pos"]).select(*one, "type", "printed")).where("text is not null")
    return done.select(*keys, "width", "height", "gray"), page_keys(changed, spots, finished, old, doc)


def write_keys(keys_: DataFrame, doc: list[str], out: str, private_: str) -> None:
    """Public keys to ``out`` and private ones to ``private_``, as JSON; folders of other documents and copies stay."""
    for rows, folder in ((public(keys_), out), (private(keys_), private_)):
        rows.write.partitionBy(*doc, "seed").mode("overwrite").option("partitionOverwriteMode", "dynamic").json(f"{folder}/page_keys")
