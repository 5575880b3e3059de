"""Where values are printed: joins of boxes, nearest places, and claims of better evidence first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.functions import boxes as B
from maskwright.functions.text import one_slip, strip_edges
from maskwright.operators import matching, pixels, reading

SEARCH_LINES = 6
#: Names of lines with one box that a row holds.
NAMES = 256


def _steps(least: Column, greatest: Column, side: Column) -> Column:
    return F.explode(F.sequence(F.floor(least / side), F.floor(F.greatest(greatest - 1, least) / side)))


def _sides(*boxes: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, wide, high): the sides of a page's cells, root mean squares of its boxes' sides, so boxes have few cells on the average."""
    every = boxes[0]
    for more in boxes[1:]:
        every = every.union(more)
    mean = lambda a, b: F.greatest(F.ceil(F.sqrt(F.avg(F.pow((F.col(f"box.{b}") - F.col(f"box.{a}")).cast("double"), F.lit(2))))), F.lit(1))
    return every.groupBy(*keys).agg(mean("x0", "x1").alias("wide"), mean("y0", "y1").alias("high"))


def _dealt(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` dealt out by columns to a number of tasks that doesn't go by its bytes: pairs are many more than rows."""
    conf = df.sparkSession.conf
    return df.repartition(max(int(conf.get("spark.sql.shuffle.partitions")), 4 * df.sparkSession.sparkContext.defaultParallelism), *columns)


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], least: float = 0.3) -> DataFrame:
    """Pairs of ``left(*keys, a)`` and ``right(*keys, b)`` boxes of a page that overlap, each pair once.

    Boxes meet in grid cells of their usual size; a pair counts in the first cell that both cover.
    """
    sides = _sides(left.select(*keys, F.col("a").alias("box")), right.select(*keys, F.col("b").alias("box")), keys=keys)

    def celled(df: DataFrame, b: str) -> DataFrame:
        own = df.join(sides.withColumnsRenamed({"wide": "__w", "high": "__h"}), keys)
        own = own.withColumn("__x", _steps(F.col(f"{b}.x0"), F.col(f"{b}.x1"), F.col("__w")))
        return own.withColumn("__y", _steps(F.col(f"{b}.y0"), F.col(f"{b}.y1"), F.col("__h")))

    cell = [*keys, "__x", "__y"]
    l, r = _dealt(celled(left, "a"), *cell), _dealt(celled(right, "b").drop("__w", "__h"), *cell)
    first = (F.col("__x") == F.floor(F.greatest("a.x0", "b.x0") / F.col("__w"))) & (F.col("__y") == F.floor(F.greatest("a.y0", "b.y0") / F.col("__h")))
    both = l.join(r, cell).where(first & B.overlaps(F.col("a"), F.col("b"), least))
    return both.drop("__x", "__y", "__w", "__h")


def _named(boxes: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(*keys, box, part, names): the boxes of a page once each, with up to ``NAMES`` of their sorted names a row."""
    n = F.row_number().over(Window.partitionBy(*keys, "box").orderBy(name))
    own = boxes.select(*keys, name, "box").withColumn("part", F.floor((n - 1) / NAMES))
    return own.groupBy(*keys, "box", "part").agg(F.array_sort(F.collect_list(name)).alias("names"))


def overlapping_pairs(boxes: DataFrame, keys: list[str], name: str = "id", least: float = 0.3) -> DataFrame:
    """(*keys, a, b): names of ``boxes(*keys, name, box)`` of a page that overlap, the lesser one first.

    Equal boxes are compared once, with all of their names; names are written out in pairs afterwards.
    """
    own = _named(boxes, keys, name)
    one = own.select(*keys, F.col("box").alias("a"), F.col("part").alias("__p"), F.col("names").alias("__i"))
    two = own.select(*keys, F.col("box").alias("b"), F.col("part").alias("__q"), F.col("names").alias("__j"))
    order = lambda box, part: F.struct(*[F.col(f"{box}.{n}") for n in B.SIDES], F.col(part).alias("part"))
    met = overlapping(one, two, keys, least).where(order("a", "__p") <= order("b", "__q"))
    same = (order("a", "__p") == order("b", "__q")).alias("__same")
    pairs = met.select(*keys, "__j", same, F.explode("__i").alias("i")).select(*keys, "__same", "i", F.explode("__j").alias("j"))
    return pairs.where(~F.col("__same") | (F.col("i") < F.col("j"))).where("i <> j").select(*keys, F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"))


def snap(runs: DataFrame, ink: DataFrame, keys: list[str]) -> DataFrame:
    """``runs(*keys, run, a)`` grown by the ink words of which at least half lies in the run's box."""
    share = B.shared_area(F.col("a"), F.col("b")) >= 0.5 * B.area(F.col("b"))
    met = overlapping(runs.select(*keys, "run", "a"), ink.select(*keys, F.col("box").alias("b")), keys, 0.0).where(share)
    grown = met.groupBy(*keys, "run").agg(
        B.box(F.min("b.x0"), F.min("b.y0"), F.max("b.x1"), F.max("b.y1")).alias("w")
    )
    both = runs.join(grown, [*keys, "run"], "left")
    return both.withColumn("box", F.when(F.col("w").isNull(), F.col("a")).otherwise(B.union(F.col("a"), F.col("w")))).drop("w")


def next_lines(lines: DataFrame, keys: list[str], line_height: int) -> DataFrame:
    """(*keys, upper, lower): lines that go on in a later line below; a join on bands of a line's height and columns of a usual width.

    Equal boxes are compared once, with all of their lines.
    """
    own = lines.select(*keys, "line", "box").distinct()
    boxes = F.count(F.lit(1)).over(Window.partitionBy(*keys, "line"))
    own = own.withColumn("__many", boxes > 1)
    one, many = own.where("not __many"), own.where("__many")
    # Only lines that stand in several boxes can meet another line several times.
    twice = _below(many, own, keys, line_height).union(_below(one, many, keys, line_height)).distinct()
    return _below(one, one, keys, line_height).union(twice)


def _below(upper: DataFrame, lower: DataFrame, keys: list[str], line_height: int) -> DataFrame:
    """(*keys, upper, lower) of ``upper`` and ``lower(*keys, line, box)``, for each pair of boxes that go on in one another."""
    a, b = _named(upper, keys, "line"), _named(lower, keys, "line")
    sides = _sides(upper.select(*keys, "box"), lower.select(*keys, "box"), keys=keys).drop("high")
    column = lambda c: _steps(F.col(f"{c}.x0"), F.col(f"{c}.x1"), F.col("wide"))
    band = lambda edge: F.floor(F.col(edge) / line_height)
    a = a.select(*keys, F.col("box").alias("a"), F.col("names").alias("__i")).join(sides, keys).withColumn("x", column("a"))
    a = a.withColumn("band", F.explode(F.array(band("a.y1") - 1, band("a.y1"), band("a.y1") + 1)))
    b = b.select(*keys, F.col("box").alias("b"), F.col("names").alias("__j")).join(sides, keys).withColumn("x", column("b")).drop("wide")
    cell = [*keys, "x", "band"]
    both = _dealt(a, *cell).join(_dealt(b.withColumn("band", band("b.y0")), *cell), cell)
    first = F.col("x") == F.floor(F.greatest("a.x0", "b.x0") / F.col("wide"))
    met = both.where(first & B.below(F.col("a"), F.col("b"), line_height) & (F.get("__i", F.lit(0)) < F.element_at("__j", -1)))
    pairs = met.select(*keys, "__j", F.explode("__i").alias("upper")).select(*keys, "upper", F.explode("__j").alias("lower"))
    return pairs.where("lower > upper")


def nearest_blank(cuts: DataFrame, blanks: DataFrame, keys: list[str]) -> DataFrame:
    """For each ``cuts(*keys, cut, x, reach)`` the nearest of ``blanks(*keys, blank)`` within reach, the left of two; else x."""
    d = F.abs(F.col("blank") - F.col("x"))
    met = cuts.join(blanks, keys).where(d <= F.col("reach"))
    best = met.groupBy(*keys, "cut").agg(F.min(F.struct(d.alias("d"), "blank")).alias("m"))
    return cuts.join(best, [*keys, "cut"], "left").select(*keys, "cut", F.coalesce("m.blank", "x").alias("at"))


def nearest_lines(values: DataFrame, lines: DataFrame, keys: list[str], most: int = 2 * SEARCH_LINES) -> DataFrame:
    """The ``most`` lines of a page whose centres are nearest to each value's hint.

    Equal hints are looked up once, whatever values have them. Of lines with one centre only the first ``most`` can count. The rest lies in grid cells, sized by
    how close a page's lines are; rings of cells around a hint are widened until enough lines are
    certain, and where they never are, on sparse pages, the whole page is tried.
    """
    middle = lambda b: F.struct((b["x0"] + b["x1"]).alias("x"), (b["y0"] + b["y1"]).alias("y"))
    same = F.row_number().over(Window.partitionBy(*keys, "mid").orderBy("line"))
    own = lines.select(*keys, "line", "box", middle(F.col("box")).alias("mid"))
    own = own.withColumn("__n", same).where(F.col("__n") <= most).drop("__n")
    x, y = F.col("mid.x"), F.col("mid.y")
    # Centres are kept doubled, so they are whole numbers; sides are in the same unit.
    area = (F.max(x) - F.min(x) + 1).cast("double") * (F.max(y) - F.min(y) + 1)
    sides = own.groupBy(*keys).agg(F.greatest(F.ceil(F.sqrt(area * most / F.count(F.lit(1)))), F.lit(1)).alias("side"))
    cell = lambda c, n: F.floor(F.col(f"{c}.{n}") / F.col("side")).alias(f"c{n}")
    placed = own.join(sides, keys).select(*keys, "line", "box", cell("mid", "x"), cell("mid", "y"))
    # Equal hints are looked up once, whatever values have them.
    hints = values.select(*keys, "hint").distinct().withColumn("mid", middle(F.col("hint"))).join(sides, keys)
    near = reading.once(_ranked(hints, placed, keys, most, 1))
    far = _ranked(near.where("not sure").select(*hints.columns), placed, keys, most, 3)
    rest = _ranked(far.where("not sure").select(*hints.columns), placed, keys, most, None)
    best = near.where("sure").unionByName(far.where("sure")).unionByName(rest).select(*keys, "hint", "best")
    # A value with several hints has the nearest to any of them; equal rows count once each, as a join does.
    told = values.select(*keys, "value", "hint").join(best, [*keys, "hint"]).groupBy(*keys, "value").agg(F.array_sort(F.flatten(F.collect_list("best"))).alias("best"))
    rows = told.select(*keys, "value", F.posexplode(F.slice("best", 1, most)).alias("n", "b"))
    return rows.select(*keys, "value", "b.line", "b.box", "b.distance", (F.col("n") + 1).alias("rank"))


def _ranked(hints: DataFrame, placed: DataFrame, keys: list[str], most: int, reach: int | None) -> DataFrame:
    """``hints`` with ``best``, the nearest lines in the cells around as (distance, line, box), and whether they are ``sure``.

    Without a ``reach`` the whole page is looked at, and what is found is sure.
    """
    if reach is None:
        both = hints.join(placed.select(*keys, "line", "box"), keys)
    else:
        around = lambda c: F.explode(F.sequence(c - reach, c + reach))
        cell = lambda n: around(F.floor(F.col(f"mid.{n}") / F.col("side")))
        own = [*keys, "cx", "cy"]
        both = _dealt(hints.withColumn("cx", cell("x")).withColumn("cy", cell("y")), *own).join(_dealt(placed, *own), own, "left")
    distance = B.centre_distance(F.col("hint"), F.col("box"))
    n = F.row_number().over(Window.partitionBy(*keys, "hint").orderBy(F.asc_nulls_last("distance"), "line"))
    first = both.withColumn("distance", distance).withColumn("__n", n).where(F.col("__n") <= most)
    found = F.collect_list(F.when(F.col("distance").isNotNull(), F.struct("distance", "line", "box")))
    out = first.groupBy(*keys, "hint").agg(F.first("mid").alias("mid"), F.first("side").alias("side"), F.array_sort(found).alias("best"))
    # Whatever is no farther than so many sides lies in the cells; a hair less for rounding.
    sure = F.lit(True) if reach is None else (F.size("best") >= most) & (F.coalesce(F.array_max(F.transform("best", lambda x: x["distance"])), F.lit(0.0)) * 2 < F.col("side") * (reach - 1e-9))
    return out.withColumn("sure", sure)


def wrapped(values: DataFrame, lines: DataFrame, keys: list[str], line_height: int) -> DataFrame:
    """(*keys, value, upper, lower, first, cut, last): values that begin in one line and end in one below.

    Of several such pairs of lines the first stands.
    """
    many = values.where(F.size(F.split(F.trim(F.col("value")), r"\s+")) >= 2)
    below = next_lines(lines, keys, line_height)
    a = lines.select(*keys, F.col("line").alias("upper"), F.col("words").alias("wa"))
    b = lines.select(*keys, F.col("line").alias("lower"), F.col("words").alias("wb"))
    both = below.join(a, [*keys, "upper"]).join(b, [*keys, "lower"])
    joined = both.select(*keys, F.struct("upper", "lower").alias("line"), F.concat("wa", "wb").alias("words"), F.size("wa").alias("cut"))
    # Within one pair of lines the best run counts.
    tried = matching._tries(many, joined.select(*keys, "line", "words"), keys, matching.SCORE, True)
    best = Window.partitionBy(*keys, "value", "line").orderBy(F.desc("score"), F.col("last") - F.col("first"), "first")
    tried = tried.withColumn("__n", F.row_number().over(best)).where("__n = 1").join(joined.select(*keys, "line", "cut"), [*keys, "line"])
    over = tried.where("first < cut and cut <= last")
    order = Window.partitionBy(*keys, "value").orderBy("line")
    one = over.withColumn("__n", F.row_number().over(order)).where("__n = 1")
    return one.select(*keys, "value", F.col("line.upper").alias("upper"), F.col("line.lower").alias("lower"), "first", "cut", "last")


def by_pixels(values: DataFrame, pages: DataFrame, lines: DataFrame, keys: list[str], reader: reading.Reader) -> DataFrame:
    """(*keys, value, first, last, box, printed, next_x): where values stand by the ink of their page, one place each.

    ``values(*keys, value, hint)``, ``pages(*keys, width, height, gray, line_height)``, ``lines(*keys, word_boxes)`` of a text layer. The text
    lines nearest to the hint are read by ``reader``; the nearest whose reading holds the value counts if its words can be told
    apart: by blanks in the ink, else by the text layer's words within the line, whichever are as many as the reading has. A line
    that is nothing but the value, a digit misread at most, counts whole. A crop that the reader fails on is no evidence.
    """
    own = [*keys, "asked", "rank"]
    read = reading.read(pixels.near_lines(pages, values, keys), reader).where("error is null and reading is not null")
    # What follows looks at readings several times; the reader is called once.
    read = reading.once(read.withColumnRenamed("value", "asked").withColumnRenamed("line", "area").drop("error"))
    held = matching.contains(read.select(*own, "reading", F.col("asked").alias("value")), own).where("contained").select(*own)
    parts = F.filter(F.split("reading", r"\s+"), lambda w: w != "")
    rows = reading.once(read.join(held, own, "left_semi").withColumn("words", parts))
    best = matching.find_value(rows.select(*own, F.col("asked").alias("value")), rows.select(*own, F.lit(0).alias("line"), "words"), own, strict=False)
    rows = rows.join(best.select(*own, "first", "last"), own, "left")
    run = F.array_join(F.slice("words", F.col("first") + 1, F.col("last") - F.col("first") + 1), " ")
    rows = rows.withColumn("run", F.when(one_slip(F.col("asked"), run), run))
    # Words of the text layer that lie in the line, two pixels more or less.
    layer = lines.select(*keys, F.explode("word_boxes").alias("w"))
    a, w = F.col("area"), F.col("w")
    within = (w["x0"] >= a["x0"] - 2) & (w["x1"] <= a["x1"] + 2) & ((w["y0"] + w["y1"]) / 2).between(a["y0"] - 2, a["y1"] + 2)
    inside = rows.select(*own, "area").join(layer, keys).where(within).groupBy(*own).agg(F.array_sort(F.collect_list("w")).alias("layer"))
    rows = rows.join(inside, own, "left")
    boxes = F.when(F.size("word_boxes") == F.size("words"), F.col("word_boxes")).when(F.size("layer") == F.size("words"), F.col("layer"))
    rows = rows.withColumn("boxes", F.when(F.col("run").isNotNull(), boxes))
    part = F.slice("boxes", F.col("first") + 1, F.col("last") - F.col("first") + 1)
    side = lambda n, f: f(F.transform(part, lambda b: b[n]))
    words = B.box(side("x0", F.array_min), side("y0", F.array_min), side("x1", F.array_max), side("y1", F.array_max))
    count = F.size(F.filter(F.split("asked", r"\s+"), lambda w: w != ""))
    whole = (count == F.size("words")) & (matching.similarity(F.col("reading"), F.col("asked")) >= matching.SCORE) & one_slip(F.col("asked"), F.col("reading"))
    rows = rows.withColumn("whole", whole).where(F.col("boxes").isNotNull() | F.col("whole"))
    apart, bare = F.col("boxes").isNotNull(), strip_edges(F.col("run"))
    told = rows.select(
        *keys, F.col("asked").alias("value"), "rank",
        F.when(apart, F.col("first")).otherwise(0).alias("first"),
        F.when(apart, F.col("last")).otherwise(F.size("words") - 1).alias("last"),
        F.when(apart, words).otherwise(B.box(*[a[n] for n in B.SIDES])).alias("box"),
        F.when(apart, F.when(bare == "", F.col("asked")).otherwise(bare)).otherwise(F.trim("reading")).alias("printed"),
        F.when(apart, F.get("boxes", F.col("last") + 1)["x0"]).alias("next_x"),
    )
    first = Window.partitionBy(*keys, "value").orderBy("rank")
    return told.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n", "rank")


def locate(values: DataFrame, lines: DataFrame, keys: list[str], line_height: int = 12, pages: DataFrame | None = None, reader: reading.Reader | None = None) -> DataFrame:
    """(*keys, value, line, first, last, score, how, box): all places of each value.

    ``values(*keys, value)``, with ``pos`` for their order, else they go by text, and
    ``lines(*keys, line, words, word_boxes, box)``. Exact matches claim their boxes; near ones count on
    words that no claim overlaps, of earlier values either; values still without a place are tried
    over two lines, where nothing is claimed. With ``pages`` and a ``reader``, what has no place yet and a ``hint`` is looked for in the
    ink of its page (see :func:`by_pixels`), ``how`` being "pixels" and ``line`` null.
    """
    own = lines.select(*keys, "line", "words")
    spots = lines.select(*keys, "line", "word_boxes")

    def placed(found: DataFrame, how: str) -> DataFrame:
        part = F.slice("word_boxes", F.col("first") + 1, F.col("last") - F.col("first") + 1)
        both = found.join(spots, [*keys, "line"]).withColumn("part", part)
        side = lambda n, f: f(F.transform("part", lambda b: b[n]))
        b = B.box(side("x0", F.array_min), side("y0", F.array_min), side("x1", F.array_max), side("y1", F.array_max))
        return both.select(*keys, "value", "line", "first", "last", "score", F.lit(how).alias("how"), b.alias("box"), "part")

    exact = placed(matching.find_all(values, own, keys), "exact")
    # A near match may have one digit misread, not more: another number is another value.
    loose = matching.find_all(values, own, keys, strict=False).join(own, [*keys, "line"])
    run = F.array_join(F.slice("words", F.col("first") + 1, F.col("last") - F.col("first") + 1), " ")
    near = placed(loose.where(one_slip(F.col("value"), run)).drop("words"), "near")
    rows = near.withColumn("a", F.explode("part"))
    taken = overlapping(rows.select(*keys, "value", "line", "first", "a"), exact.select(*keys, F.col("box").alias("b")), keys)
    free = near.join(taken.select(*keys, "value", "line", "first").distinct(), [*keys, "value", "line", "first"], "left_anti")
    order = F.col("pos") if "pos" in values.columns else F.col("value")
    turns = values.select(*keys, "value", order.alias("turn")).groupBy(*keys, "value").agg(F.min("turn").alias("turn"))
    free = _in_turn(free.join(turns, [*keys, "value"]), keys).select(*exact.columns)
    sure = exact.union(free)
    rest = values.select(*keys, "value").distinct().join(sure.select(*keys, "value").distinct(), [*keys, "value"], "left_anti")
    over = wrapped(rest, lines, keys, line_height)
    shorter = F.size(F.filter(F.split("value", r"\s+"), lambda w: w != ""))
    top = over.join(spots.withColumnRenamed("line", "upper"), [*keys, "upper"])
    two = top.select(*keys, "value", F.col("upper").alias("line"), "first", (F.col("cut") - 1).alias("last"), F.lit(None).cast("double").alias("score")).union(
        over.select(*keys, "value", F.col("lower").alias("line"), F.lit(0), (F.col("last") - F.col("cut")), F.lit(None).cast("double"))
    )
    two = placed(two.where(shorter > 1), "wrapped")
    held = overlapping(two.select(*keys, "value", F.col("box").alias("a")), sure.select(*keys, F.col("box").alias("b")), keys)
    # A value over two lines has both of its places or none.
    open_ = two.join(held.select(*keys, "value").distinct(), [*keys, "value"], "left_anti").join(turns, [*keys, "value"])
    whole = _in_turn(open_, keys, whole=True).select(*exact.columns)
    found = sure.union(whole)
    if reader is not None and pages is not None:
        found = reading.once(found)
        left = values.select(*keys, "value", "hint").join(found.select(*keys, "value").distinct(), [*keys, "value"], "left_anti")
        seen = reading.once(by_pixels(left, pages, lines, keys, reader))
        no = F.lit(None)
        seen = seen.select(
            *keys, "value", no.cast(found.schema["line"].dataType).alias("line"), "first", "last", no.cast("double").alias("score"), F.lit("pixels").alias("how"), "box", F.array("box").alias("part")
        )
        held = overlapping(seen.select(*keys, "value", F.col("box").alias("a")), found.select(*keys, F.col("box").alias("b")), keys)
        free = seen.join(held.select(*keys, "value").distinct(), [*keys, "value"], "left_anti").join(turns, [*keys, "value"])
        found = found.union(_in_turn(free, keys).select(*found.columns))
    return found.drop("part")


def _in_turn(places: DataFrame, keys: list[str], whole: bool = False) -> DataFrame:
    """``places(*keys, turn, value, box, part, ...)`` that overlap none of a value whose turn was before, on their page.

    With ``whole``, a value one of whose places is taken loses all of them. A page's places are gone through in one fold.
    """
    columns = [c for c in places.columns if c not in keys]
    order = ["turn", "value", *[c for c in columns if c not in ("turn", "value")]]
    pages = places.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order))).alias("all"))
    none = F.filter("all", lambda x: F.lit(False))
    met = lambda kept, x: F.exists(kept, lambda k: (k["value"] != x["value"]) & F.exists(x["part"], lambda w: B.overlaps(w, k["box"])))
    lost = lambda kept, x: F.exists(F.filter("all", lambda y: y["value"] == x["value"]), lambda y: met(kept, y)) if whole else met(kept, x)
    kept = F.aggregate("all", none, lambda kept, x: F.when(lost(kept, x), kept).otherwise(F.concat(kept, F.array(x))))
    return pages.select(*keys, F.inline(kept))


