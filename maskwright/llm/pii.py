"""Personal data by bootstrapped contextual extraction (operator 3), with DataFrame operations only.

Four kinds of identifiers are found by their form; these are the seeds. Whatever looks like an
identifier, a run of tokens with a digit or ``@``, is an instance, and the one or two words before
it are a lexical pattern. Patterns and instances form a graph with weights: a pattern is as good as
the share of its instances that are known, times the share of its uses in distinct texts that are
followed by an instance at all; an instance is known as far as good patterns say so. After some
rounds, patterns of high confidence add the instances behind them that no form has found.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions.text import matches
from maskwright.llm.tables import cut, small, text_key

KINDS = ("email", "ip", "card", "phone")
CONFIDENCE = 0.8
#: Distinct known instances that a pattern needs.
SUPPORT = 3
#: Rounds at most; they end when the good patterns no longer change.
ROUNDS = 20
#: Characters before an instance in which its context words are looked for.
_NEAR = 100
# Each begins where a run of its first characters begins or the last match ended, so that a failed
# run isn't tried again from each of its characters; possessive, since nothing after could give back.
_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[ -]?[0-9])++"
_PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
_INSTANCE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?: [^\s0-9@]*+[0-9@]\S*+)*+"
_PLACE = "array<struct<start:int,kind:int,end:int>>"


def _is_ip(s: Column) -> Column:
    def fits(part: Column) -> Column:
        bare = F.ltrim(part, F.lit("0"))
        return F.when(F.length(bare) <= 3, F.coalesce(bare.try_cast("int"), F.lit(0)) <= 255).otherwise(F.lit(False))

    return F.forall(F.split(s, r"\."), fits)


def _is_card(s: Column) -> Column:
    digits = F.regexp_replace(s, "[ -]", "")
    return F.when(F.length(digits).between(14, 19), F.call_function("luhn_check", digits)).otherwise(F.lit(False))


def _is_phone(s: Column) -> Column:
    return F.length(F.regexp_replace(s, "[^0-9]", "")).between(10, 15)


def base_spans(text: Column) -> Column:
    """(start, kind, end) of what the four forms find, sorted; kind is a place in ``KINDS``."""
    none = F.array().cast(_PLACE)
    digits = text.rlike("[0-9]")
    forms = (
        (F.contains(text, F.lit("@")), _EMAIL, None),
        (digits & F.contains(text, F.lit(".")), _IP, _is_ip),
        (digits, _CARD, _is_card),
        (F.contains(text, F.lit("+")), _PHONE, _is_phone),
    )
    parts = []
    for kind, (may, pattern, valid) in enumerate(forms):
        found = matches(text, pattern)
        parts.append(F.when(may, _placed(found, kind, valid)).otherwise(none))
    return F.array_sort(F.concat(*parts))


def _placed(found: Column, kind: int, valid: Callable[[Column], Column] | None) -> Column:
    if valid is not None:
        found = F.filter(found, lambda m: valid(m["s"]))
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))


def written(spans: Column) -> Column:
    """``kind:start:end`` of spans, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def instances(docs: DataFrame) -> DataFrame:
    """(key, start, end, s, kind, one, two): distinct texts' instances, the kind of a form that overlaps
    each, and hashes of the one and the two words before it."""
    text = F.coalesce("text", F.lit(""))
    own = docs.where(F.col("text").rlike("[0-9@]")).select(
        text_key(text).alias("key"), text.alias("text"), base_spans(text).alias("base"), matches(text, _INSTANCE).alias("found")
    )
    rows = own.select("key", "text", "base", F.explode_outer("found").alias("m")).where("m is not null")
    lead = F.length(F.regexp_extract(F.col("m.s"), r"^[(\"'\[{<]*", 0))
    trail = F.length(F.regexp_extract(F.col("m.s"), r"[.,;:!?)\"'\]}>]*$", 0))
    size = F.greatest(F.length("m.s") - lead - trail, F.lit(0))
    before = F.substring(F.col("text"), F.greatest(F.col("m.start") - _NEAR + 1, F.lit(1)), F.least(F.col("m.start"), F.lit(_NEAR)))
    rows = rows.select(
        "key",
        "base",
        (F.col("m.start") + lead).alias("start"),
        (F.col("m.start") + lead + size).alias("end"),
        F.substring(F.col("m.s"), lead + 1, size).alias("s"),
        F.lower(F.regexp_extract(before, r"(\S+)\s+$", 1)).alias("w1"),
        F.lower(F.regexp_extract(before, r"(\S+)\s+\S+\s+$", 1)).alias("w2"),
    ).where("end > start")
    over = F.filter("base", lambda b: (b["start"] < F.col("end")) & (b["end"] > F.col("start")))
    one = F.xxhash64("w1")
    return rows.select(
        "key",
        "start",
        "end",
        "s",
        F.get(over, F.lit(0))["kind"].alias("kind"),
        F.when(F.col("w1") != "", one).alias("one"),
        F.when((F.col("w1") != "") & (F.col("w2") != ""), F.xxhash64(F.xxhash64("w2"), one)).alias("two"),
    ).distinct()


def _uses(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, uses): how often in the distinct texts anything follows each of ``patterns``."""
    hashes = F.transform(F.split(F.lower("text"), r"\s+"), lambda w: F.xxhash64(w))
    own = docs.where("text is not null").select(text_key(F.col("text")).alias("key"), hashes.alias("h"))
    # Each of a text's n copies counts as one nth; only the keys of copied texts are brought together.
    copies = own.groupBy(F.col("key").alias("copied")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    own = own.join(small(cut(copies)), F.col("key") == F.col("copied"), "left").select("h", (1 / F.coalesce("n", F.lit(1))).alias("part"))
    n = F.greatest(F.size("h") - 1, F.lit(0))
    own = own.select("part", F.slice("h", 1, n).alias("one"), F.zip_with(F.slice("h", 1, n), F.slice("h", 2, n), lambda a, b: F.xxhash64(a, b)).alias("two"))
    two = F.slice("two", 1, F.greatest(F.size("two") - 1, F.lit(0)))
    rows = own.select("part", F.explode_outer(F.concat("one", two)).alias("pattern")).where("pattern is not null")
    met = rows.join(small(patterns), "pattern", "left_semi")
    return met.groupBy("pattern").agg(F.round(F.sum("part")).cast("long").alias("uses"))


def patterns(docs: DataFrame, found: DataFrame, confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """(pattern, kind, confidence): the patterns that are good after the last round."""
    slots = found.select("key", "start", "s", "kind", F.explode(F.array("one", "two")).alias("pattern")).where("pattern is not null")
    slots = cut(slots)
    wide = cut(slots.groupBy("pattern").agg(F.countDistinct("s").alias("n"), F.count(F.lit(1)).alias("seen")).where(F.col("n") >= support))
    if wide.isEmpty():
        return slots.select("pattern", "kind", F.lit(0.0).alias("confidence")).limit(0)
    uses = _uses(docs, wide.select("pattern"))
    # Both count distinct texts. Words over _NEAR characters are cut among the instances only: cap the share at one.
    share = F.least(F.lit(1.0), F.col("seen") / F.col("uses"))
    wide = cut(wide.join(uses, "pattern").select("pattern", "n", share.alias("share")).where(F.col("share") >= confidence))
    edges = cut(slots.join(small(wide.select("pattern")), "pattern", "left_semi").select("pattern", "s").distinct())
    seeds = cut(slots.where("kind is not null").select("s", "kind").distinct().withColumn("score", F.lit(1.0)))
    known, good, before = seeds, None, -1
    for _ in range(ROUNDS):
        scored = edges.join(known, "s").groupBy("pattern", "kind").agg(F.sum("score").alias("f"))
        scored = scored.join(small(wide), "pattern").withColumn("confidence", F.col("f") / F.col("n") * F.col("share"))
        good = cut(scored.where((F.col("f") >= support) & (F.col("confidence") >= confidence)).select("pattern", "kind", "confidence"))
        now = good.count()
        if now == before or not now:
            break
        before = now
        told = edges.join(small(good), "pattern").groupBy("s", "kind").agg((1 - F.product(1 - F.col("confidence"))).alias("score"))
        known = cut(seeds.union(told.join(seeds.select("s"), "s", "left_anti").select("s", "kind", "score")))
    return good


def added_spans(docs: DataFrame) -> DataFrame:
    """(key, added): for texts with instances that only patterns have found, their spans."""
    found = cut(instances(docs))
    good = patterns(docs, found)
    new = found.where("kind is null").select("key", "start", "end", F.explode(F.array("one", "two")).alias("pattern"))
    best = new.join(small(good), "pattern").groupBy("key", "start", "end").agg(F.max(F.struct("confidence", -F.col("kind"), "kind"))["kind"].alias("kind"))
    span = F.struct("start", "kind", "end")
    return cut(best.groupBy("key").agg(F.array_sort(F.collect_list(span)).cast(_PLACE).alias("added")))


def find(docs: DataFrame) -> DataFrame:
    """A row for each row of ``docs``: doc_id, base and spans, arrays of (start, kind, end).

    ``base`` is what the forms find; ``spans`` has also what the patterns add. Null texts are empty
    and have none. Ids may be null or repeated; equal texts have equal spans. No rows give no rows,
    and columns beside doc_id and text aren't read.
    """
    added = added_spans(docs.select("text")).withColumnRenamed("key", "__key")
    text = F.coalesce("text", F.lit(""))
    own = docs.select("doc_id", text_key(text).alias("key"), base_spans(text).alias("base"))
    both = own.join(small(added), F.col("key") == F.col("__key"), "left")
    more = F.coalesce("added", F.array().cast(_PLACE))
    return both.select("doc_id", "base", F.array_sort(F.concat("base", more)).alias("spans"))


def masked(text: Column, spans: Column) -> Column:
    """``text`` with ``[KIND]`` in place of each span; of overlapping spans the first stands."""
    names = F.array(*map(F.lit, KINDS))
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s: Column, x: Column) -> Column:
        mark = F.concat(F.lit("["), F.upper(F.get(names, x["kind"])), F.lit("]"))
        out = F.concat(s["out"], F.substring(text, s["at"] + 1, x["start"] - s["at"]), mark)
        return F.when(x["start"] < s["at"], s).otherwise(F.struct(x["end"].alias("at"), out.alias("out")))

    ends = lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text)))
    return F.aggregate(spans, state, step, ends)


def counts(spans: Column) -> list[Column]:
    """How many spans of each kind."""
    return [F.size(_of_kind(spans, k)).cast("long").alias(f"n_{x}") for k, x in enumerate(KINDS)]


def _of_kind(spans: Column, kind: int) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


