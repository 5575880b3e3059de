"""Benchmark decontamination by winnowing (operator 5), with DataFrame operations only.

A span of ten words has five 6-grams; of each window of five the gram of least hash is recorded,
once for as long as it stays the least. Whatever ten words a document and an item share, the window
over them records the same gram on both sides, so joining on the records finds every shared span;
each find is then compared word by word and extended to all windows on its diagonal. Items below
ten words are one window: their word of least hash is the fingerprint (grams of one word, a window
as long as the item).

Documents are handled by the content of their text. So copies cost one comparison, ids may be null
or repeated, and no text is shuffled but those that share a fingerprint with some item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions.arrays import once
from maskwright.llm.tables import ascii_lower, cut, small, stored, text_key

SPAN = 10
_GRAM = 6
#: Bytes of item words up to which they are sent to every executor.
_ITEM_BYTES = 64 << 20
_OTHER = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text, A-Z in lower case; none for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _OTHER), "")


def _joined(x: Column, y: Column, apart: int, how: str) -> Column:
    """Of elements of ``x`` and elements of ``y`` that stand ``apart`` places later: their hash or the least."""
    n = F.greatest(F.size(y) - apart, F.lit(0))
    both = {"hash": lambda a, b: F.xxhash64(a, b), "least": lambda a, b: F.least(a, b)}[how]
    return F.slice(F.zip_with(x, F.slice(y, 1 + apart, n), both), 1, n)


def _with_prints(df: DataFrame) -> DataFrame:
    """Adds ``hashes``, of the words, and ``kept``: (at, value) of the 6-grams that are least in some window of five."""
    df = df.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    df = df.withColumn("two", _joined(F.col("hashes"), F.col("hashes"), 1, "hash"))
    df = df.withColumn("four", _joined(F.col("two"), F.col("two"), 2, "hash"))
    df = df.withColumn("g", _joined(F.col("four"), F.col("two"), 4, "hash")).drop("two", "four")
    df = df.withColumn("m2", _joined(F.col("g"), F.col("g"), 1, "least"))
    df = df.withColumn("m4", _joined(F.col("m2"), F.col("m2"), 2, "least"))
    df = df.withColumn("m", _joined(F.col("m4"), F.col("g"), 4, "least")).drop("m2", "m4")
    # A gram is recorded if one of the up to five windows over it has it as its least.
    windows = SPAN - _GRAM + 1
    first = lambda i: F.greatest(i - windows + 2, F.lit(1))
    recorded = lambda m, x, i: F.array_contains(F.slice(m, first(i), i + 2 - first(i)), x)
    # Handed over, or the optimizer would put the leasts in place of their name and compute all for each gram.
    marked = once(F.col("m"), lambda m: F.transform("g", lambda x, i: F.when(recorded(m, x, i), F.struct(i.alias("at"), x.alias("value")))))
    return df.withColumn("kept", F.filter(marked, lambda x: x.isNotNull())).drop("g", "m")


def _items(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct word sequences with their fingerprints, and the ids that each stands for."""
    own = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("words"))
    own = own.where(F.size("words") > 0).withColumn("item", text_key(F.array_join("words", " ")))
    texts = _with_prints(own.groupBy("item").agg(F.min("words").alias("words")))
    texts = cut(texts.select("item", "words", "hashes", "kept"))
    ids = cut(own.select("item", "item_id").where("item_id is not null").distinct())
    return texts, ids


def _prints(texts: DataFrame) -> DataFrame:
    """(value, short, item, at): the fingerprints of items."""
    whole = texts.select("item", F.explode("kept").alias("k")).select("item", "k.at", "k.value")
    least = F.array_min("hashes")
    # Of a short item the first word with the least hash.
    short = texts.where(F.size("words") < SPAN).select(
        "item", (F.array_position("hashes", least) - 1).cast("int").alias("at"), least.alias("value")
    )
    return whole.select("value", F.lit(False).alias("short"), "item", "at").union(
        short.select("value", F.lit(True).alias("short"), "item", "at")
    )


def _found(doc_words: Column, item_words: Column, shift: Column) -> Column:
    """First document positions of the item's windows that stand on this diagonal."""
    span = F.least(F.size(item_words), F.lit(SPAN))
    same = F.transform(item_words, lambda w, i: F.coalesce(w == F.get(doc_words, i + shift), F.lit(False)))
    starts = F.sequence(F.lit(0), F.size(item_words) - span)
    whole = F.filter(starts, lambda s: F.forall(F.slice(same, s + 1, span), lambda x: x))
    return F.transform(whole, lambda s: s + shift)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """By ``key`` of a text: n_hit, n_items and items_sha256, for the texts that hold some window.

    Rows of ``benchmark(item_id, text)`` without words are no items; repeated rows are one; items
    without an id mark words as hit but aren't counted. Either table may be empty.
    """
    texts, ids = _items(benchmark)
    prints = cut(_prints(texts))
    own = _with_prints(docs.select(text_key(F.col("text")).alias("key"), words(F.col("text")).alias("words")))
    mine = F.transform("kept", lambda k: F.struct(k["value"].alias("value"), F.lit(False).alias("short"), k["at"].alias("pos")))
    if not prints.where("short").isEmpty():
        every = F.transform("hashes", lambda h, i: F.struct(h.alias("value"), F.lit(True).alias("short"), i.alias("pos")))
        mine = F.concat(mine, every)
    # The outer form, since for the other the optimizer would compute the array a second time to
    # leave out empty ones.
    rows = own.select("key", F.explode_outer(mine).alias("p")).where("p is not null").select("key", "p.*")
    met = rows.join(small(prints), ["value", "short"])
    met = cut(met.select("key", "item", (F.col("pos") - F.col("at")).alias("shift")).distinct())
    # Only the texts that met some item are read again, once each.
    keys = cut(met.select("key").distinct())
    again = docs.select(text_key(F.col("text")).alias("key"), "text").join(small(keys), "key")
    # Written, so that a text is split once and not within the loops below.
    again = stored(again.groupBy("key").agg(F.min("text").alias("text")).select("key", words(F.col("text")).alias("words")))
    item_words = texts.select("item", F.col("words").alias("item_words"))
    tries = met.groupBy("key", "item").agg(F.collect_list("shift").alias("shifts"))
    tries = tries.join(again, "key").join(small(item_words, _ITEM_BYTES // 8, F.aggregate("item_words", F.lit(0), lambda n, w: n + F.octet_length(w)), _ITEM_BYTES), "item")
    span = F.least(F.size("item_words"), F.lit(SPAN))
    starts = F.flatten(F.transform("shifts", lambda s: _found(F.col("words"), F.col("item_words"), s)))
    hits = once(starts, lambda x: F.array_distinct(F.flatten(F.transform(x, lambda s: F.sequence(s, s + span - 1)))))
    told = stored(tries.select("key", "item", hits.alias("hits")))
    told = told.where(F.size("hits") > 0).groupBy("key").agg(F.collect_list("hits").alias("hits"), F.collect_list("item").alias("items"))
    told = cut(
        told.select(
            "key",
            F.size(F.array_distinct(F.flatten("hits"))).cast("long").alias("n_hit"),
            "items",
        )
    )
    named = told.select("key", F.explode("items").alias("item")).join(small(ids), "item")
    named = named.groupBy("key").agg(F.collect_set("item_id").alias("ids"))
    named = told.select("key", "n_hit").join(named, "key", "left")
    found = F.coalesce("ids", F.array().cast("array<string>"))
    return cut(
        named.select(
            "key",
            "n_hit",
            F.size(found).cast("long").alias("n_items"),
            F.sha2(F.array_join(F.array_sort(found), ","), 256).alias("items_sha256"),
        )
    )


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words and no hits. Repeated rows each get their row. Columns
    beside doc_id and text aren't read.
    """
    found = contamination(docs, benchmark)
    own = docs.select(
        "doc_id", text_key(F.col("text")).alias("key"), F.size(words(F.col("text"))).cast("long").alias("n_words")
    )
    out = own.join(small(found), "key", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text holds no window of any item, unchanged."""
    found = contamination(docs, benchmark).select("key")
    # The rows travel as one struct, so no column of theirs can have the name of one made here.
    keyed = docs.select(F.struct(*docs.columns).alias("row"), text_key(F.col("text")).alias("key"))
    return keyed.join(small(found), "key", "left_anti").select("row.*")
