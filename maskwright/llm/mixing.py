"""Mixing sources to target weights (operator 1), with DataFrame operations only.

Every source is cut into 4096 blocks of documents by a hash, and each source's blocks are permuted
by four rounds of a keyed exchange of halves. Its target says how many passes over the source are
taken and how far a last pass goes into the permuted blocks; that is the source's quota of blocks.
A splitting tree divides the quotas among the output shards: each node hands its left half a
multivariate hypergeometric draw of what it holds, so every quota is split exactly. A shard then
draws its disjoint run of each source's permuted blocks, which is what is taken, and is shuffled by
a hash on its own.

What is planned is a row for each source, not for each document; a source may hold most rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.functions.arrays import once, running
from maskwright.llm.tables import cut, small

WEIGHTS = (5.0, 2.0, 1.0)
MOST_REPEATS = 3
SHARDS = 16
SEED = 42
BLOCKS = 4096
_HALF = 64
#: Source plans that are sent to all executors; more are joined by shuffling.
_PLANS = 20_000
_WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def _row_hash() -> Column:
    return F.xxhash64("doc_id", "text")


def _block() -> Column:
    return F.pmod(_row_hash(), F.lit(BLOCKS)).cast("int")


def _sub_block() -> Column:
    """Where in its block a document is: one of 4096 parts in order."""
    return F.shiftrightunsigned(_row_hash(), 52).cast("int")


def _place(source: Column, block: Column, seed: int) -> Column:
    """Where a block stands in its source's permuted order.

    The two halves of its number change places four times, each time one of them mixed with a hash
    of the other: a permutation for every source.
    """
    left, right = F.floor(block / _HALF).cast("int"), block % _HALF
    for turn in range(4):
        mixed = F.pmod(F.xxhash64(F.lit(seed), F.lit(turn), source, right), F.lit(_HALF)).cast("int")
        left, right = right, left.bitwiseXOR(mixed)
    return left * _HALF + right


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_REPEATS) -> DataFrame:
    """``sizes(source, size)`` with ``target``: shares of all sizes by weight, none above ``most`` sizes.

    Sources in code-point order, null last, have the weights in turn. What a source can't take is
    reshared among the others by weight, until none is above its limit: in the order in which
    sources become full as the level rises, the level is that of the first one that isn't full.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int"))
    table = sizes.withColumn("weight", weight).withColumn("limit", F.col("size") * float(most)).withColumn("full", F.col("limit") / F.col("weight"))
    every = Window.partitionBy()
    before = Window.orderBy("full", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    less = lambda x: F.coalesce(F.sum(x).over(before), F.lit(0.0))
    level = (F.sum("size").over(every) - less("limit")) / (F.sum("weight").over(every) - less("weight"))
    table = table.withColumn("level", level)
    reached = F.min(F.when(F.col("full") > F.col("level"), F.struct("full", "level"))).over(every)["level"]
    goal = F.least("limit", F.coalesce(reached * F.col("weight"), F.col("limit")))
    return table.withColumn("target", goal).drop("limit", "full", "level")


def _log_factorial(n: Column) -> Column:
    """ln n!, by Stirling's series at n + 9."""
    y = n + 9.0
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    shift = n + 1.0
    for k in range(2, 9):
        shift = shift * (n + float(k))
    return series - F.log(shift)


def hypergeometric(good: Column, total: Column, draws: Column, uniform: Column) -> Column:
    """How many of ``draws`` from ``total``, drawn without putting back, are of the ``good``.

    The inverse of the distribution function at ``uniform``, summed over ten deviations to either
    side of the mean, where all but about 1e-20 of the mass lies.
    """
    low = F.greatest(F.lit(0).cast("long"), draws - (total - good))
    high = F.least(good, draws)
    share = good / total
    mean = draws * share
    deviation = F.sqrt(mean * (1 - share) * (total - draws) / F.greatest(total - 1, F.lit(1)))
    first = F.greatest(low, F.floor(mean - 10 * deviation) - 5).cast("long")
    last = F.least(high, F.ceil(mean + 10 * deviation) + 5).cast("long")
    # Each use of these two would write all of their parts into the plan, which the driver holds.
    drawn = once(F.struct(first.alias("first"), last.alias("last")), lambda r: _inverse(good, total, draws, uniform, r["first"], r["last"]))
    return F.when(low >= high, low).otherwise(drawn)


def _inverse(good: Column, total: Column, draws: Column, uniform: Column, first: Column, last: Column) -> Column:
    """The least number from ``first`` to ``last`` at which the sum of the chances reaches ``uniform``."""
    choose = lambda n, k: _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k)
    start = F.exp(choose(good, first) + choose(total - good, draws - first) - choose(total, draws))
    state = F.struct(start.alias("p"), F.lit(0.0).alias("below"), first.alias("x"))

    def step(s: Column, x: Column) -> Column:
        below = s["below"] + s["p"]
        more = s["p"] * (good - x) * (draws - x) / ((x + 1.0) * (total - good - draws + x + 1.0))
        # x counts up for as long as the sum up to it is below the uniform number.
        go = (s["x"] == x) & (below < uniform) & (x < last)
        return F.struct(more.alias("p"), below.alias("below"), F.when(go, x + 1).otherwise(s["x"]).alias("x"))

    return F.aggregate(F.sequence(first, last), state, step, lambda s: s["x"])


def shard_quotas(quotas: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``quotas(source, quota, ...)`` with ``ends``: each quota divided among the shards, as running sums by shard.

    The tree is one row that holds all of its nodes, each with what it has of every source: made for
    up to about a million sources, as any table of sources by shards is.
    """
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    rows = quotas.select(order.alias("order"), *quotas.columns).agg(F.array_sort(F.collect_list(F.struct("order", *quotas.columns))).alias("list"))
    zero = F.lit(0).cast("long")
    node = lambda low, high, held: F.struct(low.alias("low"), high.alias("high"), held.alias("held"))

    def drawn(n: Column) -> Column:
        """Of what a node holds, how many blocks of each source go to its left half."""
        total = F.aggregate(n["held"], zero, lambda a, x: a + x)
        middle = F.floor((n["low"] + n["high"]) / 2)
        share = F.floor(total * (middle - n["low"]) / (n["high"] - n["low"]) + 0.5).cast("long")
        bits = lambda i: F.xxhash64(F.lit(seed), n["low"], n["high"], i).bitwiseAND(F.lit((1 << 52) - 1))
        numbered = F.transform(n["held"], lambda q, i: F.struct(q.alias("q"), ((bits(i) + 0.5) / float(1 << 52)).alias("u")))
        begin = F.struct(total.alias("total"), share.alias("draws"), F.array().cast("array<bigint>").alias("out"))

        def draw(s: Column, x: Column) -> Column:
            take = F.when(s["draws"] <= 0, zero).otherwise(hypergeometric(x["q"], s["total"], s["draws"], x["u"]))
            return once(
                take, lambda k: F.struct((s["total"] - x["q"]).alias("total"), (s["draws"] - k).alias("draws"), F.concat(s["out"], F.array(k)).alias("out"))
            )

        return F.aggregate(numbered, begin, draw, lambda s: s["out"])

    def halves(n: Column) -> Column:
        middle = F.floor((n["low"] + n["high"]) / 2).cast("int")
        both = once(drawn(n), lambda left: F.array(node(n["low"], middle, left), node(middle, n["high"], F.zip_with(n["held"], left, lambda a, b: a - b))))
        return F.when(n["high"] - n["low"] > 1, both).otherwise(F.array(n))

    rows = rows.withColumn("nodes", F.array(node(F.lit(0), F.lit(shards), F.transform("list", lambda x: x["quota"].cast("long")))))
    for _ in range(math.ceil(math.log2(shards))):
        rows = rows.withColumn("nodes", F.flatten(F.transform("nodes", halves)))
    ends = F.transform("list", lambda x, i: running(F.transform("nodes", lambda n: F.get(n["held"], i))))
    both = cut(rows.select(F.explode(F.zip_with("list", ends, lambda x, e: F.struct(x.alias("x"), e.alias("ends")))).alias("r")))
    return both.select(*[F.col(f"r.x.{c}").alias(c) for c in quotas.columns], F.col("r.ends").alias("ends"))


def _reached(parts: DataFrame, extra: str) -> DataFrame:
    """(source, at, rest): of ``parts(source, at, words, ...)`` in order the one within which ``extra`` words are reached, and its share."""
    run = Window.partitionBy("source").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    told = parts.withColumn("before", F.coalesce(F.sum("words").over(run), F.lit(0)))
    inside = (F.col("before") < F.col(extra)) & (F.col(extra) <= F.col("before") + F.col("words"))
    return told.where(inside).select("source", "at", (F.col(extra) - F.col("before")).alias("rest"))


def _named(df: DataFrame, name: str) -> DataFrame:
    """``df(source, at, rest)`` as (of, name_at, name_rest), to be joined."""
    return df.select(F.col("source").alias("of"), F.col("at").alias(f"{name}_at"), F.col("rest").alias(f"{name}_rest"))


def plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """A row for each source: its size and target, whole passes, where the last pass ends, and its shards.

    The last pass ends in a block, there in a 4096th part of it, and there after so many words.
    """
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    blocks = docs.groupBy("source", _block().alias("block")).agg(F.sum(word_count(F.col("text"))).alias("words"))
    blocks = cut(blocks.withColumn("at", _place(F.col("source"), F.col("block"), seed)))
    goals = targets(blocks.groupBy("source").agg(F.sum("words").alias("size")), weights)
    passes = F.when(F.col("size") > 0, F.least(F.lit(MOST_REPEATS), F.floor(F.col("target") / F.col("size")))).otherwise(0).cast("long")
    extra = F.greatest(F.lit(0).cast("long"), F.round("target").cast("long") - F.col("passes") * F.col("size"))
    goals = goals.withColumn("passes", passes).withColumn("extra", F.when(F.col("passes") >= MOST_REPEATS, F.lit(0).cast("long")).otherwise(extra))
    goals = cut(goals.select("source", F.col("size").alias("source_size"), "target", "passes", "extra"))
    wanted = goals.where("extra > 0").select(F.col("source").alias("of"), "extra")
    last = cut(_named(_reached(blocks.join(small(wanted, _PLANS), same("source", "of")), "extra"), "block"))
    # The last block alone is read once more.
    own = docs.select("source", "text", _block().alias("block"), _sub_block().alias("at"))
    own = own.withColumn("place", _place(F.col("source"), F.col("block"), seed)).join(small(last, _PLANS), same("source", "of") & (F.col("place") == F.col("block_at")))
    parts = own.groupBy("source", "at", "block_rest").agg(F.sum(word_count(F.col("text"))).alias("words"))
    ending = cut(_named(_reached(parts, "block_rest"), "part"))
    goals = goals.join(last, same("source", "of"), "left").drop("of").join(ending, same("source", "of"), "left").drop("of")
    goals = goals.select(
        "source", "source_size", "target", "passes", F.coalesce("block_at", F.lit(-1)).alias("last_place"), F.coalesce("part_at", F.lit(-1)).alias("last_part"), F.coalesce("part_rest", F.lit(0)).alias("last_words")
    )
    return shard_quotas(goals.withColumn("quota", (F.col("passes") * BLOCKS + F.col("last_place") + 1).cast("long")), shards, seed).drop("quota")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``docs`` with size, source_size, target, draws and taken; a row for each row of ``docs``.

    ``draws`` lists (shard, epoch, words, order) for each time the mix takes the document: the
    output shard, the pass, how many of its first words, and the place in the shard's own shuffle.
    ``taken`` is the sum of those words; over a source it equals the rounded target. Only the one
    document in which a source's last pass ends is taken in part.

    Null texts and texts without words have size 0 and take nothing. Null sources are one source,
    the last. Ids may be null or repeated; equal rows are told apart by nothing and may trade
    places. Reruns agree. Columns of ``docs`` with one of the five names are replaced. No rows give
    no rows.
    """
    own = docs.drop("size", "source_size", "target", "draws", "taken")
    # The rows travel as one struct, so no column of theirs can have the name of one made here.
    keyed = own.select(F.struct(*own.columns).alias("row"), "source", _row_hash().alias("h"), _block().alias("block"), _sub_block().alias("part"), word_count(F.col("text")).alias("size"))
    keyed = keyed.withColumn("place", _place(F.col("source"), F.col("block"), seed)).drop("block")
    plans = plan(own.select("doc_id", "text", "source"), weights, shards, seed).withColumnRenamed("source", "of")
    joined = keyed.join(small(plans, _PLANS), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    # Only the part in which a last pass ends goes by order; of every other a document is all in or all out.
    at_end = (F.col("place") == F.col("last_place")) & (F.col("part") == F.col("last_part"))
    before_end = (F.col("place") < F.col("last_place")) | ((F.col("place") == F.col("last_place")) & (F.col("part") < F.col("last_part")))
    inside = joined.where(~at_end).withColumn("last", F.when(before_end, F.col("size")).otherwise(F.lit(0).cast("long")))
    run = Window.partitionBy("source").orderBy("h", "row.doc_id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("size").over(run), F.lit(0))
    ending = joined.where(at_end).withColumn("last", F.greatest(F.lit(0), F.least(F.col("size"), F.col("last_words") - before)).cast("long"))
    both = inside.unionByName(ending)
    # The shard that drew a block in a pass: the one whose run of the source's quota holds it.
    unit = lambda e: e * BLOCKS + F.col("place")
    epochs = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("passes")),
        lambda e: F.struct(
            F.size(F.filter("ends", lambda x: x <= unit(e))).alias("shard"),
            e.cast("int").alias("epoch"),
            F.when(e < F.col("passes"), F.col("size")).otherwise(F.col("last")).alias("words"),
            F.xxhash64(F.lit(seed), e, F.col("h")).alias("order"),
        ),
    )
    both = both.withColumn("draws", F.filter(epochs, lambda d: (d["words"] > 0) & (d["shard"] < shards)))
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"])
    return both.select(*[F.col("row").getField(c).alias(c) for c in own.columns], "size", "source_size", "target", "draws", taken.alias("taken"))


def shuffled(mixed: DataFrame) -> DataFrame:
    """The mix itself: a row for each draw of :func:`mix`, with shard, epoch, words and order, each shard shuffled.

    Rows are dealt out by ranges of (shard, order) and sorted within them, so a shard is a run of
    partitions and its rows stand in the order of a hash. ``words`` below ``size`` asks for the
    first words of the text only.
    """
    columns = [x for x in mixed.columns if x not in ("draws", "taken")]
    drawn = mixed.select(*columns, F.inline("draws"))
    return drawn.repartitionByRange("shard", "order").sortWithinPartitions("shard", "order")
