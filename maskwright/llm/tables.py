"""Helpers that the corpus operators share: cut lineage, keys by content, joins of a checked size."""

from __future__ import annotations

import math
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table with short rows may be sent to every executor.
BROADCAST_ROWS = 200_000
#: Bits for each key of the table of :func:`among`, and longs in each of its rows.
_BITS_A_KEY = 16
_LONGS = 1024


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset and driver and
    executors are one process, as in tests, a folder of this machine is used and remembered in the
    session; on a cluster that would lose tables, so it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("spark.maskwright.shared.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="maskwright-")
        spark.conf.set("spark.maskwright.shared.dir", folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read from there."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, plain: bool = False) -> DataFrame:
    """``df`` as compressed Parquet in the shared folder; for tables that carry text, or with ``plain`` hashes."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    # A dictionary of hashes saves nothing.
    df.write.option("parquet.enable.dictionary", str(not plain).lower()).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = BROADCAST_ROWS, size: Column | None = None, most_bytes: int = 0) -> DataFrame:
    """``df`` with a broadcast hint if it was counted and is small; else as it is, to be shuffled.

    ``df`` has to be cheap to count: the result of :func:`cut` or :func:`stored`, with rows of a
    fixed width. Where rows hold texts or arrays, ``size`` gives their bytes, and these are bounded too.
    """
    if size is None:
        return F.broadcast(df) if df.limit(most + 1).count() <= most else df
    got = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    return F.broadcast(df) if got["n"] <= most and got["bytes"] <= most_bytes else df


def among(df: DataFrame, column: Column, keys: DataFrame, n: int, others: bool = False) -> DataFrame:
    """The rows of ``df`` whose ``column`` is in ``keys``, ``n`` rows of one column, and about a sixteenth of the others.

    With ``others`` all rows but these, none of which is in ``keys``.

    Two bytes a key are sent to every executor: a table of bits, in rows of ``_LONGS`` longs, with
    the bit of each key set. A join that is too large for a broadcast so shuffles what it can meet.
    """
    chunks = max(1, math.ceil(n * _BITS_A_KEY / (64 * _LONGS)))

    def spot(key: Column) -> tuple[Column, Column, Column]:
        """Row, long and bit of a key."""
        h = F.xxhash64(key)
        return F.pmod(F.shiftright(h, 24), F.lit(chunks)), F.shiftright(h, 6).bitwiseAND(F.lit(_LONGS - 1)).cast("int"), h.bitwiseAND(F.lit(63)).cast("int")

    chunk, at, bit = spot(keys[keys.columns[0]])
    put = keys.select(chunk.alias("chunk"), at.alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bits"))
    # Every long is there, so that its place in the array is its number.
    every = df.sparkSession.range(chunks * _LONGS).select(F.expr(f"id div {_LONGS}").alias("chunk"), F.expr(f"cast(id % {_LONGS} as int)").alias("at"), F.lit(0).cast("long").alias("bits"))
    longs = put.union(every).groupBy("chunk", "at").agg(F.bit_or("bits").alias("bits")).groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("at", "bits"))).alias("longs"))
    table = longs.select(F.col("chunk").alias("_chunk"), F.col("longs.bits").alias("_longs"))
    chunk, at, bit = spot(column)
    return df.join(F.broadcast(table), (chunk == F.col("_chunk")) & (F.bit_get(F.get("_longs", at), bit) == 1), "left_anti" if others else "left_semi")


def meeting(df: DataFrame, keys: DataFrame, on: list[str], most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` joined to ``keys``, cheap to count as in :func:`small`; if they are many, what has no key is not shuffled."""
    n = keys.count()
    if n <= most:
        return df.join(F.broadcast(keys), on)
    return among(df, F.xxhash64(*on), keys.select(F.xxhash64(*on)), n).join(keys, on)


def text_key(text: Column) -> Column:
    """A key of a text's content, 96 bits and its length. Null and empty texts share one key."""
    text = F.coalesce(text, F.lit(""))
    return F.struct(F.xxhash64(text).alias("a"), F.hash(text).alias("b"), F.octet_length(text).alias("n"))


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z in lower case and every other character as it is."""
    plain = F.length(text) == F.octet_length(text)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))
