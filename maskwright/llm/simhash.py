"""SimHash near-duplicates (operator 7): fingerprints, then links found by pigeonring filtering.

Two fingerprints link if at most two of their 64 bits differ. Cut into 16 segments on a ring, such
a pair has a start from which every chain of ``l`` segments differs in at most ``l * 2 / 16`` bits
(the pigeonring principle: a proportional budget for each length). Up to seven segments that
budget is zero, so equal 28-bit chains are the join key; the longer chains prune the candidates
before the full Hamming check.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from maskwright.llm.components import components
from maskwright.llm.tables import cut

SEED = 42
SHINGLE = 3
DISTANCE = 2
SEGMENTS = 16
#: Fingerprints under one chain key up to which they are compared with each other.
CROWD = 64
_CHUNK = 1 << 16
_LIMIT = (1 << 63) - 1


def fingerprint(text: str | None) -> int:
    """The signed 64-bit fingerprint of one text; zero without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        return _signed(xxhash.xxh64_intdigest(b" ".join(words), SEED))
    votes, digest, total = np.zeros(64, np.int64), xxhash.xxh64_intdigest, len(words) - SHINGLE + 1
    for start in range(0, total, _CHUNK):
        part = words[start : start + _CHUNK + SHINGLE - 1]
        hashes = np.fromiter((digest(b"%b %b %b" % x, SEED) for x in zip(part, part[1:], part[2:], strict=False)), ">u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return _signed(int.from_bytes(np.packbits(2 * votes > total).tobytes(), "big"))


def _signed(value: int) -> int:
    return value - (1 << 64) if value > _LIMIT else value


@F.pandas_udf(LongType())
def fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([fingerprint(x) for x in batch], dtype="int64")


def _turned(x: Column, bits: int) -> Column:
    """``x`` turned left by ``bits`` on the ring of 64."""
    return x if bits == 0 else F.shiftleft(x, bits).bitwiseOR(F.shiftrightunsigned(x, 64 - bits))


def links(prints: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """Edges (a, b) over distinct fingerprints ``prints(fp)`` that connect all within ``distance``.

    Chain keys under which many fingerprints meet are not compared in pairs. Their fingerprints
    are dealt out by every value one bit away instead: two within distance 2 share such a value,
    any two that share one are within distance 2, and at most 65 fingerprints can share it.
    """
    if distance != 2:
        raise ValueError("links: made for a distance of 2")
    width = 64 // segments
    zero = (segments - 1) // distance  # longest chain whose budget is below one bit
    key_bits = zero * width
    chains = F.array(
        *[
            F.shiftrightunsigned(_turned(F.col("fp"), i * width), 64 - key_bits).bitwiseOR(
                F.shiftleft(F.lit(i).cast("long"), key_bits)
            )
            for i in range(segments)
        ]
    )
    keyed = prints.select("fp", F.explode(chains).alias("key"))
    crowds = cut(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    met = keyed.join(crowds, "key")
    few = met.where(F.col("n") <= CROWD).select("key", "fp")
    differ = F.col("a").bitwiseXOR(F.col("b"))
    ring = F.lit(False)
    for i in range(segments):
        start = F.shiftrightunsigned(F.col("key"), key_bits) == i
        budget = F.lit(True)
        for length in range(zero + 1, segments):
            # Only where the budget is about to grow does a longer chain tell more.
            if (length + 1) * distance // segments > length * distance // segments or length == segments - 1:
                chain = F.shiftrightunsigned(_turned(differ, i * width), 64 - length * width)
                budget = budget & (F.bit_count(chain) <= length * distance // segments)
        ring = ring | (start & budget)
    pairs = (
        few.select("key", F.col("fp").alias("a"))
        .join(few.select("key", F.col("fp").alias("b")), "key")
        .where(F.col("a") > F.col("b"))
        .where(ring & (F.bit_count(differ) <= distance))
        .select("a", "b")
    )
    many = met.where(F.col("n") > CROWD).select("fp").distinct()
    flips = [F.col("fp").bitwiseXOR(F.lit(_signed(1 << i)).cast("long")) for i in range(64)]
    near = many.select("fp", F.explode(F.array(F.col("fp"), *flips)).alias("value"))
    centre = near.groupBy("value").agg(F.min("fp").alias("b"), F.max("fp").alias("top")).where("b <> top")
    spokes = near.join(centre, "value").select(F.col("fp").alias("a"), "b")
    return pairs.union(spokes.where("a <> b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``' (doc_id, fp, component_id), a row for each row of ``docs``.

    ``component_id`` is the smallest id that can be reached over links, the row's own included; it
    is null only if all ids in reach are null. Null and empty texts have the fingerprint zero and
    link like any other. Repeated rows and repeated ids are kept, each with its own row. Other
    columns, whatever their names, are not read. No rows give no rows.
    """
    own = cut(docs.select(F.col(id_col).alias("doc_id"), fingerprints(F.col(text_col)).alias("fp")))
    nodes = cut(own.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = cut(components(links(nodes.select("fp"))))
    named = nodes.join(roots, nodes.fp == roots.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    groups = named.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = cut(named.select("fp", "root").join(groups, "root").select("fp", "component_id"))
    return own.join(labels, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group: that of the smallest id, nulls last.

    Rows that repeat the kept id are settled by their content, and of rows equal in every column
    one stays. Columns that hold maps are compared as they are written in JSON. The columns are
    those of ``docs``.
    """
    plain = [F.to_json(F.struct(f.name)).alias(f.name) if "map<" in f.dataType.simpleString() else F.col(f.name) for f in docs.schema]
    row = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64(*plain).alias("h"))
    own = cut(docs.select(row.alias("row"), fingerprints("text").alias("fp")))
    nodes = cut(own.groupBy("fp").agg(F.min("row").alias("least")))
    roots = cut(components(links(nodes.select("fp"))))
    named = nodes.join(roots, nodes.fp == roots.node, "left").select("least", F.coalesce("root", "fp").alias("root"))
    kept = cut(named.groupBy("root").agg(F.min("least").alias("row")).select("row"))
    repeated = own.groupBy("row").count().where("count > 1").join(kept, "row", "left_semi")
    keyed = docs.select(F.struct(*docs.columns).alias("all"), F.struct(*plain).alias("plain"), row.alias("mine"))
    out = keyed.join(kept, F.col("mine") == F.col("row"), "left_semi")
    return (out if repeated.isEmpty() else out.dropDuplicates(["plain"])).select("all.*")
