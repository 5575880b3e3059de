"""What a second reading of a crop says: where the value stands in it, and readers that the user gives."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.functions import text as T
from maskwright.operators import matching

#: A reading may be this much worse than words that a page's own text layer gives.
LEAST = 0.75
#: Takes grey images (rows by columns, one byte each) and gives the text of each.
Reader = Callable[[list[np.ndarray]], list[str]]


def read_spans(pairs: DataFrame, keys: list[str], least: float = LEAST) -> DataFrame:
    """``pairs(*keys, value, reading)`` with ``span``: printed, before, after, start, end; null where the reading has not the value.

    Keys name a row. The value is aligned with the reading's words, which end at blanks and at cell borders ("|"), with both
    ends free: the run of words of the best score counts, then the one of fewest words, then the first. ``printed`` is that
    run without the punctuation around it, ``before`` and ``after`` that punctuation; ``start`` and ``end`` are the run's
    shares of the reading's characters. An amount is never a value; where letters and digits are the same, the value's own
    writing stands. Null values and readings have no span.
    """
    text = F.btrim("reading", F.lit(" \t\n\r\x0b\x0c"))
    own = pairs.withColumn("__text", text).withColumn("__tokens", T.matches(F.col("__text"), r"[^\s|]+"))
    lines = own.select(*keys, F.lit(0).alias("line"), F.transform("__tokens", lambda t: t["s"]).alias("words"))
    best = matching.find_value(own.select(*keys, "value"), lines, keys, least, strict=False).select(*keys, "first", "last")
    both = own.join(best, keys, "left")
    start, end = F.get("__tokens", F.col("first"))["start"], F.get("__tokens", F.col("last"))["end"]
    raw = F.substring(F.col("__text"), start + 1, end - start)
    bare = T.strip_edges(raw)
    lead = F.length(raw) - F.length(F.ltrim(raw, F.lit(T.EDGE_PUNCTUATION)))
    kept = F.length(F.rtrim(raw, F.lit(T.EDGE_PUNCTUATION)))
    size = F.greatest(F.length("__text"), F.lit(1))
    printed = F.when(T.norm(bare) == T.norm(F.col("value")), F.col("value")).otherwise(bare)
    span = F.struct(
        printed.alias("printed"),
        F.substring(raw, F.lit(1), lead).alias("before"),
        F.substring(raw, kept + 1, F.length(raw)).alias("after"),
        (start / size).alias("start"),
        (end / size).alias("end"),
    )
    good = F.col("first").isNotNull() & (bare != "") & ~T.is_amount(bare)
    return both.withColumn("span", F.when(good, span)).drop("__text", "__tokens", "first", "last")


def once(df: DataFrame) -> DataFrame:
    """``df`` computed once: written to the checkpoint folder, which a lost executor does not take along; kept in the executors where none is named."""
    context = df.sparkSession.sparkContext
    if df.sparkSession.conf.get("spark.checkpoint.dir", None) or not context._jsc.sc().getCheckpointDir().isEmpty():
        return df.checkpoint()
    return df.persist()


def read(crops: DataFrame, reader: Reader, batch: int = 16, attempts: int = 3) -> DataFrame:
    """``crops(..., width, height, gray)`` with ``reading`` and ``error`` in place of the three.

    The reader gets up to ``batch`` crops at once. If that fails, or gives another number of texts, each crop is tried on its
    own, up to ``attempts`` times; one that fails every time has its error and no reading, and costs no other crop its
    reading. Without crops the reader is not called.
    """
    kept = [c for c in crops.columns if c not in ("width", "height", "gray")]

    def alone(image: np.ndarray) -> tuple[str | None, str | None]:
        for k in range(attempts):
            try:
                (text,) = reader([image])
                return text, None
            except Exception as e:  # whatever a user's reader raises is this crop's error
                if k + 1 == attempts:
                    return None, f"{type(e).__name__}: {e}"
        return None, "not tried"

    def told(images: list[np.ndarray]) -> list[tuple[str | None, str | None]]:
        try:
            texts = list(reader(images))
        except Exception:
            texts = []
        return [(x, None) for x in texts] if len(texts) == len(images) else [alone(x) for x in images]

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            images = [np.frombuffer(g, np.uint8).reshape(h, w) for g, h, w in zip(frame["gray"], frame["height"], frame["width"], strict=True)]
            got = [x for k in range(0, len(images), batch) for x in told(images[k : k + batch])]
            out = frame[kept].copy()
            out["reading"], out["error"] = [x for x, _ in got], [e for _, e in got]
            yield out

    names = ", ".join(f"`{c}` {crops.schema[c].dataType.simpleString()}" for c in kept)
    return crops.mapInPandas(rows, f"{names}, reading string, error string")
