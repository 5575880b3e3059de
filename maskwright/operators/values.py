"""Values from a model's answers: read leniently, split, and each kept once."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from maskwright.functions import text as T

DATE = r"^[0-9]{1,2}\.[0-9]{1,2}\.([0-9]{2,4})?$"
TIME = r"^[0-9]{1,2}:[0-9]{2}(:[0-9]{2})?$"
ITEM = "struct<text:string,type:string,owner:string,bbox_2d:array<double>>"
# Fixed value: the box of an item without one, in thousandths of the page.
WHOLE_PAGE = (0.0, 0.0, 1000.0, 1000.0)


def _objects(answer: str | None) -> list[str]:
    decoder, out, at = json.JSONDecoder(), [], (answer or "").find("{")
    while at >= 0:
        try:
            item, end = decoder.raw_decode(answer, at)
        except json.JSONDecodeError:
            at = answer.find("{", at + 1)
        else:
            out.append(json.dumps(item, ensure_ascii=False))
            at = answer.find("{", end)
    return out


@F.pandas_udf(ArrayType(StringType()))
def json_objects(answers: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Every whole JSON object in an answer, be the list around them cut off or not."""
    for batch in answers:
        yield batch.map(_objects, na_action=None)


def parse(answers: DataFrame, keys: list[str], answer: str = "answer", width: str = "width", height: str = "height") -> DataFrame:
    """(*keys, pos, text, type, owner, hint): an answer's usable items, the first of each text and type.

    Items without text or of an unknown type are dropped; without a whole box they may be anywhere;
    without an owner they are the document's. Hints are pixels, rounded half to even.
    """
    items = F.transform(json_objects(answer), lambda o: F.from_json(o, ITEM))
    rows = answers.select(*keys, width, height, F.posexplode_outer(items).alias("pos", "v")).where("v is not null")
    whole = (F.size("v.bbox_2d") == 4) & ~F.exists("v.bbox_2d", lambda x: x.isNull())
    spot = F.when(F.coalesce(whole, F.lit(False)), F.col("v.bbox_2d")).otherwise(F.array(*map(F.lit, WHOLE_PAGE)))
    owner = F.lower(F.trim(F.coalesce("v.owner", F.lit(""))))
    rows = rows.select(
        *keys,
        "pos",
        T.strip_edges(F.coalesce("v.text", F.lit(""))).alias("text"),
        F.col("v.type").alias("type"),
        F.when(owner == "", "document").otherwise(owner).alias("owner"),
        F.struct(
            *[F.rint(spot[k] * F.col((width, height)[k % 2]) / 1000).cast("int").alias(n) for k, n in enumerate(("x0", "y0", "x1", "y1"))]
        ).alias("hint"),
    )
    return _first(rows.where((F.col("text") != "") & F.col("type").isin(*T.VALUE_TYPES)), keys)


def _first(rows: DataFrame, keys: list[str]) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*keys, "text", "type").orderBy("pos"))
    return rows.withColumn("__n", n).where("__n = 1").drop("__n")


def not_personal(text: Column, kind: Column) -> Column:
    """Sums of money told as numbers, and years told as dates."""
    return (kind.isin("id", "card") & T.is_amount(text)) | ((kind == "date") & text.rlike("^(19|20)[0-9]{2}$"))


def split_compound(text: Column, kind: Column) -> Column:
    """(text, type) of the parts of an id line that holds dates or times; else the value itself."""
    tokens = F.filter(F.split(text, r"\s+"), lambda t: t != "")
    mixed = (kind == "id") & (F.size(tokens) >= 2) & F.exists(tokens, lambda t: t.rlike(DATE) | t.rlike(TIME))
    typed = F.transform(tokens, lambda t: F.struct(t.alias("text"), F.when(t.rlike(DATE), "date").when(t.rlike(TIME), "time").otherwise("id").alias("type")))
    kept = F.filter(typed, lambda p: (p["type"] != "id") | (F.length(T.digits(p["text"])) >= 3))
    return F.when(mixed, kept).otherwise(F.array(F.struct(text.alias("text"), kind.alias("type"))))


def normalise(values: DataFrame, keys: list[str]) -> DataFrame:
    """Compound values in their parts, without what isn't personal, and each text and type once."""
    rest = [c for c in values.columns if c not in ("text", "type", "pos")]
    rows = values.select(*rest, "pos", F.posexplode(split_compound(F.col("text"), F.col("type"))).alias("part", "p"))
    rows = rows.select(*rest, F.struct("pos", "part").alias("pos"), F.col("p.text").alias("text"), F.col("p.type").alias("type"))
    kept = _first(rows.where(~not_personal(F.col("text"), F.col("type"))), keys)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("pos")) - 1
    return kept.withColumn("pos", place)
