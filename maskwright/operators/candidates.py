"""Rule-based candidates for personal values, and which of them known values confirm."""

from __future__ import annotations

from collections.abc import Callable, Collection

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.functions import text as T

# The entities that are kept, the type a value of each has, and the floor of scores.
ENTITIES = (
    "PERSON", "EMAIL_ADDRESS", "PHONE_NUMBER", "IBAN_CODE", "CREDIT_CARD", "DATE_TIME",
    "DE_TAX_ID", "DE_ID_CARD", "DE_PASSPORT", "DE_HEALTH_INSURANCE", "DE_SOCIAL_SECURITY",
)
VALUE_TYPE = {"PERSON": "person", "EMAIL_ADDRESS": "email", "PHONE_NUMBER": "phone", "IBAN_CODE": "iban", "CREDIT_CARD": "card", "DATE_TIME": "date"}
MIN_SCORE = 0.4
MIN_CHARS = 3
SPANS = "array<struct<start:int,end:int,entity:string,score:double>>"


def _iban_valid(s: Column) -> Column:
    bare = F.regexp_replace(s, r"\s", "")
    return T.iban_check(F.substring(bare, 1, 2), F.substring(bare, F.lit(5), F.length(bare))) == F.substring(bare, 3, 2)


def _holds(part: str) -> Callable[[Column], Column]:
    return lambda text: F.contains(text, F.lit(part))


def _like(pattern: str) -> Callable[[Column], Column]:
    return lambda text: text.rlike(pattern)


_DIGITS = _like("[0-9]{2}")
# The letters that numbers of identity cards and passports are made of, and those that they begin with.
_SERIAL = "CFGHJKLMNPRTVWXYZ0-9"
_CARD, _PASSPORT = "LMNPRTVWXYZ", "CFGHJK"
# Patterns and checks of our own: entity, pattern, score, check of a match, what a text must hold. Numbers of identity cards and
# passports count with their check digit only, since nine letters and digits alone are too often something else.
RECOGNIZERS = (
    ("EMAIL_ADDRESS", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 1.0, None, _holds("@")),
    ("PHONE_NUMBER", r"\+[0-9][ ().0-9-]{7,20}[0-9]", 0.6, lambda s: F.length(T.digits(s)).between(10, 15), _holds("+")),
    ("IBAN_CODE", r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", 1.0, _iban_valid, _DIGITS),
    ("CREDIT_CARD", r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])", 1.0, lambda s: T.luhn_ok(T.digits(s)), _DIGITS),
    ("DATE_TIME", r"(?<![0-9.])[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}(?![0-9])|(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])", 0.6, None, _DIGITS),
    ("DE_TAX_ID", r"(?<![0-9])[1-9][0-9]{10}(?![0-9])", 0.5, T.tax_id_ok, _DIGITS),
    ("DE_HEALTH_INSURANCE", r"(?<![A-Za-z0-9])[A-Z][0-9]{9}(?![A-Za-z0-9])", 0.5, T.insurance_id_ok, _DIGITS),
    ("DE_SOCIAL_SECURITY", r"(?<![A-Za-z0-9])[0-9]{8}[A-Z][0-9]{3}(?![A-Za-z0-9])", 0.5, T.social_id_ok, _like("[0-9]{8}[A-Z][0-9]{3}")),
    ("DE_ID_CARD", rf"(?<![A-Za-z0-9])[{_CARD}][{_SERIAL}]{{8}}[0-9](?![A-Za-z0-9])", 0.5, T.card_number_ok, _like(f"[{_CARD}][{_SERIAL}]{{8}}[0-9]")),
    ("DE_PASSPORT", rf"(?<![A-Za-z0-9])[{_PASSPORT}][{_SERIAL}]{{8}}[0-9](?![A-Za-z0-9])", 0.5, T.card_number_ok, _like(f"[{_PASSPORT}][{_SERIAL}]{{8}}[0-9]")),
)


def recognized(text: Column, wanted: Collection[str] | None = None) -> Column:
    """Spans (start, end, entity, score) of what the recognizers find, by place and then by entity; of ``wanted`` entities alone, if given."""
    none = F.array().cast(SPANS)
    parts = [
        F.when(may(text), _spans(text, pattern, entity, score, valid)).otherwise(none)
        for entity, pattern, score, valid, may in RECOGNIZERS
        if wanted is None or entity in wanted
    ]
    return F.array_sort(F.concat(none, *parts))


#: Takes texts and gives each one's spans of (start, end, entity, score), for instance by a model of names.
Analyze = Callable[[list[str]], list[list[tuple[int, int, str, float]]]]


def analysed(text: Column, analyze: Analyze) -> Column:
    """Spans that a callable of the user's finds, asked for a batch of texts at a time; null texts have none."""

    @F.pandas_udf(SPANS)
    def found(texts: pd.Series) -> pd.Series:
        own = texts.dropna()
        told = dict(zip(own.index, analyze(own.tolist()), strict=True)) if len(own) else {}
        names = ("start", "end", "entity", "score")
        return pd.Series([[dict(zip(names, span, strict=True)) for span in told.get(i, [])] for i in texts.index])

    return found(text)


def _spans(text: Column, pattern: str, entity: str, score: float, valid) -> Column:
    placed = T.matches(text, pattern)
    if valid is not None:
        placed = F.filter(placed, lambda m: valid(m["s"]))
    return F.transform(placed, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(entity).alias("entity"), F.lit(score).alias("score")))


def value_type(entity: Column) -> Column:
    """The type that a value of an entity has; what isn't mapped is an id."""
    out = F.lit("id")
    for name, kind in VALUE_TYPE.items():
        out = F.when(entity == name, kind).otherwise(out)
    return out


def from_spans(pages: DataFrame, keys: list[str], text: str = "text", spans: str = "spans") -> DataFrame:
    """(*keys, pos, text, entity, score): the spans worth checking, the first of each text and entity on a page."""
    rows = pages.select(*keys, F.col(text).alias("__page"), F.posexplode_outer(spans).alias("pos", "s")).where("s is not null")
    flagged = F.trim(F.regexp_replace(F.expr("substring(__page, s.start + 1, s.end - s.start)"), r"\s+", " "))
    rows = rows.select(*keys, "pos", flagged.alias("text"), F.col("s.entity").alias("entity"), F.col("s.score").alias("score"))
    rows = rows.where(F.col("entity").isin(*ENTITIES) & (F.col("score") >= MIN_SCORE) & (F.length(T.norm(F.col("text"))) >= MIN_CHARS))
    first = F.row_number().over(Window.partitionBy(*keys, "text", "entity").orderBy("pos"))
    return rows.withColumn("__n", first).where("__n = 1").drop("__n").withColumn("score", F.bround("score", 2))


def find(pages: DataFrame, keys: list[str], text: str = "text", wanted: Collection[str] | None = None, analyze: Analyze | None = None) -> DataFrame:
    """The candidates of each page's text; blank pages have none and aren't shown to ``analyze``, which adds its spans to the recognizers'."""
    spans = recognized(F.col(text), wanted)
    if analyze is not None:
        more = analysed(F.col(text), analyze)
        spans = F.array_sort(F.concat(spans, more if wanted is None else F.filter(more, lambda s: s["entity"].isin(*wanted))))
    own = pages.where(F.trim(F.col(text)) != "").select(*keys, F.col(text).alias("text"), spans.alias("spans"))
    return from_spans(own, keys)


def unconfirmed(candidates: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates that no value of the same page covers: an anti join on the page and containment."""
    v = values.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("text").alias("__value"))
    on = T.covered(F.col("text"), F.col("__value"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"__{k}"))
    return candidates.join(v, on, "left_anti")


def confirmed(candidates: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    v = values.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("text").alias("__value"))
    on = T.covered(F.col("text"), F.col("__value"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"__{k}"))
    return candidates.join(v, on, "left_semi")
