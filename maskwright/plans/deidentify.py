"""Documents without their personal values: candidates, invented replacements, new text and verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.functions import text as T
from maskwright.functions.arrays import once
from maskwright.operators import candidates as C
from maskwright.operators import replace as R


def deidentified(docs: DataFrame, seed: int = 1) -> DataFrame:
    """(doc_id, n_found, text, passed): texts with every recognized value replaced, and the leak verdict.

    All of it is row-local: a value's replacement is a hash of the document, the seed and the value,
    so the same value gets the same replacement wherever the document has it, with no shuffle.
    """
    own = docs.select("doc_id", "text", C.recognized(F.col("text")).alias("spans"))
    # Of overlapping spans the first stands.
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(C.SPANS).alias("kept"))

    def keep(state, s):
        more = F.struct(s["end"].alias("at"), F.concat(state["kept"], F.array(s)).alias("kept"))
        return F.when(s["start"] < state["at"], state).otherwise(more)

    own = own.withColumn("spans", F.when(F.size("spans") > 1, F.aggregate("spans", begin, keep, lambda s: s["kept"])).otherwise(F.col("spans")))
    doc = F.col("doc_id")

    def changed(s):
        old = F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"])
        return once(old, lambda o: F.struct(s["start"].alias("start"), s["end"].alias("end"), C.value_type(s["entity"]).alias("type"), o.alias("old"), new(s, o).alias("new")))

    def new(s, old):
        parts = [doc, F.lit(seed), s["entity"], old]
        name = lambda pool, what: T.ascii_mail(T.pick(pool, T.number_of(*parts, F.lit(what))))
        owner = F.concat(name(R.FIRST, "first"), F.lit("."), name(R.LAST, "last"), F.lit("@example.com"))
        return (
            F.when(s["entity"] == "EMAIL_ADDRESS", owner)
            .when(s["entity"] == "CREDIT_CARD", T.card_like(old, *parts))
            .when(s["entity"] == "IBAN_CODE", T.iban_like(old, *parts))
            .when(s["entity"] == "DATE_TIME", R.dates.shift(old, R.day_shift(doc, F.lit(seed))))
            .otherwise(T.same_shape(old, *parts))
        )

    own = own.withColumn("made", F.transform("spans", changed))
    # What stands before each value and the new value, and at last what stands after all.
    pieces = F.transform("made", lambda m, i: F.concat(F.substring(F.col("text"), _end(i - 1) + 1, m["start"] - _end(i - 1)), m["new"]))
    tail = F.substring(F.col("text"), _end(F.size("made") - 1) + 1, F.length("text"))
    own = own.withColumn("text", F.when(F.size("made") == 0, F.col("text")).otherwise(F.concat(F.array_join(pieces, ""), tail)))
    touched = F.size("made") > 0
    own = own.withColumn("page", F.when(touched, T.norm(F.col("text")))).withColumn("numbers", F.when(touched, T.number_line(F.col("text"))))
    left = F.exists(
        "made",
        lambda m: F.exists(
            T.pieces(m["old"], m["type"]),
            lambda p: T.on_page(p, F.col("page"), F.col("numbers")) & ~F.exists("made", lambda n: F.contains(T.norm(n["new"]), p)),
        ),
    )
    return own.select("doc_id", F.size("made").alias("n_found"), "text", F.when(touched, ~left).otherwise(True).alias("passed"))


def _end(i):
    """Where the ``i``-th value ends; the start of the text before the first."""
    return F.when(i < 0, 0).otherwise(F.get("made", i)["end"])
