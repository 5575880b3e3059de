"""Chat formatting by multi-party perspective rotation (operator 4).

For every participant of a conversation the dialogue is written once with that speaker as the
assistant and all others as named users; what the speaker says is what the masks mark.

A conversation is brought together once, its repeated turns dropped before and after the shuffle;
the speakers are read off the gathered turns, and each renders them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions.arrays import once, running

#: Roles that give context and take no perspective.
CONTEXT = ("system",)
UNNAMED = "unknown"
END = "<|end|>\n"


def _header(role: Column, perspective: Column) -> Column:
    return (
        F.when(role == perspective, F.lit("<|assistant|>\n"))
        .when(role.isin(*CONTEXT), F.concat(F.lit("<|"), role, F.lit("|>\n")))
        .otherwise(F.concat(F.lit('<|user name="'), role, F.lit('"|>\n')))
    )


def _replaced(x: Column, *pairs: tuple[str, str]) -> Column:
    for old, new in pairs:
        x = F.replace(x, F.lit(old), F.lit(new))
    return x


def rotate(conversations: DataFrame, part_turns: int | None = None) -> DataFrame:
    """(conv_id, perspective, n_turns, rendered, masks) from conv_id, turn, role and text.

    ``masks`` holds (start, end) in code points of ``rendered``: an assistant turn's text and its
    end mark. Turns are in order, null turns after all others, ties by role and then text; repeated
    rows count once. Null roles are ``unknown``, null texts empty, and a null conversation is one
    conversation. In texts ``<|`` is written ``<\\|``; in names backslashes, quotation marks and
    line ends are escaped as well, so no name ends its header. A conversation without participants
    but the context has no rows. Other columns aren't read.

    A whole conversation is one row. With ``part_turns``, for logs that are too long for that, a
    column ``part`` numbers pieces of so many turn numbers, each rendered on its own for the
    speakers in it.
    """
    keys = ["conv_id"] if part_turns is None else ["conv_id", "part"]
    text = _replaced(F.coalesce("text", F.lit("")), ("<|", "<\\|"))
    role = _replaced(F.coalesce("role", F.lit(UNNAMED)), ("\\", "\\\\"), ("<|", "<\\|"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"))
    part = [] if part_turns is None else [F.floor(F.col("turn") / part_turns).alias("part")]
    turn = F.struct(F.col("turn").isNull().alias("last"), "turn", role.alias("role"), text.alias("text"))
    turns = conversations.select("conv_id", *part, turn.alias("t")).groupBy(*keys).agg(F.array_sort(F.collect_set("t")).alias("turns"))
    speakers = F.filter(F.array_distinct(F.transform("turns", lambda t: t["role"])), lambda r: ~r.isin(*CONTEXT))
    both = turns.select(*keys, "turns", F.explode(speakers).alias("perspective"))
    pieces = F.transform(
        "turns",
        lambda t: F.struct(
            _header(t["role"], F.col("perspective")).alias("head"),
            F.concat(t["text"], F.lit(END)).alias("body"),
            (t["role"] == F.col("perspective")).alias("own"),
        ),
    )
    both = both.select(*keys, "perspective", F.size("turns").cast("long").alias("n_turns"), pieces.alias("pieces"))
    ends = running(F.transform("pieces", lambda p: F.length(p["head"]) + F.length(p["body"])))
    placed = F.zip_with("pieces", ends, lambda p, e: F.struct(p["own"].alias("own"), (e - F.length(p["body"])).cast("int").alias("start"), e.cast("int").alias("end")))
    masks = once(placed, lambda x: F.transform(F.filter(x, lambda p: p["own"]), lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"))))
    rendered = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"])), "")
    return both.select("conv_id", "perspective", *keys[1:], "n_turns", rendered.alias("rendered"), masks.alias("masks"))
