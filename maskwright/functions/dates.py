"""Dates and times within text, moved while their written form is kept.

A written date is read as its tokens: numbers, a month's name, and what stands between. Its first
token tells the order of day, month and year; moving a date writes new numbers and names into the
same places, so padding, punctuation and length of the year stay what they were.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwright.functions.arrays import once
from maskwright.functions.text import rewrite

# Month names, in German and English, whole and short.
MONTHS = (
    ("Januar", "Februar", "März", "April", "Mai", "Juni", "Juli", "August", "September", "Oktober", "November", "Dezember"),
    ("Jan", "Feb", "Mär", "Apr", "Mai", "Jun", "Jul", "Aug", "Sep", "Okt", "Nov", "Dez"),
    ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"),
    ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"),
)
# Other spellings, by language (row of MONTHS) and month.
SPELLINGS = (("Maerz", 0, 3), ("Sept", 3, 9))
# The written forms: D, M and Y are numbers, YYYY, MM and DD have so many digits, NAME is a month's name,
# a space is any white space, and what stands in brackets may be missing.
FORMS = ("YYYY-MM-DD", "D.M.[Y]", "D/M/Y", "D[.] NAME[.][ YYYY]", "NAME[.] D[,] YYYY", "NAME YYYY")
LEAP = 2000
_LAST = 9999


def _names() -> dict[str, tuple[int, int]]:
    """Lower-case name: its row of ``MONTHS`` and its month. Later rows win, so shared names are English."""
    rows = [(name, row, k) for row, names in enumerate(MONTHS) for k, name in enumerate(names, 1)]
    return {name.lower(): (row, month) for name, row, month in (*rows, *SPELLINGS)}


_BY_NAME = _names()
_SYMBOLS = {
    "YYYY": "[0-9]{4}",
    "NAME": "(?:" + "|".join(sorted(_BY_NAME, key=len, reverse=True)) + ")",
    "MM": "[0-9]{2}",
    "DD": "[0-9]{2}",
    "D": "[0-9]{1,2}",
    "M": "[0-9]{1,2}",
    "Y": "(?:[0-9]{4}|[0-9]{2})",
    " ": r"\s+",
    "[": "(?:",
    "]": ")?",
}


def _compiled(form: str) -> str:
    """A form as a pattern. Numbers of open length don't begin or end within a longer number."""
    out, rest = "", form
    while rest:
        symbol = next((x for x in _SYMBOLS if rest.startswith(x)), rest[0])
        out += _SYMBOLS.get(symbol, "\\" + symbol)
        rest = rest[len(symbol) :]
    if form.startswith("D."):
        # Points join numbers to other things than dates: versions before, amounts after.
        return rf"(?<![0-9.]){out.replace('[0-9]{2})', '[0-9]{2}(?![0-9]))')}(?![0-9]|,[0-9])"
    return (r"(?<![0-9])" if form.startswith("D") else "") + out + ("(?![0-9])" if form.endswith("/Y") else "")


PATTERN = f"(?iu)(?:{'|'.join(map(_compiled, FORMS))})"
_TOKEN = r"[0-9]+|\p{L}+|[^0-9\p{L}]+"
_TIME = r"\b[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?\b"


def _month(name: Column) -> Column:
    """(row, month) of a name, null if it is none."""
    known = F.map_from_arrays(F.array(*map(F.lit, _BY_NAME)), F.array(*[F.struct(F.lit(r).alias("row"), F.lit(m).alias("month")) for r, m in _BY_NAME.values()]))
    return F.try_element_at(known, F.lower(name))


def _like(n: Column, old: Column) -> Column:
    """A number in as many digits as the old, where that was two or four."""
    text = n.cast("string")
    return F.when(F.length(old) == 4, F.lpad(text, 4, "0")).when(F.length(old) == 2, F.lpad(F.right(text, F.lit(2)), 2, "0")).otherwise(text)


def _moved(written: Column, days: Column) -> Column:
    """One matched date, moved; itself if there is no such date or none to move to."""
    return once(F.regexp_extract_all(written, F.lit(_TOKEN), F.lit(0)), lambda tokens: once(_read(tokens, days), lambda r: _written(tokens, r, written)))


def _read(tokens: Column, days: Column) -> Column:
    """Where day, month and year stand among the tokens (-1 is nowhere), the month's name, and the new date."""
    number = lambda s: s.try_cast("int")
    first = F.get(tokens, F.lit(0))
    named_first = ~first.rlike("^[0-9]")
    alone = named_first & (F.size(tokens) < 5)
    orders = ((alone, (-1, 0, 2)), (named_first, (2, 0, 4)), (F.length(first) == 4, (4, 2, 0)))
    at = [reduce(lambda other, x: F.when(x[0], x[1][k]).otherwise(other), reversed(orders), F.lit((0, 2, 4)[k])) for k in range(3)]  # noqa: B023
    day, month, year = (F.get(tokens, x) for x in at)
    name = _month(month)
    y = F.when(year.isNull(), LEAP).when(F.length(year) == 2, number(year) + 2000).otherwise(number(year))
    # As text, since a cast of what is no date gives null.
    begin = F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.coalesce(name["month"], number(month)), F.coalesce(number(day), F.lit(1))).try_cast("date")
    # A month alone moves by whole months, by one at least.
    months = F.rint(days / 30.44).cast("int")
    months = F.when(days > 0, F.greatest(months, F.lit(1))).otherwise(F.least(months, F.lit(-1)))
    to = F.when(alone, F.add_months(begin, months)).otherwise(F.date_add(begin, days))
    return F.struct(*[x.alias(n) for n, x in zip("dmy", at, strict=True)], name["row"].alias("row"), to.alias("to"))


def _written(tokens: Column, r: Column, otherwise: Column) -> Column:
    """The new date in the old one's form."""
    styles = F.array(*[F.array(*map(F.lit, names)) for names in MONTHS])
    old = F.get(tokens, r["m"])
    name = F.get(F.get(styles, r["row"]), F.month(r["to"]) - 1)
    upper = (F.length(old) > 1) & (F.upper(old) == old)
    name = F.when(upper, F.upper(name)).when(F.lower(old) == old, F.lower(name)).otherwise(name)

    def put(t: Column, i: Column) -> Column:
        return (
            F.when(i == r["d"], _like(F.day(r["to"]), t))
            .when(i == r["m"], F.when(r["row"].isNull(), _like(F.month(r["to"]), t)).otherwise(name))
            .when(i == r["y"], _like(F.year(r["to"]), t))
            .otherwise(F.regexp_replace(t, r"\s+", " "))
        )

    return F.when(F.year(r["to"]) <= _LAST, F.array_join(F.transform(tokens, put), "")).otherwise(otherwise)


def shift(text: Column, days: Column | int) -> Column:
    """Every date in ``text`` moved by ``days``, padding, names, case and length of the year kept.

    What isn't a date stays, and so does a date that would leave the years up to 9999.
    """
    days = F.lit(days) if isinstance(days, int) else days
    # A text that is one date and nothing else, as values are, needs no search.
    whole = (text != "") & (F.regexp_extract(text, PATTERN, 0) == text)
    return F.when(whole, _moved(text, days)).when(text.rlike(PATTERN), rewrite(text, PATTERN, lambda m: _moved(m, days))).otherwise(text)


def shift_times(text: Column, minutes: Column | int) -> Column:
    """Every ``H:MM[:SS]`` moved by ``minutes`` within the day, the hour in two digits."""
    minutes = F.lit(minutes) if isinstance(minutes, int) else minutes

    def moved(m: Column) -> Column:
        parts = F.split(m, ":")
        t = F.pmod(parts[0].cast("int") * 60 + parts[1].cast("int") + minutes, F.lit(1440))
        clock = F.concat(F.lpad(F.floor(t / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((t % 60).cast("string"), 2, "0"))
        return F.when(F.size(parts) > 2, F.concat(clock, F.lit(":"), F.get(parts, F.lit(2)))).otherwise(clock)

    return rewrite(text, _TIME, moved)
