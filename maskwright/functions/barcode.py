"""Code 128: digits as symbols and bar widths, and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwright.functions.arrays import once
from maskwright.functions.text import characters

# Bar and space widths of the symbols 0 to 105 and of the stop pattern (ISO/IEC 15417).
WIDTHS = (
    "212222", "222122", "222221", "121223", "121322", "131222", "122213", "122312", "132212", "221213",
    "221312", "231212", "112232", "122132", "122231", "113222", "123122", "123221", "223211", "221132",
    "221231", "213212", "223112", "312131", "311222", "321122", "321221", "312212", "322112", "322211",
    "212123", "212321", "232121", "111323", "131123", "131321", "112313", "132113", "132311", "211313",
    "231113", "231311", "112133", "112331", "132131", "113123", "113321", "133121", "313121", "211331",
    "231131", "213113", "213311", "213131", "311123", "311321", "331121", "312113", "312311", "332111",
    "314111", "221411", "431111", "111224", "111422", "121124", "121421", "141122", "141221", "112214",
    "112412", "122114", "122411", "142112", "142211", "241211", "221114", "413111", "241112", "134111",
    "111242", "121142", "121241", "114212", "124112", "124211", "411212", "421112", "421211", "212141",
    "214121", "412121", "111143", "111341", "131141", "114113", "114311", "411113", "411311", "113141",
    "114131", "311141", "411131", "211412", "211214", "211232",
)
STOP = "2331112"
START_B, START_C, CODE_B = 104, 105, 100
_INTS = "array<int>"


def symbols(number: Column) -> Column:
    """Start, digit pairs, an odd last digit in set B, and the check symbol; null for what isn't digits."""
    n = F.length(number)
    pairs = F.when(n >= 2, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)), F.lit(2)), lambda i: F.substring(number, i, F.lit(2)).cast("int")))
    pairs = F.coalesce(pairs, F.array().cast(_INTS))
    odd = F.when(n % 2 == 1, F.array(F.lit(CODE_B), F.ascii(F.substring(number, -1, 1)) - 32)).otherwise(F.array().cast(_INTS))
    body = F.concat(F.array(F.lit(START_C)), pairs, odd)
    whole = once(body, lambda b: F.concat(b, F.array(_check(b))))
    return F.when(number.rlike("^[0-9]+$"), whole)


def _check(body: Column) -> Column:
    weighted = F.transform(body, lambda s, i: s * F.greatest(i, F.lit(1)))
    return F.aggregate(weighted, F.lit(0).cast("bigint"), lambda a, x: a + x, lambda a: (a % 103).cast("int"))


def widths(number: Column) -> Column:
    """Module widths, beginning with a bar, with the stop pattern; null for what isn't digits."""
    table = F.array(*map(F.lit, WIDTHS))
    text = F.concat(F.array_join(F.transform(symbols(number), lambda s: F.get(table, s)), ""), F.lit(STOP))
    return F.transform(characters(text), lambda c: c.cast("int"))


def decode(modules: Column) -> Column:
    """The digits of module widths; null unless they are symbols of sets C and B with a right check and stop."""
    return once(modules, lambda m: once(F.array_join(F.transform(m, lambda x: x.cast("string")), ""), lambda text: _read(m, text)))


def _read(modules: Column, text: Column) -> Column:
    """The digits of ``modules``, whose widths are written one after another in ``text``."""
    n = F.size(modules)
    known = F.create_map(*[F.lit(x) for k, w in enumerate(WIDTHS) for x in (w, k)])
    count = F.floor((n - 7) / 6).cast("int")
    got = F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: F.element_at(known, F.substring(text, i * 6 + 1, F.lit(6))))
    shaped = (n >= 13) & ((n - 7) % 6 == 0) & (F.length(text) == n) & (F.substring(text, n - 6, F.lit(7)) == STOP)
    return once(got, lambda found: F.when(shaped, _said(found)))


def _said(got: Column) -> Column:
    """The digits of symbols; null if one is none or the check symbol isn't right."""
    body = F.slice(got, 1, F.greatest(F.size(got) - 1, F.lit(0)))
    right = (F.size(got) >= 2) & F.get(got, F.lit(0)).isin(START_B, START_C) & (_check(body) == F.element_at(got, -1))
    begin = F.struct((F.get(got, F.lit(0)) == START_C).alias("c"), F.lit("").alias("out"))

    def step(s: Column, x: Column) -> Column:
        said = F.when(x == CODE_B, F.lit("")).when(s["c"] & (x < 100), F.lpad(x.cast("string"), 2, "0")).when(~s["c"] & x.between(16, 25), (x - 16).cast("string"))
        return F.struct((s["c"] & (x != CODE_B)).alias("c"), F.concat(s["out"], said).alias("out"))

    read = F.aggregate(F.slice(body, 2, F.greatest(F.size(body) - 1, F.lit(0))), begin, step, lambda s: s["out"])
    return F.when(~F.exists(got, lambda x: x.isNull()) & right, read)
