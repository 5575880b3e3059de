"""Column functions on the text of personal values: normal forms, look-alikes, shapes and checksums.

All stay inside the JVM. Character classes are ASCII but where a letter is named.
"""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwright.functions.arrays import once, running

# Value types whose words don't identify anyone, and those that can be a business's own.
NUMBER_TYPES = ("id", "card", "iban", "phone", "date", "time")
PLACE_TYPES = ("city", "street")
VALUE_TYPES = ("person", "street", "city", "email", "phone", "date", "time", "id", "card", "iban")
EDGE_PUNCTUATION = " \t:;,=-–—|("
# Letters that a reader takes for digits, and the digits.
LOOK_ALIKES = ("OoIlZzSBG", "001122586")
#: Letters that invented codes are made of: all but those that could be read as a one or a zero.
SHAPE_LOWER = "".join(x for x in ascii_lowercase if x not in "iloq")
SHAPE_UPPER = "".join(x for x in ascii_uppercase if x not in "IOQ")
# What a sum of money is written with.
CURRENCY = ("EUR", "€")
SLIP_DIGITS = 6
LONG_DIGITS = 6
PIECE_LENGTH = 4


def rewrite(text: Column, pattern: str, change: Callable[[Column], Column]) -> Column:
    """``text`` with every match of ``pattern`` put through ``change``.

    The gaps between the matches and the changed matches are put together again in turn.
    """
    gaps = F.split(text, pattern, -1)
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), change)
    both = F.zip_with(gaps, F.concat(found, F.array(F.lit(""))), lambda g, m: F.concat(g, m))
    return F.array_join(both, "")


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as (start, end, s), places in code points; none for null.

    The lengths of the gaps and of the matches, summed, give the places.
    """

    def placed(found: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(found))
        ends = running(F.zip_with(gaps, found, lambda g, s: F.length(g) + F.length(s)))
        return F.zip_with(found, ends, lambda s, e: F.struct((e - F.length(s)).cast("int").alias("start"), e.cast("int").alias("end"), s.alias("s")))

    return once(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def characters(s: Column) -> Column:
    """The characters of a text, in an array."""

    def every(s: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.substring(s, i, F.lit(1)))
        return F.when(F.length(s) > 0, cut).when(s.isNotNull(), F.array().cast("array<string>"))

    # What a function of the elements mentions is computed anew for each element.
    return once(s, every)


def norm(s: Column) -> Column:
    """Upper case, letters and digits only."""
    return F.regexp_replace(F.upper(s), "[^0-9A-ZÄÖÜß]", "")


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def same_digits(value: Column, candidate: Column) -> Column:
    return (digits(value) == "") | (digits(value) == digits(candidate))


def folded_digits(s: Column) -> Column:
    """The digits of a reading; in words that hold a digit, look-alike letters count as theirs."""
    fold = lambda w: digits(F.when(w.rlike("[0-9]"), F.translate(w, *LOOK_ALIKES)).otherwise(w))
    return F.array_join(F.transform(F.split(s, r"\s+"), fold), "")


def one_slip(value: Column, reading: Column) -> Column:
    """Equal folded digits, or with six digits and more, at most one of them misread, lost or added."""
    a, b = folded_digits(value), folded_digits(reading)
    return (a == b) | ((F.length(a) >= SLIP_DIGITS) & F.levenshtein(a, b, 1).between(0, 1))


def is_amount(s: Column) -> Column:
    """A sum of money, a percentage, or a number with a unit word.

    The text is cut into a currency sign, a number and a unit. A unit makes any number an amount;
    without one, or with a sign before it, the number has to be written as money: thousands in
    groups of three after points, and two decimals after a comma. Only a currency sign may have blanks behind it: "- 5 EUR" is
    a dash and a sum, no amount.
    """
    cut = lambda k: F.regexp_extract(F.trim(s), r"^[-+]?((?:€\s*)?)([0-9][0-9.,]*)\s*(.*)$", k)
    sign, number, unit = cut(1), cut(2), cut(3)
    counted = unit.isin("%", *CURRENCY) | unit.rlike("^[A-Z][a-z]+$")
    sides = F.split(number, ",")
    groups = F.split(F.get(sides, F.lit(0)), "[.]")
    whole = F.length(F.get(groups, F.lit(0))).between(1, 3) & F.forall(F.slice(groups, 2, F.size(groups)), lambda g: F.length(g) == 3)
    money = (F.size(sides) == 2) & (F.length(F.get(sides, F.lit(1))) == 2) & ~F.contains(F.get(sides, F.lit(1)), F.lit(".")) & whole
    return (number != "") & (((sign == "") & counted) | (unit.isin("", *CURRENCY) & money))


def match_case(new: Column, old: Column) -> Column:
    """``new`` in upper or lower case if all letters of ``old`` are."""
    letters = F.regexp_replace(old, r"[^\p{L}]", "")
    return (
        F.when(letters == "", new)
        .when(~letters.rlike(r"[^\p{Lu}]"), F.upper(new))
        .when(~letters.rlike(r"[^\p{Ll}]"), F.lower(new))
        .otherwise(new)
    )


def ascii_mail(s: Column) -> Column:
    out = F.lower(s)
    for letter, written in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        out = F.replace(out, F.lit(letter), F.lit(written))
    return out


def covered(candidate: Column, value: Column) -> Column:
    """Whether the two hold each other, by their normal forms, neither being empty."""
    c, v = norm(candidate), norm(value)
    return (c != "") & (v != "") & (F.contains(c, v) | F.contains(v, c))


def strip_edges(s: Column) -> Column:
    return F.btrim(s, F.lit(EDGE_PUNCTUATION))


# -- checks ---------------------------------------------------------------------------------------


def luhn_ok(number: Column) -> Column:
    return F.call_function("luhn_check", number)


def iban_check(country: Column, bban: Column) -> Column:
    """The two check digits of ISO 13616, by remainders of one character at a time."""
    alphabet = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def step(rest: Column, c: Column) -> Column:
        v = F.position(c, F.lit(alphabet)) - 1
        return (rest * F.when(v > 9, 100).otherwise(10) + v) % 97

    rest = F.aggregate(characters(F.concat(bban, country, F.lit("00"))), F.lit(0), step)
    return F.lpad((98 - rest).cast("string"), 2, "0")


def tax_id_ok(number: Column) -> Column:
    """Whether the last of eleven digits checks the others by ISO 7064, modulus 11 and 10."""

    def step(product: Column, c: Column) -> Column:
        total = (product + c.cast("int")) % 10
        return F.when(total == 0, 10).otherwise(total) * 2 % 11

    product = F.aggregate(characters(F.substring(number, 1, 10)), F.lit(10), step)
    return number.rlike("^[1-9][0-9]{10}$") & ((11 - product) % 10 == F.right(number, F.lit(1)).try_cast("int"))


def insurance_id_ok(number: Column) -> Column:
    """Whether the last digit of a letter and nine digits checks the others.

    The letter counts as its two-digit place in the alphabet; every second digit is doubled, and all
    digits of what comes out are summed.
    """
    place = F.lpad((F.ascii(number) - ord("A") + 1).cast("string"), 2, "0")
    told = characters(F.concat(place, F.substring(number, 2, 8)))
    worth = F.transform(told, lambda c, i: c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1))
    total = F.aggregate(worth, F.lit(0), lambda n, x: n + x % 10 + F.floor(x / 10).cast("int"))
    return number.rlike("^[A-Z][0-9]{9}$") & (total % 10 == F.right(number, F.lit(1)).try_cast("int"))


def card_number_ok(number: Column) -> Column:
    """Whether the last digit of a travel document's number checks the others: weights of 7, 3 and 1 in turn, letters from 10 on."""
    told = characters(F.left(number, F.length(number) - 1))
    worth = lambda c: F.when(c.rlike("[0-9]"), c.try_cast("int")).otherwise(F.ascii(c) - ord("A") + 10)
    weighed = F.transform(told, lambda c, i: worth(c) * F.get(F.array(*map(F.lit, (7, 3, 1))), (i % 3).cast("int")))
    total = F.aggregate(weighed, F.lit(0), lambda n, x: n + x)
    return number.rlike("^[A-Z0-9]+[0-9]$") & (total % 10 == F.right(number, F.lit(1)).try_cast("int"))


# What the twelve digits of a social insurance number weigh.
SOCIAL_WEIGHTS = (2, 1, 2, 5, 7, 1, 2, 1, 2, 1, 2, 1)


def social_id_ok(number: Column) -> Column:
    """Whether the last digit of eight digits, a letter and three digits checks the others; the letter counts as its place in the alphabet."""
    place = F.lpad((F.ascii(F.substring(number, 9, 1)) - ord("A") + 1).cast("string"), 2, "0")
    told = characters(F.concat(F.left(number, F.lit(8)), place, F.substring(number, 10, 2)))
    worth = F.transform(told, lambda c, i: c.try_cast("int") * F.get(F.array(*map(F.lit, SOCIAL_WEIGHTS)), i.cast("int")))
    total = F.aggregate(worth, F.lit(0), lambda n, x: n + x % 10 + F.floor(x / 10).cast("int"))
    return number.rlike("^[0-9]{8}[A-Z][0-9]{3}$") & (total % 10 == F.right(number, F.lit(1)).try_cast("int"))


# -- invention ------------------------------------------------------------------------------------


def number_of(*parts: Column) -> Column:
    """A reproducible number of 32 bits from the parts: the first digits of an MD5 hash."""
    digest = F.md5(F.concat_ws("\u001f", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def pick(pool: tuple[str, ...] | str, number: Column) -> Column:
    return F.get(F.array(*map(F.lit, pool)), (number % len(pool)).cast("int"))


def _shaped(c: Column, i: Column, drawn: Column, old: Column, first: Column) -> Column:
    """The character in place of ``c``, the ``i``-th of ``old``, by hexadecimal digits ``drawn``."""
    n = F.conv(F.substring(drawn, 2 * i + 1, F.lit(2)), 16, 10).cast("int")
    return (
        F.when(c.rlike("[0-9]"), F.when(i + 1 == first, n % 9 + 1).otherwise(n % 10).cast("string"))
        .when(c.rlike("[A-Z]"), pick(SHAPE_UPPER, n))
        .when(c.rlike("[a-z]"), pick(SHAPE_LOWER, n))
        .otherwise(F.substring(old, i + 1, F.lit(1)))
    )


def same_shape(old: Column, *seed: Column) -> Column:
    """New digits and ASCII letters in the places of the old; masks (``XX``) and all else stay.

    The first digit that changes isn't zero. Each character has two digits of an MD5 hash, so one
    hash is enough for sixteen of them.
    """
    open_ = F.when(old.rlike("[Xx]{2}"), rewrite(old, "[Xx]{2,}", lambda m: F.regexp_replace(m, "[Xx]", "*"))).otherwise(old)
    digest = lambda k: F.md5(F.concat_ws("\u001f", *[p.cast("string") for p in (*seed, k)]))
    drawn = F.array_join(F.transform(F.sequence(F.lit(0), F.floor(F.length(old) / 16).cast("int")), digest), "")
    given = F.struct(old.alias("old"), open_.alias("open"), drawn.alias("drawn"))

    def shaped(g: Column) -> Column:
        first = F.regexp_instr(g["open"], F.lit("[0-9]"))
        return once(first, lambda n: F.array_join(F.transform(characters(g["open"]), lambda c, i: _shaped(c, i, g["drawn"], g["old"], n)), ""))

    return once(given, shaped)


def card_like(old: Column, *seed: Column) -> Column:
    """New digits in the old layout; a whole unmasked number keeps a valid check digit."""
    new = same_shape(old, *seed)
    number = digits(new)
    body = F.substring(number, F.lit(1), F.length(number) - 1)
    tries = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda c: c.cast("string"))
    check = F.get(F.filter(tries, lambda c: luhn_ok(F.concat(body, c))), F.lit(0))
    last = F.length(F.regexp_extract(new, "^(.*)[0-9][^0-9]*$", 1)) + 1
    valid = F.concat(F.substring(new, F.lit(1), last - 1), check, F.substring(new, last + 1, F.length(new)))
    whole = (F.length(number) >= 12) & ~old.rlike(r"[*#•]|[Xx]{2,}")
    return F.when(whole, valid).otherwise(new)


def iban_like(old: Column, *seed: Column) -> Column:
    """A valid IBAN of the old one's country, length and spacing; without an IBAN, the same shape."""
    iban = F.regexp_extract(F.regexp_replace(old, r"\s", ""), "[A-Z]{2}[0-9]{2}[A-Z0-9]{8,30}", 0)
    country = F.substring(iban, 1, 2)
    account = F.array_join(
        F.transform(
            characters(F.substring(iban, F.lit(5), F.length(iban))),
            lambda c, i: F.when(c.rlike("[0-9]"), (number_of(*seed, i) % 10).cast("string")).otherwise(c),
        ),
        "",
    )
    new = F.concat(country, iban_check(country, account), account)
    start = F.position(F.substring(iban, 1, 1), old)
    tail = characters(F.substring(old, start, F.length(old)))
    # Each character that isn't white space takes the next of the new number, as long as there are.
    state = F.struct(F.lit(0).alias("n"), F.lit("").alias("out"))

    def step(s: Column, c: Column) -> Column:
        space = c.rlike(r"\s")
        out = F.when(space, c).otherwise(F.substring(new, s["n"] + 1, F.lit(1)))
        return F.struct(F.when(space, s["n"]).otherwise(s["n"] + 1).alias("n"), F.concat(s["out"], out).alias("out"))

    put = F.aggregate(tail, state, step, lambda s: s["out"])
    return F.when(iban == "", same_shape(old, *seed)).otherwise(F.concat(F.substring(old, F.lit(1), start - 1), put))


# -- leaks ----------------------------------------------------------------------------------------


def pieces(value: Column, kind: Column) -> Column:
    """The parts of an old value that would tell it if they came back, four characters and longer."""
    v = F.when(kind == "email", F.substring_index(value, "@", 1)).otherwise(value)
    none = F.array().cast("array<string>")
    words = F.transform(F.regexp_extract_all(v, F.lit("[A-Za-zÄÖÜäöüß]{4,}"), F.lit(0)), norm)
    runs = F.regexp_extract_all(F.regexp_replace(v, r"[.\- ]", ""), F.lit("[0-9]{4,}"), F.lit(0))
    every = F.concat(F.array(norm(v)), F.when(kind.isin(*NUMBER_TYPES), none).otherwise(words), runs)
    parts = F.array_sort(F.array_distinct(F.filter(every, lambda p: F.length(p) >= PIECE_LENGTH)))
    # A plain word is its only part.
    return F.when(value.rlike(f"^[A-Za-z]{{{PIECE_LENGTH},}}\\z"), F.array(F.upper(value))).otherwise(parts)


def digit_runs(text: Column) -> Column:
    """The numbers on a page: digit runs in each word, and all joins of neighbouring all-digit words."""
    none = F.array().cast("array<string>")
    words = F.transform(F.split(F.trim(text), r"\s+"), lambda w: F.regexp_replace(w, r"[.\-/:]", ""))
    begin = F.struct(none.alias("open"), none.alias("out"))

    def step(s: Column, w: Column) -> Column:
        joined = F.concat(F.transform(s["open"], lambda x: F.concat(x, w)), F.array(w))
        number = w.rlike("^[0-9]+$")
        found = F.when(number, joined).otherwise(F.regexp_extract_all(w, F.lit("[0-9]+"), F.lit(0)))
        return F.struct(F.when(number, joined).otherwise(none).alias("open"), F.concat(s["out"], found).alias("out"))

    return F.array_sort(F.array_distinct(F.aggregate(words, begin, step, lambda s: s["out"])))


def number_line(text: Column) -> Column:
    """The numbers on a page in one string as long as the page: ``|`` between all-digit words, ``#`` where no number goes on."""
    words = F.regexp_replace(F.concat(F.lit(" "), text, F.lit(" ")), r"[.\-/:]", "")
    marked = F.regexp_replace(words, r"(?<!\S)([0-9]*[^\s0-9]\S*)", "#$1#")
    return F.regexp_replace(F.regexp_replace(marked, r"[^0-9\s#]+", "#"), r"\s+", "|")


def on_page(piece: Column, page_norm: Column, numbers: Column) -> Column:
    """A word piece anywhere on the page; a digit piece as a number of its own, or, if long, within one.

    ``numbers`` is the page's :func:`number_line`: a number may be printed in several words, so a
    piece is looked for with a border allowed between its digits.
    """
    spread = F.array_join(characters(piece), r"\|?")
    pattern = F.when(F.length(piece) >= LONG_DIGITS, spread).otherwise(F.concat(F.lit("[|#]"), spread, F.lit("[|#]")))
    return F.when(piece.rlike("^[0-9]+$"), F.regexp_like(numbers, pattern)).otherwise(F.contains(page_norm, piece))


def windows(number: Column, size: Column, page_norm: Column, numbers: Column) -> Column:
    """All pieces of ``size`` characters that are on a page as :func:`on_page` has it, by one match at each place; ``number`` tells pieces of digits from words."""
    spread = F.concat(F.lit(r"[0-9](?:\|?[0-9]){"), (size - 1).cast("string"), F.lit("}"))
    pattern = F.when(size >= LONG_DIGITS, F.concat(F.lit("(?=("), spread, F.lit("))"))).otherwise(F.concat(F.lit("(?<=[|#])(?=("), spread, F.lit(")[|#])")))
    digits_ = F.transform(F.regexp_extract_all(numbers, pattern, F.lit(1)), lambda x: F.replace(x, F.lit("|"), F.lit("")))
    letters = F.regexp_extract_all(page_norm, F.concat(F.lit("(?=(.{"), size.cast("string"), F.lit("}))")), F.lit(1))
    return F.when(number, digits_).otherwise(letters)
