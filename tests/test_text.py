import re

import pytest
from pyspark.sql import functions as F

from maskwright.functions import dates
from maskwright.functions import text as T


@pytest.fixture(scope="module")
def ask(spark):
    """Evaluate one function on rows of strings, all in one job."""

    def run(fn, rows):
        rows = [r if isinstance(r, tuple) else (r,) for r in rows]
        names = [f"c{i}" for i in range(len(rows[0]))]
        frame = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "n int, " + ", ".join(f"{n} string" for n in names))
        return [r.v for r in frame.select("n", fn(*map(F.col, names)).alias("v")).orderBy("n").collect()]

    return run


def test_normal_forms(ask):
    assert ask(T.norm, ["Müller-Lüdenscheidt, 12a", "Straße", ""]) == ["MÜLLERLÜDENSCHEIDT12A", "STRASSE", ""]
    assert ask(T.folded_digits, ["O1-IZS B", "Terminal-ID 7", "OIl"]) == ["01125", "7", ""]
    assert ask(T.same_digits, [("10117 Berlin", "10117 BERLN"), ("10178 Berlin", "10117 Berlin"), ("Keller", "Kel1er")]) == [True, False, True]
    slips = [("66128244", "Terminal-ID 66128344"), ("10117 BERLIN", "10178 Berlin"), ("8001", "0800"), ("662824", "662834"), ("4512", "4513")]
    assert ask(T.one_slip, slips) == [True, False, False, True, False]


def test_amounts(ask):
    yes = ["146,50 EUR", "3.450 Bits", "18,50", "1.234,56 €", "0,00%", "19 %", "€ 18,50", "-5 EUR"]
    no = ["60120873", "12.07.2026", "00 075 00", "19:10 Uhr", "- 5 EUR", "+ 18,50"]
    assert ask(T.is_amount, yes + no) == [True] * len(yes) + [False] * len(no)


def test_case_and_mail(ask):
    assert ask(T.match_case, [("Mira Vogt", "LEON"), ("Mira Vogt", "leon"), ("Mira", "Leon"), ("Mira", "12"), ("Mira", "ß é")]) == ["MIRA VOGT", "mira vogt", "Mira", "Mira", "mira"]
    assert ask(T.ascii_mail, ["Jörg Weiß"]) == ["joerg weiss"]
    assert ask(T.covered, [("Tel. 030 555-014", "030 555014"), ("", "x"), ("-", "x"), ("ab", "xaby")]) == [True, False, False, True]


def test_pieces_and_digit_runs(ask):
    cases = [("Leon Hartmann", "person"), ("DE89 3704.0044-05", "iban"), ("A 1", "id"), ("leon.h@web.example", "email")]
    assert ask(T.pieces, cases) == [["HARTMANN", "LEON", "LEONHARTMANN"], ["8937040044" + "05", "DE893704004405"], [], ["LEON", "LEONH"]]
    assert sorted(ask(T.digit_runs, ["12.07.2026 A1 22 33"])[0]) == sorted("12072026 1 22 33 2233".split())
    assert sorted(ask(T.digit_runs, [" 00 075 00 x"])[0]) == sorted({"00", "00075", "0007500", "075", "07500"})


def test_shapes(ask):
    seeds = [f"{k}" for k in range(30)]
    for old in ["A1b-2 ****-XX99xx", "007", "Ä-1 x", "", "xx"]:
        for new in ask(lambda s, o=old: T.same_shape(F.lit(old), s), seeds):
            shape = lambda s: re.sub("[0-9]", "9", re.sub("[A-Z]", "A", re.sub("[a-z]", "a", s)))
            assert shape(new) == shape(old) and len(new) == len(old)
            assert [c for c in new if not c.isalnum()] == [c for c in old if not c.isalnum()]
            if old == "007":
                assert new[0] != "0"
    assert ask(lambda s: T.same_shape(F.lit("A1b-2 ****-XX99xx"), s), ["1"])[0][-6:-4] == "XX"


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def test_cards_and_ibans(ask):
    seeds = [str(k) for k in range(20)]
    for new in ask(lambda s: T.card_like(F.lit("4111 1111-1111 1111."), s), seeds):
        assert luhn(re.sub(r"\D", "", new)) and re.fullmatch(r"\d{4} \d{4}-\d{4} \d{4}\.", new)
    assert all(x.startswith("************") and len(x) == 16 for x in ask(lambda s: T.card_like(F.lit("************7318"), s), seeds))
    assert ask(T.iban_check, [("DE", "370400440532013000"), ("GB", "WEST12345698765432")]) == ["89", "82"]
    for new in ask(lambda s: T.iban_like(F.lit("IBAN: GB82 WEST 1234 5698 7654 32"), s), seeds):
        assert re.fullmatch(r"IBAN: GB\d\d WEST \d{4} \d{4} \d{4} \d\d", new)
        bare = new[6:].replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1
    assert re.fullmatch(r"[A-Z]\d-\d", ask(lambda s: T.iban_like(F.lit("X1-2"), s), ["1"])[0])


DATES_20 = {
    "12.07.26": "01.08.26", "12.07.2026": "01.08.2026", "13.07.": "02.08.", "2026-07-12": "2026-08-01", "12/07/2026": "01/08/2026",
    "1. Juli 2026": "21. Juli 2026", "01 Jul 2026": "21 Jul 2026", "Jul 01 2026": "Jul 21 2026", "July 1, 2026": "July 21, 2026",
    "Juli 2026": "August 2026", "DEZEMBER 2026": "JANUAR 2027", "31.02.2026": "31.02.2026", "12.07,50": "12.07,50", "146,50 EUR": "146,50 EUR", "MÄRZ 2026": "APRIL 2026",
}


def test_dates(ask):
    assert ask(lambda t: dates.shift(t, 20), list(DATES_20)) == list(DATES_20.values())
    assert ask(lambda t: dates.shift(t, 1), ["29.02.", "am 31.07.2026, 17:49", "from 1.1.26 to 31.12.2026!", "31.12.9999", None]) == ["01.03.", "am 01.08.2026, 17:49", "from 2.1.26 to 01.01.2027!", "31.12.9999", None]
    assert ask(lambda t: dates.shift(t, 30), ["1. Sept. 2026"]) == ["1. Oct. 2026"]
    assert ask(lambda t: dates.shift(t, 60), ["August 2026", "8.12.20.105"]) == ["October 2026", "6.02.21.105"]
    assert ask(lambda t: dates.shift(t, -20), ["Januar 2026"]) == ["Dezember 2025"]


def test_times(ask):
    assert ask(lambda t: dates.shift_times(t, 15), ["23:50:07", "x 9:05 y"]) == ["00:05:07", "x 09:20 y"]
    assert ask(lambda t: dates.shift_times(t, -20), ["0:10"]) == ["23:50"]


def test_numbers_on_a_page(ask):
    page = "No. 00 075 00 x A1 22 33-44 B7C 1234567 89"
    pieces = {"00075": True, "0007500": True, "07500": True, "075": True, "122": False, "22": True, "223344": True, "3344": True, "7": True, "45678": False, "345678": True, "567890": False, "123456789": True, "4567": False}
    got = ask(lambda p: T.on_page(p, T.norm(F.lit(page)), T.number_line(F.lit(page))), list(pieces))
    assert got == list(pieces.values())


def tax_check(ten):
    p = 10
    for c in ten:
        p = 2 * ((int(c) + p) % 10 or 10) % 11
    return str((11 - p) % 10)


def insurance_check(letter, eight):
    digits = f"{ord(letter) - 64:02d}{eight}"
    return str(sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits)) % 10)


def test_german_ids(ask):
    numbers = ["1234567890", "8609574271", "4792506845", "9999999999"]
    right = [n + tax_check(n) for n in numbers]
    wrong = [n[:-1] + str((int(n[-1]) + 1) % 10) for n in right]
    assert right[1] == "86095742719"
    assert ask(T.tax_id_ok, [*right, *wrong, "0123456789" + tax_check("0123456789"), "123"]) == [True] * 4 + [False] * 6
    cards = [("A", "12345678"), ("Z", "00000000"), ("M", "98765432")]
    right = [a + b + insurance_check(a, b) for a, b in cards]
    wrong = [n[:-1] + str((int(n[-1]) + 1) % 10) for n in right]
    assert right[0] == "A123456780"
    assert ask(T.insurance_id_ok, [*right, *wrong, "a123456780"]) == [True] * 3 + [False] * 4
