"""Finished copies of drawn pages: edits in order, reading back, page keys, leaks."""

import json

import numpy as np
from pyspark.sql import functions as F

from maskwright.operators import pixels as P
from maskwright.plans import finished as N

VALUES = "doc string, page int, pos int, owner string, type string, text string"
PLACES = f"doc string, page int, pos int, place int, how string, printed string, before string, after string, words struct<first:int,last:int>, line_box {N.BOX}, run_box {N.BOX}, next_x int"
KEYS = ["doc", "seed", "page"]


def drawn(*boxes, bars=None):
    g = np.full((120, 400), 240, np.uint8)
    for x0, y0, x1, y1 in boxes:
        for x in range(x0, x1, 8):
            g[y0:y1, x : min(x + 5, x1)] = 0
    if bars:
        x0, y0, x1, y1 = bars
        widths = P.pattern([1], x1 - x0)
        P.draw_bars(g, bars, widths, 240)
    return g


def place(page, pos, n, printed, box, before="", after="", words=None):
    return ("d", page, pos, n, "exact", printed, before, after, words, box, box, None)


def tables(spark):
    values = [("d", 1, 0, "ann", "person", "Ann Berg"), ("d", 1, 1, "ann", "id", "12345678"), ("d", 1, 2, "ann", "id", "XX-XX"), ("d", 2, 0, "ann", "person", "Ann Berg")]
    name, low, number, wrapped = (20, 10, 80, 20), (20, 90, 60, 100), (100, 60, 160, 70), (300, 90, 340, 100)
    places = [place(1, 0, 0, "Ann Berg", name, "(", ","), place(1, 1, 0, "12345678", number), place(2, 0, 0, "Ann", low, words=(0, 1)), place(2, 0, 1, "Berg", wrapped, words=(1, 2))]
    pages = []
    for n, g, text in ((1, drawn(name, number, bars=(60, 30, 196, 50)), "Name: Ann Berg, No 12345678 total"), (2, drawn(low, wrapped), "Dear Ann\nBerg hello"), (3, drawn(bars=(90, 30, 250, 60)), "Berg Street 5")):
        pages.append(("d", n, text, 400, 120, bytearray(g.tobytes())))
    return spark.createDataFrame(values, VALUES), spark.createDataFrame(places, PLACES), spark.createDataFrame(pages, "doc string, page int, text string, width int, height int, gray binary")


def test_context_is_the_text_without_values(spark):
    values, places, pages = tables(spark)
    told = {r.page: r.context for r in N.context(pages.select("doc", "page", "text"), values, places, ["doc", "page"]).collect()}
    assert told == {1: "Name:  , No   total", 2: "Dear  \n  hello", 3: "Berg Street 5"}


def test_edits_share_wrapped_values_and_leave_what_cannot_change(spark):
    from maskwright.plans import copies

    values, places, _ = tables(spark)
    changed = copies.copies(values, places, ["doc"], 1, 7)
    new = {(r.page, r.pos): r.new for r in changed.collect()}
    got = {(r.page, r.pos, r.place): (r.text, r.number) for r in N.edits(changed, places, ["doc"]).collect()}
    first, last = new[2, 0].split()
    assert got == {(1, 0, 0): (f"({new[1, 0]},", None), (1, 1, 0): (new[1, 1], new[1, 1]), (2, 0, 0): (first, None), (2, 0, 1): (last, None)}


def test_finished_copies(spark, tmp_path):
    values, places, pages = tables(spark)
    def writer(gray, box, text):
        """Draws one bar a character, so that a reading can be told from it: as high as its place in a list."""
        gray[box[1] : box[1] + 1, box[0] : box[0] + len(text)] = 0
        return gray, (box[0], box[1], min(gray.shape[1], box[0] + len(text) + 2), box[3])

    texts = {}  # what the stand-in reader says of a crop by its width; filled from the edits
    from maskwright.plans import copies

    changed = copies.copies(values, places, ["doc"], 1, 7)
    for r in N.edits(changed, places, ["doc"]).collect():
        texts[len(r.text) + 2] = r.text
    wrong = next(r.text for r in N.edits(changed, places, ["doc"]).collect() if r.place == 1)

    def read(images):
        return ["zzz" if texts.get(i.shape[1]) == wrong else texts.get(i.shape[1], "?") for i in images]

    def read_page(images):
        # The page with a value over two lines still has the old name; the one with bars alone can't be read.
        return ["Dear Ann Berg" if (i[91, 20:60] < 128).any() or (i[90, 300:340] < 128).any() else "" if (i[10] < 128).sum() == 0 else "Name: somebody" for i in images]

    images, keys = N.finish(pages, values, places, ["doc"], 1, 7, writer, read, read_page)
    keys = keys.persist()
    rows = {r.page: r for r in keys.collect()}
    assert set(rows) == {1, 2, 3}
    one = rows[1]
    assert [(c.pos, c.located, c.read_back_ok) for c in one.changes] == [(0, True, True), (1, True, True), (2, False, False)]
    bar = one.changes[1].places[0]
    assert bar.barcode is not None and bar.barcode.y0 == 30 and one.changes[0].places[0].barcode is None
    assert one.barcodes_scrambled == 0 and one.leak_check.leaked_types == ["id"] and [(x.type, x.pieces) for x in one.leaks] == [("id", ["(unchanged)"])]
    two = rows[2]
    assert len(two.changes[0].places) == 2 and not two.changes[0].read_back_ok and not two.leak_check.passed and two.leak_check.leaked_types == ["person"]
    assert rows[3].changes == [] and rows[3].barcodes_scrambled == 1 and rows[3].leak_check is None
    # Old ink is gone where values stood; the number's own pixels are what the writer drew.
    after = {r.page: np.frombuffer(bytes(r.gray), np.uint8).reshape(120, 400) for r in images.collect()}
    assert not (after[1][12:20, 18:82] < 128).any() and (after[1][10, 20:30] < 128).all()
    assert not (after[1][62:70, 100:160] < 128).any() and (after[1][60, 100:108] < 128).all()
    shown, hidden = N.public(keys), N.private(keys)
    told = json.dumps([r.asDict(True) for r in shown.collect()])
    assert not [v for v in ("Ann Berg", "12345678", "XX-XX", "BERG", "old") if v in told] and "(unchanged)" in told
    assert shown.where("page = 1").first().changes[0].places[0].box == [20, 10, 80, 20]
    assert {c.old for r in hidden.collect() for c in r.changes} == {"Ann Berg", "12345678", "XX-XX"}
    (line,) = N.summaries(shown, ["doc"]).collect()
    assert line.summary == "3 values replaced, 2 read back correctly, 1 barcodes scrambled, leak of id, person"
    for _ in range(2):
        N.write_keys(keys, ["doc"], str(tmp_path / "out"), str(tmp_path / "private"))
    back = spark.read.json(str(tmp_path / "out" / "page_keys"))
    assert back.count() == 3 and "leaks" not in back.columns
    assert spark.read.json(str(tmp_path / "private" / "page_keys")).selectExpr("inline(changes)").where("old = 'Ann Berg'").count() == 2
    keys.unpersist()


def test_without_readers_and_edits(spark):
    values, places, pages = tables(spark)
    images, keys = N.finish(pages, values, places, ["doc"], 2, 3)
    rows = {(r.seed, r.page): r for r in keys.collect()}
    assert len(rows) == 6 and images.count() == 6
    assert all(r.leak_check is None and r.leaks is None for r in rows.values()) and rows[3, 1].changes[0].places[0].read_back_ok is None and rows[3, 1].changes[0].read_back_ok
    lines = {r.seed: r.summary for r in N.summaries(N.public(keys), ["doc"]).collect()}
    assert lines[3] == lines[4] == "3 values replaced, not read back, 1 barcodes scrambled, no leak check"
    bare = N.finish(pages.where("page = 3"), values.limit(0), places.limit(0), ["doc"], 1, 3)[1].collect()
    assert [(r.page, r.changes, r.barcodes_scrambled) for r in bare] == [(3, [], 1)]
    assert N.finish(pages.limit(0), values, places, ["doc"], 1, 3)[1].collect() == []
