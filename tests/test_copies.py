from pyspark.sql import functions as F

from maskwright.plans import copies as C


def tables(spark):
    values = spark.createDataFrame(
        [("d", 1, 0, "ann", "person", "Ann Berg"), ("d", 1, 1, "ann", "phone", "0301234567"), ("d", 2, 0, "ann", "person", "Ann Berg"), ("d", 2, 1, "bob", "id", "XX-XX")],
        "doc string, page int, pos int, owner string, type string, text string",
    )
    places = spark.createDataFrame(
        [("d", 1, 0, 0, "ocr", "Ann Berg", None), ("d", 1, 1, 0, "ocr", "0301234568", None), ("d", 1, 1, 1, "ocr", "0301234568", None), ("d", 2, 0, 0, "pixels", "Ann Berg", None)],
        "doc string, page int, pos int, place int, how string, printed string, words int",
    )
    return values, places


def test_copies_change_alike_and_differ_by_seed(spark, tmp_path):
    values, places = tables(spark)
    changed = C.copies(values, places, ["doc"], 3, 7)
    rows = changed.collect()
    assert {r.seed for r in rows} == {7, 8, 9} and len(rows) == 12
    for seed in (7, 8, 9):
        own = {(r.page, r.pos): r for r in rows if r.seed == seed}
        assert own[1, 0].new == own[2, 0].new != "Ann Berg"
        assert (own[1, 1].old, own[1, 1].n_places, len(own[1, 1].new)) == ("0301234568", 2, 10)
        assert own[2, 1].new == "XX-XX" and not own[2, 1].located
    assert len({r.new for r in rows if r.type == "phone"}) == 3
    shown = C.public_key(changed).collect()
    assert not {"Ann Berg", "0301234568", "XX-XX"} & {v for r in shown for v in r if isinstance(v, str)}
    leaks = C.unchanged(changed, ["doc"])
    told = {r.seed: r for r in C.summary(changed, ["doc"], leaks).collect()}
    assert (told[7].n_values, told[7].n_edited, told[7].n_not_located, told[7].verdict) == (4, 3, 1, "leak of id")
    C.write(changed, ["doc"], str(tmp_path / "out"), str(tmp_path / "private"))
    back = spark.read.json(str(tmp_path / "out" / "keys"))
    assert back.count() == 12 and "old" not in back.columns
    assert spark.read.json(str(tmp_path / "private" / "keys")).where("seed = 8 and old = 'Ann Berg'").count() == 2


def test_accepted_values_and_report(spark):
    values, places = tables(spark)
    more = spark.createDataFrame([("d", 1, "ann", "person", "Ann Berg"), ("d", 1, "x", "id", "77"), ("e", 1, "y", "id", "78")], "doc string, page int, owner string, type string, text string")
    got = C.accepted(values, more, ["doc", "page"])
    assert {(r.doc, r.page, r.pos, r.text) for r in got.collect()} - {(r.doc, r.page, r.pos, r.text) for r in values.collect()} == {("d", 1, 2, "77"), ("e", 1, 0, "78")}
    open_ = spark.createDataFrame([("d", 2, "z@q.w", "EMAIL_ADDRESS", 1.0)], "doc string, page int, text string, entity string, score double")
    rows = {r.page: r for r in C.document_report(values, places, open_, ["doc"]).collect()}
    assert [v.located for v in rows[1]["values"]] == [True, True] and rows[1].unconfirmed is None
    assert [v.located for v in rows[2]["values"]] == [True, False] and rows[2].unconfirmed[0].text == "z@q.w"


def test_documents_written_in_turn_both_stay(spark, tmp_path):
    values, places = tables(spark)
    out, private = str(tmp_path / "out"), str(tmp_path / "private")
    for name, n in (("d", 2), ("e", 1), ("d", 1)):
        own = [t.withColumn("doc", F.lit(name)) for t in (values, places)]
        C.write(C.copies(*own, ["doc"], n, 7), ["doc"], out, private)
    for folder in (out, private):
        back = spark.read.json(f"{folder}/keys")
        assert {(r.doc, r.seed): r["count"] for r in back.groupBy("doc", "seed").count().collect()} == {("d", 7): 4, ("d", 8): 4, ("e", 7): 4}
