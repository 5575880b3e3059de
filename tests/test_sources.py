import numpy as np

from maskwright.sources import pages as S
from maskwright.streaming import ingest

TSV = """level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext
5\t1\t1\t1\t1\t1\t10\t10\t40\t12\t96\tLeon
5\t1\t1\t1\t1\t2\t60\t11\t60\t12\t96\t"Hartmann
5\t1\t1\t1\t1\t3\t400\t10\t30\t12\t90\tRechnung
5\t1\t1\t1\t2\t1\t10\t40\t119\t12\t90\tBERLIN|
5\t1\t1\t1\t2\t2\t140\t40\t20\t12\t-1\t{}
4\t1\t1\t1\t2\t0\t0\t0\t0\t0\t-1\t
"""


def test_recognizer_table(spark, tmp_path):
    (tmp_path / "a.tsv").write_text(TSV, encoding="utf-8")
    words = S.words(S.read_tsv(spark, str(tmp_path)), ["path"])
    lines = S.group_lines(words, ["path"]).orderBy("line").collect()
    assert [r.words for r in lines] == [["Leon", '"Hartmann'], ["Rechnung"], ["BERLIN"]]
    assert tuple(lines[0].box) == (10, 10, 120, 23) and tuple(lines[2].box) == (10, 40, 112, 52)
    assert S.page_text(S.group_lines(words, ["path"]), ["path"]).first().text == 'Leon "Hartmann\nRechnung\nBERLIN'


def test_text_layer(spark):
    xml = """<html><body><doc>
  <page width="595" height="842"><flow><block>
   <line xMin="72" yMin="40" xMax="200" yMax="50"><word xMin="72.0" yMin="40.5" xMax="90.5" yMax="50.25">A&amp;B</word>
   <word xMin="95" yMin="40" xMax="99" yMax="50"> </word></line>
   <line><word xMin="10" yMin="20" xMax="20" yMax="30">top</word></line><line><word xMin="1" yMin="1" xMax="2" yMax="2"></word></line></block></flow></page>
  <page></page></doc></body></html>"""
    got = S.text_layer(spark.createDataFrame([("d", xml)], "doc string, xml string"), ["doc"], scale=2.0).orderBy("line").collect()
    assert [(r.page, r.line, r.words) for r in got] == [(1, 0, ["top"]), (1, 1, ["A&B"])]
    assert tuple(got[1].word_boxes[0]) == (144, 81, 181, 100)


def test_scanned_pages(spark):
    listing = "page   num  type\n-----------\n   1     0 image    1653\n   2     1 image 10\n   2     2 image 10\n   3     3 smask 1\n"
    assert [r.page for r in S.scanned_pages(spark.createDataFrame([("d", listing)], "doc string, listing string"), ["doc"]).collect()] == [1]


def test_image_files(spark, tmp_path):
    import struct
    import zlib

    def png(gray):
        raw = b"".join(b"\0" + bytes(r) for r in gray)
        part = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
        return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", len(gray[0]), len(gray), 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")

    (tmp_path / "page.one.png").write_bytes(png(np.full((3, 5), 200).tolist()))
    (tmp_path / "notes.txt").write_text("x")
    got = {r.stem: r for r in S.read_images(spark, str(tmp_path)).collect()}
    assert got["page.one"].image.width == 5 and got["page.one"].error is None
    assert got["notes"].image is None and "not an image" in got["notes"].error


def test_caches_keep_their_schema(spark, tmp_path):
    frame = spark.createDataFrame([(1, "a"), (2, None)], "n int, s string")
    S.write_cache(frame, f"{tmp_path}/c")
    assert sorted(map(tuple, S.read_cache(spark, f"{tmp_path}/c", frame.schema).collect()), key=str) == sorted([(1, "a"), (2, None)], key=str)


def test_streams(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs.write.parquet(f"{tmp_path}/in")
    stream = ingest.read_stream(spark, f"{tmp_path}/in", docs.schema)
    query = ingest.deidentify_stream(stream, f"{tmp_path}/out", f"{tmp_path}/check")
    query.processAllAvailable()
    query.stop()
    assert spark.read.parquet(f"{tmp_path}/out").count() == docs.count()
    events = spark.createDataFrame([("2026-01-01 00:01:00", "a@b.cd +49 30 5550147"), ("2026-01-01 00:25:00", "x@y.zz")], "t string, text string")
    events = events.selectExpr("cast(t as timestamp) t", "text")
    got = {(str(r.start), r.entity, r.n) for r in ingest.candidate_counts(events, "t", "text").collect()}
    assert got == {("2026-01-01 00:00:00", "EMAIL_ADDRESS", 1), ("2026-01-01 00:00:00", "PHONE_NUMBER", 1), ("2026-01-01 00:20:00", "EMAIL_ADDRESS", 1)}


def test_pdf_pages_by_a_users_decoder(spark, tmp_path):
    (tmp_path / "good.pdf").write_bytes(b"2")
    (tmp_path / "bad.PDF").write_bytes(b"x")
    (tmp_path / "other.txt").write_bytes(b"1")

    def decode(content):
        for page in range(1, int(content) + 1):
            layer = "<page><line><word xMin='1'>a</word></line></page>".replace("'", '"') if page == 1 else None
            yield page, "text" if layer else "scan", 2, 1, b"\xf0\x00", layer

    got = S.read_pdfs(spark, str(tmp_path), decode).orderBy("stem", "page").collect()
    assert [(r.stem, r.page, r.kind, r.error is None) for r in got] == [("bad", None, None, False), ("good", 1, "text", True), ("good", 2, "scan", True)]
    assert got[0].error.startswith("ValueError") and bytes(got[2].gray) == b"\xf0\x00" and got[2].layer is None
