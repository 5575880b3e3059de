"""Archives: round trips, layouts of gzip, damage, and revisits against brute force."""

import gzip
import hashlib
import os
import zlib

import pytest

from maskwright.llm import queries, warc


def brute(rows):
    out = []
    for page, html in rows:
        raw = (html or "").encode()
        same = [p for p, h in rows if (h or "") == (html or "") and p is not None]
        first = min(same, default=None) if len(raw) >= 100 else None
        again = first is not None and page != first
        out.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in df.collect()), key=repr)


ROWS = [
    (5, "x" * 100), (3, "x" * 100), (9, "x" * 100), (1, "x" * 99), (2, "x" * 99), (4, None), (6, ""), (7, "é" * 50), (8, "é" * 50), (3, "x" * 100),
    (10, "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 20), (11, "\r\n\r\n" * 40), (12, "\0" * 200), (None, "x" * 100), (None, "null " * 40), (None, "null " * 40), (13, "big " * 500_000),
]


@pytest.mark.parametrize("hot", [2, 10_000])
def test_pages_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(warc, "HOT", hot)
    rows = [(p, None if p == 5 else f"http://a.example/{p}?\r\nWARC-Type: x" if p == 3 else "http://b.example/é", h, 1, "z", b"k") for p, h in ROWS]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, page int, digest string, payload binary").repartition(3)
    assert got(warc.archived(spark, pages)) == brute(ROWS)


def test_joins_without_broadcast_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(warc, "small", lambda df: df)
    pages = spark.createDataFrame([(p, "u", h) for p, h in ROWS], "page_id long, url string, html string")
    assert got(warc.archived(spark, pages)) == brute(ROWS)


def test_ids_of_another_type(spark):
    rows = [("b", "y" * 200), ("a", "y" * 200), ("é\r\n", "z")]
    pages = spark.createDataFrame([(p, h) for p, h in rows], "k string, page string").selectExpr("k", "CAST(NULL AS STRING) AS u", "page")
    assert got(warc.archived(spark, pages, id_col="k", url_col="u", html_col="page")) == brute(rows)


def test_no_rows(spark):
    assert warc.archived(spark, spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def record(k, body=b"", kind=b"resource"):
    return b"WARC/1.0\r\nWARC-Type: %s\r\nWARC-Record-ID: <urn:x:%d>\r\nX-Long: a\r\n b\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (kind, k, len(body), body)


def normalised(spark, folder, files):
    os.makedirs(folder / "in", exist_ok=True)
    for name, data in files.items():
        (folder / "in" / name).write_bytes(data)
    names = spark.createDataFrame([(f"file://{folder}/in/{name}",) for name in files], "archive string")
    return warc.normalise(names, f"file://{folder}/out")


BODIES = [b"", b"a", b"x" * 1_000_000, b"\r\n\r\n", os.urandom(700_000), b"WARC/1.0\r\n\r\n"]


def test_any_layout_becomes_a_member_for_each_record(spark, tmp_path):
    whole = b"".join(record(k, b) for k, b in enumerate(BODIES))
    files = {
        "one.gz": gzip.compress(whole),
        "members.gz": b"".join(gzip.compress(record(k, b)) for k, b in enumerate(BODIES)),
        # Members that end anywhere, and zeros behind them.
        "odd.gz": b"".join(gzip.compress(whole[i : i + 333_333]) for i in range(0, len(whole), 333_333)) + bytes(100),
        "spaced.gz": gzip.compress(b"\r\n" + record(0) + b"\r\n\r\n" + record(1, b"q")),
        "empty.gz": gzip.compress(b""),
    }
    done = normalised(spark, tmp_path, files)
    assert sorted((r.records, r.error) for r in done.collect()) == [(0, None), (2, None), (6, None), (6, None), (6, None)]
    for row in done.where("records = 6").collect():
        path = row.archive.removeprefix("file://")
        data, seen = open(path, "rb").read(), []
        for x in warc.index_of(done.where(f"archive = '{row.archive}'")).orderBy("offset").collect():
            member = data[x.offset : x.offset + x.length]
            inflate = zlib.decompressobj(31)
            seen.append(inflate.decompress(member))
            assert inflate.eof and not inflate.unused_data
        assert seen == [record(k, b) for k, b in enumerate(BODIES)] and gzip.decompress(data) == whole
    read = warc.read_records(warc.index_of(done)).collect()
    assert sorted(len(r.payload) for r in read if r.error is None) == sorted([len(b) for b in BODIES] * 3 + [0, 1])


@pytest.mark.parametrize("piece", [1, 2, 3, 7])
def test_streams_may_be_cut_anywhere(monkeypatch, piece):
    monkeypatch.setattr(warc, "_PIECE", piece)
    data = gzip.compress(b"\r\n" + b"".join(record(k, b) for k, b in enumerate([b"", b"\r\n\r\n", b"abc", b"\r\n"])))
    held = iter([data[i : i + piece] for i in range(0, len(data), piece)])
    stream, seen = warc.Stream(lambda n: next(held, b"")), []
    while (head := stream.head()) is not None:
        seen.append(b"".join(stream.take(int(warc.fields(head)["content-length"]))))
    assert seen == [b"", b"\r\n\r\n", b"abc", b"\r\n"]


def test_damaged_archives_keep_what_is_whole(spark, tmp_path):
    whole = gzip.compress(b"".join(record(k, os.urandom(300_000)) for k in range(4)))
    files = {"cut.gz": whole[: len(whole) // 2], "flipped.gz": whole[:900_000] + bytes([whole[900_000] ^ 255]) + whole[900_001:], "text.gz": gzip.compress(b"no archive\r\n\r\n"), "plain.gz": b"not gzip"}
    told = {len(files): r for r in normalised(spark, tmp_path, files).collect()}
    rows = normalised(spark, tmp_path / "again", files).collect()
    assert told and all(r.error for r in rows) and sorted(r.records for r in rows)[:2] == [0, 0] and max(r.records for r in rows) >= 1


def test_a_record_that_cannot_be_read_fails_alone(spark, tmp_path):
    done = normalised(spark, tmp_path, {"a.gz": gzip.compress(b"".join(record(k, b"%d" % k * 50) for k in range(3)))})
    index = warc.index_of(done).orderBy("offset").collect()
    path = done.first().archive.removeprefix("file://")
    data = bytearray(open(path, "rb").read())
    data[index[1].offset + 20] ^= 255
    open(path, "wb").write(bytes(data))
    read = warc.read_records(warc.index_of(done), attempts=2).orderBy("offset").collect()
    assert [r.error is None for r in read] == [True, False, True] and read[2].payload == b"2" * 50


def test_archives_are_rolled_and_read_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 3000)
    monkeypatch.setattr(warc, "RANGE_BYTES", 500)
    rows = [(k, f"{k} " * 300) for k in range(40)]
    pages = spark.createDataFrame([(p, "u", h) for p, h in rows], "page_id long, url string, html string")
    assert got(warc.archived(spark, pages)) == brute(rows)


def test_query_equals_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html").collect()]
    assert got(queries.op13_warc(spark, sf_dir)) == brute(rows)
