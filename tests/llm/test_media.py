import hashlib
import os
import random
import zlib

import pytest
from pyarrow import fs

from maskwright.llm import media

SCHEMA = "doc_id long, text string, media string, name string, feature int"


def test_png_round_trip_and_damage():
    rng = random.Random(1)
    for rows in (1, 2, 77):
        payload = rng.randbytes(64 * rows)
        png = media.to_png(payload)
        assert media.from_png(png) == payload
        for _ in range(20):
            k = rng.randrange(len(png))
            with pytest.raises(ValueError):
                media.from_png(png[:k] + bytes([png[k] ^ 1]) + png[k + 1 :])


def brute(text):
    raw = (text or "").encode()
    payload = raw + b"\0" * (-len(raw) % 64) if raw else b"\0" * 64
    return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])


def test_texts_through_archives(spark, tmp_path):
    rows = [(1, "a" * 64, "x", "y", 1), (1, "a" * 64, "x", "y", 1), (2, None, None, None, None), (None, "", "x", "y", 2), (-7, "é_" * 3, "x", "y", 3), (5, "long text " * 30_000, "x", "y", 1)]
    rows += [(100 + i, "w" * i, "x", "y", 0) for i in range(200)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = media.text_media(docs, f"file://{tmp_path}/a", rangeBytes="3000").collect()
    assert sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got), key=str) == sorted(((r[0], *brute(r[1])) for r in rows), key=str)
    by_payload = {}
    for r in got:
        assert by_payload.setdefault(r.payload_sha256, (r.media_bytes, r.media_sha256, r.feature)) == (r.media_bytes, r.media_sha256, r.feature)


def test_no_rows(spark, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    assert media.text_media(docs, f"{tmp_path}/none").count() == 0


def test_uncommitted_archives_are_not_read_and_damaged_members_fail_alone(spark, tmp_path):
    folder = f"{tmp_path}/b"
    frame = spark.createDataFrame([(f"m{i}", media.to_png(bytes([i]) * 64)) for i in range(9)], "name string, media binary")
    media.write_archives(frame.coalesce(1), folder)
    (archive,) = [x for x in os.listdir(folder) if x.endswith(".zip")]
    with open(f"{folder}/{archive}", "rb") as f:
        data = bytearray(f.read())
    with open(f"{folder}/left-behind.zip", "wb") as f:
        f.write(data)
    data[media.directory(fs.LocalFileSystem(), f"{folder}/{archive}")[4][0] + 50] ^= 255
    with open(f"{folder}/{archive}", "wb") as f:
        f.write(data)
    got = {r.name: r.error for r in media.read_archives(spark, folder, rangeBytes="200", attempts="2").collect()}
    assert len(got) == 9 and [k for k, v in got.items() if v] == ["m4"] and "damaged" in got["m4"]


def test_members_are_tried_again_on_their_own():
    tries, opened = [], []

    def act():
        tries.append(1)
        if len(tries) < 3:
            raise OSError("away")
        return b"here"

    assert media.retried(act, 4, lambda: opened.append(1)) == b"here" and len(opened) == 2
    with pytest.raises(ValueError):
        media.retried(lambda: int("x"), 2)


def test_ids_of_any_type_come_back(spark, tmp_path):
    docs = [("a_b", "x"), ("null", "y"), (None, "z"), ("", "w"), ("é/../🙂 \n", "v"), ("a_b", "x")]
    rows = media.text_media(spark.createDataFrame(docs, "doc_id string, text string"), f"file://{tmp_path}/m").collect()
    assert sorted((str(r.doc_id), r.n_bytes) for r in rows) == sorted((str(d), len(t)) for d, t in docs)
    assert {r.doc_id for r in rows} == {d for d, _ in docs}
