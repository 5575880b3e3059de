"""Media columns (operator 2): a Spark data source over folders of archives.

Writing, each task streams its rows into one ZIP archive, stored without further compression; the
driver's commit lists the archives that count, so what a lost task left behind is not read.
Reading, archives are cut into byte ranges; a task takes the members that start in its range from
the archive's directory, reads each by its offset, tries each again on its own if that fails, and
hands payloads on in Arrow batches of bounded size.

The one format made here is PNG: 8-bit grey, 64 samples a row, so a payload of whole rows is kept
losslessly.
"""

from __future__ import annotations

import hashlib
import io
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from maskwright.llm.tables import shared_folder

ROW = 64
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_LIST = "_archives-"
_BATCH_BYTES = 4 << 20


def to_png(payload: bytes) -> bytes:
    """A grey PNG whose samples are ``payload``, a positive multiple of 64 bytes."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(rows), ROW + 1), np.uint8)  # each row begins with its filter, none
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def from_png(media: bytes) -> bytes:
    """The samples of a PNG that :func:`to_png` made; ``ValueError`` if it is damaged or another kind."""
    if not media.startswith(_SIGNATURE):
        raise ValueError("no PNG")
    at, data, head = len(_SIGNATURE), [], None
    while at < len(media):
        size, kind = struct.unpack_from(">I4s", media, at)
        body = media[at + 8 : at + 8 + size]
        if struct.pack(">I", zlib.crc32(kind + body)) != media[at + 8 + size : at + 12 + size]:
            raise ValueError(f"damaged chunk {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    if head is None or head[0] != ROW or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("another kind of PNG")
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(head[1], ROW + 1)
    if lines[:, 0].any():
        raise ValueError("another kind of PNG")
    return lines[:, 1:].tobytes()


@dataclass
class _Written(WriterCommitMessage):
    name: str | None


@dataclass
class _Range(InputPartition):
    path: str
    start: int
    end: int

    def __init__(self, path: str, start: int, end: int):
        super().__init__((path, start, end))
        self.path, self.start, self.end = path, start, end


class _ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        store, root = fs.FileSystem.from_uri(self.folder)
        name, archive, out = f"{uuid.uuid4().hex}.zip", None, None
        for batch in iterator:
            for member, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if archive is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(f"{root}/{name}")
                    archive = zipfile.ZipFile(_Stream(out), "w", zipfile.ZIP_STORED)
                archive.writestr(zipfile.ZipInfo(member), media)
        if archive is None:
            return _Written(None)
        archive.close()
        out.close()
        return _Written(name)

    def commit(self, messages: list[_Written | None]) -> None:
        store, root = fs.FileSystem.from_uri(self.folder)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/{_LIST}{uuid.uuid4().hex}") as out:
            out.write("".join(f"{x.name}\n" for x in messages if x and x.name).encode())

    def abort(self, messages: list[_Written | None]) -> None:
        store, root = fs.FileSystem.from_uri(self.folder)
        for x in messages:
            if x and x.name:
                store.delete_file(f"{root}/{x.name}")


class _Stream(io.RawIOBase):
    """An output stream that can only be written on, as ``zipfile`` takes it."""

    def __init__(self, out: pa.NativeFile):
        self.out = out

    def writable(self) -> bool:
        return True

    def write(self, data: bytes) -> int:
        self.out.write(data)
        return len(data)

    def flush(self) -> None:
        self.out.flush()


class _ArchiveReader(DataSourceReader):
    def __init__(self, folder: str, range_bytes: int, attempts: int):
        self.folder, self.range_bytes, self.attempts = folder, range_bytes, attempts

    def partitions(self) -> list[_Range]:
        store, root = fs.FileSystem.from_uri(self.folder)
        found = store.get_file_info(fs.FileSelector(root))
        listed: set[str] = set()
        for x in found:
            if x.base_name.startswith(_LIST):
                with store.open_input_stream(x.path) as f:
                    listed.update(f.read().decode().split())
        out = []
        for x in sorted(found, key=lambda x: x.path):
            if x.base_name in listed:
                out += [_Range(x.path, at, at + self.range_bytes) for at in range(0, x.size, self.range_bytes)]
        return out or [_Range("", 0, 0)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        store, _ = fs.FileSystem.from_uri(self.folder)
        # Members start in order of their offsets; what the directory holds on others is dropped.
        members = retried(lambda: directory(store, part.path), self.attempts)
        rows: list[tuple] = []
        held = 0
        with _Handle(store, part.path) as handle:
            for offset, name, size, crc in members:
                if not part.start <= offset < part.end:
                    continue
                try:
                    media, error = retried(lambda o=offset, s=size, c=crc: handle.member(o, s, c), self.attempts, handle.again), None
                except (OSError, ValueError) as e:
                    media, error = None, f"{type(e).__name__}: {e}"
                rows.append((part.path, offset, name, media, error))
                held += size
                if held >= _BATCH_BYTES:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)


_SCHEMA = StructType(
    [
        StructField("archive", StringType()),
        StructField("offset", LongType()),
        StructField("name", StringType()),
        StructField("media", BinaryType()),
        StructField("error", StringType()),
    ]
)
_ARROW = pa.schema(
    [("archive", pa.string()), ("offset", pa.int64()), ("name", pa.string()), ("media", pa.binary()), ("error", pa.string())]
)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def directory(store: fs.FileSystem, path: str) -> list[tuple[int, str, int, int]]:
    """(offset, name, size, CRC) of an archive's members."""
    with store.open_input_file(path) as f, zipfile.ZipFile(f) as archive:
        return [(x.header_offset, x.filename, x.compress_size, x.CRC) for x in archive.infolist()]


def retried(act, attempts: int, before_next=lambda: None):
    """``act()``, tried up to ``attempts`` times with growing waits."""
    for k in range(attempts):
        try:
            return act()
        except (OSError, ValueError, zipfile.BadZipFile) as e:
            if k + 1 == attempts:
                raise e if isinstance(e, (OSError, ValueError)) else ValueError(str(e)) from e
            time.sleep(0.05 * 2**k)
            before_next()


class _Handle:
    """An open archive that can be opened anew."""

    def __init__(self, store: fs.FileSystem, path: str):
        self.store, self.path = store, path
        self.file = store.open_input_file(path)

    def __enter__(self) -> _Handle:
        return self

    def __exit__(self, *_: object) -> None:
        self.file.close()

    def again(self) -> None:
        self.file.close()
        self.file = self.store.open_input_file(self.path)

    def member(self, offset: int, size: int, crc: int) -> bytes:
        """The stored bytes of the member at ``offset``; ``ValueError`` unless they have its CRC."""
        self.file.seek(offset)
        head = self.file.read(30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError(f"no member at {offset}")
        name, extra = struct.unpack_from("<HH", head, 26)
        self.file.seek(offset + 30 + name + extra)
        data = self.file.read(size)
        if len(data) != size or zlib.crc32(data) != crc:
            raise ValueError(f"damaged member at {offset}")
        return data


class MediaArchives(DataSource):
    """``spark.read.format("media_archives").load(folder)`` gives archive, offset, name, media, error.

    Options: ``rangeBytes``, how many bytes of an archive a partition covers; ``attempts``, how
    often a member is tried. A member that fails every time is a row with ``error`` set and no
    media; the others are not touched by it. Written are rows of (name, media).
    """

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> StructType:
        return _SCHEMA

    def _folder(self) -> str:
        folder = self.options["path"]
        return folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"

    def reader(self, schema: StructType) -> _ArchiveReader:
        return _ArchiveReader(self._folder(), int(self.options.get("rangebytes", 16 << 20)), int(self.options.get("attempts", 4)))

    def writer(self, schema: StructType, overwrite: bool) -> _ArchiveWriter:
        if schema.simpleString() != "struct<name:string,media:binary>":
            raise ValueError(f"media_archives takes (name string, media binary), not {schema.simpleString()}")
        return _ArchiveWriter(self._folder())


def write_archives(media: DataFrame, folder: str) -> None:
    """Add rows of (name, media) to a folder of archives."""
    media.sparkSession.dataSource.register(MediaArchives)
    media.select(F.col("name").cast("string"), F.col("media").cast("binary")).write.format("media_archives").mode("append").save(folder)


def read_archives(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    spark.dataSource.register(MediaArchives)
    return spark.read.format("media_archives").options(**options).load(folder)


@F.pandas_udf(BinaryType())
def encoded(payloads: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Texts as PNG: UTF-8, filled with zeros to a positive multiple of 64 bytes."""
    for batch in payloads:
        out = []
        for text in batch:
            raw = (text or "").encode()
            out.append(to_png(raw + bytes(-len(raw) % ROW or (0 if raw else ROW))))
        yield pd.Series(out)


_FEATURES = StructType(
    [
        StructField("payload_bytes", LongType()),
        StructField("payload_sha256", StringType()),
        StructField("tail_crc32", LongType()),
        StructField("media_bytes", LongType()),
        StructField("media_sha256", StringType()),
        StructField("feature", StringType()),
    ]
)


@F.pandas_udf(_FEATURES)
def features(media: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """What the stored bytes hold: digests, and mean, deviation and entropy of the samples."""
    for batch in media:
        yield pd.DataFrame([_described(bytes(x)) for x in batch], columns=_FEATURES.names)


def _described(media: bytes) -> tuple:
    payload = from_png(media)
    share = np.bincount(np.frombuffer(payload, np.uint8), minlength=256) / len(payload)
    values = np.arange(256)
    mean = float((share * values).sum())
    deviation = float(np.sqrt((share * (values - mean) ** 2).sum()))
    some = share[share > 0]
    feature = f"mean={mean:.4f};deviation={deviation:.4f};entropy={abs(float((some * np.log2(some)).sum())):.4f};rows={len(payload) // ROW}"
    return (
        len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ROW:]),
        len(media), hashlib.sha256(media).hexdigest(), feature,
    )


def text_media(docs: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", **options: str) -> DataFrame:
    """Every text of ``docs`` stored as media in ``folder`` and described from what is read back.

    A member's name carries the unpadded size and the row's id, written in hexadecimal so that any
    id can be part of a name; what is stored depends on the text alone, so equal texts give equal
    values. Ids of any type that can be written as text come back as they were, null ids as null; null texts are empty texts;
    repeated rows are stored and returned as often as they stand. No rows give no rows. Columns
    other than the two named are not read. A member that can't be read after all attempts stops
    the job with its archive and offset.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/media/{uuid.uuid4().hex}"
    size = F.coalesce(F.octet_length(text_col), F.lit(0))
    # The id is left out if it is null, which no id is written as.
    name = F.concat_ws("_", size.cast("string"), F.hex(F.encode(F.col(id_col).cast("string"), "UTF-8")))
    write_archives(docs.select(name.alias("name"), encoded(F.col(text_col)).alias("media")), folder)
    read = read_archives(spark, folder, **options)
    media: Column = F.when(F.col("error").isNull(), F.col("media")).otherwise(
        F.raise_error(F.concat_ws(" ", "archive", F.col("offset").cast("string"), "error"))
    )
    told = read.select("name", features(media).alias("f"))
    parts = F.split("name", "_")
    return told.select(
        F.decode(F.unhex(F.get(parts, F.lit(1))), "UTF-8").cast(docs.schema[id_col].dataType).alias("doc_id"),
        F.get(parts, F.lit(0)).cast("long").alias("n_bytes"),
        "f.*",
    )
