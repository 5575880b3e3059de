"""WARC archives (operator 13): written, brought to one gzip member a record, indexed and read back.

Tasks write their records into archives that are one gzip stream each, as many crawlers and exports leave them: no record in
such a file can be reached without inflating all before it. The normaliser takes any such files. A task inflates one file
once, as a stream of bounded pieces, writes every record as a member of its own and, beside the archive, an index with a
JSON line for each record: where its member starts and how long it is. From then on records are read by their offsets,
in ranges that know nothing of where archives begin or end, and each is tried again on its own.

Which files count is what the finished tasks said, kept in a table; what a lost task left behind is never read.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm.media import retried
from maskwright.llm.tables import cut, shared_folder, small, stored

#: Payloads below this many bytes are always written out.
LEAST_BYTES = 100
#: Equal payloads from this number on are looked up in a table of their own; there are at most rows / HOT such payloads.
HOT = 10_000
#: Bytes of records after which a task begins another archive, of an archive that one task reads, of a piece that is inflated.
ARCHIVE_BYTES = 256 << 20
RANGE_BYTES = 16 << 20
_PIECE = 1 << 18
_BATCH_BYTES = 4 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = b"\r\n\r\n"


def _record_id(page: Column) -> Column:
    """A name-based UUID of the page's id."""
    h = F.md5(F.concat(F.lit("page "), page))
    parts = [h.substr(1, 8), h.substr(9, 4), F.concat(F.lit("3"), h.substr(14, 3)), F.concat(F.lit("8"), h.substr(18, 3)), h.substr(21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _hex(c: Column) -> Column:
    return F.lower(F.hex(F.encode(c.cast("string"), "UTF-8")))


def revisits(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(page, url, payload, digest) rows with ``refers``: the smallest page of an equal payload, null where the row stands for itself."""
    sized = pages.withColumn("_n", F.octet_length("payload"))
    same = sized.where(F.col("_n") >= least_bytes).groupBy("digest").agg(F.min("page").alias("_first"), F.count(F.lit(1)).alias("_many")).where("_many > 1")
    same = cut(same)
    hot = small(same.where(F.col("_many") >= HOT).select("digest", F.col("_first").alias("_hot")))
    rest = small(same.where(F.col("_many") < HOT).select(F.col("digest").alias("_key"), "_first"))
    found = sized.join(hot, "digest", "left")
    # Rows that have nothing to look up are spread by keys that nothing has.
    alone = F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string"))
    found = found.withColumn("_key", F.when((F.col("_n") >= least_bytes) & F.col("_hot").isNull(), F.col("digest")).otherwise(alone))
    first = F.coalesce("_hot", "_first")
    refers = F.when((F.col("_n") >= least_bytes) & first.isNotNull() & ~F.col("page").eqNullSafe(first), first)
    return found.join(rest, "_key", "left").select("page", "url", "payload", "digest", refers.alias("refers"))


def records(pages: DataFrame, date: str) -> DataFrame:
    """(head, body): WARC records of rows with their ``refers``; a revisit has the response's HTTP head and no payload."""
    again = F.col("refers").isNotNull()
    size = F.octet_length("payload")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit("\r\n\r\n"))
    body = F.when(again, F.lit(b"")).otherwise(F.col("payload"))
    # Addresses with blanks or control characters would break the head; they are percent-encoded.
    uri = F.when(F.col("url").rlike(r"[\x00-\x20\x7f]"), F.url_encode("url")).otherwise(F.col("url"))

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))

    lines = [
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", _record_id(F.coalesce(F.col("page").cast("string"), F.concat(F.lit("none "), "digest")))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        F.when(again, line("WARC-Profile", F.lit(_PROFILE))),
        line("WARC-Refers-To", _record_id(F.col("refers").cast("string"))),
        line("X-Page", _hex(F.col("page"))),
        line("X-Refers-To-Page", _hex(F.col("refers"))),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", (F.octet_length(http) + F.octet_length(body)).cast("string")),
        F.lit("\r\n"),
    ]
    # Lines without a value are null and left out.
    head = F.concat(F.concat_ws("", *lines), http)
    return pages.select(F.encode(head, "UTF-8").alias("head"), body.alias("body"))


class _Out:
    """A gzip stream into a new file, begun anew for each member."""

    def __init__(self, store: fs.FileSystem, path: str):
        self.file = store.open_output_stream(path, compression=None)
        self.at = self.start = 0
        self.deflate = None

    def begin(self) -> None:
        self.start, self.deflate = self.at, zlib.compressobj(1, zlib.DEFLATED, 31)

    def write(self, data: bytes) -> None:
        self._put(self.deflate.compress(data))

    def end(self) -> tuple[int, int]:
        """Where the member began, and how long it is."""
        self._put(self.deflate.flush())
        return self.start, self.at - self.start

    def _put(self, data: bytes) -> None:
        self.file.write(data)
        self.at += len(data)


_WRITTEN = "archive string, records long, bytes long"


def write_monolithic(rows: DataFrame, folder: str) -> DataFrame:
    """Records as archives of one gzip stream each in ``folder``; a row for each archive that counts."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, name, n, size = None, "", 0, 0

        def told() -> pa.RecordBatch:
            out.end()
            out.file.close()
            return pa.RecordBatch.from_pylist([{"archive": f"{folder}/{name}", "records": n, "bytes": out.at}], pa.schema([("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

        for batch in batches:
            for head, body in zip(batch.column(0), batch.column(1), strict=True):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, n, size = _Out(store, f"{root}/{name}"), 0, 0
                    out.begin()
                for part in (head.as_py(), body.as_py(), _END):
                    out.write(part)
                    size += len(part)
                n += 1
                if size >= ARCHIVE_BYTES:
                    yield told()
                    out = None
        if out is not None:
            yield told()

    return stored(rows.mapInArrow(write, _WRITTEN))


class Stream:
    """The bytes of a gzip file of one or more members, inflated piece by piece."""

    def __init__(self, read: Callable[[int], bytes]):
        self.read, self.held, self.done = read, bytearray(), False
        self.inflate, self.raw = zlib.decompressobj(31), b""

    def _more(self) -> bool:
        """Whether another piece could be inflated; ``ValueError`` if the file ends inside a member."""
        while not self.done:
            if self.inflate.eof:
                # Zeros may fill up what is behind the last member.
                self.raw = (self.inflate.unused_data or self.read(_PIECE)).lstrip(b"\0")
                if not self.raw:
                    self.raw = self.read(_PIECE).lstrip(b"\0")
                if not self.raw:
                    self.done = True
                    return False
                self.inflate = zlib.decompressobj(31)
            data, self.raw = self.raw or self.inflate.unconsumed_tail or self.read(_PIECE), b""
            if not data:
                if self.inflate.unconsumed_tail == b"" and not self.inflate.eof:
                    raise ValueError("the file ends inside a gzip member")
            out = self.inflate.decompress(data, _PIECE)
            self.held += out
            if out:
                return True
        return False

    def head(self, most: int = 1 << 20) -> bytes | None:
        """All up to and with the next empty line; None at the end of the file."""
        seen = 0
        while True:
            # Line ends between records are not part of any, and no head begins with one.
            while self.held[:2] == b"\r\n":
                del self.held[:2]
                seen = 0
            at = self.held.find(_END, max(0, seen - 3))
            if at >= 0:
                out = bytes(self.held[: at + 4])
                del self.held[: at + 4]
                return out
            seen = len(self.held)
            if seen > most:
                raise ValueError("a record's head has no end")
            if not self._more():
                if self.held.strip():
                    raise ValueError("the file ends inside a record's head")
                return None

    def take(self, n: int) -> Iterator[bytes]:
        """The next n bytes, in pieces."""
        while n:
            if not self.held and not self._more():
                raise ValueError("the file ends inside a record")
            part = bytes(self.held[:n])
            del self.held[: len(part)]
            n -= len(part)
            yield part


def fields(head: bytes) -> dict[str, str]:
    """A record's named fields by their names in lower case; ``ValueError`` if it is no WARC record."""
    first, *lines = head.decode(errors="replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no WARC record: {first[:40]!r}")
    told: dict[str, str] = {}
    for x in lines:
        if x[:1] in (" ", "\t") and told:  # a field goes on
            last = next(reversed(told))
            told[last] += " " + x.strip()
        elif ":" in x:
            name, value = x.split(":", 1)
            told[name.strip().lower()] = value.strip()
    if not told.get("content-length", "").isdecimal():
        raise ValueError("a record without Content-Length")
    return told


_NORMALISED = "archive string, index string, records long, error string"
_INDEX = "offset long, length long, type string, id string, uri string, digest string"


def _normalise(source: str, folder: str) -> dict:
    """One archive as members with an index; what stands before the first fault is kept, the fault is told."""
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    name = f"{uuid.uuid4().hex}.warc.gz"
    n, error = 0, None
    origin, path = fs.FileSystem.from_uri(source)
    out = _Out(store, f"{root}/{name}")
    with origin.open_input_stream(path, compression=None) as f, store.open_output_stream(f"{root}/{name}.idx.json", compression=None) as index:
        stream = Stream(f.read)
        try:
            while (head := stream.head()) is not None:
                told = fields(head)
                out.begin()
                out.write(head)
                for part in stream.take(int(told["content-length"])):
                    out.write(part)
                out.write(_END)
                offset, length = out.end()
                line = {"offset": offset, "length": length, "type": told.get("warc-type"), "id": told.get("warc-record-id"), "uri": told.get("warc-target-uri"), "digest": told.get("warc-payload-digest")}
                index.write(json.dumps(line).encode() + b"\n")
                n += 1
        except (ValueError, zlib.error) as e:
            error = f"{type(e).__name__}: {e}"
    out.file.close()
    return {"archive": f"{folder}/{name}", "index": f"{folder}/{name}.idx.json", "records": n, "error": error}


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Archives of any gzip layout, named in column ``archive``, rewritten into ``folder`` with a member for each record.

    A row for each: the new ``archive``, its ``index``, how many ``records`` it has, and an ``error`` if the file is damaged;
    whole records before the damage are kept. An empty archive has no records. One task takes one file.
    """
    schema = pa.schema([("archive", pa.string()), ("index", pa.string()), ("records", pa.int64()), ("error", pa.string())])

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_pylist([_normalise(source, folder)], schema)

    names = archives.select("archive")
    return stored(names.repartition(max(1, names.count())).mapInArrow(rewrite, _NORMALISED))


def index_of(normalised: DataFrame) -> DataFrame:
    """The lines of the indexes beside normalised archives."""
    spark = normalised.sparkSession
    folders = [r[0] for r in normalised.select(F.regexp_replace("index", "/[^/]*$", "")).distinct().collect()]
    if not folders:
        return spark.createDataFrame([], f"archive string, {_INDEX}")
    read = spark.read.schema(_INDEX).json([f"{x}/*.idx.json" for x in folders]).withColumn("_of", F.regexp_extract("_metadata.file_path", "([^/]*)[.]idx[.]json$", 1))
    known = normalised.select("archive", F.regexp_extract("archive", "([^/]*)$", 1).alias("_of"))
    return read.join(small(known), "_of").select("archive", "offset", "length", "type", "id", "uri", "digest")


_READ = "archive string, offset long, type string, uri string, digest string, page string, refers string, size long, payload binary, error string"
_SCHEMA = pa.schema(
    [("archive", pa.string()), ("offset", pa.int64()), ("type", pa.string()), ("uri", pa.string()), ("digest", pa.string())]
    + [("page", pa.string()), ("refers", pa.string()), ("size", pa.int64()), ("payload", pa.binary()), ("error", pa.string())]
)


def parsed(member: bytes) -> tuple:
    """Type, address, digest, page, page referred to, size of the whole payload, and the payload of one member's record."""
    inflate = zlib.decompressobj(31)
    data = inflate.decompress(member) + inflate.flush()
    if not inflate.eof:
        raise ValueError("a member without end")
    at = data.find(_END)
    told = fields(data[: at + 4])
    block = data[at + 4 : at + 4 + int(told["content-length"])]
    if len(block) != int(told["content-length"]) or data[at + 4 + len(block) :] != _END:
        raise ValueError("a record of another length")
    size, payload = len(block), block
    if told.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(_END)
        lines = (x.split(b":", 1) for x in http.split(b"\r\n")[1:] if b":" in x)
        size = next((int(v) for k, v in lines if k.strip().lower() == b"content-length"), len(payload))
    return told.get("warc-type"), told.get("warc-target-uri"), told.get("warc-payload-digest"), told.get("x-page"), told.get("x-refers-to-page"), size, payload


def read_records(index: DataFrame, attempts: int = 4) -> DataFrame:
    """The records that an index names, each read by its offset. One that fails every time is a row with ``error`` set."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, name, store, path, file = [], 0, None, None, None, None
        for batch in batches:
            for archive, offset, length in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if archive != name:
                    if file is not None:
                        file.close()
                    name, (store, path) = archive, fs.FileSystem.from_uri(archive)
                    file = retried(lambda s=store, p=path: s.open_input_file(p), attempts)

                def again():
                    nonlocal file
                    file.close()
                    file = store.open_input_file(path)

                def member(offset=offset, length=length):
                    file.seek(offset)
                    try:
                        return parsed(file.read(length))
                    except zlib.error as e:
                        raise ValueError(str(e)) from e

                try:
                    rows.append((archive, offset, *retried(member, attempts, again), None))
                except (OSError, ValueError) as e:
                    rows.append((archive, offset, *[None] * 7, f"{type(e).__name__}: {e}"))
                held += len(rows[-1][8] or b"")
                if held >= _BATCH_BYTES or len(rows) >= 10_000:
                    yield _batch(rows)
                    rows, held = [], 0
        if file is not None:
            file.close()
        if rows:
            yield _batch(rows)

    places = index.select("archive", "offset", "length").withColumn("_range", F.floor(F.col("offset") / RANGE_BYTES))
    # Index rows are tiny beside what they name: tasks are as many as the ranges, whatever Spark makes of the rows' size.
    size = index.agg(F.sum("length").alias("n")).first().n or 0
    dealt = places.repartition(size // RANGE_BYTES + 1, "archive", "_range").sortWithinPartitions("archive", "offset")
    return dealt.select("archive", "offset", "length").mapInArrow(read, _READ)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


def archived(spark: SparkSession, pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Pages written as WARC archives, normalised, and told from what is read back.

    Returns ``page_id``, ``payload_bytes``, ``payload_digest`` (SHA-256 in hexadecimal), ``record_type``, ``refers_to``. Of equal
    payloads of 100 bytes or more, the smallest id is the response, others revisit it; rows that share this smallest id are
    all responses. A null id is larger than any other, and equal payloads of null ids alone are all responses; ids of any type that
    can be written as text come back as they were. Null pages are empty ones. Null addresses are left out of the head,
    addresses with blanks or control characters are percent-encoded in it. No rows give no rows. Columns other than the three
    named are not read. A damaged archive or record, or a payload that has not its digest, stops the job and is named.
    """
    folder = folder or f"{shared_folder(spark)}/warc/{uuid.uuid4().hex}"
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    written = write_monolithic(records(revisits(rows), date), f"{folder}/whole")
    done = normalise(written, f"{folder}/members")
    checked = done.where(F.col("error").isNull() | F.raise_error(F.concat_ws(" ", "archive", "error")).isNotNull())
    back = read_records(index_of(checked))
    kind = pages.schema[id_col].dataType
    own = F.concat(F.lit("sha256:"), F.sha2("payload", 256))
    good = F.col("error").isNull() & ((F.col("type") == "revisit") | ((own == F.col("digest")) & (F.octet_length("payload") == F.col("size"))))
    told = F.when(good, F.substring_index("digest", ":", -1)).otherwise(F.raise_error(F.concat_ws(" ", "archive", F.col("offset").cast("string"), F.coalesce("error", F.lit("another digest")))))

    def as_id(c: str) -> Column:
        return F.decode(F.unhex(c), "UTF-8").cast(kind)

    return back.select(as_id("page").alias("page_id"), F.col("size").alias("payload_bytes"), told.alias("payload_digest"), F.col("type").alias("record_type"), as_id("refers").alias("refers_to"))
