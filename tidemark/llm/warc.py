"""WARC archives through a chunked record table.

A payload becomes rows of a record key and a chunk number (:func:`chunk_records`), each with the SHA-1 and the number of
bytes of the payload so far; the last one of a record carries the digest of the whole. Which record is the response is
decided by digests that the same walk over chunks gives. Archives are written from these rows and read back as such rows, so
neither side ever builds a record in memory: the writer appends a chunk at a time to a gzip member, the reader inflates a
block at a time. The writer holds the digest that a record's last chunk carries against the one its head declares and raises
where they differ, as they do if the input changed between its two readings.

Equal payloads of at least ``min_bytes`` bytes: the one with the largest page id is the response, the others revisit it.
The largest id of each digest comes from a map-side aggregate, pinned, so that digests and ids meet in a join of their own,
which adaptive execution splits where one digest holds many rows. Payloads are shuffled once, by a row key of their own. Those
of revisits are left out before that, by a broadcast of their keys, where these are at most ``REVISIT_KEYS``; with more
revisits they are left out when they meet their heads. The archives are the same.

A null payload is an empty one. Rows with a null page id are written too; they are responses only if no equal payload has
an id. Repeated ids keep all their rows. An empty table gives an empty manifest. Columns other than page_id, url and html
are ignored. White space in a URL is percent-encoded and decoded again, a null one comes back as null. Each archive begins
with a warcinfo record and has a name of its own; the manifest names those whose task ended well.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from datetime import datetime, timezone
from urllib.parse import unquote
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import common

CHUNK_BYTES = 1 << 20
#: Rows of chunks are handed on when they hold about so much.
BATCH_BYTES = 1 << 22
#: Keys of revisits that are broadcast (about 30 bytes each), so that their payloads are not shuffled.
REVISIT_KEYS = 1 << 19
#: An archive is closed at the first record end after this many compressed bytes.
ARCHIVE_BYTES = 1 << 28
NO_URL = "urn:none"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
CHUNK_SCHEMA = "record_key string, chunk_no int, last boolean, data binary, bytes_so_far long, sha1_so_far binary"


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _walk(data: pa.Scalar, chunk_bytes: int) -> Iterator[tuple[int, bool, memoryview, int, bytes]]:
    """chunk number, whether it is the last, its bytes, and the length and SHA-1 of the payload up to its end."""
    view = memoryview(data.as_buffer() or b"")
    running, at, no = hashlib.sha1(), 0, 0
    while no == 0 or at < len(view):
        piece = view[at : at + chunk_bytes]
        running.update(piece)
        at += len(piece)
        yield no, at >= len(view), piece, at, running.digest()
        no += 1


def chunk_records(records: DataFrame, key: str = "record_key", payload: str = "payload", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Rows of ``record_key, chunk_no, last, data, bytes_so_far, sha1_so_far``; an empty payload has one empty chunk."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for no, last, piece, at, digest in _walk(data, chunk_bytes):
                    rows.append((k, no, last, bytes(piece), at, digest))
                    held += len(piece)
                    if held >= BATCH_BYTES or len(rows) >= 10_000:
                        yield _rows(rows, ARROW_CHUNK)
                        rows, held = [], 0
        if rows:
            yield _rows(rows, ARROW_CHUNK)

    return records.select(F.col(key).cast("string"), F.coalesce(F.col(payload).cast("binary"), F.lit(b""))).mapInArrow(split, CHUNK_SCHEMA)


ARROW_CHUNK = pa.schema([("record_key", pa.string()), ("chunk_no", pa.int32()), ("last", pa.bool_()), ("data", pa.binary()), ("bytes_so_far", pa.int64()), ("sha1_so_far", pa.binary())])


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def payload_digests(records: DataFrame, keep: list[str], payload: str = "payload", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``keep`` columns with the length and the SHA-1 that the last chunk of each payload carries; no payload leaves its task."""
    rows = records.select(*keep, F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias(common.free_name(records, "payload")))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = []
            for data in batch.column(batch.num_columns - 1):
                *_, end = _walk(data, chunk_bytes)
                ends.append(end[3:])
            made = [pa.array([e[i] for e in ends], t) for i, t in enumerate((pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], [*keep, "payload_bytes", "sha1"])

    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("payload_bytes", T.LongType()), T.StructField("sha1", T.BinaryType())])
    return rows.mapInArrow(digest, schema)


def decide(digests: DataFrame, min_bytes: int = 0, key: str | None = None) -> DataFrame:
    """Adds ``refers_to``: the page id of the response that a row revisits, null for responses; with a ``key`` column also
    ``response_key``, that of the response."""
    large = digests.where(F.col("payload_bytes") >= min_bytes)
    first = large.groupBy("sha1").agg(F.max(F.struct(F.col("page_id"), F.col(key) if key else F.lit(None).alias("key"))).alias("top"), F.count("*").alias("n"))
    first = common.pin(first.where("n > 1").select("sha1", F.col("top")["page_id"].alias("response"), F.col("top")[key or "key"].cast("string").alias("response_key")), "warc-responses")
    revisits = (F.col("payload_bytes") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("response"))
    found = digests.join(first, "sha1", "left").withColumns({"refers_to": F.when(revisits, F.col("response")), "response_key": F.when(revisits & F.col("response").isNotNull(), F.col("response_key"))})
    return found.drop("response") if key else found.drop("response", "response_key")


def _url(url: str | None) -> str:
    """One token: white space and signs that would not come back are percent-encoded."""
    return NO_URL if url is None else "".join(f"%{b:02X}" for b in url.encode("utf-8", "replace")) if url in ("", NO_URL) else re.sub(r"[\s%\x00-\x20\x7f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)


def _record_id(key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, key)}>"


class ArchiveWriter:
    """One gzip member for each record, fed a chunk at a time."""

    def __init__(self, folder: str):
        self.path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
        fs, at = common.file_system(self.path)
        self.out, self.size, self.records = fs.open_output_stream(at, compression=None), 0, 0
        self.date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")  # when the archive is written
        about = b"software: tidemark\r\nformat: WARC File Format 1.1\r\n"
        fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", self.date), ("Content-Type", "application/warc-fields"), ("Content-Length", len(about))]
        self.open(fields, about)
        self.put(self.gzip.compress(b"\r\n\r\n") + self.gzip.flush())

    def open(self, fields: list[tuple], body: bytes) -> None:
        self.gzip = zlib.compressobj(6, zlib.DEFLATED, 31)
        self.put(self.gzip.compress("WARC/1.1\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + body))

    def put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def begin(self, row: dict) -> None:
        revisit = row["refers_to"] is not None
        http = b"" if revisit else HTTP_HEAD.format(row["payload_bytes"]).encode()
        fields = [
            ("WARC-Type", "revisit" if revisit else "response"),
            ("WARC-Record-ID", _record_id(row["record_key"])),
            ("WARC-Date", self.date),
            ("WARC-Target-URI", _url(row["url"])),
            ("WARC-Payload-Digest", "sha1:" + base32_sha1(row["sha1"])),
            ("X-Page-ID", "" if row["page_id"] is None else row["page_id"]),
            ("X-Record-Key", row["record_key"]),
            ("X-Payload-Length", row["payload_bytes"]),
        ]
        if revisit:
            fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _record_id(row["response_key"])), ("X-Refers-To-Page-ID", row["refers_to"])]
        fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(http) + (0 if revisit else row["payload_bytes"]))]
        self.open(fields, http)

    def chunk(self, data: bytes) -> None:
        self.put(self.gzip.compress(data))

    def end(self) -> None:
        self.put(self.gzip.compress(b"\r\n\r\n") + self.gzip.flush())
        self.records += 1


def write_warc(chunks: DataFrame, records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write archives; returns their paths and record counts.

    ``records`` has a row for each record: record_key, page_id, url, payload_bytes, sha1, refers_to, response_key. ``chunks`` is
    a chunk table; it may lack the chunks of revisits, which are not stored. The two meet by record key, in chunk order, each
    task streaming its rows. Raises where a record's chunks do not end with the length and the digest it declares.
    """
    fs, at = common.file_system(folder)
    fs.create_dir(at, recursive=True)
    cols = ["page_id", "url", "payload_bytes", "sha1", "refers_to", "response_key"]
    # heads come first (chunk -1) and have their own length and digest; a chunk has those of the payload so far
    heads = records.select("record_key", F.lit(-1).alias("chunk_no"), F.lit(b"").alias("data"), *cols)
    carried = {"payload_bytes": F.col("bytes_so_far"), "sha1": F.col("sha1_so_far")}
    body = chunks.select("record_key", "chunk_no", "data", *[carried.get(c, F.lit(None)).cast(heads.schema[c].dataType).alias(c) for c in cols])
    rows = heads.unionByName(body).repartition("record_key").sortWithinPartitions("record_key", "chunk_no")

    names = ("record_key", *cols)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, done, row, upto = None, [], None, None
        read = lambda batch, i, *names: tuple(batch.column(c)[i].as_py() for c in names)

        def end() -> None:
            if row["refers_to"] is None and upto != (row["payload_bytes"], row["sha1"]):
                raise ValueError(f"the payload of {row['record_key']} is not the one its digest was taken of")
            out.end()

        for batch in batches:
            for i in range(batch.num_rows):
                if batch.column("chunk_no")[i].as_py() == -1:
                    if row is not None:
                        end()
                        if out.size >= archive_bytes:
                            out.out.close()
                            done.append(out)
                            out = None
                    out = out or ArchiveWriter(folder)
                    row, upto = dict(zip(names, read(batch, i, *names), strict=True)), None
                    out.begin(row)
                elif row["refers_to"] is None:
                    out.chunk(batch.column("data")[i].as_py())
                    upto = read(batch, i, "payload_bytes", "sha1")
        if out:
            end()
            out.out.close()
            done.append(out)
        yield pa.RecordBatch.from_arrays([pa.array([d.path for d in done], pa.string()), pa.array([d.records for d in done], pa.int64())], ["path", "n_records"])

    return common.pin(rows.mapInArrow(write, "path string, n_records long"), "warc-manifest")


class _Inflated:
    """The bytes of a gzip file of many members, a block at a time."""

    def __init__(self, path: str, block: int = 1 << 18):
        fs, at = common.file_system(path)
        self.raw, self.block, self.buffer, self.rest = fs.open_input_stream(at, compression=None), block, b"", b""
        self.gzip = zlib.decompressobj(31)

    def more(self) -> bool:
        if self.gzip.eof:
            self.rest, self.gzip = self.gzip.unused_data, zlib.decompressobj(31)
        data = self.gzip.unconsumed_tail or self.rest or self.raw.read(self.block)
        self.rest = b""
        if not data:
            return False
        self.buffer += self.gzip.decompress(data, self.block)
        return True

    def until(self, mark: bytes) -> bytes | None:
        while (at := self.buffer.find(mark)) < 0:
            if not self.more():
                return None
        found, self.buffer = self.buffer[:at], self.buffer[at + len(mark) :]
        return found

    def pieces(self, n: int, size: int) -> Iterator[bytes]:
        while n:
            while len(self.buffer) < min(n, size):
                if not self.more():
                    raise EOFError("the archive ends within a record")
            piece, self.buffer = self.buffer[: min(n, size)], self.buffer[min(n, size) :]
            n -= len(piece)
            yield piece


READ_SCHEMA = pa.schema(
    [("record_id", pa.string()), ("chunk_no", pa.int32()), ("last", pa.bool_()), ("data", pa.binary()), ("bytes_so_far", pa.int64()), ("sha1_so_far", pa.binary()), ("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("refers_to", pa.int64()), ("declared_bytes", pa.int64()), ("declared_digest", pa.string()), ("digest", pa.string())]
)


def read_warc(archives: DataFrame, chunk_bytes: int = CHUNK_BYTES, with_data: bool = True) -> DataFrame:
    """The chunk table of the archives in ``path``; the fields of the record stand on each of its chunks.

    Revisits have one empty chunk. ``with_data=False`` leaves the payload out, after hashing it. Raises where a payload is
    not what its record declares.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for path in (p for b in batches for p in b.column(0).to_pylist()):
            src = _Inflated(path)
            while (head := src.until(b"\r\n\r\n")) is not None:
                lines = head.decode().split("\r\n")
                f = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
                n, kind = int(f["Content-Length"]), f["WARC-Type"]
                if kind == "warcinfo":
                    for _ in src.pieces(n, chunk_bytes):
                        pass
                    src.until(b"\r\n\r\n")
                    continue
                if kind == "response":
                    http = src.until(b"\r\n\r\n")
                    n -= len(http) + 4
                fields = (kind, int(f["X-Page-ID"]) if f["X-Page-ID"] else None, None if f["WARC-Target-URI"] == NO_URL else unquote(f["WARC-Target-URI"]), int(f["X-Refers-To-Page-ID"]) if "X-Refers-To-Page-ID" in f else None, int(f["X-Payload-Length"]), f["WARC-Payload-Digest"].removeprefix("sha1:"))
                running, at = hashlib.sha1(), 0
                for no, piece in enumerate(src.pieces(n, chunk_bytes) if n else [b""]):
                    running.update(piece)
                    at += len(piece)
                    # on the last chunk, what was computed; a revisit stores no payload and has what it declares
                    digest = None if at < n else base32_sha1(running.digest()) if kind == "response" else fields[-1]
                    rows.append((f["WARC-Record-ID"], no, at == n, piece if with_data else None, at, running.digest(), *fields, digest))
                    held += len(piece) * with_data + 200
                    if held >= BATCH_BYTES:
                        yield _rows(rows, READ_SCHEMA)
                        rows, held = [], 0
                if (at if kind == "response" else fields[-2], digest) != fields[-2:]:
                    raise ValueError(f"a payload does not have its declared length and digest in {path}")
                if src.until(b"\r\n\r\n") != b"":
                    raise ValueError(f"no record end where expected in {path}")
        if rows:
            yield _rows(rows, READ_SCHEMA)

    ddl = "record_id string, chunk_no int, last boolean, data binary, bytes_so_far long, sha1_so_far binary, record_type string, page_id long, url string, refers_to long, declared_bytes long, declared_digest string, digest string"
    n = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return archives.select("path").repartition(n).mapInArrow(read, ddl)


def archive_pages(pages: DataFrame, folder: str, min_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Write pages (page_id, url, html) as WARC archives in ``folder``; returns the manifest.

    ``pages`` is read twice, for digests and for payloads, and must read alike: a table of files, or pinned.
    """
    html: Column = F.coalesce(F.encode(F.col("html"), "UTF-8"), F.lit(b""))
    keyed = pages.select(F.concat_ws("-", F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.monotonically_increasing_id()).alias("record_key"), F.col("page_id").cast("long"), "url", html.alias("payload"))
    records = common.pin(decide(payload_digests(keyed, ["record_key", "page_id", "url"], chunk_bytes=chunk_bytes), min_bytes, "record_key"), "warc-records")
    revisits = records.where("refers_to is not null").select("record_key")
    stored = keyed.join(F.broadcast(revisits), "record_key", "left_anti") if revisits.count() <= REVISIT_KEYS else keyed
    return write_warc(chunk_records(stored, chunk_bytes=chunk_bytes), records, folder)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = archive_pages(common.table(spark, sf_dir, "pages"), common.workdir(spark, "warc"))
    size = F.when(F.col("record_type") == "revisit", F.col("declared_bytes")).otherwise(F.col("bytes_so_far"))
    return read_warc(manifest, with_data=False).where("last").select("page_id", size.alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")
