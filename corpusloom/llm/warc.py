"""WARC archives in seekable Zstandard bundles.

Records are grouped into frames that decompress on their own; a bundle is its
frames, an index frame that maps record ids to (frame, offset in the frame,
length), and the seek table of the public seekable format. Both trailers are
skippable frames, so any Zstandard tool reads a bundle as one WARC file.

Bundles travel as rows of a table: Spark's committer then guards against lost
executors on any file system. :func:`export` writes them out as files.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import materialize

#: Fixed values of the seekable Zstandard format.
_SKIPPABLE, _INDEX, _SEEKABLE = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1
LEAST, FRAME, BUNDLE = 1000, 1 << 18, 1 << 23
_CLEAN = {i: f"%{i:02X}" for i in [*range(33), 127]}


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, copy: int = 0, date: str = "1970-01-01T00:00:00Z") -> tuple[str, bytes]:
    """Record id and bytes of one record; a revisit carries headers only.

    ``copy`` numbers the records that share page and payload; the first stands for them in references.
    """
    ident = lambda page, n: f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}:{digest}:{n}')}"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{ident(page_id, copy)}>", f"WARC-Date: {date}"]
    if url:
        head.append(f"WARC-Target-URI: {url.translate(_CLEAN)}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{ident(refers_to, 0)}>", f"X-Refers-To-Page: {refers_to}"]
    else:
        block += payload
    if page_id is not None:
        head.append(f"X-Page: {page_id}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ident(page_id, copy), "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


class Bundle:
    """Collects records; :meth:`close` gives the bundle's bytes."""

    def __init__(self, frame: int = FRAME) -> None:
        import zstandard

        self.pack, self.limit = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True), frame
        self.frames, self.sizes, self.index, self.open, self.raw, self.records = [], [], [], bytearray(), 0, 0

    def add(self, ident: str, data: bytes) -> None:
        self.index.append((ident, len(self.sizes), len(self.open), len(data)))
        self.open += data
        self.raw += len(data)
        self.records += 1
        if len(self.open) >= self.limit:
            self._flush()

    def _flush(self) -> None:
        if self.open:
            packed = self.pack.compress(bytes(self.open))
            self.frames.append(packed)
            self.sizes.append((len(packed), len(self.open)))
            self.open = bytearray()

    def close(self) -> bytes:
        self._flush()
        listed = self.pack.compress(json.dumps(self.index).encode())
        index = struct.pack("<II", _INDEX, len(listed)) + listed
        sizes = [*self.sizes, (len(index), 0)]
        table = b"".join(struct.pack("<II", *x) for x in sizes) + struct.pack("<IBI", len(sizes), 0, _SEEKABLE)
        return b"".join(self.frames) + index + struct.pack("<II", _SKIPPABLE, len(table)) + table


class Reader:
    """Random access to a bundle's bytes."""

    def __init__(self, data: bytes) -> None:
        import zstandard

        self.data, self.unpack = data, zstandard.ZstdDecompressor()
        count, _, magic = struct.unpack("<IBI", data[-9:])
        table = len(data) - 9 - 8 * count
        if magic != _SEEKABLE or struct.unpack("<II", data[table - 8 : table]) != (_SKIPPABLE, 8 * count + 9):
            raise ValueError("no seek table at the end of the bundle")
        self.at, at = [], 0
        for i in range(count):
            packed, _ = struct.unpack_from("<II", data, table + 8 * i)
            self.at.append((at, at + packed))
            at += packed

    def index(self) -> list[tuple[str, int, int, int]]:
        lo, hi = self.at[-1]
        return [tuple(x) for x in json.loads(self.unpack.decompress(self.data[lo + 8 : hi]))]

    def frame(self, number: int) -> bytes:
        lo, hi = self.at[number]
        return self.unpack.decompress(self.data[lo:hi])

    def records(self) -> Iterator[bytes]:
        number, frame = -1, b""
        for _, n, offset, length in self.index():
            if n != number:
                number, frame = n, self.frame(n)
            yield frame[offset : offset + length]

    def get(self, ident: str) -> bytes | None:
        """One record; only its frame is decompressed."""
        found = next((x for x in self.index() if x[0] == ident), None)
        return found and self.frame(found[1])[found[2] : found[2] + found[3]]


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    fields["Payload-Length"] = http.rpartition(b": ")[2].decode()
    return fields, payload


def _bundler(frame: int, limit: int):
    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, now = TaskContext.get().partitionId(), 0, Bundle(frame)

        def done() -> pa.RecordBatch:
            name = f"{part:05d}-{number:05d}"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([now.close()], pa.binary()), pa.array([now.records], pa.int64())], ["bundle", "data", "records"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "size", "digest", "refers_to", "copy")), strict=True):
                now.add(*record(*row))
                if now.raw >= limit:
                    yield done()
                    number, now = number + 1, Bundle(frame)
        if now.records:
            yield done()

    return bundle


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "bundle"]
    for batch in batches:
        for bundle, data in zip(batch.column("bundle").to_pylist(), batch.column("data").to_pylist(), strict=True):
            rows = []
            for raw in Reader(data).records():
                f, payload = parse(raw)
                digest, page = f["WARC-Payload-Digest"].removeprefix("sha1:"), f.get("X-Page")
                if f["WARC-Type"] == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != int(f["Payload-Length"])):
                    raise ValueError(f"payload of {f['WARC-Record-ID']} in {bundle} is not what its digest says")
                to = f.get("X-Refers-To-Page")
                rows.append((page and int(page), int(f["Payload-Length"]), digest, f["WARC-Type"], to and int(to), f["WARC-Record-ID"].strip("<>"), bundle))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def archive(pages: DataFrame, least: int = LEAST, frame: int = FRAME, bundle: int = BUNDLE) -> DataFrame:
    """Bundles of one record per row of ``pages`` (page_id, url, html): bundle, data, records.

    Of records whose payloads of at least ``least`` bytes are equal, the largest
    page_id is the response and the others revisit it. Null html is an empty
    payload, a null url leaves its header out; rows that repeat a page_id get a
    record with an id of its own each, and so do null ids, which revisit but are
    never revisited; very long html is one record in a frame of its own; an
    empty table makes no bundle; other columns are not read, whatever their
    names. Digests alone are compared, so html moves once, by page and not by
    digest: a payload with many copies makes no hot key.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    keys = rows.select("page_id", "digest", F.octet_length("payload").alias("n")).groupBy("digest", "page_id").agg(F.count("*").alias("copies"), F.first("n").alias("n"))
    keep = keys.filter(F.col("n") >= least).groupBy("digest").agg(F.max("page_id").alias("keep"), F.count("*").alias("pages")).filter("pages > 1").drop("pages")
    told = keys.join(keep, "digest", "left").withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("keep")), F.col("keep")))
    told = told.filter("refers_to is not null or copies > 1").select(F.col("page_id").alias("id"), F.col("digest").alias("d"), "refers_to", "copies")
    told = materialize(told, "told")
    full = rows.join(told, F.col("page_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("d")), "left")
    full = full.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise(F.lit(b"")).alias("payload"), F.octet_length("payload").alias("size"), "digest", "refers_to", "copies")
    if told.filter("copies > 1").isEmpty():
        full = full.select("*", F.lit(0).alias("copy")).drop("copies")
    else:  # rows that share page and payload are numbered; only they move for it
        order = Window.partitionBy("page_id", "digest").orderBy("url")
        again = full.filter("copies > 1").withColumn("copy", F.row_number().over(order) - 1)
        full = full.filter("copies is null or copies = 1").withColumn("copy", F.lit(0)).unionByName(again).drop("copies")
    return full.mapInArrow(_bundler(frame, bundle), "bundle string, data binary, records long")


def records(bundles: DataFrame) -> DataFrame:
    """Every record of the bundles; responses are checked against their digests."""
    return bundles.select("bundle", "data").mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, bundle string")


def round_trip(pages: DataFrame, **how) -> DataFrame:
    """Writes the archives to the shared folder and reads them back."""
    return records(materialize(archive(pages, **how), "warc"))


def _export(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    import os

    for batch in batches:
        paths = []
        for name, data in zip(batch.column("bundle").to_pylist(), batch.column("data").to_pylist(), strict=True):
            path = f"{folder}/{name}.warc.zst"
            part = f"{path}.{uuid.uuid4().hex}.part"
            with open(part, "wb") as f:
                f.write(data)
            os.replace(part, path)  # a task that runs twice leaves one whole file
            paths.append(path)
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], ["path"])


def export(bundles: DataFrame, folder: str) -> DataFrame:
    """Write the bundles as files to a folder that all executors mount; their paths."""
    return bundles.select("bundle", "data").mapInArrow(lambda batches: _export(batches, folder), "path string")


def read_files(spark: SparkSession, pattern: str) -> DataFrame:
    """Bundles from files on any file system that Spark reads."""
    found = spark.read.format("binaryFile").load(pattern)
    return found.select(F.regexp_extract("path", r"([^/]+)\.warc\.zst$", 1).alias("bundle"), F.col("content").alias("data"), F.lit(None).cast("long").alias("records"))
