"""WARC archives: writing, normalising and reading through an offset index.

Writers stream each partition into archives that are one gzip stream from end
to end. The normaliser inflates such a stream once, in blocks, writes every
record as a gzip member of its own, and leaves a sidecar index of offsets, so
that a reader can seek to any record. No task holds more than one record and
one block. Files are named afresh by every attempt, and only the names that a
finished task reports count, so lost executors leave nothing but orphans, which
go with the raw folder.

Of the rows with equal payloads of at least ``LEAST`` bytes, that of the
smallest page_id is a response and the others revisit it.

Edge cases: a null html is an empty payload; rows that repeat the smallest
page_id are responses all; a null page_id revisits the smallest there is, and
without any is a response; a null url leaves the target out, and control
characters in a url are percent-encoded; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmark.llm.common import BROADCAST_BYTES, drop_path, fresh_path, written

LEAST = 100
SALTS = 32
FILE_BYTES = 256 << 20
BLOCK = 1 << 20
MANIFEST = "path string, records long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, at: str) -> bytes:
    """A response or revisit record; both carry the HTTP head of the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>",
        f"WARC-Date: {at}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"Content-Type: application/http;msgtype=response\r\nContent-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in url))
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {refers_to}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "surrogatepass").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:]) if k}


def inflate(source) -> Iterator[bytes]:
    """The content of a gzip file of any number of members, block by block."""
    z = zlib.decompressobj(31)
    while data := source.read(BLOCK):
        while data:
            out = z.decompress(data, 4 * BLOCK)
            if out:
                yield out
            data = z.unconsumed_tail
            if z.eof:
                data, z = z.unused_data, zlib.decompressobj(31)
    if rest := z.flush():
        yield rest


def records(blocks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(headers, block, the whole record) of each record in a stream."""
    held = bytearray()
    need = 0
    while True:
        end = held.find(b"\r\n\r\n", max(0, need - 4))
        if end < 0:
            need = len(held)
        else:
            head = headers(bytes(held[:end]))
            size = end + 4 + int(head["content-length"]) + 4
            while len(held) < size:
                more = next(blocks, None)
                if more is None:
                    raise ValueError("the stream ends inside a record")
                held += more
            yield head, bytes(held[end + 4 : size - 4]), bytes(held[:size])
            del held[:size]
            need = 0
            continue
        more = next(blocks, None)
        if more is None:
            if held.strip():
                raise ValueError("the stream ends inside a header")
            return
        held += more


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    return fs, path


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        out = z = None
        name, n, size, done = "", 0, 0, []
        at = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out, z = fs.open_output_stream(f"{base}/{name}", compression=None), zlib.compressobj(1, zlib.DEFLATED, 31)
                raw = record(*row, at)
                out.write(z.compress(raw))
                n, size = n + 1, size + len(raw)
                if size >= FILE_BYTES:
                    out.write(z.flush())
                    out.close()
                    done.append((name, n))
                    out = None
        if out is not None:
            out.write(z.flush())
            out.close()
            done.append((name, n))
        yield pa.RecordBatch.from_pydict({"path": pa.array([f"{folder}/{x}" for x, _ in done], pa.string()), "records": pa.array([k for _, k in done], pa.int64())})

    return run


def _normalise(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        for batch in batches:
            done = []
            for raw in batch.column(0).to_pylist():
                src_fs, src = pafs.FileSystem.from_uri(raw)
                name, at, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                with src_fs.open_input_stream(src, compression=None) as source, fs.open_output_stream(f"{base}/{name}", compression=None) as out, fs.open_output_stream(f"{base}/{name}.idx", compression=None) as index:
                    for head, _, whole in records(inflate(source)):
                        z = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = z.compress(whole) + z.flush()
                        out.write(member)
                        index.write(f"{at}\t{len(member)}\t{head['warc-type']}\t{head.get('x-page-id', '')}\t{head['warc-record-id']}\n".encode())
                        at, n = at + len(member), n + 1
                done.append((f"{folder}/{name}", n))
            yield pa.RecordBatch.from_pydict({"path": pa.array([p for p, _ in done], pa.string()), "records": pa.array([k for _, k in done], pa.int64())})

    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    number = lambda x: None if x is None else int(x)
    for batch in batches:
        for path in batch.column(0).to_pylist():
            rows = []
            for head, block in seek(path):
                http, _, payload = block.partition(b"\r\n\r\n")
                digest = head["warc-payload-digest"].removeprefix("sha256:")
                size = int(headers(http)["content-length"])
                if head["warc-type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                    raise ValueError(f"{path}: a payload differs from its digest")
                rows.append((number(head.get("x-page-id")), size, digest, head["warc-type"], number(head.get("x-refers-to-page"))))
                if len(rows) == 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def seek(path: str, wanted: set[int] | None = None) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of the records that the index lists; ``wanted`` picks page ids."""
    fs, file = pafs.FileSystem.from_uri(path)
    with fs.open_input_stream(f"{file}.idx", compression=None) as f:
        entries = [x.split("\t") for x in f.read().decode().splitlines()]
    with fs.open_input_file(file) as f:
        for at, size, _, page, _ in entries:
            if wanted is None or (page and int(page) in wanted):
                f.seek(int(at))
                head, block, _ = next(records(iter([zlib.decompress(f.read(int(size)), 31)])))
                yield head, block


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Write monolithic archives of (page_id, url, html); returns their names, as written."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "bytes": F.octet_length("payload")})
    twins = rows.where(F.col("bytes") >= LEAST).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first")
    twins = written(twins, "twins")
    keys = ["digest"]
    if twins.count() * 96 <= BROADCAST_BYTES:
        twins = F.broadcast(twins)
    else:  # the pages of one payload go to ``SALTS`` tasks
        keys.append("salt")
        twins = twins.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    placed = rows.join(twins, keys, "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))
    return written(placed.mapInArrow(_write(folder), MANIFEST), "manifest")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite archives (path, records) record by record, with an index beside each."""
    spread = archives.repartition(max(1, min(archives.count(), 10_000)), "path").select("path", "records")
    return written(spread.mapInArrow(_normalise(folder), MANIFEST), "manifest")


def read(archives: DataFrame) -> DataFrame:
    """One row for each record, through the index."""
    return archives.repartition(max(1, min(archives.count(), 10_000)), "path").select("path", "records").mapInArrow(_read, RECORDS)


def archive(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write, normalise and read back ``pages``; the normalised archives stay in ``folder``."""
    spark = pages.sparkSession
    raw, folder = fresh_path(spark, "warc-raw"), folder or fresh_path(spark, "warc")
    kept = normalise(write(pages, raw), folder)
    drop_path(spark, raw)
    return read(kept)
