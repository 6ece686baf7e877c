"""WARC archives: writing pages as records, and normalising monolithic gzip files to one member per record.

A monolithic archive is one gzip stream over many records, which cannot be read from the middle. The normaliser
inflates such a file once as a stream, rewrites every record as a gzip member of its own and writes a sidecar index
of member offsets, after which any record is one slice and one small inflate.

Scale: which page responds and which revisit it is settled on ids and digests; payloads are dealt once, by page. Writers
keep one open stream each and close an archive at ``max_bytes`` of records. Archives are rows (path, content, index) of
tables in the shared folder, which Spark writes and commits on any storage that it can reach; ``read_files`` takes
archives from any such storage, and ``write_files`` puts archives and sidecars out as files.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, written

VERSION = b"WARC/1.1"
MAX_BYTES = 16 << 20
_IO = 1 << 18
#: Of zlib: 4 takes two thirds of the time of 6 and gives files a few per cent larger.
LEVEL = 4
_SALT = 16
#: Fixed so that the same pages always make the same bytes: the tables have no fetch time.
DATE = "2024-01-01T00:00:00Z"
_SOFTWARE = b"software: orogen\r\nformat: WARC File Format 1.1\r\n"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}/sha256:{digest}').urn}>"


def _record(head: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*head, ("Content-Length", str(len(block)))])
    return VERSION + b"\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def info(name: str, date: str = DATE) -> bytes:
    """The record that opens an archive."""
    head = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<{uuid.uuid5(uuid.NAMESPACE_URL, name).urn}>"), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")]
    return _record(head, _SOFTWARE)


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None, date: str = DATE) -> bytes:
    """The record of a page: an HTTP response with its header lines, or a revisit with header lines alone.

    The digest and length of the payload are given for both; ``X-Page-ID`` holds the page's id where it has one.
    """
    digest = hashlib.sha256(payload).hexdigest()
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", quote(url, safe="%/:=&?~#+!$,;'@()*[]")))
    head += [("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(len(payload))), ("Content-Type", "application/http; msgtype=response")]
    if page_id is not None:
        head.append(("X-Page-ID", str(page_id)))
    if kind == "revisit":
        head += [("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page-ID", str(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return _record(head, http + (payload if kind == "response" else b""))


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:] if x)}


def records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Split an inflated stream into whole records, holding no more than one record and one chunk."""
    held = bytearray()
    need = -1
    for chunk in chunks:
        held += chunk
        while True:
            if need < 0:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                need = end + 4 + int(parse_head(bytes(held[:end]))["content-length"]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = -1
    if held:
        raise ValueError(f"truncated record of {len(held)} bytes at the end of the archive")


def inflate(stream) -> Iterator[bytes]:
    """Chunks of a gzip file of one member or many."""
    engine = zlib.decompressobj(31)
    while data := stream.read(_IO):
        while data:
            out = engine.decompress(data, 4 * _IO)
            if out:
                yield out
            data = engine.unconsumed_tail
            if engine.eof:
                data, engine = engine.unused_data, zlib.decompressobj(31)
    if tail := engine.flush():
        yield tail


def _member(body: bytes) -> bytes:
    engine = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return engine.compress(body) + engine.flush()


def with_roles(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """``page_id, url, payload, kind, refers_to``: of equal payloads of ``min_bytes`` or more, the smallest page_id is
    the response and the others revisit it. Rows that repeat the smallest page_id are responses all; rows with a null
    page_id revisit like any other, and are responses where no other row holds their payload."""
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "utf-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    same = {"same1": F.xxhash64("payload"), "same2": F.xxhash64(F.lit(1), "payload")}  # 128 bits tell payloads apart
    keys = rows.where(F.octet_length("payload") >= min_bytes).select("page_id", *[c.alias(n) for n, c in same.items()])
    shared = keys.groupBy("same1", "same2").agg(F.count("*").alias("n"), F.min("page_id").alias("first")).where("n > 1 and first is not null")
    # Ids meet their response in salted groups, as a third of all pages may hold one payload.
    salted = keys.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(_SALT)))
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_SALT - 1).cast("long")))
    firsts = shared.select(F.col("same1").alias("d1"), F.col("same2").alias("d2"), "first", salts.alias("s"))
    met = (F.col("same1") == F.col("d1")) & (F.col("same2") == F.col("d2")) & (F.col("salt") == F.col("s"))
    again = salted.join(firsts, met).where(~F.col("page_id").eqNullSafe(F.col("first")))
    # Pages meet their verdict under their own id; the hashes go along for ids that several payloads have.
    known = again.select(F.coalesce("page_id", "same1").alias("k"), F.col("same1").alias("k1"), F.col("same2").alias("k2"), F.col("first").alias("refers_to")).distinct()
    keyed = rows.withColumns(same).withColumn("key", F.coalesce("page_id", "same1"))
    own = (F.col("key") == F.col("k")) & (F.col("same1") == F.col("k1")) & (F.col("same2") == F.col("k2")) & (F.octet_length("payload") >= min_bytes)
    joined = keyed.join(known, own, "left")
    # A null id may have the key of another page's id, so a page never refers to itself.
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("refers_to")), F.col("refers_to"))
    return joined.select("page_id", "url", "payload", F.when(refers.isNotNull(), "revisit").otherwise("response").alias("kind"), refers.alias("refers_to"))


_ARCHIVE = "path string, content binary, n_records long"


def write_monolithic(rows: DataFrame, max_bytes: int = MAX_BYTES, date: str = DATE) -> DataFrame:
    """Archives of one gzip stream each: their ``path`` (a name), ``content`` and ``n_records`` (of pages)."""
    return materialize(_monolithic(rows, max_bytes, date), "archives")


def _monolithic(rows: DataFrame, max_bytes: int = MAX_BYTES, date: str = DATE) -> DataFrame:

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[bytes] = []
        engine, name, n, size = None, "", 0, 0

        def closed() -> pa.RecordBatch:
            out.append(engine.flush())
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"".join(out)], pa.binary()), pa.array([n], pa.int64())], ["path", "content", "n_records"])

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "kind", "refers_to")]
            for row in zip(*columns, strict=True):
                if engine is None:
                    engine, name, n, size = zlib.compressobj(LEVEL, zlib.DEFLATED, 31), f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out[:] = [engine.compress(info(name, date))]
                body = record(*[x.as_py() for x in row], date)
                out.append(engine.compress(body))
                n, size = n + 1, size + len(body)
                if size >= max_bytes:
                    yield closed()
                    engine = None
        if engine is not None:
            yield closed()

    return rows.select("page_id", "url", "payload", "kind", "refers_to").mapInArrow(run, _ARCHIVE)


def read_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Archives (``path, content``) from files on any storage that Spark reads."""
    return spark.read.format("binaryFile").load(paths).select("path", "content")


_NORMAL = "path string, content binary, index string, n_records long"


def normalize(archives: DataFrame) -> DataFrame:
    """Each archive of ``path, content`` with one gzip member per record, and its sidecar ``index``.

    The index has a JSON line per record: record_id, kind, offset, length; ``n_records`` counts them all. An archive that
    is truncated or holds anything but records fails its task; a record may be larger than ``max_bytes``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                members, lines, offset = [], [], 0
                for body in records(inflate(pa.BufferReader(content.as_buffer()))):
                    head = parse_head(body[: body.index(b"\r\n\r\n")])
                    members.append(_member(body))
                    lines.append(json.dumps({"record_id": head["warc-record-id"], "kind": head["warc-type"], "offset": offset, "length": len(members[-1])}))
                    offset += len(members[-1])
                columns = [pa.array([path.as_py()]), pa.array([b"".join(members)], pa.binary()), pa.array(["\n".join(lines)]), pa.array([len(lines)], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["path", "content", "index", "n_records"])

    return materialize(archives.select("path", "content").mapInArrow(run, _NORMAL), "normalized")


def write_files(archives: DataFrame, folder: str) -> DataFrame:
    """Put normalised archives out as files in ``folder``, each with its ``.idx`` beside it; returns their paths.

    The folder is any that pyarrow's file systems open from the executors (local, hdfs, s3, gs). Names are unique to a
    task attempt, so only those that are returned count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        store.create_dir(base)
        for batch in batches:
            names = [f"{uuid.uuid4().hex}.warc.gz" for _ in range(batch.num_rows)]
            for name, content, index in zip(names, batch.column("content"), batch.column("index"), strict=True):
                for suffix, data in (("", content.as_buffer()), (".idx", index.as_buffer())):
                    with store.open_output_stream(f"{base}/{name}{suffix}", compression=None) as out:
                        out.write(data)
            paths = [f"{folder}/{name}" for name in names]
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array([f"{p}.idx" for p in paths], pa.string()), batch.column("n_records")], ["path", "index_path", "n_records"])

    return materialize(archives.select("content", "index", "n_records").mapInArrow(run, "path string, index_path string, n_records long"), "files")


_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_records(archives: DataFrame) -> DataFrame:
    """Read every page's record of normalised archives by its index entry, checking size and digest of responses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        for batch in batches:
            for content, index in zip(batch.column("content"), batch.column("index").to_pylist(), strict=True):
                data, found = memoryview(content.as_buffer()), []
                for entry in map(json.loads, index.split("\n") if index else []):
                    if entry["kind"] not in ("response", "revisit"):
                        continue
                    body = zlib.decompress(data[entry["offset"] : entry["offset"] + entry["length"]], 31)
                    end = body.index(b"\r\n\r\n")
                    head = parse_head(body[:end])
                    size, digest = int(head["x-payload-length"]), head["warc-payload-digest"].removeprefix("sha256:")
                    if head["warc-type"] == "response":
                        payload = body[body.index(b"\r\n\r\n", end + 4) + 4 : -4]
                        if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"payload of {head['warc-record-id']} does not match its digest")
                    page, refers = head.get("x-page-id"), head.get("x-refers-to-page-id")
                    found.append({"page_id": page and int(page), "payload_bytes": size, "payload_digest": digest, "record_type": head["warc-type"], "refers_to": refers and int(refers)})
                if found:
                    yield pa.RecordBatch.from_pylist(found, schema=schema)

    return archives.select("content", "index").mapInArrow(run, _READ)


def archive_pages(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """Write pages to monolithic archives, normalise those, and read the result back: one row per page.

    A null html is an empty payload, a null url leaves the target header out; rows that repeat are records of their
    own. Columns other than page_id, url and html are ignored. An empty table writes no archive and has no rows.
    """
    archives, folder = written(_monolithic(with_roles(pages, min_bytes)), "archives")
    members = normalize(archives)
    discard(pages.sparkSession, folder)  # each of its records stands in a member now
    return read_records(members)
