"""WARC archives by way of a chunked record table.

A payload is cut into rows of (record number, chunk number, bytes) as soon as
it leaves the scan.  Each chunk row carries the running SHA-1 of its record up
to that chunk, so the last one holds the payload's digest.  Writer and reader
stream over chunks with a compressor and a hash per record; neither holds a
whole record.

Archives are gzip files with a member per record, written to the shared folder
under names that belong to one task attempt.  The manifest table, committed by
Spark, lists the files of the attempts that counted; nothing else is read back.

Of records with equal payloads the one with the largest page id is the
response, the others revisit it.

Cases: null html is an empty payload; a null page id ranks below all others and
gets no page header; of repeated rows the first is the response; an empty table
gives no archive and no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from urllib.parse import quote

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import open_shared, shared_path, written

CHUNK = 16 << 10
ARCHIVE = 256 << 20
DATE = "2024-01-01T00:00:00Z"
#: Fixed values of the archive format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK_SCHEMA = ("record long, page_id long, url string, n_bytes long, n_chunks int, chunk_no int, chunk binary, "
                "running_digest string")
MANIFEST_SCHEMA = "path string, n_records long, n_bytes long"
READ_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def _base32(sha) -> str:
    return base64.b32encode(sha.digest()).decode()


def chunked(pages: DataFrame, chunk_bytes: int = CHUNK) -> DataFrame:
    """The chunked record table of ``pages`` (page_id, url, html)."""
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "utf-8")
    rows = pages.select(F.monotonically_increasing_id().alias("record"), F.col("page_id").cast("long"), "url",
                        payload.alias("payload"))
    n = F.octet_length("payload")
    rows = rows.withColumn("n_bytes", n.cast("long")).withColumn(
        "n_chunks", F.greatest(F.lit(1), F.ceil(n / F.lit(chunk_bytes))).cast("int"))
    rows = rows.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)))
    rows = rows.select("record", "page_id", "url", "n_bytes", "n_chunks", "chunk_no",
                       F.expr(f"substring(payload, chunk_no * {chunk_bytes} + 1, {chunk_bytes})").alias("chunk"))

    def run(batches):
        import pyarrow as pa
        sha = None
        for batch in batches:
            numbers = batch.column("chunk_no").to_pylist()
            running = []
            for no, chunk in zip(numbers, batch.column("chunk")):
                if no == 0:
                    sha = hashlib.sha1()
                sha.update(chunk.as_buffer())
                running.append(_base32(sha))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(running, pa.string())],
                                             names=[*batch.schema.names, "running_digest"])

    return rows.mapInArrow(run, CHUNK_SCHEMA)


def revisits(chunks: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(record, refers_to) of the records that repeat another's payload of at least ``min_bytes``."""
    last = chunks.filter(F.col("chunk_no") == F.col("n_chunks") - 1).filter(F.col("n_bytes") >= min_bytes).select(
        "record", "page_id", "n_bytes", "running_digest")
    best = (last.groupBy("running_digest", "n_bytes")
            .agg(F.max(F.struct("page_id", (-F.col("record")).alias("r"))).alias("best"), F.count(F.lit(1)).alias("n"))
            .filter("n > 1"))
    return (last.join(best, ["running_digest", "n_bytes"]).filter(F.col("record") != -F.col("best.r"))
            .select("record", F.lit(True).alias("revisit"), F.col("best.page_id").alias("refers_to")))


class _Archive:
    """One open archive: records are written chunk by chunk, each as a gzip member."""

    def __init__(self, folder: str, name: str):
        self.path = f"{folder.rstrip('/')}/{name}.warc.gz"
        self.context = open_shared(self.path, "w")
        self.file = self.context.__enter__()
        self.records = self.size = 0

    def _put(self, data: bytes) -> None:
        self.size += len(data)
        if data:
            self.file.write(data)

    def begin(self, row: dict) -> None:
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['n_bytes']}\r\n\r\n"
        target = quote(row["url"], safe=":/?#[]@!$&'()*+,;=%~") if row["url"] else f"urn:record:{row['record']}"
        head = ["WARC/1.1", f"WARC-Type: {'revisit' if row['revisit'] else 'response'}",
                f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, str(row['record']))}>",
                f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}",
                f"WARC-Payload-Digest: sha1:{row['running_digest']}", "Content-Type: application/http; msgtype=response",
                f"Content-Length: {len(http) + (0 if row['revisit'] else row['n_bytes'])}"]
        if row["page_id"] is not None:
            head.append(f"X-Page-ID: {row['page_id']}")
        if row["revisit"]:
            head.append(f"WARC-Profile: {PROFILE}")
            if row["refers_to"] is not None:
                head.append(f"X-Refers-To-Page-ID: {row['refers_to']}")
        self.gzip = zlib.compressobj(4, zlib.DEFLATED, 31)
        self._put(self.gzip.compress(("\r\n".join(head) + "\r\n\r\n" + http).encode()))

    def chunk(self, data) -> None:
        self._put(self.gzip.compress(data))

    def end(self) -> None:
        self._put(self.gzip.compress(b"\r\n\r\n") + self.gzip.flush())
        self.records += 1

    def close(self) -> tuple[str, int, int]:
        self.context.__exit__(None, None, None)
        return self.path, self.records, self.size


def write_archives(chunks: DataFrame, folder: str, min_bytes: int = 0, archive_bytes: int = ARCHIVE) -> DataFrame:
    """Write the chunk table as archives in ``folder``; returns the manifest."""
    digest = (chunks.filter(F.col("chunk_no") == F.col("n_chunks") - 1)
              .select("record", F.col("running_digest").alias("digest")))
    marks = digest.join(revisits(chunks, min_bytes), "record", "left")
    # numbering a record's chunks asks for all of them in one task, in order, whatever join is planned before it
    # (the window spills beyond 4,096 chunks)
    rows = (chunks.drop("running_digest").join(marks, "record")
            .withColumn("revisit", F.coalesce("revisit", F.lit(False)))
            .withColumn("chunk", F.when(~F.col("revisit"), F.col("chunk")))
            .withColumn("place", F.row_number().over(Window.partitionBy("record").orderBy("chunk_no")) - 1))

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        ctx = TaskContext.get()
        stem = f"part-{ctx.partitionId():06d}-{ctx.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        archive, done = None, []
        for batch in batches:
            heads = batch.drop_columns(["chunk"])
            for i, data in enumerate(batch.column("chunk")):
                row = {n: c[i].as_py() for n, c in zip(heads.schema.names, heads.columns)}
                if row["place"] != row["chunk_no"]:
                    raise ValueError(f"a chunk before {row['chunk_no']} of record {row['record']} is missing")
                if row["chunk_no"] == 0:
                    if archive is not None and archive.size >= archive_bytes:
                        done.append(archive.close())
                        archive = None
                    if archive is None:
                        archive = _Archive(folder, f"{stem}-{len(done):04d}")
                    archive.begin(row | {"running_digest": row["digest"]})
                if data.is_valid:
                    archive.chunk(data.as_buffer())
                if row["chunk_no"] == row["n_chunks"] - 1:
                    archive.end()
        if archive is not None:
            done.append(archive.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["path", "n_records", "n_bytes"])

    return rows.mapInArrow(run, MANIFEST_SCHEMA)


def _blocks(f, size: int = 1 << 18):
    """The unpacked bytes of a file of gzip members, in pieces; nothing is held beyond one piece."""
    unpack, data = zlib.decompressobj(31), f.read(size)
    inside = False
    while data:
        yield unpack.decompress(data, size)
        inside = not unpack.eof
        if unpack.eof:  # at a member's end all that follows is in ``unused_data``
            data = unpack.unused_data
            unpack = zlib.decompressobj(31)
        else:
            data = unpack.unconsumed_tail
        data = data or f.read(size)
    if inside:
        raise ValueError("the archive ends inside a record")


def records(f):
    """Stream over an archive: (header, digest of payload, payload bytes) of every record, block by block."""
    source, buffer = _blocks(f), b""

    def until(mark: bytes) -> bytes:
        nonlocal buffer
        while (at := buffer.find(mark)) < 0:
            more = next(source, None)
            if more is None:
                if buffer.strip():
                    raise ValueError("the archive ends inside a record")
                return b""
            buffer += more
        out, buffer = buffer[:at], buffer[at + len(mark):]
        return out

    def skip(n: int, into) -> None:
        nonlocal buffer
        while n:
            if not buffer:
                buffer = next(source)
            into.update(buffer[:n])
            n, buffer = n - min(n, len(buffer)), buffer[n:]

    while head := until(b"\r\n\r\n"):
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        http = until(b"\r\n\r\n")
        left = int(fields["Content-Length"]) - len(http) - 4
        sha = hashlib.sha1()
        skip(left, sha)
        skip(4, hashlib.sha1())
        length = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))
        yield fields, _base32(sha), length


def read_archives(manifest: DataFrame) -> DataFrame:
    """One row per record of the archives of a manifest; digests of responses are computed from their bytes."""
    def run(batches):
        import pyarrow as pa
        names = [c.split()[0] for c in READ_SCHEMA.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = []
                with open_shared(path, "r") as f:
                    for head, digest, length in records(f):
                        kind, said = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
                        if kind == "response" and said != digest:
                            raise ValueError(f"{path}: digest of {head['WARC-Record-ID']} differs")
                        page, ref = head.get("X-Page-ID"), head.get("X-Refers-To-Page-ID")
                        rows.append((None if page is None else int(page), length, said, kind,
                                     None if ref is None else int(ref), head["WARC-Target-URI"]))
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    tasks = max(1, manifest.count())  # archives, not the manifest's files or size, decide the tasks
    return manifest.select("path").repartition(tasks, "path").mapInArrow(run, READ_SCHEMA)


def round_trip(pages: DataFrame, min_bytes: int = 0, chunk_bytes: int = CHUNK) -> DataFrame:
    """Write an archive record per page, then read the archives back."""
    spark = pages.sparkSession
    chunks = written(chunked(pages, chunk_bytes), "warc-chunks")
    manifest = written(write_archives(chunks, shared_path(spark, "warc"), min_bytes), "warc-manifest")
    return read_archives(manifest)
