"""WARC archives and their chunked record table.

Writing: a task streams its rows into gzip members, one per record, and lists the archives it finished. Equal payloads
of at least `least` bytes are stored once: the record with the smallest page_id is the response, the others are
revisit records that name it. Reading: a task walks through an archive with buffers of a fixed size and emits rows
(record, chunk number), each with the digest of the payload so far, so no record is ever held whole, however large.

Archives lie in the shared folder, reached through its URI: by pyarrow, in the tasks, so the store must be one that
pyarrow knows too. Each attempt of a task writes archives of its own names and
only those of the attempt that succeeded are in the list, so a lost executor leaves nothing but unlisted files.

Defined results: null html is an empty payload; payloads under `least` bytes are always responses; repeated rows with
the page_id of the response are responses too; a null page_id never becomes the target of a revisit; null urls are
written as urn:page URIs; an empty table gives an empty record table. Columns other than page_id, url, html are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, durable, scratch_path, written

LEAST_BYTES = 100
CHUNK_BYTES = 1 << 20
ARCHIVE_BYTES = 1 << 30
#: Repeated payloads that may be broadcast, about 100 bytes each; beyond, the pages are joined by a shuffle.
BROADCAST_ROWS = 100_000

_BUFFER = 1 << 18
_LIST = "archive string, records long, bytes long"
CHUNKS = (
    "archive string, record_id string, page_id long, record_type string, refers_to long, declared_digest string, "
    "chunk long, offset long, n long, digest string, last boolean, payload binary"
)


def with_targets(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, html, digest and refers_to: the page whose payload is equal and which this one revisits, or null."""
    html = F.coalesce(F.col("html"), F.lit(""))
    keyed = pages.select("page_id", "url", html.alias("html"), F.sha2(html, 256).alias("digest"))
    repeated = durable(
        keyed.where(F.octet_length("html") >= least).groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("digest", "first")
    )
    if repeated.count() <= BROADCAST_ROWS:
        repeated = F.broadcast(repeated)
    first = F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))
    return keyed.join(repeated, "digest", "left").select("page_id", "url", "html", "digest", first.alias("refers_to"))


class _Member:
    """A gzip member written piece by piece."""

    def __init__(self, out):
        self._out, self._zip = out, zlib.compressobj(6, zlib.DEFLATED, 31)

    def add(self, data) -> None:
        self._out.write(self._zip.compress(data))

    def close(self) -> None:
        self._out.write(self._zip.flush())


def _record(out, page, url: str | None, payload: memoryview, digest: str, target) -> None:
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page}"
    http = b"" if target is not None else f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if target is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{page}>",
        f"WARC-Target-URI: {uri}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + (len(payload) if target is None else 0)}",
    ]
    if target is not None:
        lines += [f"WARC-Refers-To: <urn:page:{target}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    member = _Member(out)
    member.add("\r\n".join(lines).encode() + b"\r\n\r\n" + http)
    if target is None:
        for a in range(0, len(payload), _BUFFER):
            member.add(payload[a : a + _BUFFER])
    member.add(b"\r\n\r\n")
    member.close()


def _cells(column: pa.Array) -> Iterator[memoryview]:
    """The UTF-8 bytes of a string column, without a copy."""
    column = column.cast(pa.large_string())
    _, ends, data = column.buffers()
    at = memoryview(ends).cast("q")[column.offset : column.offset + len(column) + 1]
    view = memoryview(data) if data is not None else memoryview(b"")
    for a, b in zip(at, at[1:]):
        yield view[a:b]


def write_archives(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write rows of with_targets() as archives in a folder; the written list of archives, one or more per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name = out = None
        done, records = [], 0

        def finish():
            done.append((name, records, out.tell()))
            out.close()

        for batch in batches:
            page, url, digest, target = (batch.column(k).to_pylist() for k in (0, 1, 3, 4))
            for k, payload in enumerate(_cells(batch.column(2))):
                if out is not None and out.tell() >= archive_bytes:
                    finish()
                    out = None
                if out is None:
                    name, records = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None, buffer_size=_BUFFER)
                _record(out, "none" if page[k] is None else page[k], url[k], payload, digest[k], target[k])
                records += 1
        if out is not None:
            finish()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done) if done else [[]] * 3, (pa.string(), pa.int64(), pa.int64()))], ["archive", "records", "bytes"])

    listed = rows.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(run, _LIST)
    with batches_of(rows.sparkSession, 2000):
        return written(listed, "archives")


class _Reader:
    """The decompressed bytes of an archive of gzip members, in pieces of bounded size."""

    def __init__(self, stream):
        self._stream, self._zip, self._in, self._buffer = stream, zlib.decompressobj(31), b"", bytearray()

    def _more(self) -> bool:
        while True:
            if self._zip.eof:
                self._in, self._zip = self._zip.unused_data, zlib.decompressobj(31)
            if not self._in:
                self._in = self._stream.read(_BUFFER)
                if not self._in:
                    return False
            data = self._zip.decompress(self._in, _BUFFER)
            self._in = b"" if self._zip.eof else self._zip.unconsumed_tail
            if data:
                self._buffer += data
                return True

    def head(self) -> bytes | None:
        """All up to an empty line, without it; None at the end."""
        while (end := self._buffer.find(b"\r\n\r\n")) < 0:
            if not self._more():
                if self._buffer.strip():
                    raise ValueError("the archive ends within a record")
                return None
        head = bytes(self._buffer[:end])
        del self._buffer[: end + 4]
        return head

    def take(self, n: int) -> bytes:
        """The next bytes, n at most and one at least."""
        if not self._buffer and not self._more():
            raise ValueError("the archive ends within a record")
        data = bytes(self._buffer[:n])
        del self._buffer[: len(data)]
        return data


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode().lstrip("\r\n").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def _page(uri: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", uri or "")
    return int(found[1]) if found else None


def _records(reader: _Reader, chunk_bytes: int) -> Iterator[tuple]:
    """Chunk rows without the archive's name."""
    while (head := reader.head()) is not None:
        field = _fields(head)
        left, told = int(field["content-length"]), field.get("warc-payload-digest", "").removeprefix("sha256:") or None
        ident = (field["warc-record-id"], _page(field["warc-record-id"]), field["warc-type"], _page(field.get("warc-refers-to")), told)
        if left:
            http = reader.head()
            left -= len(http) + 4
        chunk, offset, sha = 0, 0, hashlib.sha256()
        while True:
            piece = bytearray()
            while left and len(piece) < chunk_bytes:
                got = reader.take(min(left, chunk_bytes - len(piece)))
                piece += got
                left -= len(got)
            sha.update(piece)
            so_far = sha.copy().hexdigest()
            if not left and ident[2] == "response" and told and told != so_far:
                raise ValueError(f"{ident[0]}: the payload does not have the digest of its record")
            yield (*ident, chunk, offset, len(piece), so_far, not left, bytes(piece))
            if not left:
                break
            chunk, offset = chunk + 1, offset + len(piece)
        if reader.head() != b"":
            raise ValueError(f"{ident[0]}: the record is longer than it says")


def read_archives(archives: DataFrame, folder: str, chunk_bytes: int = CHUNK_BYTES, payloads: bool = True) -> DataFrame:
    """The chunked record table of the archives of a list: see CHUNKS. Without payloads their bytes are left out."""
    spec = [(x.split()[0], {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}[x.split()[1]]) for x in CHUNKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = FileSystem.from_uri(folder)

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), spec)], [n for n, _ in spec])

        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for row in _records(_Reader(stream), chunk_bytes):
                        rows.append((name, *(row if payloads else (*row[:-1], None))))
                        held += len(row[-1]) if payloads else 0
                        if held >= 4 * chunk_bytes or len(rows) >= 2000:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    tasks = max(1, archives.sparkSession.sparkContext.defaultParallelism)
    return archives.select("archive").repartition(max(tasks, archives.count())).mapInArrow(run, CHUNKS)


def record_table(chunks: DataFrame) -> DataFrame:
    """A row per record: its last chunk has the length and the digest. Revisits take theirs from the record they name."""
    last = chunks.where("last").select("page_id", "record_type", "refers_to", "declared_digest", (F.col("offset") + F.col("n")).alias("bytes"), "digest")
    last = durable(last)
    own = last.where("record_type = 'response'")
    named = own.select(F.col("page_id").alias("refers_to"), F.col("digest").alias("declared_digest"), "bytes").distinct()
    revisits = last.where("record_type = 'revisit'").drop("bytes", "digest").join(named, ["refers_to", "declared_digest"], "left")
    return own.select("page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to").unionByName(
        revisits.select("page_id", F.col("bytes").alias("payload_bytes"), F.col("declared_digest").alias("payload_digest"), "record_type", "refers_to")
    )


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    folder = scratch_path(spark, "warc")
    archives = write_archives(with_targets(pages), folder)
    return record_table(read_archives(archives, folder))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes FROM pages),
     g AS (SELECT html, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY html)
SELECT page_id, payload_bytes, sha256(html) AS payload_digest,
       CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN g USING (html)
"""
