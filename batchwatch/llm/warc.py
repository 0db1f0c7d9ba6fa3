"""WARC archives written from and read into a chunked record table.

A payload is a run of rows (record_id, chunk_no, data) of at most ``CHUNK`` bytes.  Each row carries the SHA-1 of
the payload up to its end, so the last one has the whole digest.  Writer and reader stream such rows: neither
holds more than one chunk of a record.

Archives are files of one gzip member per record below the shared folder.  A task names its files itself and
returns the names; only names of finished tasks are read, so files of lost attempts are never seen.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import scratch

CHUNK = 64 * 1024
#: an archive is closed when it has this many bytes
ARCHIVE_BYTES = 256 * 1024 * 1024
#: payloads of fewer bytes are never replaced by a reference
LEAST_REVISIT = 1000
#: rows are handed to Spark when they hold this many bytes
_FLUSH = 4 * 1024 * 1024
# Fixed value: the date of all records, so that archives of equal tables are equal
DATE = "2024-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

_CHUNKS = ("record_id long, chunk_no int, last boolean, page_id long, url string, payload_bytes long, "
           "payload_digest string, record_type string, refers_to long, data binary")
_COLUMNS = [c.split()[0] for c in _CHUNKS.split(", ")]
_LONGS = {"record_id": "Int64", "page_id": "Int64", "payload_bytes": "Int64", "refers_to": "Int64"}


def _frames(rows: Iterator[tuple]) -> Iterator[pd.DataFrame]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 500 + len(row[-1] or b"")
        if size >= _FLUSH:
            yield pd.DataFrame(held, columns=_COLUMNS).astype(_LONGS)
            held, size = [], 0
    yield pd.DataFrame(held, columns=_COLUMNS).astype(_LONGS)


def _number(value) -> int | None:
    return None if value is None or value is pd.NA or value != value else int(value)


def chunk_records(pages: DataFrame) -> DataFrame:
    """Chunk rows of (page_id, url, html); null payloads are empty, and an empty payload is one empty chunk.

    ``record_id`` numbers the rows of ``pages``, so repeated pages stay apart.  Other columns are not read.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for batch in batches:
            for record, page, url, html in zip(batch["record_id"], batch["page_id"].astype("Int64"), batch["url"], batch["html"]):
                payload = (html or "").encode("utf-8", "surrogatepass")
                digest = hashlib.sha1()
                for k, at in enumerate(range(0, max(1, len(payload)), CHUNK)):
                    data = payload[at:at + CHUNK]
                    digest.update(data)
                    yield (record, k, at + CHUNK >= len(payload), _number(page), url, at + len(data),
                           digest.hexdigest(), None, None, data)

    numbered = pages.selectExpr("monotonically_increasing_id() AS record_id", "cast(page_id AS long) AS page_id", "url", "html")
    return numbered.mapInPandas(lambda batches: _frames(rows(batches)), _CHUNKS)


def stored(chunks: DataFrame) -> DataFrame:
    """The chunk table as compressed Parquet in the shared folder."""
    path = scratch(chunks.sparkSession, "chunks")
    chunks.write.option("compression", "zstd").parquet(path)
    return chunks.sparkSession.read.schema(chunks.schema).parquet(path)


def record_heads(chunks: DataFrame) -> DataFrame:
    """One row per record, in the form of a chunk with number -1: whole size and digest, type and reference.

    Of records with equal payloads of at least ``LEAST_REVISIT`` bytes those with the greatest page_id are
    responses, the others revisit it; a null page_id is less than any other.
    """
    last = chunks.where("last").drop("data", "record_type", "refers_to")
    greatest = last.where(f"payload_bytes >= {LEAST_REVISIT}").groupBy("payload_digest", "payload_bytes").agg(
        F.max("page_id").alias("response"))
    head = last.join(greatest, ["payload_digest", "payload_bytes"], "left")
    revisit = f"payload_bytes >= {LEAST_REVISIT} AND NOT page_id <=> response"
    return head.selectExpr(
        "record_id", "-1 AS chunk_no", "false AS last", "page_id", "url", "payload_bytes", "payload_digest",
        f"IF({revisit}, 'revisit', 'response') AS record_type", f"IF({revisit}, response, NULL) AS refers_to",
        "CAST(NULL AS BINARY) AS data")


def _urn(kind: str, page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind}:{page}:{digest}')}>"


def _header(head) -> bytes:
    page, refers = _number(head.page_id), _number(head.refers_to)
    revisit = head.record_type == "revisit"
    digest = base64.b32encode(bytes.fromhex(head.payload_digest)).decode()
    url = "".join(c if c > " " else f"%{ord(c):02X}" for c in head.url or "")
    fields = {
        "WARC-Type": head.record_type, "WARC-Record-ID": _urn(head.record_type, page, head.payload_digest),
        "WARC-Date": DATE, "WARC-Target-URI": url or None, "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None,
        "WARC-Refers-To": _urn("response", refers, head.payload_digest) if revisit else None,
        "X-Page-ID": page, "X-Refers-To-Page": refers, "X-Payload-Length": int(head.payload_bytes),
        "Content-Type": "application/http;msgtype=response",
        "Content-Length": len(_HTTP) + (0 if revisit else int(head.payload_bytes)),
    }
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields.items() if v is not None)]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + _HTTP


class _Archives:
    """Writes records to files of about ``ARCHIVE_BYTES`` each."""

    def __init__(self, folder: str):
        self.uri = folder
        self.system, self.folder = fs.FileSystem.from_uri(folder)
        self.file, self.done, self.member = None, [], None

    def begin(self, data: bytes) -> None:
        if self.file is None:
            self.system.create_dir(self.folder, recursive=True)
            name, self.size, self.records = f"{uuid.uuid4().hex}.warc.gz", 0, 0
            self.path = f"{self.uri}/{name}"
            self.file = self.system.open_output_stream(f"{self.folder}/{name}", compression=None)
        self.member = zlib.compressobj(level=4, wbits=31)
        self.records += 1
        self.add(data)

    def add(self, data: bytes) -> None:
        self._write(self.member.compress(data))

    def end(self) -> None:
        if self.member is not None:
            self.add(b"\r\n\r\n")
            self._write(self.member.flush())
            self.member = None
            if self.size >= ARCHIVE_BYTES:
                self.close()

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.done.append((self.path, self.size, self.records))
            self.file = None

    def _write(self, data: bytes) -> None:
        self.file.write(data)
        self.size += len(data)


def _packed():
    """Compresses chunks one by one, for the way through the shuffle."""

    @F.pandas_udf("binary")
    def run(data: pd.Series) -> pd.Series:
        pack = zstandard.ZstdCompressor(level=1).compress
        return data.map(lambda d: None if d is None else pack(d))

    return run


def write_archives(chunks: DataFrame, folder: str) -> DataFrame:
    """Write the records of a stored chunk table; returns (path, bytes, records) of the archives, stored.

    Heads and chunks are dealt by record and sorted, so a record arrives head first, then chunk by chunk.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        archives = _Archives(folder)
        whole, unpack = False, zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.chunk_no < 0:
                    archives.end()
                    archives.begin(_header(row))
                    whole = row.record_type == "response"
                elif whole:
                    archives.add(unpack(row.data))
        archives.end()
        archives.close()
        yield pd.DataFrame(archives.done, columns=["path", "bytes", "records"])

    small = chunks.withColumn("data", _packed()("data"))
    dealt = record_heads(chunks).unionByName(small).repartition("record_id").sortWithinPartitions("record_id", "chunk_no")
    written = dealt.mapInPandas(run, "path string, bytes long, records long")
    manifest = scratch(chunks.sparkSession, "archives")
    written.write.parquet(manifest)
    return chunks.sparkSession.read.schema(written.schema).parquet(manifest)


class _Stream:
    """The decompressed bytes of all gzip members of a file, a bounded piece at a time."""

    def __init__(self, file):
        self.file, self.raw, self.member, self.held = file, b"", zlib.decompressobj(31), b""

    def _more(self) -> bool:
        while True:
            if self.member.eof:
                self.raw, self.member = self.member.unused_data, zlib.decompressobj(31)
            if not self.raw:
                self.raw = self.file.read(CHUNK)
                if not self.raw:
                    return False
            data = self.member.decompress(self.raw, CHUNK)
            self.raw = self.member.unconsumed_tail
            if data:
                self.held += data
                return True

    def until(self, mark: bytes) -> bytes | None:
        """The bytes before ``mark``, which is consumed; None at the end of the file."""
        while (at := self.held.find(mark)) < 0:
            if not self._more():
                return None
        out, self.held = self.held[:at], self.held[at + len(mark):]
        return out

    def take(self, n: int) -> bytes:
        """At most ``n`` bytes, at least one unless the file is cut off."""
        if not self.held and not self._more():
            raise EOFError("archive ends inside a record")
        out, self.held = self.held[:n], self.held[n:]
        return out

    def skip(self, n: int) -> None:
        while n:
            n -= len(self.take(n))


def _read(path: str, with_data: bool) -> Iterator[tuple]:
    system, place = fs.FileSystem.from_uri(path)
    with system.open_input_stream(place, compression=None) as file:
        stream, record = _Stream(file), 0
        while (head := stream.until(b"\r\n\r\n")) is not None:
            fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
            page, refers = (int(fields[k]) if k in fields else None for k in ("X-Page-ID", "X-Refers-To-Page"))
            kind, url = fields["WARC-Type"], fields.get("WARC-Target-URI")
            stored = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
            left = int(fields["Content-Length"]) - len(stream.until(b"\r\n\r\n")) - 4
            if kind == "revisit":
                yield (record, 0, True, page, url, int(fields["X-Payload-Length"]), stored, kind, refers, None)
            else:
                digest, size, k = hashlib.sha1(), 0, 0
                while True:
                    data = b""
                    while left and len(data) < CHUNK:
                        data += (part := stream.take(min(left, CHUNK - len(data))))
                        left -= len(part)
                    digest.update(data)
                    size += len(data)
                    if not left and digest.hexdigest() != stored:
                        raise ValueError(f"payload of record {record} in {path} does not have its digest")
                    yield (record, k, not left, page, url, size, digest.hexdigest(), kind, refers,
                           data if with_data else None)
                    k += 1
                    if not left:
                        break
            stream.skip(4)
            record += 1


def read_archives(manifest: DataFrame, with_data: bool = True) -> DataFrame:
    """Chunk rows of the archives; ``record_id`` counts within an archive.  A wrong digest fails the job.

    A revisit is one row without data; its size and digest are those of the payload it stands for.
    """
    archives = max(1, manifest.count())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                yield from _frames(_read(path, with_data))

    return manifest.select("path").repartition(archives, "path").mapInPandas(run, _CHUNKS)


def oracle() -> str:
    """DuckDB SQL for the records of ``pages``."""
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS response FROM d),
r AS (SELECT *, payload_bytes >= {LEAST_REVISIT} AND page_id IS DISTINCT FROM response AS again FROM m)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN response END AS refers_to FROM r"""
