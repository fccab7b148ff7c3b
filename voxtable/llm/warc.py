"""WARC archives as a chunked record table.

A record's bytes (header, payload, trailer) are rows (record, record_id,
chunk_no, chunks, head, data, crc32, sha1): the payload is cut into chunks of a
bounded size, and each chunk carries the digests of the payload up to and
including it. The table is written and committed by Spark like any other, so it
lives in any store and survives lost executors; concatenating ``head`` and
``data`` in the order of record and chunk gives a standard WARC file. Reading
back, chunks of a record stream through an incremental digest that is compared
at every chunk; only records of more than one chunk are shuffled to bring their
chunks together in order, and no task holds more than one chunk of a record.

Of the records with equal payloads of at least ``min_bytes`` bytes, those with
the largest id are responses; the others are revisit records, which store no
payload and refer to it.

Defined cases: a null payload is empty; rows with the same id and payload are
all responses if their id is the largest; a null id is never the largest unless
all are null; null URLs are written as an empty target; line breaks and spaces
in a URL are percent-encoded; an empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtable.scratch import cut

#: Payload bytes of one chunk.
CHUNK = 1 << 18
CHUNKS = "record long, record_id long, chunk_no int, chunks int, head binary, data binary, crc32 long, sha1 binary"
RECORDS = "record_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
#: Fixed, so that equal inputs give equal archives.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def _urn(record_id) -> str:
    return f"<urn:record:{'' if record_id is None else record_id}>"


def header(record_id, url: str, kind: str, digest: str, size: int, refers_to) -> bytes:
    """WARC header and, for both kinds, the HTTP header of the payload; ``size``: of the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
    target = "".join(c if c > " " else "".join(f"%{b:02X}" for b in c.encode()) for c in url)
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(record_id)}", f"WARC-Target-URI: {target}", f"WARC-Date: {DATE}",
             f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
             f"Content-Length: {len(http) + (size if kind == 'response' else 0)}"]
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    return ("\r\n".join(lines) + "\r\n\r\n" + http).encode("utf-8", "surrogatepass")


def _write(chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.binary())
        names = ["record", "record_id", "chunk_no", "chunks", "head", "data", "crc32", "sha1"]
        record = TaskContext.get().partitionId() << 40
        for b in batches:
            rows: list[tuple] = []
            held = 0
            for key, url, body, kind, refers in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), b.column(4).to_pylist()):
                view = memoryview(body.as_buffer())  # no copy of the payload
                size, stored = len(view), kind == "response"
                n = max(1, -(-size // chunk)) if stored else 1
                digest, crc = hashlib.sha1(), 0
                record += 1
                whole = hashlib.sha1(view).digest()
                for k in range(n):
                    part = view[k * chunk : (k + 1) * chunk] if stored else view[:0]
                    digest.update(part)
                    crc = zlib.crc32(part, crc)
                    rows.append((record, key, k, n, header(key, url, kind, base32(whole), size, refers) if not k else b"", part.tobytes() + (b"\r\n\r\n" if k == n - 1 else b""), crc, digest.digest()))
                    held += len(part)
                    if held > 1 << 24:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return run


def archive(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", chunk: int = CHUNK, min_bytes: int = 0) -> DataFrame:
    """The chunk table of a record for each row of ``pages``."""
    rows = pages.select(F.col(page_id).cast("long").alias("id"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"),
                        F.encode(F.coalesce(F.col(html).cast("string"), F.lit("")), "UTF-8").alias("body"))
    rows = rows.withColumn("digest", F.sha1("body"))
    own = rows.select("digest", "id", F.length("body").alias("size"))
    # One row for each payload that several records share; joined as small or large as it is.
    shared = own.where(F.col("size") >= min_bytes).groupBy("digest").agg(F.max("id").alias("last"), F.count("*").alias("n")).where("n > 1")
    shared = cut(shared.select(F.col("digest").alias("d"), "last"), "payloads")
    joined = rows.join(shared, F.col("digest") == F.col("d"), "left")
    first = F.col("d").isNull() | F.col("id").eqNullSafe(F.col("last"))
    typed = joined.select("id", "url", "body", F.when(first, "response").otherwise("revisit").alias("kind"), F.when(~first, F.col("last")).alias("refers_to"))
    return typed.mapInArrow(_write(chunk), CHUNKS)


def _fields(head: bytes) -> tuple[dict[str, str], dict[str, str]]:
    warc, _, http = head.decode("utf-8", "surrogatepass").partition("\r\n\r\n")
    return tuple(dict(x.split(": ", 1) for x in part.split("\r\n")[1:] if ": " in x) for part in (warc, http))


def _id(urn: str) -> int | None:
    text = urn.removeprefix("<urn:record:").removesuffix(">")
    return int(text) if text else None


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks in the order of record and number -> records, checked at every chunk."""
    warc: dict[str, str] = {}
    http: dict[str, str] = {}
    digest, crc, size = hashlib.sha1(), 0, 0
    for b in batches:
        out: list[tuple] = []
        for _, key, k, n, head, data, want_crc, want_sha in zip(*(b.column(i) for i in range(8))):
            view = memoryview(data.as_buffer())
            last = k.as_py() == n.as_py() - 1
            if k.as_py() == 0:
                warc, http = _fields(head.as_py())
                digest, crc, size = hashlib.sha1(), 0, 0
            part = view[:-4] if last else view
            digest.update(part)
            crc = zlib.crc32(part, crc)
            size += len(part)
            if crc != want_crc.as_py() or digest.digest() != want_sha.as_py():
                raise ValueError(f"record {key.as_py()}, chunk {k.as_py()}: its digest differs from the one written")
            if last:
                kind, told = warc["WARC-Type"], warc["WARC-Payload-Digest"].removeprefix("sha1:")
                if kind == "response" and (base32(digest.digest()) != told or size != int(http["Content-Length"])):
                    raise ValueError(f"record {key.as_py()}: the payload differs from its header")
                out.append((key.as_py(), int(http["Content-Length"]), told, kind, _id(warc["WARC-Refers-To"]) if kind == "revisit" else None))
        cols = list(zip(*out)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], ["record_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def records(chunks: DataFrame) -> DataFrame:
    """(record_id, payload_bytes, payload_digest, record_type, refers_to) of each record of a chunk table.

    Sizes and digests are of the full payload; a revisit's are those of its header.
    """
    one = chunks.where("chunks = 1").mapInArrow(_read, RECORDS)
    many = chunks.where("chunks > 1").repartition("record").sortWithinPartitions("record", "chunk_no")
    return one.unionByName(many.mapInArrow(_read, RECORDS))


def round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", chunk: int = CHUNK, min_bytes: int = 0) -> DataFrame:
    """Writes the archive to the shared folder and reads its records back."""
    return records(cut(archive(pages, page_id, url, html, chunk, min_bytes), "warc"))
