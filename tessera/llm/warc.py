"""WARC archives written and read as a table of chunks.

A payload is written as records of bounded size: a first record and, for an oversized payload, continuation records with
WARC-Segment-Number and WARC-Segment-Origin-ID, as the standard has it. Each is one row (record id, chunk number, bytes),
and Spark's text writer lays the rows one after another into files of whole records, on any store that Spark writes. Chunks
are cut from the bytes of the row as Arrow holds them, one at a time, and the SHA-1 is carried from chunk to chunk.

A record ends and the next begins with the line WARC/1.1, after an empty line; a chunk that would hold WARC/1.1 is cut inside
it, so the sequence never stands within a record and splits the file into rows. Files without compression are read in splits;
of gzip files, as the query writes them to save disk, each is one stream, and its number of records is bounded (RECORDS).
Payloads of one chunk get their digest where they are read. Only the chunks of oversized ones are dealt out by written row,
sorted by chunk number and digested one after another, whatever the size of the whole.

Of pages with equal payloads, that with the smallest id is stored and the others become revisit records, which name it. A
record's id is its page's id and its payload's digest; copies of an oversized record are told apart by task and row.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import release, shared_dir, slices

#: Bytes of a chunk; records of a file.
CHUNK, RECORDS = 256 * 1024, 8192
MARK = b"\r\n\r\nWARC/1.1\r\n"
_PREFIX = "<urn:page:"


def parts(batches: Iterator[pa.RecordBatch], column: int, most: int = 16 * CHUNK) -> Iterator[pa.RecordBatch]:
    """Batches cut so that a column of bytes has at most `most` in each, or one row: what is taken out of them stays small
    however long the rows are. Their memory goes back at the end, as the worker lives on."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        for a, b in slices(sizes, most):
            yield batch.slice(a, b - a)
    pa.default_memory_pool().release_unused()


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def chunks(payload: bytes | memoryview, size: int = CHUNK) -> Iterator[bytes]:
    """Pieces of at most `size` bytes, at least one; no piece holds the version line that begins a record."""
    at, n = 0, len(payload)
    if n == 0:
        yield b""
    while at < n:
        piece = bytes(payload[at : at + size])
        if (found := piece.find(MARK[4:-2])) >= 0:
            piece = piece[: found + 2]
        yield piece
        at += len(piece)


def _head(kind: str, record: str, length: int, more: dict[str, object]) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_PREFIX}{record}>", "WARC-Date: 1970-01-01T00:00:00Z", *(f"{k}: {v}" for k, v in more.items()), "Content-Type: text/html", f"Content-Length: {length}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def _uri(url: str | None) -> str | None:
    """A header value: what would end the line is written in hexadecimal."""
    return None if url is None else "".join(c if c > " " and c != "%" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def records(page: int | None, url: str | None, payload: bytes | memoryview, sha1: str, first: int | None, row: str, size: int = CHUNK) -> Iterator[bytes]:
    """The records of a page. sha1: the payload's digest, in hexadecimal; first: the page that holds the payload if it isn't
    this one; row: a name of the written row."""
    name = "null" if page is None else str(page)
    record = f"{name}:{sha1}"
    target = {} if url is None else {"WARC-Target-URI": _uri(url)}
    named = {"WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode()}
    if first is not None:
        more = {"WARC-Refers-To": f"{_PREFIX}{first}:{sha1}>", "X-Payload-Length": len(payload), "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
        yield _head("revisit", record, 0, target | named | more) + b"\r\n\r\n"
        return
    digest, piece, number = hashlib.sha1(), None, 0
    for following in chunks(payload, size):
        if piece is not None:
            number += 1
            digest.update(piece)
            yield _segment(record, target, number, piece, {"X-Row": row})
        piece = following
    number += 1
    digest.update(piece)
    if digest.hexdigest() != sha1:
        raise ValueError(f"payload of page {name} has digest {digest.hexdigest()}, not {sha1}")
    if number == 1:
        yield _head("response", record, len(piece), target | named) + piece + b"\r\n\r\n"
    else:  # the last segment names the whole
        yield _segment(record, target, number, piece, named | {"X-Row": row, "WARC-Segment-Total-Length": len(payload)})


def _segment(record: str, target: dict, number: int, piece: bytes, more: dict) -> bytes:
    head = {"WARC-Segment-Number": number} | ({"WARC-Segment-Origin-ID": f"{_PREFIX}{record}>"} if number > 1 else {}) | more
    name = record if number == 1 else f"{record}#{number}"
    return _head("response" if number == 1 else "continuation", name, len(piece), target | head) + piece + b"\r\n\r\n"


def with_first(pages: DataFrame) -> tuple[DataFrame, str]:
    """(page_id, url, payload binary, sha1 string, first_id) of pages (page_id, url, html), null as empty. first_id is the
    smallest id of all rows with the same payload, null where no other row has it or none has an id.

    Only the digests are dealt out, by themselves; those of several rows are written and joined to the pages again. Spark
    measures the written table: a small one goes to every task, and for a large one the pages are dealt out by digest, a
    digest of many rows further, as the other side has one row for it. Returns the written table's path as well.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    path = shared_dir(spark, "warc-copies")
    own = pages.select("page_id", F.unhex(F.sha1(payload)).alias("sha1"), F.octet_length(payload).alias("size"))
    own.groupBy("sha1", "size").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n").write.parquet(path)
    keyed = pages.select("page_id", "url", payload.alias("payload"), F.unhex(F.sha1(payload)).alias("sha1"), F.octet_length(payload).alias("size"))
    marked = keyed.join(spark.read.parquet(path), ["sha1", "size"], "left")
    return marked.select("page_id", "url", "payload", F.lower(F.hex("sha1")).alias("sha1"), "first_id"), path


def write(pages: DataFrame, path: str, size: int = CHUNK, compression: str = "gzip", key: str = "page_id", url: str = "url", payload: str = "html") -> None:
    """Write archives. A null payload is empty. Rows repeated with one id hold their payload each; a row without an id
    holds its payload unless a row with an id has the same one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        rows, held, number = [], 0, 0
        for batch in parts(batches, 2):
            ids, urls, _, digests, firsts = (c.to_pylist() if k != 2 else None for k, c in enumerate(batch.columns))
            for page, link, data, sha1, first in zip(ids, urls, batch.column(2), digests, firsts, strict=True):
                number += 1
                for record in records(page, link, memoryview(data.as_buffer()), sha1, None if first == page else first, f"{task}-{number}", size):
                    # the writer ends each row by a line feed: the last byte of a record
                    rows.append(record[:-1])
                    held += len(record)
                    if held > 16 * CHUNK:
                        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["value"])
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["value"])

    marked, copies = with_first(pages.selectExpr(f"cast(`{key}` as long) page_id", f"cast(`{url}` as string) url", f"`{payload}` html"))
    bytes_ = marked.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    bytes_.write.option("lineSep", "\n").option("compression", compression).option("maxRecordsPerFile", RECORDS).text(path)
    release(pages.sparkSession, copies)


_PARTS = "record string, kind string, url string, chunk int, last boolean, named string, total long, refers string, row string, data binary"


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The table of chunks: record id, type, chunk number from 1, whether it is the last, its bytes and what its header says.
    Rows are records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 0):
            out: list[list] = [[] for _ in range(10)]
            for row in batch.column(0).to_pylist():
                if not row:
                    continue
                for column, value in zip(out, _parse(row), strict=True):
                    column.append(value)
            types = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], [x.split()[0] for x in _PARTS.split(", ")])

    rows = spark.read.option("lineSep", MARK.decode()).text(path).select(F.col("value").cast("binary"))
    return rows.mapInArrow(run, _PARTS)


def _parse(row: bytes) -> tuple:
    head, _, data = row.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.removeprefix(b"WARC/1.1\r\n").decode().split("\r\n"))
    length = int(fields["Content-Length"])
    if len(data) < length or data[length:].strip(b"\r\n"):
        raise ValueError(f"a record of {length} bytes has {len(data)}")
    number = int(fields.get("WARC-Segment-Number", 1))
    record = fields.get("WARC-Segment-Origin-ID", fields["WARC-Record-ID"])[len(_PREFIX) : -1]
    last = "WARC-Segment-Total-Length" in fields or "WARC-Segment-Number" not in fields
    total = fields.get("X-Payload-Length") or fields.get("WARC-Segment-Total-Length") or (length if last else None)
    refers = fields.get("WARC-Refers-To")
    return record, fields["WARC-Type"], fields.get("WARC-Target-URI"), number, last, fields.get("WARC-Payload-Digest", "")[5:] or None, None if total is None else int(total), refers and refers[len(_PREFIX) : -1], fields.get("X-Row"), data[:length]


_OUT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def payloads(table: DataFrame) -> DataFrame:
    """One row for each record of a table of chunks, with the size and digest of its payload as read.

    The digest of what was read is held against the one that the header names; a difference raises ValueError.
    """

    def number(x: str | None) -> int | None:
        name = None if x is None else x.split(":")[0]
        return None if name in (None, "null") else int(name)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], [x.split()[0] for x in _OUT.split(", ")])

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 5):
            rows = []
            for record, kind, named, total, refers, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == "revisit":
                    rows.append((number(record), total, named, kind, number(refers)))
                else:
                    if (found := base32_sha1(data)) != named:
                        raise ValueError(f"payload of record {record} has digest {found}, not {named}")
                    rows.append((number(record), len(data), found, kind, None))
            if rows:
                yield batch_of(rows)

    def many(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, digest, size, following = None, None, 0, 0
        for batch in parts(batches, 5):
            rows = []
            for record, row, chunk, last, named, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if current is None:
                    current, digest, size, following = (record, row), hashlib.sha1(), 0, 1
                if (record, row) != current or chunk != following:
                    raise ValueError(f"record {current[0]} has no chunk {following}")
                following += 1
                digest.update(data)
                size += len(data)
                if last:
                    found = base64.b32encode(digest.digest()).decode()
                    if found != named:
                        raise ValueError(f"payload of record {record} has digest {found}, not {named}")
                    rows.append((number(record), size, found, "response", None))
                    current = None
            if rows:
                yield batch_of(rows)
        if current is not None:
            raise ValueError(f"record {current[0]} has no end")

    single = table.where("last and chunk = 1").select("record", "kind", "named", "total", "refers", "data").mapInArrow(one, _OUT)
    whole = table.where("not last or chunk > 1").select("record", "row", "chunk", "last", "named", "data").repartition("record", "row").sortWithinPartitions("record", "row", "chunk").mapInArrow(many, _OUT)
    return single.unionByName(whole)


def archive_and_read(pages: DataFrame, size: int = CHUNK) -> DataFrame:
    """Write archives of the pages into the shared folder and read them back: what payloads() returns.

    An empty table gives no row. Null columns: see write(). Other columns of the table are not looked at.
    """
    spark = pages.sparkSession
    path = shared_dir(spark, "warc")
    write(pages, path, size)
    return payloads(read_chunks(spark, path))
