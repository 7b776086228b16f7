"""WARC archives with revisit resolution.

Headers (id, url, payload digest and size, no payload) are shuffled by payload digest to find
each payload's original response; other records of the same payload become revisits that refer
to it. Archives are then written with fresh headers: responses carry their payload, revisits
only the digest. They are written by Spark's own writer to the shared folder, gzip-compressed,
and `read_archives` streams them back record by record, checking every digest.

Null payloads are empty. Payloads shorter than `least_bytes` are never revisits. Of the records
with equal payloads, all that have the smallest page_id are responses (so repeated rows of it
stay); a null page_id is larger than any other, and where a payload has no other id its records
are all responses. Empty tables give empty archives. Columns other than page_id, url and html
are ignored. A url's control characters, spaces and non-ASCII are percent-encoded in headers.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import new_path, read_table

DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Records per archive at most.
PER_ARCHIVE = 10_000


def resolve(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, digest (binary SHA-1), first_id and first_url: the original response of each
    (page_id, digest), null where it is a response itself."""
    headers = _with_digest(pages).select("page_id", "url", "digest", F.octet_length("payload").alias("n"))
    first = (
        headers.where(F.col("n") >= least_bytes).groupBy("digest")
        .agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"))
    )
    # A payload may belong to a third of all rows; both sides are shuffled for a join whose
    # skewed partitions Spark splits, and only after rows of one id are reduced to one.
    return (
        headers.select("page_id", "digest", "n").distinct().join(first, "digest", "left")
        .where((F.col("n") >= least_bytes) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id")))
        .select("page_id", "digest", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"))
    )


def _with_digest(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    return pages.select("page_id", "url", payload.alias("payload"), F.unhex(F.sha1(payload)).alias("digest"))


def record(page_id: int | None, url: str | None, payload: bytes, digest: bytes, first: tuple[int, str | None] | None, copy: int = 0) -> bytes:
    """One WARC record; `first` makes it a revisit of (page_id, url). Equal rows are told apart by
    the number of the copy at the end of the record's id; revisits refer to the first copy. The
    payload's length, which a revisit's block does not show, stands in X-Payload-Length."""
    name = base64.b32encode(digest).decode()
    known = "none" if page_id is None else str(page_id)
    block = HTTP if first else HTTP + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if first else 'response'}", f"WARC-Record-ID: <urn:x-page:{known}:{name}:{copy}>",
        f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{name}", f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=_SAFE)}")
    if first:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:x-page:{first[0]}:{name}:0>"]
        if first[1] is not None:
            head.append(f"WARC-Refers-To-Target-URI: {quote(first[1], safe=_SAFE)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


_SAFE = "".join(chr(c) for c in range(33, 127))


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0) -> str:
    """Writes one record per row of pages under `path`."""
    found = resolve(pages, least_bytes)
    # A key without nulls, as a null-safe join is dealt out by other expressions than the window's: payloads
    # are shuffled once, for both.
    keyed = lambda df: df.withColumn("id_key", F.coalesce(F.col("page_id").cast("string"), F.lit("-")))
    rows = keyed(_with_digest(pages)).join(keyed(found).drop("page_id"), ["id_key", "digest"], "left")
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy("id_key", "digest").orderBy("url")) - 1).drop("id_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                part = whole.slice(at, 256).to_pylist()
                made = [record(r["page_id"], r["url"], r["payload"], r["digest"], None if r["first_id"] is None else (r["first_id"], r["first_url"]), r["copy"])[:-1] for r in part]
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["record"])

    # The writer ends each record with the line feed that was cut off.
    (rows.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
     .write.option("lineSep", "\n").option("compression", "gzip").option("maxRecordsPerFile", PER_ARCHIVE).text(path))
    return path


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, record_type, payload_digest, payload_bytes, refers_to and payload (null for
    revisits) of every record under `path`. Compressed archives are not split, so each task gets
    whole archives in order, line by line, and holds one record at a time."""
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("value").cast("binary").alias("line"))
    schema = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0
        for row in parse(x for b in batches for x in b.column(0).to_pylist()):
            out.append(row)
            size += len(row[-1] or b"") + 200
            if size > 8_000_000:
                yield _batch(out, names, types)
                out, size = [], 0
        yield _batch(out, names, types)

    return lines.mapInArrow(run, schema)


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)


def parse(lines: Iterator[bytes]) -> Iterator[tuple]:
    """Records from the lines of an archive, by their Content-Length; malformed ones raise."""
    for line in lines:
        if line != b"WARC/1.1\r":
            raise ValueError(f"not a record: {line[:80]!r}")
        head = {}
        while (line := next(lines)) != b"\r":
            k, _, v = line.decode().partition(":")
            head[k.strip().lower()] = v.strip()
        want, got, block = int(head["content-length"]) + 4, 0, []
        while got < want:
            line = next(lines)
            block.append(line)
            got += len(line) + 1
        data = b"\n".join(block) + b"\n"
        if got != want or not data.endswith(b"\r\n\r\n"):
            raise ValueError(f"{head['warc-record-id']}: its length is wrong")
        ident = lambda x: None if x is None or x.split(":")[2] == "none" else int(x.split(":")[2])
        kind, digest = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:")
        payload = data[:-4].partition(b"\r\n\r\n")[2] if kind == "response" else None
        if payload is not None and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"{head['warc-record-id']}: its payload has another digest")
        yield (ident(head["warc-record-id"]), head.get("warc-target-uri"), kind, digest, int(head["x-payload-length"]), ident(head.get("warc-refers-to")), payload)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_archives(read_table(spark, sf_dir, "pages"), new_path(spark, "warc"))
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha1(b) AS hex FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first FROM h),
x AS (SELECT *, list_aggregate(list_transform(range(0, 40), lambda i: printf('%04b', strpos('0123456789abcdef', substr(hex, CAST(i + 1 AS BIGINT), 1)) - 1)), 'string_agg', '') AS bits FROM f)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + list_sum(list_transform(range(0, 5), lambda j: CASE WHEN substr(bits, CAST(i * 5 + j + 1 AS BIGINT), 1) = '1' THEN 1 << CAST(4 - j AS INTEGER) ELSE 0 END)) AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM x
"""
