"""Web archives: written with an index, read back by coalesced byte ranges.

Writing emits one index row per record (file, offset, length, url, digest) through
Spark's own committer. Only committed index rows name archive files, so what a lost or
repeated task has left behind is never read. Reading sorts the wanted index rows by file
and offset, joins neighbouring ranges into one read, and unpacks the records.

Each record is a gzip member of its own, so any record can be read alone. The archive
folder is reached through ``pyarrow.fs`` (local, HDFS and object-store addresses).
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlens.llm.base import as_bytes, table
from recordlens.session import shared_folder, written

INDEX = "page_id long, file string, offset long, length long, url string, payload_digest string, record_type string"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_UNSAFE = re.compile(rb"[\x00-\x20\x7f]")


def with_roles(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, payload_sha1, refers_to): which record each page becomes.

    Of pages with equal payloads of at least ``min_bytes`` bytes the smallest page_id is
    kept whole (refers_to null) and the others refer to it. A null html is an empty
    payload. Rows that repeat the smallest page_id are kept whole too; a group without
    any page_id has nothing to refer to and is kept whole.
    """
    p = pages.select("page_id", "url", F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("payload"))
    p = p.withColumn("payload_sha1", F.sha1("payload"))
    # Few rows: payloads met more than once. Written, so that a hot digest is a skewed join Spark can split.
    firsts = written(
        p.filter(F.length("payload") >= min_bytes)
        .groupBy("payload_sha1")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
        .filter((F.col("n") > 1) & F.col("first_id").isNotNull())
        .select("payload_sha1", "first_id"),
        "payload-firsts",
    )
    return p.join(firsts, "payload_sha1", "left").select(
        "page_id",
        "url",
        "payload",
        "payload_sha1",
        F.when((F.length("payload") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")).alias("refers_to"),
    )


def _member(page_id, url: bytes | None, payload: bytes, sha1: str, refers_to, date: str) -> bytes:
    """One record as a gzip member; a revisit keeps the HTTP head and drops the payload."""
    digest = base64.b32encode(bytes.fromhex(sha1))
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [b"WARC/1.1", b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"), b"WARC-Date: " + date.encode()]
    head.append(b"WARC-Record-ID: <urn:page:%s>" % str(page_id).encode())
    if url is not None:
        head.append(b"WARC-Target-URI: " + _UNSAFE.sub(lambda m: b"%%%02X" % m[0][0], url))
    head.append(b"WARC-Payload-Digest: sha1:" + digest)
    if refers_to is not None:
        head += [b"WARC-Refers-To: <urn:page:%d>" % refers_to, b"WARC-Profile: " + PROFILE.encode()]
    head += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress(b"\r\n".join(head) + b"\r\n\r\n") + pack.compress(block) + pack.compress(b"\r\n\r\n") + pack.flush()


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", max_file: int = 1 << 30) -> DataFrame:
    """Write one record per page below ``folder`` and return the index, written beside it.

    A task writes its own files under names no other attempt uses and starts a new one
    beyond ``max_file`` bytes. An empty table gives an empty index.
    """
    spark = pages.sparkSession

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        part, out, name, at = TaskContext.get().partitionId(), None, "", 0
        try:
            for batch in batches:
                rows = []
                cols = (batch.column("page_id").to_pylist(), as_bytes(batch.column("url")), batch.column("payload"), batch.column("payload_sha1").to_pylist(), batch.column("refers_to").to_pylist())
                for page_id, url, payload, sha1, refers_to in zip(*cols, strict=True):
                    if out is None or at >= max_file:
                        if out is not None:
                            out.close()
                        name, at = f"part-{part:05d}-{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    data = _member(page_id, url, payload.as_py(), sha1, refers_to, date)
                    out.write(data)
                    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                    rows.append((page_id, name, at, len(data), None if url is None else url.decode(), digest, "response" if refers_to is None else "revisit"))
                    at += len(data)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)] if rows else [pa.array([], t) for t in (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())], names=["page_id", "file", "offset", "length", "url", "payload_digest", "record_type"])
        finally:
            if out is not None:
                out.close()

    path = f"{folder}/index"
    with_roles(pages, min_bytes).mapInArrow(write, INDEX).write.parquet(path)
    return spark.read.parquet(path)


def _parsed(data: bytes) -> tuple:
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
    http, _, payload = rest[: int(fields[b"Content-Length"])].partition(b"\r\n\r\n")
    number = lambda x: None if x == b"<urn:page:None>" else int(x[10:-1])
    url = fields.get(b"WARC-Target-URI")
    kind = fields[b"WARC-Type"].decode()
    if kind == "revisit":
        size, digest = int(re.search(rb"Content-Length: (\d+)", http)[1]), fields[b"WARC-Payload-Digest"][5:].decode()
    else:
        size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
    refers = fields.get(b"WARC-Refers-To")
    return number(fields[b"WARC-Record-ID"]), None if url is None else url.decode(), size, digest, kind, None if refers is None else number(refers), payload


def read_records(index: DataFrame, folder: str, payload: bool = True, gap: int = 64 << 10, most: int = 8 << 20, chunk: int = 64 << 20) -> DataFrame:
    """The records that ``index`` names (any selection of its rows).

    Rows are dealt by file and ``chunk`` of offsets and sorted; ranges no further apart
    than ``gap`` bytes become one read of at most ``most`` bytes (a longer record is read
    alone). The digest of a response is taken from the payload read, that of a revisit
    from its head. With ``payload`` the bytes come too (empty for revisits).
    """
    schema = RECORD + (", payload binary" if payload else "")
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * payload
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payload

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        opened, name = None, None
        try:
            for batch in batches:
                wanted = list(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True))
                i = 0
                while i < len(wanted):
                    file, begin, length = wanted[i]
                    j, end = i + 1, begin + length
                    while j < len(wanted) and wanted[j][0] == file and wanted[j][1] - end <= gap and wanted[j][1] + wanted[j][2] - begin <= most:
                        end = max(end, wanted[j][1] + wanted[j][2])
                        j += 1
                    if file != name:
                        if opened is not None:
                            opened.close()
                        opened, name = fs.open_input_file(f"{base}/{file}"), file
                    data = opened.read_at(end - begin, begin)
                    rows = [_parsed(data[o - begin : o - begin + n]) for _, o, n in wanted[i:j]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=False)], names=names)
                    i = j
        finally:
            if opened is not None:
                opened.close()

    place = index.select("file", "offset", "length", F.floor(F.col("offset") / chunk).alias("chunk"))
    return place.repartition("file", "chunk").sortWithinPartitions("file", "offset").drop("chunk").mapInArrow(read, schema)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a record and read back: size, digest, kind and what it refers to."""
    folder = shared_folder(spark, "archives")
    if "://" not in folder and not folder.startswith("/"):
        folder = "file:" + folder
    index = write_archives(table(spark, sf_dir, "pages"), folder)
    return read_records(index, folder, payload=False).drop("url")


OP1_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages
), f AS (SELECT hex, min(page_id) AS first_id FROM p GROUP BY hex)
SELECT page_id,
       CAST(strlen(body) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                1 + CAST((CAST('0x' || substr(p.hex, CAST(5 * (i // 4) + 1 AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS INTEGER), 1)), '')
         AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM p JOIN f ON p.hex = f.hex
"""
