"""WARC archives with revisit records.

Headers (id, payload digest, payload length) are shuffled by digest; the original of each digest is found by an
aggregate that combines before the shuffle, and headers are joined to it, those of digests that many pages share by a
broadcast (`common.meet`), so that a digest of a third of all pages is no hot key. Then every task writes its own archive: a response with
its payload for an original, a revisit without payload for the others, all with fresh headers; each record is a gzip
member of its own. The list of written files is kept in the shared folder before anything is read, so a task that runs
twice leaves a file that nobody reads.

Defined results: null html is an empty payload. Payloads shorter than `least` bytes are never resolved. Of equal
payloads the row with the largest id is the response; rows that repeat that id too are all responses. A null id is
smaller than any other; a record without an id has no refers_to.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inventa.llm.common import keep, meet, prepare, table, work_path

FILE_BYTES = 256 << 20
MANIFEST = "path string, n_records long"
RECORD = "record_id string, record_type string, url string, payload_digest string, payload_bytes long, refers_to string, date string, payload binary"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def digests(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """page_id, url, payload, digest (hex SHA-1) and length."""
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumns({"digest": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")})


def resolve(headers: DataFrame, least: int = 0) -> DataFrame:
    """Headers (page_id, digest, payload_bytes) that revisit another, with `refers_to` and the original's url, one row for each id and digest."""
    lowest = F.lit(-(1 << 63))
    known = headers.where(F.col("payload_bytes") >= least).select("page_id", "url", "digest").withColumn("rank", F.coalesce("page_id", lowest))
    first = known.groupBy("digest").agg(F.max(F.struct("rank", "url")).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = keep(first.select("digest", F.col("first.rank").alias("first"), F.col("first.url").alias("refers_url"), "n"), "originals")
    met = meet(known.select("rank", "digest"), first, ["digest"], "n")
    return met.where("rank < first").select("rank", "digest", F.col("first").alias("refers_to"), "refers_url").distinct()


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One WARC 1.1 record as a gzip member."""
    head = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def clean(value: str | None) -> str:
    """A header value: no line may end inside it."""
    return (value or "").replace("\r", "%0D").replace("\n", "%0A")


def urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_records(ids, urls, payloads, lengths, refers, refers_urls, date: str) -> Iterator[bytes]:
    for page, url, payload, size, refer, refer_url in zip(ids, urls, payloads, lengths, refers, refers_urls):
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
        headers = [("WARC-Record-ID", urn(page)), ("WARC-Target-URI", clean(url)), ("WARC-Date", date), ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"), ("Content-Type", "application/http;msgtype=response")]
        if refer is None:
            yield record("response", headers, http + payload)
        else:
            yield record("revisit", [*headers, ("WARC-Profile", PROFILE), ("WARC-Refers-To", urn(refer)), ("WARC-Refers-To-Target-URI", clean(refer_url))], http)


def open_out(path: str):
    from pyarrow import fs

    where, inner = fs.FileSystem.from_uri(path)
    where.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    return where.open_output_stream(inner, compression=None)


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """Write one record for each row into archives under `folder`; returns the kept list of archives (path, n_records)."""
    spark = prepare(pages.sparkSession)
    full = digests(pages, id_col, url_col, html_col)
    revisit = resolve(full.select("page_id", "url", "digest", "payload_bytes"), least)
    joined = full.withColumn("rank", F.coalesce("page_id", F.lit(-(1 << 63)))).join(revisit, ["rank", "digest"], "left")
    date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, out, size, path, n = TaskContext.get(), None, 0, "", 0
        done = lambda: pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], names=["path", "n_records"])
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "payload_bytes", "refers_to", "refers_url")]
            for data in page_records(*columns, date):
                if out is None:
                    path = f"{folder.rstrip('/')}/{task.partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                    out, size, n = open_out(path), 0, 0
                    head = record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("WARC-Filename", path.rsplit("/", 1)[1]), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                    out.write(head)
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= FILE_BYTES:
                    out.close()
                    yield done()
                    out = None
        if out is not None:
            out.close()
            yield done()

    manifest = f"{folder.rstrip('/')}-manifest"
    joined.select("page_id", "url", "payload", "payload_bytes", "refers_to", "refers_url").mapInArrow(write, MANIFEST).write.mode("overwrite").parquet(manifest)
    return spark.read.schema(MANIFEST).parquet(manifest)


def parse(stream) -> Iterator[tuple[str, dict[str, str], bytes]]:
    """Type, headers and block of each record of an uncompressed stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        headers = {}
        while (line := stream.readline()).strip():
            k, _, v = line.decode().partition(":")
            headers[k.strip().lower()] = v.strip()
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise EOFError("a WARC record ends too soon")
        yield headers["warc-type"], headers, block


def read_warc(archives: DataFrame) -> DataFrame:
    """Responses and revisits of the archives in column `path`. Digest and length are those of the full payload; for a
    response both are taken from the payload that was read and must agree with the headers."""
    spark = prepare(archives.sparkSession)
    files = archives.select("path").repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        schema = pa.schema([(c, pa.int64() if k == "long" else pa.binary() if k == "binary" else pa.string()) for c, k in (x.split(" ") for x in RECORD.split(", "))])
        for batch in batches:
            for path in batch.column("path").to_pylist():
                where, inner = fs.FileSystem.from_uri(path)
                rows, size = [], 0
                with where.open_input_stream(inner, compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for kind, headers, block in parse(stream):
                        if kind not in ("response", "revisit"):
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        n = int(http.lower().partition(b"content-length:")[2].split(b"\r\n")[0])
                        digest = headers["warc-payload-digest"].removeprefix("sha1:")
                        if kind == "response" and (n != len(payload) or digest != base32_sha1(payload)):
                            raise ValueError(f"{headers['warc-record-id']}: payload and headers differ")
                        rows.append((headers["warc-record-id"], kind, headers.get("warc-target-uri"), digest, n, headers.get("warc-refers-to"), headers.get("warc-date"), payload if kind == "response" else None))
                        size += len(payload) + 500
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return files.mapInArrow(read, RECORD)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    archives = write_warc(pages, work_path(prepare(spark), "warc"))
    number = lambda c: F.expr(f"try_cast(nullif(regexp_extract({c}, '<urn:page:(-?[0-9]*)>', 1), '') as bigint)")
    return read_warc(archives).select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


#: DuckDB has no base 32: the bits of the hash are cut by fives.
SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
b AS (
  SELECT *, list_aggregate(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (
      ((('0x' || substr(h, 1 + (i // 8) * 10, 10))::BIGINT) >> (35 - 5 * (i % 8))) & 31)::INT, 1)), 'string_agg', '') AS payload_digest,
    max(page_id) OVER (PARTITION BY h, payload_bytes) AS first
  FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id < first THEN first END AS refers_to
FROM b
"""
