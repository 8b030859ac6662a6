"""WARC archives with revisit resolution.

Payload digests are the headers' keys: the smallest id of each digest is found with counts combined before the shuffle,
records of other rows become revisits of it, and the archive is written without their payloads. Reading gives the
records back, with each revisit joined to its original response. A digest that a large part of the rows share is one
row on the small side of its join and is split on the large side.

Archives are gzip files of WARC/1.1 records, written and listed by Spark's own writer and reader, so any store that
Spark reaches will do. Edge cases: a null payload is empty; rows with a null id are never originals unless a payload has
no other; rows that repeat the smallest id are all responses; payloads may hold record separators; an empty table is an
archive without records; other columns of the rows, whatever their names, are left out.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconry.llm.shared import shared_dir, stage

# Parts of the archive format.
VERSION, SEPARATOR = "WARC/1.1", "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

#: Records of an archive file, and the date of records whose rows have none.
FILE_RECORDS, DATE = 5_000, "2024-01-01T00:00:00Z"
_ID = "<urn:record:"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 160 bits are eight groups of 20 bits, each four digits."""
    groups = [F.lpad(F.conv(F.substring(F.sha1(data), 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*groups)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def resolve_revisits(rows: DataFrame, min_bytes: int = 0) -> DataFrame:
    """id, url and payload of rows with payload_bytes, payload_digest, record_type and refers_to; other columns are left out."""
    held = rows.select("id", "url", F.coalesce("payload", F.lit("")).alias("payload"))
    keyed = held.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": base32_sha1(F.col("payload").cast("binary"))})
    heads = keyed.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.min("id").alias("original"), F.count(F.lit(1)).alias("n"))
    shared = stage(heads.where("n > 1 AND original IS NOT NULL").select("payload_digest", "original"), "warc_shared")
    revisit = F.col("original").isNotNull() & ~F.col("id").eqNullSafe(F.col("original"))
    return keyed.join(shared, "payload_digest", "left").select(
        "id", "url", "payload", "payload_bytes", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("original")).alias("refers_to")
    )


def write_warc(resolved: DataFrame, path: str) -> None:
    """Writes one record a row, with fresh headers; revisits carry no payload."""
    revisit = F.col("record_type") == "revisit"
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    ident = lambda c: F.concat(F.lit(_ID), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    record = F.concat(
        F.lit(f"{VERSION}\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", ident("id")),
        line("WARC-Date", F.lit(DATE)),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]+", "")), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(REVISIT_PROFILE)), line("WARC-Refers-To", ident("refers_to")))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
        F.lit("\r\n"),
        F.when(revisit, F.lit("")).otherwise(F.col("payload")),
    )
    resolved.select(record.alias("value")).write.option("lineSep", SEPARATOR).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def _records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    with gzip.GzipFile(fileobj=io.BytesIO(content)) as f:
        while line := f.readline():
            if line.strip() != VERSION.encode():
                raise ValueError(f"no record starts with {line[:40]!r}")
            head = {}
            while (line := f.readline().rstrip(b"\r\n")):
                name, _, value = line.decode("utf-8", "replace").partition(": ")
                head[name.lower()] = value
            body = f.read(int(head["content-length"]))
            if f.read(len(SEPARATOR)) != SEPARATOR.encode():
                raise ValueError("a record does not end where its length says")
            yield head, body


def _number(ident: str | None) -> int | None:
    value = (ident or "").removeprefix(_ID).removesuffix(">")
    return int(value) if value.lstrip("-").isdigit() else None


def _parsed(batches: Iterator[pa.RecordBatch], payloads: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            rows = []
            for head, body in _records(content.as_py()):
                digest = head["warc-payload-digest"].removeprefix("sha1:")
                if head["warc-type"] == "response" and base64.b32encode(hashlib.sha1(body).digest()).decode() != digest:
                    raise ValueError(f"payload of {head['warc-record-id']} does not have its digest")
                rows.append((_number(head["warc-record-id"]), head.get("warc-target-uri"), head["warc-type"], digest, len(body), _number(head.get("warc-refers-to")), body if payloads else None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()], strict=True)], names=["id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"])


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of the archives under path: id, url, record_type, payload_digest, payload_bytes (0 for revisits), refers_to, payload."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(lambda it: _parsed(it, payloads), "id bigint, url string, record_type string, payload_digest string, payload_bytes bigint, refers_to bigint, payload binary")


def with_originals(records: DataFrame) -> DataFrame:
    """Revisits get the payload size of the response they refer to; a revisit without one is an error of the archive."""
    slim = stage(records.drop("payload"), "warc_records")
    originals = slim.where("record_type = 'response'").groupBy("id", "payload_digest").agg(F.max("payload_bytes").alias("original_bytes"))
    originals = stage(originals.withColumnRenamed("id", "original"), "warc_originals")
    revisits = slim.where("record_type = 'revisit'").alias("r").join(originals.alias("o"), (F.col("r.refers_to") == F.col("o.original")) & (F.col("r.payload_digest") == F.col("o.payload_digest")), "left")
    size = F.coalesce("original_bytes", F.raise_error("a revisit refers to no response with its digest").cast("bigint"))
    return slim.where("record_type = 'response'").unionByName(revisits.select("r.id", "r.url", "r.record_type", "r.payload_digest", size.alias("payload_bytes"), "r.refers_to"))


def op4_warc_revisits(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("id"), "url", F.col("html").alias("payload"))
    path = f"{shared_dir(spark)}/beaconry/{uuid.uuid4().hex}/warc"
    write_warc(resolve_revisits(pages), path)
    out = with_originals(read_warc(spark, path, payloads=False))
    return out.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes,
      list_aggregate(list_transform(range(0, 8), lambda g: list_aggregate(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(sha1(b), CAST(1 + 5 * g AS BIGINT), 5) AS BIGINT) >> s) & 31), 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM d GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id OR first_id IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d JOIN f USING (payload_digest)
"""
