"""Content-addressed WARC archive: payload bytes once by SHA-256, record headers apart, records rebuilt by a join."""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

RECORD_DDL = "source string, offset long, header binary, payload binary"


def parse(data: bytes) -> Iterator[tuple[int, bytes, bytes]]:
    """(offset, exact header bytes with the empty line, payload) of each record; gzip members are read through.

    A record ends after its Content-Length; bytes that don't begin a record, a missing or malformed
    Content-Length and a payload that ends early are errors. No bytes give no records.
    """
    if data[:2] == b"\x1f\x8b":
        data = gzip.GzipFile(fileobj=io.BytesIO(data)).read()
    at = 0
    while at < len(data):
        if data.startswith(b"\r\n", at):
            at += 2
            continue
        end = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/", at) or end < 0:
            raise ValueError(f"no WARC record at byte {at}")
        header = data[at : end + 4]
        fields = dict(x.split(b":", 1) for x in header.split(b"\r\n")[1:] if b":" in x)
        stated = [v.strip() for k, v in fields.items() if k.strip().lower() == b"content-length"]
        if not stated or not stated[0].isdigit():
            raise ValueError(f"record at byte {at} states no Content-Length")
        length = int(stated[0])
        payload = data[end + 4 : end + 4 + length]
        if len(payload) < length:
            raise ValueError(f"record at byte {at} is cut short")
        yield at, header, payload
        at = end + 4 + length


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(source, offset, header, payload) of the records of .warc and .warc.gz files; a file is read by one task.

    An empty file has no records; a malformed one stops the job (see parse). Repeated records are
    rows of their own, an empty payload is empty, not null.
    """

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for at, header, payload in parse(data):
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([at]), pa.array([header], pa.binary()), pa.array([payload], pa.binary())], names=["source", "offset", "header", "payload"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(records, RECORD_DDL)


def pages_as_records(pages: DataFrame) -> DataFrame:
    """(record_id, header, payload) of web pages: a WARC/1.1 response record for each; null html is an empty payload."""
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    p = pages.select("page_id", "url", payload.alias("payload"))
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce("url", F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length("payload").cast("string"), F.lit("\r\n\r\n"),
    )
    return p.select(F.col("page_id").alias("record_id"), F.encode(header, "utf-8").alias("header"), "payload")


def archive(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The record table (record_id, header, digest, payload_bytes) and the payload store (digest, payload).

    records: record_id, header, payload. The digest is SHA-256 in hexadecimal. The store holds the
    bytes of each digest once; a digest under which lengths or checksums differ stops the job. A
    null payload is an empty one, a null header or record_id is kept as it is, repeated rows are
    records of their own. Other columns are ignored. Both tables may be empty.
    """
    r = records.select("record_id", "header", F.coalesce("payload", F.lit(b"")).alias("payload")).withColumn("digest", F.sha2("payload", 256))
    heads = r.select("record_id", "header", "digest", F.octet_length("payload").cast("long").alias("payload_bytes"))
    check = F.struct(F.octet_length("payload").alias("n"), F.xxhash64("payload").alias("x"))
    # the bytes travel once, keyed by digest, where both the store and the rebuilding join find them
    store = r.select("digest", "payload", check.alias("c")).groupBy("digest").agg(F.first("payload").alias("payload"), F.min("c").alias("lo"), F.max("c").alias("hi"))
    same = F.when(F.col("lo") == F.col("hi"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("two payloads under digest "), F.col("digest"))))
    return heads, store.select("digest", same.alias("payload"))


def rebuild(heads: DataFrame, store: DataFrame) -> DataFrame:
    """(record_id, digest, payload_bytes, record): the original bytes, header then payload; a missing or damaged payload stops the job."""
    j = heads.join(store, "digest", "left")
    good = (F.sha2("payload", 256) == F.col("digest")) & (F.octet_length("payload") == F.col("payload_bytes"))
    record = F.when(good, F.concat(F.coalesce("header", F.lit(b"")), F.col("payload"))).otherwise(F.raise_error(F.concat(F.lit("payload is missing or damaged: "), F.col("digest"))))
    return j.select("record_id", "digest", "payload_bytes", record.alias("record"))


def write_warc(rebuilt: DataFrame, path: str) -> None:
    """Write records as WARC files, one for each partition: the bytes as they are, each record followed by two line ends."""
    # the text sink writes a string's bytes unchanged, and lineSep is the second line end
    rebuilt.select(F.concat(F.col("record"), F.lit(b"\r\n")).cast("string")).write.option("lineSep", "\r\n").text(path)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads, store = archive(pages_as_records(shared.table(spark, sf_dir, "pages")))
    r = rebuild(heads, store)
    return r.select("record_id", "digest", "payload_bytes", F.decode("record", "utf-8").alias("record"))


OP2_SQL = """
select page_id as record_id, sha256(coalesce(html, '')) as digest, strlen(coalesce(html, ''))::bigint as payload_bytes,
  'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::varchar, '') || '>' || chr(13) || chr(10)
  || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, ''))::varchar
  || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') as record
from pages
"""
