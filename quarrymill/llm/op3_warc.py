r"""WARC archives with revisit records.

Payloads are digested (SHA-256 of the whole). Headers alone (digest, page_id, length) are shuffled by digest, with map-side minima, so a
payload that a third of all pages share costs one row for each task, and its pages meet their response in many. Of equal payloads of at least `least` bytes the smallest page_id is
the response; the revisit records, joined to their responses, get fresh headers that name them (WARC-Refers-To,
WARC-Refers-To-Target-URI) and no payload. Records are dealt to archives by page_id, so archives are even however the payloads repeat.

Archives are written by Spark's text sink with the record separator CRLF CRLF and gzip: the committer leaves whole files only, on any
file system that Spark writes, and a lost executor's archives are written again. They are read back as whole files, whose size is set by
`archive_bytes` (one record at least), and parsed by Content-Length, so payloads may hold anything, record headers included.

A null html is an empty payload. A null page_id gets no archive record that could be named: its row is a response without id. Rows that
repeat a page_id with one payload and other urls are one record each, the first url the response, the others revisits of that id; rows
equal in all are responses alike. Null urls are empty. Control characters and line ends in urls are percent-encoded in headers. A payload
of any length is one record, which has to fit a row (2 GB). Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dealt_join, hot_keys, save, work_dir

CRLF = "\r\n"
END = CRLF + CRLF
DATE = "2024-01-31T00:00:00Z"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, uri string, payload binary"


KEY = ["page_id", "uri", "payload_digest"]


def payloads(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) -> page_id, uri, payload, payload_bytes, payload_digest."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b"").cast("binary"))
    uri = F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), r"[\x00-\x20\x7F]", "%20")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), uri.alias("uri"), payload.alias("payload"))
    return rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})


def revisits(heads: DataFrame, least: int = 100) -> DataFrame:
    """A written table heads (KEY, payload_bytes) -> KEY, refers_to, refers_uri of the records that revisit another."""
    some = heads.where((F.col("payload_bytes") >= least) & F.col("page_id").isNotNull()).select(*KEY)
    first = some.groupBy("payload_digest").agg(F.min(F.struct("page_id", "uri")).alias("first"), F.count("*").alias("n")).where("n > 1")
    # payloads that over a thousandth of all pages share meet their response in several tasks
    later = dealt_join(some, first.drop("n"), ["payload_digest"], "page_id", hot_keys(some.groupBy("payload_digest").agg(F.count("*").alias("n")), ["payload_digest"], heads.count()))
    later = later.where((F.col("page_id") != F.col("first.page_id")) | (F.col("uri") != F.col("first.uri")))
    return later.select(*KEY, F.col("first.page_id").alias("refers_to"), F.col("first.uri").alias("refers_uri")).dropDuplicates(KEY)


def record_text(date: str = DATE):
    """A record of the columns of a payload and its revisit, without the separator that ends it; its bytes are kept as they are."""
    name = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("-")), F.lit(">"))
    revisit = F.col("record_type") == "revisit"
    body = F.when(revisit, F.lit(b"").cast("binary")).otherwise(F.col("payload"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), name),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.col("uri")),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("payload_digest")),
        F.concat(F.lit("WARC-Payload-Length: "), F.col("payload_bytes").cast("string")),
        F.when(revisit, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), F.lit(CRLF + "WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">" + CRLF + "WARC-Refers-To-Target-URI: "), F.col("refers_uri"))),
        F.lit("Content-Type: text/html"),
        F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")),
    ]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(END), body.cast("string"))


def write_archives(pages: DataFrame, path: str, least: int = 100, archive_bytes: int = 32 << 20) -> None:
    """Writes the deduplicated archives of pages under path, each of about archive_bytes before compression."""
    rows = payloads(pages)
    heads = save(rows.drop("payload"), f"{path}-headers")
    total = heads.agg(F.sum(F.col("payload_bytes") + 500)).first()[0] or 0
    count = max(1, -(-int(total) // archive_bytes), min(64, pages.sparkSession.sparkContext.defaultParallelism))
    # payloads are shuffled this once, and the join keeps to it
    out = rows.repartition(count, *KEY).join(revisits(heads, least), KEY, "left")
    out = out.withColumn("record_type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"))
    out.select(record_text().alias("value")).write.option("lineSep", END).option("compression", "gzip").text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under path; a revisit's payload is null."""

    def parse(data: bytes) -> Iterator[tuple]:
        at = 0
        while at < len(data):
            stop = data.index(b"\r\n\r\n", at)
            head = dict(line.split(": ", 1) for line in data[at:stop].decode("utf-8", "replace").split(CRLF)[1:])
            begin, size = stop + 4, int(head["Content-Length"])
            kind = head["WARC-Type"]
            name = head["WARC-Record-ID"][len("<urn:page:") : -1]
            refers = int(head["WARC-Refers-To"][len("<urn:page:") : -1]) if kind == "revisit" else None
            payload = None if kind == "revisit" else data[begin : begin + size]
            yield None if name == "-" else int(name), int(head["WARC-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha256:"), kind, refers, head["WARC-Target-URI"], payload
            at = begin + size + 4

    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "uri", "payload"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                rows, size = [], 0
                for r in parse(zlib.decompress(batch.column(0)[i].as_py(), 47)):
                    rows.append(r)
                    size += len(r[6] or b"")
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(run, RECORD)


def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    got = read_archives(spark, path)
    # both figures of a response come from the payload read back, not from its header
    response = F.col("record_type") == "response"
    return got.select(
        "page_id",
        F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(response, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


ORACLE_SQL = r"""
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b FROM pages
), d AS (
  SELECT page_id, octet_length(b) AS payload_bytes, sha256(b) AS payload_digest FROM p
), m AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS low FROM d
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> low THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> low THEN low END AS refers_to
FROM m
"""
