"""Exact duplicates by a stateful stream.

Texts are normalised (A-Z lower-cased, null as empty) and digested in one pass over the documents. The digests, not the texts, land in the
shared folder as (digest, doc_id, locator), and a stream reads them in: its keyed state on disk (RocksDB, checkpointed, no expiry)
retains for each digest the largest doc_id seen with its locator (file and row of the content) and how many rows came. `Stream` keeps
landing folder, checkpoint and state, so that later arrivals go to the same state; only they are digested then.

Where a digest was hit more than once, the full normalised texts are read again and counted by digest and bytes. If all rows of
each digest agree, which is certain but for a collision, the state is the answer; else the rows of the digests that differ are
regrouped by digest and text. Only rows of digests that were hit are shuffled with their text, pre-aggregated by a hash aggregate. Digests
that over a thousandth of all rows share are dealt to several tasks where rows meet their group.

Only DataFrame and SQL functions. Null and repeated doc_ids are ordered by doc_id (null least), then locator, so exactly one row of
each group is kept. Texts of any length are digested and compared whole. Empty tables give no rows; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dealt_join, fresh, hot_keys, numbered, quoted, save, work_dir

#: State on disk, checkpointed as changes. Without preallocated logs, which take megabytes for every state partition.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: Hit rows (a locator and a digest, about 300 bytes) are broadcast up to so many; more are joined by shuffle.
SMALL = 200_000


def normalised(text: str = "text") -> Column:
    """A-Z lower-cased and nothing else: lower() where the text is ASCII, else translate()."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, string.ascii_uppercase, string.ascii_lowercase))


def file_row() -> Column:
    """What tells the rows of a scan of Parquet files apart, and says where their content lies."""
    return F.struct("_metadata.file_path", "_metadata.row_index")


def landed(docs: DataFrame, locator: Column, digest_bytes: int = 32) -> DataFrame:
    """docs (doc_id, text) -> doc_id, locator, sha, key: what lands for the stream."""
    sha = F.unhex(F.sha2(normalised().cast("binary"), 256))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), locator.alias("locator"), sha.alias("sha"))
    return rows.withColumn("key", F.substring("sha", 1, digest_bytes))


class Stream:
    """A stream over rows that have landed, with its state, under one folder of the shared file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def land(self, rows: DataFrame) -> None:
        """Adds rows (doc_id, locator, sha, key)."""
        rows.write.mode("append").parquet(f"{self.path}/landing")

    def state(self, files: int = 1000) -> DataFrame:
        """Takes in what has landed since the last call -> (key, keep struct(doc_id, locator), group_size) of all that ever came."""
        spark = self.spark
        schema = spark.read.parquet(f"{self.path}/landing").schema
        before = {k: spark.conf.get(k, None) for k in STATE}
        for k, v in STATE.items():  # a query takes its state store from the session when it starts
            spark.conf.set(k, v)
        try:
            arrivals = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{self.path}/landing")
            state = arrivals.groupBy("key").agg(F.max(F.struct("doc_id", "locator")).alias("keep"), F.count("*").alias("group_size"))

            def write(batch: DataFrame, number: int) -> None:
                batch.write.mode("overwrite").parquet(f"{self.path}/updates/batch={number}")

            query = state.writeStream.outputMode("update").option("checkpointLocation", f"{self.path}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
        finally:
            for k, v in before.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)
        query.awaitTermination()
        # an updated key appears once in each batch that touched it; the last has the most rows
        all_of = spark.read.schema(f"key binary, keep struct<doc_id: bigint, locator: {schema['locator'].dataType.simpleString()}>, group_size bigint, batch bigint").parquet(f"{self.path}/updates")
        return all_of.groupBy("key").agg(F.max_by("keep", "group_size").alias("keep"), F.max("group_size").alias("group_size"))


def exact_duplicates(docs: DataFrame, locator: Column | None = None, digest_bytes: int = 32, small: int = SMALL) -> DataFrame:
    """docs (doc_id, text) -> one row per row: doc_id, keep_id, group_size, kept, text_sha256, locator.

    `locator` (file_row() for a plain scan) tells rows of docs apart and must stay the same when docs is read again; without it, docs is
    written to a work table first. Fewer digest_bytes force collisions, a smaller `small` the shuffled form (tests).
    """
    spark = docs.sparkSession
    work = work_dir(spark, "exact")
    if locator is None:
        name = fresh(docs, "_row")
        docs, locator = numbered(docs.select("doc_id", "text"), f"{work}/rows", name), F.struct(F.lit(f"{work}/rows").alias("file_path"), F.col(name).alias("row_index"))
    stream = Stream(spark, f"{work}/stream")
    stream.land(landed(docs, locator, digest_bytes))
    landing = spark.read.parquet(f"{work}/stream/landing")
    if landing.isEmpty():
        return landing.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "locator")
    state = save(stream.state(), f"{work}/state")

    # full bytes of the rows that hit
    hot = hot_keys(state.select("key", F.col("group_size").alias("n")), ["key"], landing.count())
    hit = save(dealt_join(landing, state.where("group_size > 1").select("key"), ["key"], "locator", hot).select("locator", "key"), f"{work}/hit")
    few = hit.count() <= small
    again = docs.select("doc_id", locator.alias("locator"), normalised().alias("bytes")).join(F.broadcast(hit) if few else hit, "locator")
    texts = again.groupBy("key", "bytes").agg(F.count("*").alias("n")).select("key")
    clash = save(texts.groupBy("key").agg(F.count("*").alias("texts")).where("texts > 1").select("key"), f"{work}/clash")

    out = dealt_join(landing, state, ["key"], "locator", hot)
    if not clash.isEmpty():
        torn = save(again.join(clash, "key").withColumn("doc_id", F.col("doc_id").cast("long")), f"{work}/torn")
        own = torn.groupBy("key", "bytes").agg(F.max(F.struct("doc_id", "locator")).alias("k"), F.count("*").alias("n"))
        own = torn.join(own, ["key", "bytes"]).select("locator", "k", "n")
        out = out.join(own, "locator", "left").withColumns({"keep": F.coalesce("k", "keep"), "group_size": F.coalesce("n", "group_size")})
    return out.select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("locator") == F.col("keep.locator")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "locator")


def keep_first_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all columns. docs may be any frame: it is written to a work table, whose rows are numbered."""
    path, row = f"{work_dir(docs.sparkSession, 'copies')}/rows", fresh(docs, "_row")
    rows = numbered(docs, path, row)
    place = F.struct(F.lit(path).alias("file_path"), F.col(row).alias("row_index"))
    kept = exact_duplicates(rows, place).where("kept").select(F.col("locator.row_index").alias(row))
    return rows.join(kept, row, "left_semi").select(*quoted(docs))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_duplicates(docs, file_row()).drop("locator")


ORACLE_SQL = r"""
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""
