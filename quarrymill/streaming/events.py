"""Storage events and new files as streams, and chat sessions."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.paths import BUCKETS, bucket_to_category, parse_storage_path, source_uri
from ..functions.text import COUNTERS
from ..operators.chunking import chunk_documents, chunk_lines
from ..operators.embedding import embed_column
from ..sources.files import TEXT, extract_text, files_at, lines_at, listed_files, path_root, with_names
from ..sources.shared import folder_exists, save, shared_folder

EVENT = "type string, `table` string, record struct<id:string, bucket_id:string, name:string, metadata:struct<size:bigint, mimetype:string>, updated_at:string>"
#: Priority of a new file's job.
PRIORITY = 100
#: Tables that events make rows of, and the keys that a later event's row takes over.
KEYS = {"documents": ["document_id"], "files": ["document_id", "version"], "jobs": ["file_id"]}
#: What orders the events of one key: the object's time, where the event tells it, then its version and path, then what else it says.
ORDER = "event_order struct<at: timestamp_ntz, version: int, name: string, bucket: string, size: bigint, mime: string>"


def parsed_events(events: DataFrame) -> DataFrame:
    """events (EVENT) with the parts of their path and skip, why an event counts for nothing."""
    r, p = F.col("record"), F.col("_p")
    skip = (
        F.when(F.col("type") != "INSERT", "not an insert")
        .when(F.col("table") != "objects", "other table")
        .when(~r["bucket_id"].isin(*BUCKETS.values()) | r["bucket_id"].isNull(), "unknown bucket")
        .otherwise(p["skip"])
    )
    happened = r["updated_at"].try_cast("timestamp_ntz") if "updated_at" in events.schema["record"].dataType.names else F.lit(None).cast("timestamp_ntz")
    out = events.withColumn("_p", parse_storage_path(r["name"]))
    return out.select(
        "type", r["bucket_id"].alias("bucket_id"), r["name"].alias("name"), happened.alias("event_at"), r["metadata"]["size"].alias("size_bytes"), r["metadata"]["mimetype"].alias("mime_type"),
        p["document"].alias("document_id"), p["version"].alias("version"), p["name"].alias("file_name"), skip.alias("skip"),
    )


def storage_rows(events: DataFrame, now: str) -> dict[str, DataFrame]:
    """Rows of new objects for documents, files and jobs, one for each key (KEYS), each with its event_order (ORDER).

    Of several events of a key the one that is last in this order counts, whatever order they are read in, so that rows of any cut of the
    events into batches merge to the same tables. A document is active and without content yet; a file is pending with empty progress; its job
    is pending at priority 100. file_id is made of document and version, so that an event that comes again makes the same rows.
    """
    good = parsed_events(events).where("skip IS NULL")
    stamp = F.to_timestamp_ntz(F.lit(now))
    order = F.struct(F.col("event_at").alias("at"), "version", "name", F.col("bucket_id").alias("bucket"), F.col("size_bytes").alias("size"), F.col("mime_type").alias("mime"))
    rows = good.select("document_id", "version", order.alias("event_order"), "file_name")
    last = rows.groupBy("document_id", "version").agg(F.max(F.struct("event_order", "file_name")).alias("f")).select("document_id", "version", "f.*")
    file_id = F.concat("document_id", F.lit(":v"), F.col("version").cast("string"))
    progress = F.struct(*[F.lit(0).alias(c) for c in COUNTERS], F.lit(0).alias("retry_count"), *[F.lit(None).cast("string").alias(c) for c in ("last_error",)], F.lit(None).cast("timestamp_ntz").alias("started_at"), stamp.alias("updated_at"))
    e = F.col("event_order")
    files = last.select(
        file_id.alias("file_id"), "document_id", "version", e["bucket"].alias("storage_bucket"), e["name"].alias("storage_path"), e["mime"].alias("mime_type"), e["size"].alias("size_bytes"),
        F.col("file_name").alias("original_filename"), F.lit("pending").alias("status"), progress.alias("processing_progress"), "event_order",
    )
    top = last.groupBy("document_id").agg(F.max(F.struct("event_order", "file_name")).alias("d")).select("document_id", "d.*")
    documents = top.select(
        "document_id", F.regexp_replace("file_name", r"\.[^.]+$", "").alias("title"), bucket_to_category(e["bucket"]).alias("category"), e["bucket"].alias("bucket"),
        F.lit(True).alias("is_active"), F.lit("").alias("content"), source_uri("storage", e["name"], e["bucket"]).alias("source_uri"), "event_order",
    )
    jobs = last.select(file_id.alias("file_id"), F.lit("pending").alias("status"), F.lit(PRIORITY).alias("priority"), stamp.alias("scheduled_at"), "event_order")
    return {"documents": documents, "files": files, "jobs": jobs}


def run_storage_events(spark: SparkSession, folder: str, out: str, checkpoint: str, now: str) -> None:
    """Reads JSON events that lie in folder and writes rows under out/<table>/run=<r>/batch=<n>: `stored_rows` has the tables.

    The stream keeps no state and a batch reads nothing but its events: what it writes is a log of the last row of each key, ordered by the
    events and not by arrival, so that merging is the same however batches are cut, events are ordered, repeated or replayed. A batch that runs
    again replaces what it wrote; a run from a new checkpoint writes beside earlier ones. `compact_rows` folds the log into one run.
    """
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def write(batch: DataFrame, number: int) -> None:
        for name, rows in storage_rows(batch, now).items():
            rows.write.mode("overwrite").parquet(f"{out}/{name}/run={run}/batch={number}")

    spark.readStream.schema(EVENT).json(folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _merged(rows: DataFrame, table: str) -> DataFrame:
    """The last row of each key; of rows of one event that of the first run and batch."""
    columns = [c for c in rows.columns if c not in ("run", "batch")]
    return rows.groupBy(*KEYS[table]).agg(F.max_by(F.struct(*columns), "event_order").alias("r")).select("r.*")


def stored_rows(spark: SparkSession, out: str, table: str) -> DataFrame:
    """documents, files or jobs as the last event of each key left them, with event_order."""
    return _merged(spark.read.parquet(f"{out}/{table}"), table)


def compact_rows(spark: SparkSession, out: str, table: str, to: str) -> None:
    """Folds the log of a table into one run under the folder `to`, from where it can be read, and added to, as before."""
    stored_rows(spark, out, table).write.mode("overwrite").parquet(f"{to}/{table}/run=compacted/batch=0")


#: Parts that stored chunks are written in, by a hash of the file: a batch rewrites those that its files are in.
PARTS = 64


def _part(file_id: str = "file_id"):
    return F.pmod(F.xxhash64(file_id, F.lit(41)), F.lit(PARTS)).cast("int").alias("part")


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """A table in parts, or None before its first write."""
    return spark.read.parquet(path) if folder_exists(spark, path) else None


def _rewrite(spark: SparkSession, path: str, rows: DataFrame, gone: DataFrame) -> None:
    """Puts rows in place of those of the files in gone (file_id): only parts that hold such files are read and written."""
    own = rows.withColumn("part", _part())
    before = _stored(spark, path)
    if before is not None:
        parts = [r[0] for r in gone.select(_part()).distinct().collect()]  # PARTS numbers at most
        rest = before.where(F.col("part").isin(parts)).join(gone.select("file_id"), "file_id", "left_anti")
        own = own.unionByName(rest.select(*own.columns))
    # the new files lie beside the table until all are written, and take the place of its parts then: what is read is there as long as it is read
    dealt = own.repartition("part", F.pmod(F.xxhash64("file_id", F.lit(43)), F.lit(8)))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


#: Bytes of a text file that is taken as one row at most; a larger one goes line by line, whatever its size.
WHOLE = 1 << 20


#: What a listing tells of a file.
NAMED = ["path", "rel_path", "extension", "modified", "size_bytes"]


def line_digests(lines: DataFrame) -> DataFrame:
    """(file_id, digest) of lines (file_id, start, n, line): the SHA-256 of the SHA-256 of each line, in order. Only these are sorted, not the lines."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = lambda: pa.RecordBatch.from_pydict({"file_id": [at], "digest": [whole.hexdigest()]}, pa.schema([("file_id", pa.int64()), ("digest", pa.string())]))
        at = whole = None
        for batch in batches:
            for file_id, digest in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if file_id != at:
                    if whole:
                        yield row()
                    at, whole = file_id, hashlib.sha256()
                whole.update(digest)
        if whole:
            yield row()

    rows = lines.select("file_id", "start", "n", F.unhex(F.sha2("line", 256)).alias("digest"))
    return rows.repartition("file_id").sortWithinPartitions("file_id", "start", "n").select("file_id", "digest").mapInArrow(fold, "file_id long, digest string")


def store_files(spark: SparkSession, files: DataFrame, folder: str, out: str, embed: Callable, dim: int, **options) -> None:
    """Files under folder (`with_names`, without bytes) into out/chunks and out/files, by digest.

    Their bytes are read here: small files and those that aren't text as a row each, large texts as lines.

    A file whose digest is stored already is passed over, but for its time. Chunks are written first, then the row of the file that
    vouches for them; a run that breaks off between leaves the old rows valid (`stored_chunks`), and the next does it again. Digests, not bytes,
    meet what is stored; bytes move only where a batch holds files of either kind.
    """
    files = files.withColumn("file_id", F.xxhash64("rel_path"))
    large = F.col("extension").isin(TEXT) & (F.col("size_bytes") > WHOLE)
    of = lambda some: [r[0] for r in some.select("path").toLocalIterator()]  # noqa: E731  names, as every listing of a file source has them
    lines = lambda some: lines_at(spark, of(some)).join(F.broadcast(some.select("path", "file_id")), "path").drop("path")
    found = []
    if small := of(files.where(~large)):
        own = files_at(spark, small, path_root(folder)).withColumns({"file_id": F.xxhash64("rel_path"), "digest": F.sha2("content", 256)})
        found.append(own.select("file_id", "rel_path", "modified", "size_bytes", "digest", F.lit(False).alias("_large")))
    long = files.where(large)
    if not long.isEmpty():
        found.append(long.join(line_digests(lines(long)), "file_id").select("file_id", "rel_path", "modified", "size_bytes", "digest", F.lit(True).alias("_large")))
    if not found:
        return
    listed = reduce(DataFrame.unionByName, found)
    known = _stored(spark, f"{out}/files")
    same = F.lit(False)
    if known is not None:
        listed = listed.join(known.select("file_id", F.col("digest").alias("_digest")), "file_id", "left")
        same = F.coalesce(F.col("_digest") == F.col("digest"), F.lit(False))
    listed = save(listed.withColumn("_same", same).drop("_digest"), shared_folder(spark, "listed"))
    changed = listed.where("not _same").select("file_id", "digest", "_large")
    n = {r["_large"]: r["count"] for r in changed.groupBy("_large").count().collect()}
    parts = []
    if False in n:
        some = own if n[False] == len(small) else own.join(changed.select("file_id"), "file_id", "left_semi")
        loaded = extract_text(some.select("file_id", "rel_path", "name", "extension", "size_bytes", "content")).where("status = 'ok'")
        parts.append(chunk_documents(loaded, "file_id", "text", **options))
    if True in n:
        some = long.join(changed.select("file_id"), "file_id", "left_semi")
        rows = chunk_lines(lines(some), "file_id", ("start", "n"), **options)
        total, most = some.agg(F.sum("size_bytes"), F.max("size_bytes")).first()
        if most * spark.sparkContext.defaultParallelism > total:  # else there are files enough for all cores
            rows = rows.repartition("file_id", "chunk_index")  # one long file isn't one task where it is embedded
        parts.append(rows)
    if parts:
        chunks = reduce(DataFrame.unionByName, parts).withColumn("chunk_id", F.xxhash64("file_id", "chunk_index"))
        rows = embed_column(chunks.select("chunk_id", "file_id", "chunk_index", "content", "n_tokens"), "content", embed, dim)
        changed = changed.drop("_large")
        _rewrite(spark, f"{out}/chunks", rows.join(changed, "file_id"), changed)
    _rewrite(spark, f"{out}/files", listed.drop("_same", "_large"), listed.select("file_id"))


def stored_chunks(spark: SparkSession, out: str) -> DataFrame:
    """The chunks of the newest content of each file, one row for each (file_id, chunk_index)."""
    chunks, files = spark.read.parquet(f"{out}/chunks"), spark.read.parquet(f"{out}/files")
    return chunks.drop("part").join(files.select("file_id", "digest"), ["file_id", "digest"], "left_semi")


def changed_files(spark: SparkSession, folder: str, out: str) -> DataFrame:
    """Files under folder whose time or size isn't the stored one. They are found from the listing alone."""
    known = _stored(spark, f"{out}/files")
    listed = with_names(listed_files(spark.read, folder), path_root(folder)).select(*NAMED)
    if known is not None:
        listed = listed.join(known.select("rel_path", "modified", "size_bytes"), ["rel_path", "modified", "size_bytes"], "left_anti")
    return save(listed, shared_folder(spark, "changed"))  # what is stored changes meanwhile


def ingest_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, embed: Callable, dim: int, **options) -> None:
    """New and changed files under folder to chunks with vectors under out: `stored_chunks` has them.

    The stream gives each new file to one batch, as its checkpoint has it. Since a file source never gives a path twice, files that changed are
    then found by their time and size in the listing. Either way `store_files` goes by digests: a batch that runs again, a new checkpoint or a file
    that comes back unchanged stores nothing twice, and of changed content the newest stays. Empty folders and files without text store no chunk.
    """
    schema = listed_files(spark.read, folder).schema

    def write(batch: DataFrame, number: int) -> None:
        store_files(spark, batch, folder, out, embed, dim, **options)

    # a batch is worked out as it comes, with all its columns: the stream has the names alone
    files = with_names(listed_files(spark.readStream.schema(schema), folder), path_root(folder)).select(*NAMED)
    files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    store_files(spark, changed_files(spark, folder, out), folder, out, embed, dim, **options)


def active_sessions(sessions: DataFrame) -> DataFrame:
    """The latest open session of each user."""
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("opened")))
    return sessions.where(~F.col("is_closed")).withColumn("n", rank).where("n = 1").drop("n")


def message_history(messages: DataFrame) -> DataFrame:
    """messages (session_id, turn, role, text) -> per session the turns in order and the turns of each role."""
    count = lambda r: F.count_if(F.col("role") == r).alias(f"{r}_turns")
    return messages.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("history"), count("user"), count("assistant"), count("system"))
