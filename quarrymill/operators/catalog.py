"""Upkeep of the catalogue: documents, versions, chunks and the processing queue.

Every function takes the tables it needs and returns the new rows or the new table; a table is replaced by writing a new snapshot, never the
path being read. Times are parameters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType, VariantType

from ..functions.paths import is_local_path
from ..sources.parts import PartedTable
from ..sources.shared import dealt_left_join, hot_values, save, shared_folder

CLAIM_S, STALE_S = 300, 1800
MAX_ATTEMPTS = 5


def _before(column: str, now: str, seconds: int) -> Column:
    return F.col(column) < F.to_timestamp_ntz(F.lit(now)) - F.expr(f"INTERVAL {seconds} SECOND")


def upsert_documents(target: DataFrame, batch: DataFrame, key: str = "source_uri", keep: tuple[str, ...] = ("document_id", "created_at"), order: tuple[str, ...] = ()) -> DataFrame:
    """The new table with action inserted, updated or kept; a match keeps its id and creation time.

    Of batch rows that share a key the last by `order` counts, of those that tie the one whose other columns are greatest. A null key matches
    nothing: rows of the target with one stay, rows of the batch with one are all inserted. Null keys meet no join.
    """
    whole = lambda df, name: df.select(F.col(key).alias("_key"), F.struct(*[F.col(c) for c in df.columns]).alias(name))
    old, new = whole(target, "_t"), whole(batch, "_b")
    ordered = [F.col(f"_b.{c}") for c in order] + [F.col(f"_b.{f.name}") for f in batch.schema if f.name not in order and not isinstance(f.dataType, (MapType, VariantType))]
    last = new.where("_key is not null").groupBy("_key").agg(F.max_by("_b", F.struct(*ordered)).alias("_b"))
    both = old.where("_key is not null").join(last, "_key", "full_outer").select("_t", "_b")
    none = lambda df, name: F.lit(None).cast(df.schema[name].dataType).alias(name)
    both = both.unionByName(old.where("_key is null").select("_t", none(new, "_b"))).unionByName(new.where("_key is null").select(none(old, "_t"), "_b"))
    was, comes = F.col("_t").isNotNull(), F.col("_b").isNotNull()
    action = F.when(was & comes, "updated").when(comes, "inserted").otherwise("kept")

    def column(c: str) -> Column:
        if c not in batch.columns:
            return F.col(f"_t.{c}")
        if c in keep:
            return F.when(was, F.col(f"_t.{c}")).otherwise(F.col(f"_b.{c}"))
        return F.when(comes, F.col(f"_b.{c}")).otherwise(F.col(f"_t.{c}"))

    return both.select(*[column(c).alias(c) for c in target.columns], action.alias("action"))


def replace_chunks(target: DataFrame, batch: DataFrame, key: str = "document_id") -> DataFrame:
    """All chunks of the batch's documents are dropped, then the batch is added."""
    return target.join(batch.select(key).distinct(), key, "left_anti").unionByName(batch)


def ingest_outcome(loaded: DataFrame, categories: list[str]) -> DataFrame:
    """loaded (…, status, text, error, category, n_chunks, n_vectors) with db_status, error_message, chunk_count and rejected."""
    ok = (F.col("status") == "ok") & (F.trim(F.coalesce("text", F.lit(""))) != "")
    n, v = F.coalesce("n_chunks", F.lit(0)), F.coalesce("n_vectors", F.lit(0))
    status = F.when(~ok & F.col("status").isin("needs_ocr", "needs_doc_conversion"), F.col("status")).when(~ok | (n == 0) | (n != v), "failed").otherwise("indexed")
    why = F.when(~ok, F.coalesce("error", F.concat(F.lit("not readable: "), F.col("status")))).when(n == 0, "no chunks").when(n != v, "chunks and vectors differ")
    good = status == "indexed"
    return loaded.withColumns(
        {
            "rejected": F.col("category").isNull() | ~F.col("category").isin(*categories),
            "db_status": status,
            "error_message": why,
            "content": F.when(good, F.col("text")).otherwise(""),
            "char_count": F.char_length(F.coalesce("text", F.lit(""))),
            "chunk_count": F.when(good, n).otherwise(0),
        }
    )


def dedupe_content(docs: DataFrame, order: tuple[str, ...] = ("updated_at", "document_id"), hash_col: str = "content_hash") -> DataFrame:
    """Each document with keeper (the earliest of its hash) and is_duplicate; a null hash is never a duplicate.

    The keeper is an aggregate with map-side combine, and only hashes that come twice are joined back, with those that over a
    thousandth of all documents share dealt to several tasks. Texts aren't shuffled.
    """
    known = docs.where(F.col(hash_col).isNotNull())
    first = known.groupBy(hash_col).agg(F.min(F.struct(*order)).alias("_first"), F.count("*").alias("_n"))
    first = save(first.where("_n > 1"), shared_folder(docs.sparkSession, "keepers"))
    keeper = F.coalesce(F.col(f"_first.{order[-1]}"), F.col(order[-1]))
    out = dealt_left_join(docs, first.drop("_n"), hash_col, order[-1], hot_values(first.select(hash_col, F.col("_n").alias("n")), hash_col))
    return out.withColumn("keeper", keeper).withColumn("is_duplicate", F.col("keeper") != F.col(order[-1])).drop("_first")


def latest_version(documents: DataFrame, files: DataFrame, category: str | None = None, bucket: str | None = None, active: bool | None = None) -> DataFrame:
    """Every document with its file of the highest version: one aggregate, no sort. `list_documents` puts documents in order."""
    top = files.groupBy("document_id").agg(F.max_by(F.struct("file_id", "version", "status", "storage_bucket", "storage_path", "size_bytes"), "version").alias("file"))
    out = documents.join(top, "document_id", "left")
    if category is not None:
        out = out.where(F.col("category") == category)
    if bucket is not None:
        out = out.where(F.col("file.storage_bucket") == bucket)
    if active is not None:
        out = out.where(F.col("is_active") == active)
    return out


def next_version(uploads: DataFrame, documents: DataFrame, files: DataFrame, by_title: bool = False) -> DataFrame:
    """uploads (upload_id, document_id or title) with version: 1 for a new document, else its current version + 1 and on within the batch; conflict if it exists.

    Titles match whatever their case; of documents with one title the first (smallest document_id) counts. An upload with neither id nor title
    is a new document of its own.
    """
    key = lambda df: F.lower(F.col("title")) if by_title else F.col("document_id")
    d = documents.select(F.col("document_id").alias("_document"), "current_version", key(documents).alias("_key"))
    first = d.where("_key is not null").groupBy("_key").agg(F.min_by(F.struct("_document", "current_version"), "_document").alias("_d")).select("_key", "_d.*")
    u = uploads.withColumn("_key", key(uploads))
    known = u.where("_key is not null").join(first, "_key", "left")
    place = F.row_number().over(Window.partitionBy("_key").orderBy("upload_id"))
    known = known.withColumn("version", (F.coalesce("current_version", F.lit(0)) + place).cast("int"))
    alone = u.where("_key is null").withColumns({"_document": F.lit(None).cast(d.schema["_document"].dataType), "current_version": F.lit(None).cast("int"), "version": F.lit(1)})
    out = known.unionByName(alone).withColumn("is_new", F.col("_document").isNull())
    taken = files.select(F.col("document_id").alias("_document"), "version", F.lit(True).alias("_taken")).distinct()
    return out.join(taken, ["_document", "version"], "left").withColumn("conflict", F.coalesce("_taken", F.lit(False))).drop("_taken", "_key", "current_version").withColumnRenamed("_document", "existing_document_id")


def pending_chunks(chunks: DataFrame, saved: DataFrame, budget: int = 200, batch: int = 20) -> DataFrame:
    """Chunks of each file that aren't saved yet, the first `budget` by index, with their batch number."""
    left = chunks.join(saved.select("file_id", "chunk_index"), ["file_id", "chunk_index"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("file_id").orderBy("chunk_index"))
    return left.withColumn("place", rank).where(F.col("place") <= budget).withColumn("batch_no", (F.floor((F.col("place") - 1) / batch) + 1).cast("int")).drop("place")


def insert_chunks_idempotent(target: DataFrame, batch: DataFrame) -> DataFrame:
    """target with the batch's chunks that it lacks; of repeated keys in the batch the smallest chunk_id counts, and what exists wins."""
    key = ["file_id", "chunk_index"]
    once = batch.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("chunk_id"))).where("_n = 1").drop("_n")
    return target.unionByName(once.join(target.select(*key), key, "left_anti").select(*target.columns))


def file_progress(total: DataFrame, saved: DataFrame) -> DataFrame:
    """total (file_id, total_chunks) with saved_chunks, remaining and status."""
    n = saved.groupBy("file_id").agg(F.countDistinct("chunk_index").alias("saved_chunks"))
    out = total.join(n, "file_id", "left").withColumn("saved_chunks", F.coalesce("saved_chunks", F.lit(0)))
    done = F.col("saved_chunks") >= F.col("total_chunks")
    return out.withColumns({"remaining": F.greatest(F.col("total_chunks") - F.col("saved_chunks"), F.lit(0)), "status": F.when(done, "indexed").otherwise("processing")})


def activate_versions(documents: DataFrame, indexed: DataFrame) -> DataFrame:
    """documents after files (document_id, version, original_filename, storage_bucket, chunk_count) became indexed; the latest of a document counts."""
    top = indexed.groupBy("document_id").agg(F.max_by(F.struct("version", "original_filename", "storage_bucket", "chunk_count"), "version").alias("f"))
    new = F.col("f").isNotNull()
    out = documents.join(top, "document_id", "left")
    return out.withColumns(
        {
            "current_version": F.coalesce("f.version", "current_version"),
            "is_active": F.col("is_active") | new,
            "title": F.coalesce("f.original_filename", "title"),
            "bucket": F.coalesce("f.storage_bucket", F.col("bucket")) if "bucket" in documents.columns else F.col("f.storage_bucket"),
            "status": F.when(new, "indexed").otherwise(F.col("status")),
            "chunk_count": F.coalesce("f.chunk_count", F.col("chunk_count")) if "chunk_count" in documents.columns else F.col("f.chunk_count"),
        }
    ).drop("f")


# tables in parts: the same changes, reading and writing only the parts that hold a key of the batch -----------------------------


def upsert_into(table: PartedTable, batch: DataFrame, number: int, keep: tuple[str, ...] = ("document_id", "created_at"), order: tuple[str, ...] = ()) -> list[str]:
    """`upsert_documents` by the table's key; `number` tells batches apart. The parts that were rewritten."""
    return table.merge(batch, lambda old, new: upsert_documents(old, new, table.key, keep, order).drop("action"), number)


def replace_chunks_in(table: PartedTable, batch: DataFrame, number: int) -> list[str]:
    """`replace_chunks` by the table's key."""
    return table.merge(batch, lambda old, new: replace_chunks(old, new, table.key), number)


def insert_chunks_into(table: PartedTable, batch: DataFrame, number: int) -> list[str]:
    """`insert_chunks_idempotent` into a table whose key is file_id."""
    return table.merge(batch, insert_chunks_idempotent, number)


def delete_documents_from(ids: DataFrame, documents: PartedTable, files: PartedTable, chunks: PartedTable, jobs: PartedTable) -> dict[str, list[str]]:
    """`delete_documents`: what hangs on documents goes first, so that a run that breaks off finds the rest when it is called again."""
    by_uri = "source_uri" in ids.columns and "document_id" not in ids.columns
    own = documents.rows().join(ids.select("source_uri").distinct(), "source_uri", "left_semi") if by_uri else ids
    gone = save(own.select("document_id").distinct(), shared_folder(documents.spark, "gone"))
    of_files = files.rows().select("document_id", "file_id").join(gone, "document_id", "left_semi").select("file_id")
    steps = {"jobs": (jobs, of_files, "file_id"), "chunks": (chunks, gone, "document_id"), "files": (files, gone, "document_id"), "documents": (documents, gone, "document_id")}
    return {name: table.drop(keys, on) for name, (table, keys, on) in steps.items()}


# the queue -------------------------------------------------------------------------------------------------------------------


def claimable_jobs(jobs: DataFrame, now: str, n: int = 1, honour_retry_at: bool = False) -> DataFrame:
    """The next n jobs: pending, never claimed or claimed over 300 s ago, highest priority then earliest; shown as they are once claimed."""
    free = (F.col("status") == "pending") & (F.col("claimed_at").isNull() | _before("claimed_at", now, CLAIM_S))
    if honour_retry_at:
        free &= F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= F.to_timestamp_ntz(F.lit(now)))
    out = jobs.where(free).orderBy(F.desc("priority"), "scheduled_at", "job_id").limit(n)
    return out.withColumns({"status": F.lit("processing"), "attempts": F.col("attempts") + 1, "claimed_at": F.to_timestamp_ntz(F.lit(now))})


def reap_stale(jobs: DataFrame, now: str) -> DataFrame:
    """Jobs in processing for over 1800 s: failed if this was their last attempt, else pending again in 10 s. Attempts stay as stored."""
    stale = jobs.where((F.col("status") == "processing") & _before("claimed_at", now, STALE_S))
    last = F.col("attempts") + 1 >= F.coalesce("max_attempts", F.lit(MAX_ATTEMPTS))
    return stale.withColumns({"status": F.when(last, "failed").otherwise("pending"), "next_retry_at": F.when(~last, F.to_timestamp_ntz(F.lit(now)) + F.expr("INTERVAL 10 SECOND"))})


def job_outcome(jobs: DataFrame, now: str) -> DataFrame:
    """jobs (…, result, attempts, max_attempts, error) after a run: next status and time. result is a file status, partial or crash."""
    result, a = F.col("result"), F.col("attempts")
    spent = a >= F.coalesce("max_attempts", F.lit(MAX_ATTEMPTS))
    done = result.isin("indexed", "needs_ocr", "needs_doc_conversion")
    status = F.when(done, "done").when(result == "partial", "pending").when(spent, "failed").otherwise("pending")
    wait = F.when(done | (result == "partial") | spent, F.lit(None)).when(result == "crash", F.least(F.lit(600.0), 30 * F.pow(F.lit(2.0), a - 1))).otherwise(60).cast("long")
    return jobs.withColumns({"next_status": status, "retry_in_s": wait, "next_retry_at": F.timestamp_add("SECOND", wait.cast("int"), F.to_timestamp_ntz(F.lit(now))), "error_message": F.left("error", F.lit(1000))})


def _new_jobs(files: DataFrame, priority: int, now: str) -> DataFrame:
    return files.select("file_id", F.lit("pending").alias("status"), F.lit(priority).alias("priority"), F.lit(0).alias("attempts"), F.lit(MAX_ATTEMPTS).alias("max_attempts"), F.to_timestamp_ntz(F.lit(now)).alias("scheduled_at"))


def recheck_needs(files: DataFrame, now: str) -> DataFrame:
    """A new job at priority 150 for each file that waited for OCR or conversion and lies in a bucket."""
    ready = F.col("status").isin("needs_ocr", "needs_doc_conversion") & F.col("storage_bucket").isNotNull() & ~is_local_path(F.col("storage_path"))
    return _new_jobs(files.where(ready), 150, now)


def reprocess(ids: DataFrame, documents: DataFrame, files: DataFrame, chunks: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """(chunks left, new jobs at priority 200): only the current version's file of active documents loses its chunks."""
    current = documents.where("is_active").join(ids.select("document_id").distinct(), "document_id", "left_semi").select("document_id", F.col("current_version").alias("version"))
    hit = files.join(current, ["document_id", "version"], "left_semi")
    return chunks.join(hit.select("file_id"), "file_id", "left_anti"), _new_jobs(hit, 200, now)


def set_active(documents: DataFrame, ids: DataFrame, flag: bool) -> DataFrame:
    hit = ids.select("document_id", F.lit(flag).alias("_flag")).distinct()
    return documents.join(hit, "document_id", "left").withColumn("is_active", F.coalesce("_flag", "is_active")).drop("_flag")


def delete_documents(ids: DataFrame, documents: DataFrame, files: DataFrame, chunks: DataFrame, jobs: DataFrame) -> dict[str, DataFrame]:
    """Every table without the documents (ids by document_id or source_uri) and what hangs on them."""
    key = "source_uri" if "source_uri" in ids.columns and "document_id" not in ids.columns else "document_id"
    gone = documents.join(ids.select(key).distinct(), key, "left_semi").select("document_id")
    gone_files = files.join(gone, "document_id", "left_semi").select("file_id")
    return {
        "documents": documents.join(gone, "document_id", "left_anti"),
        "files": files.join(gone, "document_id", "left_anti"),
        "chunks": chunks.join(gone, "document_id", "left_anti"),
        "jobs": jobs.join(gone_files, "file_id", "left_anti"),
    }


def unlink_sessions(drafts: DataFrame, deleted: DataFrame) -> DataFrame:
    """drafts whose session is gone keep their row, with session_id null."""
    gone = deleted.select("session_id", F.lit(True).alias("_gone")).distinct()
    return drafts.join(gone, "session_id", "left").withColumn("session_id", F.when(F.col("_gone").isNull(), F.col("session_id"))).drop("_gone")


def backfill_files(documents: DataFrame, files: DataFrame, file_id: Column | None = None) -> DataFrame:
    """files with a first version for each document that has none; `file_id` is made of document_id, unset its number with a 1 after it, or its text with -v1."""
    add = documents.join(files.select("document_id").distinct(), "document_id", "left_anti")
    if file_id is None:
        i = F.col("document_id")
        file_id = F.concat(i, F.lit("-v1")) if isinstance(documents.schema["document_id"].dataType, StringType) else i * 10 + 1
    rows = add.select(file_id.alias("file_id"), "document_id", F.lit(1).alias("version"), F.lit("pending").alias("status"))
    return files.select("file_id", "document_id", "version", "status").unionByName(rows)


def backfill_versions(documents: DataFrame, files: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, chunks): chunks without a version get version 1 and its file; a current version over 50 is taken for an error and set to 1."""
    first = files.where("version = 1").groupBy("document_id").agg(F.min("file_id").alias("_file"))
    c = chunks.join(first, "document_id", "left")
    bare = F.col("version").isNull()
    c = c.withColumns({"file_id": F.when(bare, F.coalesce("_file", "file_id")).otherwise(F.col("file_id")), "version": F.coalesce("version", F.lit(1))}).drop("_file")
    return documents.withColumn("current_version", F.when(F.col("current_version") > 50, 1).otherwise(F.col("current_version"))), c


def reset_index(documents: DataFrame) -> DataFrame:
    """Every document back to pending, without error."""
    return documents.withColumns({"status": F.lit("pending"), "error_message": F.lit(None).cast("string"), "chunk_count": F.lit(0)})


def list_documents(documents: DataFrame, category: str | None = None) -> DataFrame:
    rows = documents if category is None else documents.where(F.col("category") == category)
    return rows.orderBy(F.desc("updated_at"), "document_id")


def list_files(files: DataFrame, document_id: int) -> DataFrame:
    return files.where(F.col("document_id") == document_id).orderBy(F.desc("version"))


def list_jobs(jobs: DataFrame, status: str | None = None, limit: int = 50) -> DataFrame:
    rows = jobs if status is None else jobs.where(F.col("status") == status)
    return rows.orderBy(F.desc("scheduled_at"), "job_id").limit(limit)
