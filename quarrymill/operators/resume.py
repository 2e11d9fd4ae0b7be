"""Embedding the chunks of many files in rounds that are committed one by one, so that a run that breaks off is taken up where it stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import folder_exists
from .catalog import activate_versions, file_progress, pending_chunks
from .embedding import embed_column

KEY = ["file_id", "chunk_index"]


def committed(spark: SparkSession, out: str) -> list[int]:
    """The rounds under out that were written whole."""
    found, k = [], 0
    while folder_exists(spark, f"{out}/round={k}/_SUCCESS"):
        found.append(k)
        k += 1
    return found


def saved_chunks(spark: SparkSession, out: str, schema) -> DataFrame:
    """The chunks of all committed rounds, with their vectors; what a broken round left behind isn't read."""
    rounds = committed(spark, out)
    return spark.read.schema(schema).parquet(*[f"{out}/round={k}" for k in rounds]) if rounds else spark.createDataFrame([], schema)


def embed_round(chunks: DataFrame, out: str, embed: Callable, dim: int, budget: int = 200, batch: int = 20) -> bool:
    """One step: up to `budget` chunks of each file that aren't saved yet, embedded in blocks of `batch` and committed. False if none is left.

    A round is a folder of its own that counts once it was written whole; one that broke off is written again from its start. Of repeated
    (file_id, chunk_index) in chunks the smallest content counts. Every chunk is embedded in one committed round only.
    """
    spark = chunks.sparkSession
    schema = embed_column(chunks.limit(0), "content", embed, dim, batch, failed_col="failed").schema
    done = committed(spark, out)
    wanted = pending_chunks(chunks, saved_chunks(spark, out, schema).select(*KEY), budget, batch)
    if wanted.isEmpty():
        return False
    # batches of a file lie side by side in a task, and files are spread by them, so that one long file isn't one task
    rows = wanted.repartition("file_id", "batch_no").sortWithinPartitions("file_id", "chunk_index").drop("batch_no")
    embed_column(rows, "content", embed, dim, batch, failed_col="failed").write.mode("overwrite").parquet(f"{out}/round={len(done)}")
    return True


def ingest_resumable(documents: DataFrame, files: DataFrame, chunks: DataFrame, out: str, embed: Callable, dim: int, budget: int = 200, batch: int = 20, rounds: int | None = None) -> dict[str, DataFrame]:
    """Rounds until no chunk is left (or `rounds` of them) -> chunks with vectors, progress of the files, and the documents with what is indexed now activated.

    documents and files (file_id, document_id, version, original_filename, storage_bucket) as in the catalogue; chunks (file_id, chunk_index,
    content, ...) with one row for each (file_id, chunk_index), content not blank. Called again after a break it goes on from the last
    committed round; called once more it changes nothing. Nothing is held in memory between rounds.
    """
    spark, k = documents.sparkSession, 0
    while (rounds is None or k < rounds) and embed_round(chunks, out, embed, dim, budget, batch):
        k += 1
    schema = embed_column(chunks.limit(0), "content", embed, dim, batch, failed_col="failed").schema
    saved = saved_chunks(spark, out, schema)
    total = chunks.groupBy("file_id").agg(F.countDistinct("chunk_index").alias("total_chunks"))
    progress = file_progress(total, saved)
    ready = progress.where("status = 'indexed'").select("file_id", F.col("saved_chunks").alias("chunk_count"))
    indexed = files.select("file_id", "document_id", "version", "original_filename", "storage_bucket").join(ready, "file_id")
    return {"chunks": saved, "progress": progress, "documents": activate_versions(documents, indexed)}
