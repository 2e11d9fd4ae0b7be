"""Counts, validation of the index and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .embedding import TINY
from ..sources.shared import save, shared_folder
from .retrieval import match_batch

#: Categories that documents may have.
MOST_CATEGORIES = 1000


def catalog_stats(documents: DataFrame, files: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row of eleven counters, one pass for each table."""
    status = F.col("status")
    d = documents.agg(F.count("*").alias("documents"), F.count_if("is_active").alias("active"))
    f = files.agg(
        F.count("*").alias("files"),
        F.count_if(status == "indexed").alias("indexed"),
        F.count_if(status.isin("pending", "processing")).alias("pending"),
        *[F.count_if(status == s).alias(s) for s in ("failed", "needs_ocr", "needs_doc_conversion")],
    )
    j = jobs.agg(*[F.count_if(status == s).alias(f"jobs_{s}") for s in ("pending", "processing", "failed")])
    return d.join(f).join(j)  # three rows of one


def validate_index(documents: DataFrame, chunks: DataFrame, dim: int) -> DataFrame:
    """Each document with its chunks as counted and the checks that fail; documents that aren't indexed are skipped.

    A vector is reduced to a few numbers before the shuffle.
    """
    v = F.col("embedding")
    zero = v.isNotNull() & ~F.exists(v, lambda x: F.abs(x) >= TINY)
    one = chunks.select("document_id", v.isNotNull().alias("has"), F.coalesce(zero, F.lit(False)).alias("zero"), F.when(v.isNotNull(), F.size(v)).alias("dim"))
    got = one.groupBy("document_id").agg(F.count("*").alias("actual"), F.count_if("has").alias("with_embedding"), F.count_if("zero").alias("zero_vectors"), F.min("dim").alias("min_dim"), F.max("dim").alias("max_dim"))
    out = documents.join(got, "document_id", "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("actual", "with_embedding", "zero_vectors")})
    checks = [
        (F.col("actual") == 0, "no chunks"),
        (F.col("actual") != F.coalesce("chunk_count", F.lit(-1)), "chunk count differs"),
        (F.col("with_embedding") < F.col("actual"), "vectors missing"),
        (F.col("with_embedding") != F.coalesce("embedding_count", F.lit(-1)), "vector count differs"),
        (F.col("zero_vectors") > 0, "zero vectors"),
        ((F.col("min_dim") != dim) | (F.col("max_dim") != dim), "wrong dimension"),
    ]
    failed = F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in checks]))
    skip = F.col("status") != "indexed"
    out = out.withColumn("failed", F.when(skip, F.array().cast("array<string>")).otherwise(failed))
    verdict = F.when(skip, "skipped").when(F.size("failed") == 0, "ok").otherwise("failed")
    return out.select("document_id", "category", "status", "actual", "with_embedding", "zero_vectors", "min_dim", "max_dim", "failed", verdict.alias("verdict"))


def status_report(documents: DataFrame) -> DataFrame:
    """Counts by category and status, by each alone, and in all; level is 0 for both, 1 category, 2 status, 3 all."""
    return documents.cube("category", "status").agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))


def status_pivot(documents: DataFrame, statuses: list[str]) -> DataFrame:
    """One row for each category with a column for each status."""
    return documents.groupBy("category").pivot("status", statuses).agg(F.count(F.lit(1))).na.fill(0)


def retrievability_probe(documents: DataFrame, probes: DataFrame, chunks: DataFrame, dim: int, k: int = 50) -> DataFrame:
    """Whether each indexed document is among the k nearest chunks to its probe vector: among all, else within its category.

    probes (document_id, embedding); chunks as of current versions. Verdicts: ok, category only, not found, warn (no probe). Every probe is
    compared with every chunk, so the work is probes x chunks: give a sample of probes where documents are many.
    """
    indexed = documents.where("status = 'indexed'").select("document_id", "category")
    p = probes.join(indexed, "document_id").select(F.col("document_id").alias("request_id"), "embedding", F.col("category").alias("own"))

    def hits(found: DataFrame) -> DataFrame:
        own = found.where(F.col("request_id") == F.col("document_id"))
        return own.groupBy("document_id").agg(F.count("*").alias("hits"), F.max("similarity").alias("best"))

    everywhere = save(hits(match_batch(p.drop("own"), chunks, [(None, k, 0.0)], dim)), shared_folder(documents.sparkSession, "probe"))
    # documents that aren't among the nearest of all are few, or else the index is broken; each is tried in its own category
    missed = p.join(everywhere.select(F.col("document_id").alias("request_id")), "request_id", "left_anti")
    categories = [r[0] for r in missed.select("own").distinct().limit(MOST_CATEGORIES + 1).collect()]
    if len(categories) > MOST_CATEGORIES:
        raise ValueError(f"more than {MOST_CATEGORIES} categories")
    within = match_batch(missed.drop("own"), chunks, [(c, k, 0.0) for c in categories] or [("", k, 0.0)], dim).join(p.select("request_id", "own"), "request_id").where(F.col("section") == F.col("own"))
    inside = hits(within).select("document_id", F.col("hits").alias("hits_in_category"), F.col("best").alias("best_in_category"))
    out = indexed.join(probes.select("document_id", F.lit(True).alias("probed")).distinct(), "document_id", "left").join(everywhere, "document_id", "left").join(inside, "document_id", "left")
    verdict = F.when(F.col("probed").isNull(), "warn").when(F.col("hits") > 0, "ok").when(F.col("hits_in_category") > 0, "category only").otherwise("not found")
    return out.select("document_id", "category", F.coalesce("hits", "hits_in_category", F.lit(0)).alias("hits"), F.round(F.coalesce("best", "best_in_category"), 6).alias("best"), verdict.alias("verdict"))


def error_report(documents: DataFrame) -> DataFrame:
    """Documents that aren't indexed, with the error whole and as a short line."""
    error = F.coalesce(F.nullif(F.trim("error_message"), F.lit("")), F.lit("(no message)"))
    name = F.col("title")
    short = F.when(F.char_length(name) > 45, F.concat(F.left(name, F.lit(42)), F.lit("..."))).otherwise(name)
    rows = documents.where("status <> 'indexed'")
    return rows.select("document_id", short.alias("name"), "category", "status", error.alias("error"), F.left(F.get(F.split(error, "\n"), F.lit(0)), F.lit(60)).alias("error_line"))


def version_isolation_check(files: DataFrame, chunks: DataFrame, hits: DataFrame, current: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files with what is wrong with their chunks, hits that aren't of current versions)."""
    got = chunks.groupBy("file_id").agg(F.count("*").alias("actual"), F.min("chunk_index").alias("first"), F.countDistinct("chunk_index").alias("different"))
    out = files.join(got, "file_id", "left").withColumn("actual", F.coalesce("actual", F.lit(0)))
    wrong = F.array_compact(
        F.array(F.when(F.col("actual") != F.col("chunk_count"), "chunk count differs"), F.when(F.col("first") != 0, "does not start at 0"), F.when(F.col("different") < F.col("actual"), "repeated index"))
    )
    return out.select("file_id", "document_id", "version", "actual", wrong.alias("wrong")), hits.join(current.select("chunk_id"), "chunk_id", "left_anti")


def summary_text(report: DataFrame) -> DataFrame:
    """The status report as one line for each count, for a text file."""
    part = lambda c: F.coalesce(F.col(c), F.lit("all"))
    return report.orderBy("level", "category", "status").select(F.format_string("%-22s %-22s %8d", part("category"), part("status"), "n").alias("value"))
