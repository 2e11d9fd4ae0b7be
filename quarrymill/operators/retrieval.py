"""Exact cosine top-k over current versions, evidence bundles and citations.

Similarity is rounded to 12 digits before ranking, so that sums in another order can't change it; ties go to the smaller chunk id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .embedding import is_valid_vector

HIT = ["chunk_id", "document_id", "file_id", "version", "chunk_index", "content", "category", "title", "source_uri"]
#: Requests are broadcast if their vectors take so many bytes at most; more meet the chunks in blocks of so many bytes of either.
BLOCK_BYTES = 64 << 20
#: Numbers of a product that is held at once.
TILE = 1 << 22


def current_chunks(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks of active documents' current versions, with the documents' columns; a chunk without version is never current."""
    d = documents.where("is_active").select("document_id", F.col("current_version").alias("version"), "category", "title", "source_uri")
    return chunks.where("version is not null").join(d, ["document_id", "version"])


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two array columns, as an expression."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def match_documents(chunks: DataFrame, vector: list[float], threshold: float = 0.70, k: int = 5, category: str | None = None) -> DataFrame:
    """The k nearest of current chunks to one vector, with similarity strictly over the threshold; k is at least 1."""
    rows = chunks.where(is_valid_vector(F.col("embedding"), len(vector)))
    if category is not None:
        rows = rows.where(F.col("category") == category)
    rows = rows.withColumn("similarity", F.round(cosine(F.col("embedding"), F.array(*map(F.lit, map(float, vector)))), 12)).where(F.col("similarity") > threshold)
    return rows.orderBy(F.desc("similarity"), "chunk_id").limit(max(k, 1)).select(*[c for c in HIT if c in chunks.columns], "similarity")


def match_batch(queries: DataFrame, chunks: DataFrame, spec: list[tuple[str | None, int, float]], dim: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """queries (request_id, embedding) x spec (category or None for all, k, threshold) -> request_id, section, rank, similarity and the chunk.

    Requests up to block_bytes (their size is counted first) are broadcast, and chunks stay where they are: a task keeps the k best of
    each (request, category) of all its chunks, by products of 32 MB, and only those winners are ranked globally. More requests than that meet
    the chunks in blocks: either side is cut into blocks of block_bytes by a hash, and each pair of blocks is one group of a cogroup, so that
    neither side passes through the driver. Ids may be of any type that Spark orders.
    """
    q = queries.where(is_valid_vector(F.col("embedding"), dim)).select("request_id", F.col("embedding").cast("array<double>").alias("embedding"))
    c = chunks.where(is_valid_vector(F.col("embedding"), dim)).select("chunk_id", "embedding", "category")
    schema = f"request_id {q.schema['request_id'].dataType.simpleString()}, section string, chunk_id {c.schema['chunk_id'].dataType.simpleString()}, similarity double"
    blocks = -(-q.count() * dim * 8 // block_bytes)
    local = _beside(q, c, spec, schema) if blocks <= 1 else _in_blocks(q, c, spec, schema, blocks, dim, block_bytes)
    best = Window.partitionBy("request_id", "section").orderBy(F.desc("similarity"), "chunk_id")
    most = F.coalesce(*[F.when(F.col("section") == (s or "all"), F.lit(max(k, 1))) for s, k, _ in spec])
    ranked = local.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)
    return ranked.join(chunks.drop("embedding"), "chunk_id")


def _unit(lists: pa.Array) -> np.ndarray:
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Best:
    """The k best chunks of each request so far, for one entry of a spec; of equal similarities the smaller chunk ids."""

    def __init__(self, requests: int, section: str | None, k: int, threshold: float, kind: np.dtype):
        self.section, self.k, self.threshold = section, max(k, 1), threshold
        self.row, self.value, self.chunk = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, kind)
        self.least = np.full(requests, -np.inf)  # the worst of a full list

    def add(self, unit: np.ndarray, x: np.ndarray, chunk: np.ndarray) -> None:
        step = max(1, TILE // max(len(x), 1))
        for a in range(0, len(unit), step):
            s = np.round(unit[a : a + step] @ x.T, 12)
            hit = (s > self.threshold) & (s >= self.least[a : a + step, None])
            if s.shape[1] > self.k:
                hit &= s >= np.partition(s, -self.k, axis=1)[:, -self.k, None]
            i, j = np.nonzero(hit)
            if len(i):
                self.row, self.value, self.chunk = np.append(self.row, i + a), np.append(self.value, s[i, j]), np.append(self.chunk, chunk[j])
        self.trim()

    def trim(self) -> None:
        order = np.lexsort((np.unique(self.chunk, return_inverse=True)[1], -self.value, self.row))
        row = self.row[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        kept = order[place < self.k]
        full = order[place == self.k - 1]
        self.least[self.row[full]] = self.value[full]
        self.row, self.value, self.chunk = self.row[kept], self.value[kept], self.chunk[kept]


def _winners(requests: pa.Array, unit: np.ndarray, batches: Iterator[pa.RecordBatch], spec: list[tuple[str | None, int, float]]) -> Iterator[pa.RecordBatch]:
    """batches (chunk_id, embedding, category) -> the winners of all of them."""
    best: list[Best] = []
    kind = None
    for batch in batches:
        if not len(batch) or not len(unit):
            continue
        chunk = batch.column(0).to_numpy(zero_copy_only=False)
        kind = batch.schema.field(0).type
        best = best or [Best(len(unit), *s, chunk.dtype) for s in spec]
        x, category = _unit(batch.column(1)), np.array(batch.column(2).to_pylist(), object)
        for b in best:
            at = np.arange(len(x)) if b.section is None else np.flatnonzero(category == b.section)
            if len(at):
                b.add(unit, x[at], chunk[at])
    for b in best:
        yield pa.RecordBatch.from_arrays(
            [requests.take(pa.array(b.row)), pa.array([b.section or "all"] * len(b.row), pa.string()), pa.array(b.chunk, kind), pa.array(b.value)], names=["request_id", "section", "chunk_id", "similarity"]
        )


def _beside(q: DataFrame, c: DataFrame, spec: list[tuple[str | None, int, float]], schema: str) -> DataFrame:
    got = q.toArrow().combine_chunks()
    requests, lists = (got.column(k).combine_chunks() if len(got) else pa.array([], got.schema.field(k).type) for k in range(2))
    shared = q.sparkSession.sparkContext.broadcast((requests, _unit(lists) if len(got) else np.zeros((0, 0))))
    return c.mapInArrow(lambda batches: _winners(*shared.value, batches, spec), schema)


def _in_blocks(q: DataFrame, c: DataFrame, spec: list[tuple[str | None, int, float]], schema: str, blocks: int, dim: int, block_bytes: int) -> DataFrame:
    others = -(-c.count() * dim * 8 // block_bytes)
    place = lambda column, n: F.pmod(F.xxhash64(column), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = q.withColumns({"_q": place("request_id", blocks), "_c": every(others)})
    right = c.withColumns({"_q": every(blocks), "_c": place("chunk_id", others)})

    def run(requests: pa.Table, some: pa.Table) -> pa.Table:
        found = []
        if len(requests):
            ids, lists = (requests.column(k).combine_chunks() for k in ("request_id", "embedding"))
            found = list(_winners(ids, _unit(lists), iter(some.select(["chunk_id", "embedding", "category"]).to_batches()), spec))
        return pa.Table.from_batches(found) if found else pa.table({n: pa.array([], t) for n, t in (("request_id", requests.schema.field("request_id").type), ("section", pa.string()), ("chunk_id", some.schema.field("chunk_id").type), ("similarity", pa.float64()))})

    return left.groupBy("_q", "_c").cogroup(right.groupBy("_q", "_c")).applyInArrow(run, schema)


def match_batch_expression(queries: DataFrame, chunks: DataFrame, spec: DataFrame, dim: int) -> DataFrame:
    """The same by expressions alone, for checking: every request with every chunk of a category."""
    c = chunks.where(is_valid_vector(F.col("embedding"), dim)).join(F.broadcast(spec), "category")
    q = queries.where(is_valid_vector(F.col("embedding"), dim)).select("request_id", F.col("embedding").alias("wanted"))
    rows = c.join(q).withColumn("similarity", F.round(cosine(F.col("embedding"), F.col("wanted")), 12)).where("similarity > threshold")
    best = Window.partitionBy("request_id", "category").orderBy(F.desc("similarity"), "chunk_id")
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= F.greatest("k", F.lit(1)))


def _requests(rows: DataFrame, requests: DataFrame | None) -> DataFrame:
    """The requests to answer: each once, those without a row too if they are given."""
    return (rows if requests is None else requests).select("request_id").distinct()


def grouped_context(hits: DataFrame, categories: list[str], requests: DataFrame | None = None) -> DataFrame:
    """Hits of each request by category, in the order of categories, with total and is_empty; `requests` (request_id) without hits have empty lists."""
    by = hits.groupBy("request_id").agg(
        *[F.transform(F.array_sort(F.collect_list(F.when(F.col("section") == c, F.struct("rank", "chunk_id")))), lambda x: x["chunk_id"]).alias(c) for c in categories], F.count("*").alias("total")
    )
    none = F.array().cast(by.schema[categories[0]].dataType) if categories else None
    out = _requests(hits, requests).join(by, "request_id", "left").withColumns({c: F.coalesce(c, none) for c in categories} | {"total": F.coalesce("total", F.lit(0))})
    return out.withColumn("is_empty", F.col("total") == 0)


def label(title: Column, version: Column, index: Column) -> Column:
    return F.concat(F.coalesce(F.nullif(title, F.lit("")), F.lit("untitled")), F.lit(" v"), version.cast("string"), F.lit(" #"), index.cast("string"))


SECTIONS = ["templates", "internal_policies", "national_regulations"]


def build_evidence(hits: DataFrame, caps: list[tuple[str, int]]) -> DataFrame:
    """The best hits of each section up to its cap, in the order of caps, labelled; position counts through a request."""
    cap = F.coalesce(*[F.when(F.col("section") == s, F.lit(n)) for s, n in caps], F.lit(0))
    order = F.coalesce(*[F.when(F.col("section") == s, F.lit(i)) for i, (s, _) in enumerate(caps)], F.lit(len(caps)))
    kept = hits.where(F.col("rank") <= cap).withColumn("section_order", order)
    kept = kept.withColumn("position", F.row_number().over(Window.partitionBy("request_id").orderBy("section_order", "rank")))
    first = F.first(F.when(F.col("section") == "templates", F.col("chunk_id")), ignorenulls=True).over(Window.partitionBy("request_id").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return kept.withColumns({"label": label(F.col("title"), F.col("version"), F.col("chunk_index")), "best_template": first, "has_template": first.isNotNull()})


def evidence_bundles(evidence: DataFrame, requests: DataFrame, sections: list[str] = SECTIONS) -> DataFrame:
    """One row for each request, those without evidence too: chunks of each section, best_template and has_template."""
    own = evidence.groupBy("request_id").agg(*[F.count_if(F.col("section") == s).alias(s) for s in sections], F.first("best_template", ignorenulls=True).alias("best_template"))
    out = _requests(evidence, requests).join(own, "request_id", "left").withColumns({s: F.coalesce(s, F.lit(0)) for s in sections})
    return out.withColumn("has_template", F.col("best_template").isNotNull())


def citation() -> Column:
    return F.struct("document_id", "file_id", "version", "chunk_index", "title", "category", F.round("similarity", 4).alias("similarity"))


def to_citations(evidence: DataFrame) -> DataFrame:
    return evidence.select("request_id", "position", "label", *[citation()[c].alias(c) for c in ("document_id", "file_id", "version", "chunk_index", "title", "category", "similarity")])


def render_evidence(evidence: DataFrame, sections: list[tuple[str, str]] = [("templates", "Templates"), ("internal_policies", "Policies"), ("national_regulations", "Regulations")], drop_templates: bool = False, no_template: str = "_No template was found._", requests: DataFrame | None = None) -> DataFrame:
    """One markdown text for each request: a heading for each section with hits, `### label  (similarity=0.123)` and the content of each hit.

    Where no template was found there is a notice, for `requests` (request_id) without any evidence too.
    """
    block = F.concat(F.lit("### "), F.col("label"), F.format_string("  (similarity=%.3f)", "similarity"), F.lit("\n"), F.trim(F.coalesce("content", F.lit(""))))
    rows = evidence.select("request_id", "section", "position", block.alias("block"))
    got = rows.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("position", "section", "block"))).alias("all"))
    none = F.array().cast(got.schema["all"].dataType)
    got = _requests(evidence, requests).join(got, "request_id", "left").withColumn("all", F.coalesce("all", none))

    def text(section: str, heading: str) -> Column:
        own = F.transform(F.filter("all", lambda x: x["section"] == section), lambda x: x["block"])
        body = F.concat(F.lit(f"## {heading}\n\n"), F.array_join(own, "\n\n"))
        if section == "templates":
            empty = F.lit(f"## {heading}\n\n{no_template}")
            return F.lit(None).cast("string") if drop_templates else F.when(F.size(own) > 0, body).otherwise(empty)
        return F.when(F.size(own) > 0, body)

    return got.select("request_id", F.concat_ws("\n\n", *[text(s, h) for s, h in sections]).alias("text"))


def references_by_document(chunks_used: DataFrame, by: str = "draft_id") -> DataFrame:
    """Chunks used (by, position, document_id, title, category) by document: title, category, count, place of the first."""
    g = chunks_used.groupBy(by, "document_id").agg(F.min_by("title", "position").alias("title"), F.min_by("category", "position").alias("category"), F.count("*").alias("n"), F.min("position").alias("first_position"))
    return g.withColumn("seen", F.row_number().over(Window.partitionBy(by).orderBy("first_position")))


def provenance(evidence: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """All chunks of a request's evidence in order, as one list with the similarity unrounded; empty for `requests` (request_id) without any."""
    one = F.struct("position", "document_id", "file_id", "version", "chunk_index", "title", "category", "similarity")
    got = evidence.groupBy("request_id").agg(F.array_sort(F.collect_list(one)).alias("chunks_used"))
    none = F.array().cast(got.schema["chunks_used"].dataType)
    return _requests(evidence, requests).join(got, "request_id", "left").withColumn("chunks_used", F.coalesce("chunks_used", none))
