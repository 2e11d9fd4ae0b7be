"""Texts to vectors through a function that is passed in, and checks of stored vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, FloatType, StructField, StructType

LONG_TEXT = 4000
TINY = 1e-9


def hashing_embedder(dim: int) -> Callable[[list[str]], list[list[float]]]:
    """A deterministic embedder: words hashed by MD5 to a place and a sign, unit length. For tests and as a stand-in."""
    known: dict[str, int] = {}

    def hashed(word: str) -> int:
        """Its place, and dim more for a negative sign; a worker keeps those of so many words."""
        h = int(hashlib.md5(word.encode(), usedforsecurity=False).hexdigest()[:8], 16)
        if len(known) >= 100_000:
            known.clear()
        known[word] = at = h // 2 % dim + (0 if h % 2 else dim)
        return at

    def embed(texts: list[str]) -> list[list[float]]:
        parts = [t.lower().split() for t in texts]
        at = np.array([hashed(w) if (k := known.get(w)) is None else k for p in parts for w in p], np.int64)
        rows = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
        counts = np.bincount(rows * 2 * dim + at, minlength=len(texts) * 2 * dim).reshape(len(texts), 2, dim)
        out = (counts[:, 0] - counts[:, 1]).astype(np.float64)
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).tolist()

    return embed


Embed = Callable[[list[str]], list[list[float]]]


def embed_texts(texts: list[str], embed: Embed, dim: int, batch: int = 20, failed: list[int] | None = None) -> list[list[float]]:
    """Vectors in the order of texts. Blocks of `batch` texts; long texts go alone, and one that fails gets a zero vector (its place is added to `failed`)."""
    if any(t is None or not t.strip() for t in texts):
        raise ValueError("blank texts can't be embedded")
    out: list[list[float] | None] = [None] * len(texts)
    short = [i for i, t in enumerate(texts) if len(t) <= LONG_TEXT]
    for a in range(0, len(short), batch):
        block = short[a : a + batch]
        got = embed([texts[i] for i in block])
        if len(got) != len(block):
            raise ValueError(f"{len(got)} vectors for {len(block)} texts")
        for i, v in zip(block, got, strict=True):
            out[i] = v
    for i, t in enumerate(texts):
        if out[i] is None:
            try:
                (out[i],) = embed([t])
            except Exception:  # noqa: BLE001  a text too long for the model is kept with a placeholder
                out[i] = [0.0] * dim
                if failed is not None:
                    failed.append(i)
    if any(len(v) != dim for v in out):
        raise ValueError(f"vectors must have {dim} dimensions")
    return out


def whole_blocks(batches: Iterator[pa.RecordBatch], column: str, batch: int) -> Iterator[pa.Table]:
    """Arrow batches recut so that each but the last holds whole blocks of `batch` short texts; what is left over goes on with the next."""
    held: pa.Table | None = None
    for b in batches:
        held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        size = pc.fill_null(pc.utf8_length(held.column(column)), 0).to_numpy()
        short = np.cumsum(size <= LONG_TEXT)
        full = int(short[-1]) // batch * batch if len(short) else 0
        if full:
            cut = int(np.searchsorted(short, full)) + 1
            yield held.slice(0, cut)
            held = held.slice(cut)
    if held is not None and len(held):
        yield held


def embed_column(df: DataFrame, text_col: str, embed: Embed, dim: int, batch: int = 20, out: str = "embedding", failed_col: str | None = None) -> DataFrame:
    """df with vectors of a text column. Blocks of `batch` texts go on through a task's Arrow batches; `failed_col` tells which vectors are placeholders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_blocks(batches, text_col, batch):
            failed: list[int] = []
            vectors = embed_texts(rows.column(text_col).to_pylist(), embed, dim, batch, failed)
            rows = rows.append_column(out, pa.array(vectors, pa.list_(pa.float32())))
            if failed_col:
                rows = rows.append_column(failed_col, pa.array(np.isin(np.arange(len(rows)), failed)))
            yield from rows.combine_chunks().to_batches()

    schema = StructType([f for f in df.schema if f.name not in (out, failed_col)] + [StructField(out, ArrayType(FloatType()))] + ([StructField(failed_col, BooleanType())] if failed_col else []))
    return df.drop(out, *([failed_col] if failed_col else [])).mapInArrow(run, schema)


def is_valid_vector(vector: Column, dim: int) -> Column:
    """Of the right length and not all (nearly) zero. Cosine with a zero vector is NaN, which compares as the largest number."""
    return F.coalesce((F.size(vector) == dim) & F.exists(vector, lambda x: F.abs(x) >= TINY), F.lit(False))


def valid_vectors(df: DataFrame, dim: int, col: str = "embedding") -> DataFrame:
    return df.where(is_valid_vector(F.col(col), dim))
