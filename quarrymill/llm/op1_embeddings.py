"""Near-duplicate embeddings by randomised-rotation binary codes.

1. A vector is turned by a seeded random rotation. The signs are its code; the code is stored with its correction factor f, the inner
   product of the unit vector and its code's unit vector, and with the turned vector itself in 4 bits a number, dithered, as a query.
   For another vector q, <code of o, q> / f is an unbiased estimate of <o, q>; its error stays within
   e * sqrt((1 - <o, q>^2) (1 - f^2) / (f^2 (d - 1))) but for a probability that falls as exp(-c e^2).
2. Bands of signs of other rotations are bucket keys. Band width is such that buckets hold about `group` vectors, and the number of bands
   is the least with which a pair at the threshold shares no bucket with probability under `miss`.
3. Rows of a bucket meet in blocks, as codes, factors and small queries. Rows that have a pair whose upper bound reaches the threshold
   are marked; only their vectors travel, to the same blocks, where such pairs are recomputed exactly in double precision. A pair that met
   in an earlier band is dropped before that. Tasks send on marks, counts and spanning forests, never pairs.

Vectors that are equal number by number (by a 128-bit hash) are first represented by one of them. Nulls: a null vec_id or a vector that is
null, empty, zero or holds null or non-finite components links with nothing; its row has n_links 0, component_id = vec_id and kept true.
Vectors of other lengths never link. Rows that repeat a vec_id count as vectors of their own. Ties at the threshold link. Vectors of any
length are used whole. Empty tables give no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import groups, mix64, save, spread_join, work_dir
from .graph import connected_components

GROUP, TILE = 4096, 512
#: Two for each band: a vector's length times TAGS, plus twice the band, plus 1 in a second block, is a row's tag.
TAGS = 8192


class Rotations:
    """Seeded random rotations: one for the codes, others for `bands` keys of `width` signs; the code's dither."""

    def __init__(self, dim: int, width: int, bands: int, seed: int):
        rng = np.random.default_rng([seed, dim])
        self.width, self.bands, self.dim = width, bands, dim
        self.turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        self.dither = rng.random(dim).astype(np.float32)
        self.others = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(math.ceil(width * bands / dim))]

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """A bucket key for each band, (n, bands): no two bands, lengths or signs give the same."""
        signs = np.concatenate([unit @ t.T > 0 for t in self.others], axis=1)
        out = np.zeros((len(unit), self.bands), np.uint64)
        for i in range(self.width):
            out = (out << np.uint64(1)) | signs[:, i : self.width * self.bands : self.width]
        return mix64(out + (np.arange(self.bands, dtype=np.uint64) << np.uint64(32)) + np.uint64(self.dim << 44))

    def pack(self, t: np.ndarray, factor: np.ndarray) -> np.ndarray:
        """Bytes of each turned vector: code, query in 4 bits a number, its step, the factor."""
        step = (2 * np.abs(t).max(axis=1) / 14).astype(np.float32)
        level = np.clip(np.floor(t / step[:, None] + self.dither).astype(np.int64) + 8, 0, 15).astype(np.uint8)
        level = np.pad(level, ((0, 0), (0, self.dim % 2)))
        tail = np.column_stack([step, factor.astype(np.float32)]).view(np.uint8)
        return np.concatenate([np.packbits(t > 0, axis=1), level[:, ::2] << 4 | level[:, 1::2], tail], axis=1)

    def unpack(self, packed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Signs, queries, steps and factors."""
        code = math.ceil(self.dim / 8)
        signs = np.unpackbits(packed[:, :code], axis=1)[:, : self.dim].astype(np.float32) * 2 - 1
        both = packed[:, code:-8]
        step, factor = np.ascontiguousarray(packed[:, -8:]).view(np.float32).T
        level = np.stack([both >> 4, both & 15], axis=2).reshape(len(packed), -1)[:, : self.dim].astype(np.float32)
        return signs, (level - np.float32(7.5) - self.dither) * step[:, None], step, factor


def normed(x: np.ndarray) -> np.ndarray:
    unit = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the norm
    return unit / np.linalg.norm(unit, axis=1, keepdims=True)


def fixed(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """(rows, bytes) of a binary column whose values have one length."""
    parts = []
    for c in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        at = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]
        parts.append(np.frombuffer(c.buffers()[2], np.uint8)[at[0] : at[-1]])
    return np.concatenate(parts).reshape(len(column), -1)


def by_length(width: int, bands: int, seed: int):
    """A function from a length to its rotations, made once in a task."""
    known: dict[int, Rotations] = {}

    def of(dim: int) -> Rotations:
        if dim not in known:
            known[dim] = Rotations(dim, width, bands, seed)
        return known[dim]

    return of


def codes(rows: DataFrame, width: int, bands: int, seed: int, kind: str) -> DataFrame:
    """rows (r, vec_id, h1, h2, embedding) of valid vectors -> r, vec_id, h1, h2, dim, vec (numbers of `kind`), packed, keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = by_length(width, bands, seed)
        for batch in batches:
            lists = batch.column(4)
            sizes = np.diff(lists.offsets.to_numpy())
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                x = lists.take(pa.array(at)).flatten().to_numpy().reshape(len(at), dim)
                unit = normed(x)
                r = of(int(dim))
                t = unit @ r.turn.T
                packed = r.pack(t, np.abs(t).sum(axis=1) / math.sqrt(dim))
                keys = r.keys(unit).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(k).take(pa.array(at)) for k in range(4)),
                        pa.array(np.full(len(at), dim, np.int32)),
                        pa.array([v.tobytes() for v in x.astype(kind)], pa.binary()),
                        pa.array([c.tobytes() for c in packed], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.ravel())),
                    ],
                    names=["r", "vec_id", "h1", "h2", "dim", "vec", "packed", "keys"],
                )

    return rows.mapInArrow(run, "r long, vec_id long, h1 long, h2 long, dim int, vec binary, packed binary, keys array<long>")


def slots(rows: DataFrame, most: int) -> DataFrame:
    """rows (cls, dim, band, bucket, ...) -> slot, tag and the rest: all pairs of a bucket meet in some slot, however large it is.

    A bucket of more than `most` rows is cut into blocks, and each pair of blocks has a slot.
    """
    sizes = rows.groupBy("bucket").agg(F.ceil(F.count("*") / most).cast("int").alias("blocks")).where("blocks > 1")
    out = rows.join(sizes, "bucket", "left")
    own = F.pmod(F.xxhash64("cls", F.lit(11)), F.col("blocks")).cast("int")
    other = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
    out = out.withColumn("own", own).withColumn("other", other)
    slot = F.when(F.col("blocks").isNull(), F.col("bucket")).otherwise(F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")))
    second = F.coalesce((F.col("own") > F.col("other")).cast("int"), F.lit(0))
    return out.select(slot.alias("slot"), (F.col("dim") * TAGS + F.col("band") * 2 + second).alias("tag"), *[c for c in rows.columns if c not in ("band", "bucket", "dim")])


def tiles(tag: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Row numbers (first, second) whose pairs are all of a slot's pairs; True where second begins with first itself."""
    low, high = np.flatnonzero(tag & 1 == 0), np.flatnonzero(tag & 1)
    for a in range(0, len(low), TILE):
        yield (low[a : a + TILE], high, False) if len(high) else (low[a : a + TILE], low[a:], True)


def hopeful(turned: np.ndarray, step: np.ndarray | float, signs: np.ndarray, factor: np.ndarray, threshold: float, sure: float, own: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, code) whose estimate's upper bound reaches the threshold. The bound is that of a pair at the threshold: closer ones err less."""
    dim = signs.shape[1]
    spread = np.sqrt((1 - np.minimum(factor, 1) ** 2) / max(dim - 1, 1) * (1 - threshold**2) + np.max(step, initial=0) ** 2 / 12)
    least = (math.sqrt(dim) * (threshold * factor - sure * spread - 1e-5)).astype(np.float32)
    hit = turned.astype(np.float32) @ signs.T >= least
    if own:
        np.fill_diagonal(hit, False)
    return np.nonzero(hit)


def marks(rows: DataFrame, width: int, bands: int, seed: int, threshold: float, sure: float) -> DataFrame:
    """rows (slot, tag, cls, packed) in order -> (slot, tag, cls) of those with a pair that the estimate can't set aside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = by_length(width, bands, seed)
        for g in groups(batches, ["slot"]):
            if len(g) < 2:
                continue
            tag = g.column("tag").to_numpy()
            signs, query, step, factor = of(int(tag[0]) // TAGS).unpack(fixed(g.column("packed")))
            found = np.zeros(len(g), bool)
            for first, second, own in tiles(tag):
                i, j = hopeful(query[first], step[first], signs[second], factor[second], threshold, sure, own)
                found[first[i]] = found[second[j]] = True
            if found.any():
                yield from g.select(["slot", "tag", "cls"]).filter(pa.array(found)).to_batches()

    return rows.mapInArrow(run, "slot long, tag int, cls long")


def block_links(rows: DataFrame, width: int, bands: int, seed: int, threshold: float, sure: float, kind: str) -> DataFrame:
    """rows (slot, tag, cls, n, vec) in order -> (cls, links, other): link counts, and forest edges cls-other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = by_length(width, bands, seed)
        for g in groups(batches, ["slot"]):
            if len(g) < 2:
                continue
            unit, tag = normed(fixed(g.column("vec")).view(kind).astype(np.float64)), g.column("tag").to_numpy()
            r = of(unit.shape[1])
            cls, n = g.column("cls").to_numpy(), g.column("n").to_numpy()
            t = unit @ r.turn.T
            signs, factor = np.where(t > 0, np.float32(1), np.float32(-1)), np.abs(t).sum(axis=1) / math.sqrt(r.dim)
            keys = r.keys(unit)[:, : tag[0] % TAGS >> 1]
            count, tree = np.zeros(len(unit), np.int64), np.arange(len(unit))
            for first, second, own in tiles(tag):
                i, j = hopeful(t[first], 0.0, signs[second], factor[second], threshold, sure, own)
                i, j = first[i], second[j]
                if own:  # either direction of a pair may be hopeful; it counts once
                    i, j = np.divmod(np.unique(np.minimum(i, j) * len(unit) + np.maximum(i, j)), len(unit))
                for b in range(keys.shape[1]):  # pairs that met in an earlier band
                    new = keys[i, b] != keys[j, b]
                    i, j = i[new], j[new]
                good = np.concatenate([np.einsum("ij,ij->i", unit[i[a : a + (1 << 16)]], unit[j[a : a + (1 << 16)]]) for a in range(0, len(i), 1 << 16)] or [np.zeros(0)]) >= threshold
                i, j = i[good], j[good]
                if not len(i):
                    continue
                np.add.at(count, i, n[j])
                np.add.at(count, j, n[i])
                while True:  # every row takes the least label among its links
                    new = tree.copy()
                    np.minimum.at(new, i, tree[j])
                    np.minimum.at(new, j, tree[i])
                    np.minimum.at(new, tree, new)
                    new = new[new]
                    if (new == tree).all():
                        break
                    tree = new
            rest, seen = np.flatnonzero(tree != np.arange(len(tree))), np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([cls[seen], cls[rest]])), pa.array(np.concatenate([count[seen], np.zeros(len(rest), np.int64)])), pa.array([None] * len(seen) + cls[tree[rest]].tolist(), pa.int64())],
                names=["cls", "links", "other"],
            )

    return rows.mapInArrow(run, "cls long, links long, other long")


def near_duplicate_vectors(table: DataFrame, threshold: float = 0.95, miss: float = 1e-5, sure: float = 4.0, seed: int = 1, group: int = GROUP, block: int | None = None) -> DataFrame:
    """table (vec_id, embedding) -> one row per row: vec_id, n_links, component_id, kept. `block` rows at most are met at once; unset, it is 32 MB of them."""
    work = work_dir(table.sparkSession, "embeddings")
    kind = "<f4" if table.schema["embedding"].dataType == ArrayType(FloatType(), table.schema["embedding"].dataType.containsNull) else "<f8"
    every = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    valid = F.coalesce(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & finite & F.exists("embedding", lambda v: v != 0), F.lit(False))
    n, longest = every.where(valid).agg(F.count("*"), F.max(F.size("embedding"))).first()
    same = 1 - math.acos(threshold) / math.pi
    width = min(32, max(1, math.ceil(math.log2(max(n, 2) / group))))
    bands = math.ceil(math.log(miss) / math.log(1 - same**width))
    if 2 * bands > TAGS:
        raise ValueError(f"{bands} bands: raise group or miss")
    most = block or max(256, min(GROUP, (1 << 22) // (longest or 1)))

    rows = every.where(valid).select(F.monotonically_increasing_id().alias("r"), "vec_id", F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2"), "embedding")
    coded = save(codes(rows, width, bands, seed, kind), f"{work}/codes")
    classes = save(coded.groupBy("h1", "h2").agg(F.min("r").alias("cls"), F.min("vec_id").alias("rep"), F.count("*").alias("n")), f"{work}/classes")
    members = save(spread_join(coded.select("vec_id", "h1", "h2", "r"), classes, ["h1", "h2"], "r").select("vec_id", "cls", "n"), f"{work}/members")

    own = classes.select(F.col("cls").alias("r"), "n")
    index = coded.select("r", "dim", "packed", "keys").join(own.select("r"), "r", "left_semi").select(F.col("r").alias("cls"), "dim", "packed", F.posexplode("keys").alias("band", "bucket"))
    met = slots(index, most).repartition("slot").sortWithinPartitions("slot", "tag")
    marked = save(marks(met, width, bands, seed, threshold, sure), f"{work}/marked")
    vectors = coded.select("r", "vec").join(own, "r").select(F.col("r").alias("cls"), "n", "vec")
    again = marked.join(vectors, "cls").select("slot", "tag", "cls", "n", "vec").repartition("slot").sortWithinPartitions("slot", "tag")
    found = save(block_links(again, width, bands, seed, threshold, sure, kind), f"{work}/links")

    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    edges = found.where("other is not null").select(F.col("cls").alias("a"), F.col("other").alias("b"))
    parts = save(connected_components(edges, f"{work}/parts").withColumnRenamed("id", "cls"), f"{work}/part")
    least = parts.join(classes.select("cls", "rep"), "cls").groupBy("component").agg(F.min("rep").alias("least"))
    least = spread_join(parts, least, ["component"], "cls").select("cls", "least")
    of_class = classes.select("cls", "rep").join(links, "cls", "left").join(least, "cls", "left").select("cls", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("least", "rep").alias("component_id"))
    linked = spread_join(members, of_class, ["cls"], "vec_id").select("vec_id", (F.col("links") + F.col("n") - 1).alias("n_links"), "component_id")
    alone = every.where(~valid).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("component_id").eqNullSafe(F.col("vec_id")))


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
