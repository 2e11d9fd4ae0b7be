"""Near-duplicate documents by MinHash and a multi-index Hamming join.

1. A document's signature has `chunks` x `width` symbols of 16 bits, each from the least value of one hash function over its set of
   distinct 5-word shingles. Documents with one and the same set are represented by one of them.
2. The signature is split into chunks. If two signatures differ in at most chunks * (errors + 1) - 1 symbols, some chunk has at most
   `errors` of them (pigeonhole). Every choice of `errors` positions to leave out of a chunk is enumerated, and what stays is an
   index key: all pairs within that distance meet under some key. At the default 10 x 4 symbols with 1 error that is distance 19
   of 40; a pair at similarity 0.75 shares no key with probability (1 - 0.738)^10, under 2 in a million.
3. Of each key's documents one is the hub. Each document is confirmed first against the hub it shares most keys with; components of
   these links are taken, and then only pairs under a common key that still lie in different components are looked at. They are
   met in blocks, whatever the key's size. A pair is set aside if its distance over the whole signature of `symbols` positions is
   over five standard deviations beyond what similarity 0.75 gives (3 pairs in ten million at that limit). What is left ties the
   documents into groups, and inside a group, again in blocks, all such pairs are confirmed on the full shingle sets from the texts.
   Tasks send on spanning forests of links, never all pairs.

Documents whose words are the same throughout (by SHA-256 of the whole sequence) have one set; other copies of a set, found by a 128-bit
hash of it, are confirmed on the full sets as all links are. Shingles are told apart by 64-bit hashes of their words' 64-bit hashes. Keys,
hubs and sets that over a thousandth of all rows share are dealt to several tasks; where texts meet, adaptive execution splits partitions.

Everything but (1) and the set comparison is DataFrame code. Nulls: a null text is empty; a null doc_id is never linked, and its row
is returned with component_id null and kept true. Rows that repeat a doc_id are documents of their own (the rows are numbered then, in a
work table); component_id is the smallest doc_id reached. Texts of any length are used whole; blocks are cut smaller where texts are long.
Pairs at the threshold are linked. Empty tables give no rows. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import block_pairs, dealt_join, groups, hot_keys, mix64, numbered, save, shingle_sets, work_dir
from .graph import connected_components

SIGNATURE = "doc_id long, n_shingles long, h1 long, h2 long, words binary, keys array<long>, signature binary"
BLOCK, BLOCK_BYTES = 512, 16 << 20


def signatures(docs: DataFrame, chunks: int = 10, width: int = 4, errors: int = 1, shingle: int = 5, symbols: int = 256, seed: int = 7) -> DataFrame:
    """(doc_id, n_shingles, 128-bit set hash, digest of the words, index keys, a byte of each of the signature's symbols) of every row of docs (doc_id, text)."""
    n_index = chunks * width
    k = max(symbols, n_index)
    rng = np.random.default_rng(seed)
    odd = rng.integers(0, 1 << 31, k, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    add = rng.integers(0, 1 << 32, k, dtype=np.uint32)
    kept = [list(c) for c in combinations(range(width), width - errors)]

    def keys(low: np.ndarray) -> np.ndarray:
        at = (low[:n_index] >> np.uint64(48)).reshape(chunks, width)
        out = np.zeros((chunks, len(kept)), np.uint64)
        for j, c in enumerate(kept):
            key = np.arange(chunks, dtype=np.uint64) * np.uint64(len(kept)) + np.uint64(j + 1)
            for p in c:
                key = mix64(key * np.uint64(65599) + at[:, p])
            out[:, j] = key
        return out.ravel().view(np.int64)

    def least(s: np.ndarray, room: np.ndarray) -> np.ndarray:
        """The least of each hash function (of 32 bits) over a set of shingle hashes."""
        low = np.full(k, np.iinfo(np.uint32).max, np.uint32)
        x = (s >> np.uint64(32)).astype(np.uint32)
        for a in range(0, len(x), len(room)):
            part = x[a : a + len(room)]
            table = room[: len(part)]
            np.multiply(part[:, None], odd, out=table)
            np.add(table, add, out=table)
            np.minimum(low, table.min(axis=0), out=low)
        return low

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        room = np.empty((512, k), np.uint32)  # used again for each set: new memory costs more than the hashes
        for batch in batches:
            n = len(batch)
            counts, h = np.zeros(n, np.int64), np.zeros((2, n), np.uint64)
            found, size, signs = [], np.zeros(n + 1, np.int32), [b""] * n
            words: list[bytes] = []
            for i, s in shingle_sets(batch.column(1), shingle, words):
                counts[i] = len(s)
                if not len(s):
                    continue
                h[0, i], h[1, i] = np.add.reduce(s), np.add.reduce(mix64(s + np.uint64(0x5851F42D4C957F2D)))
                low = mix64(least(s, room).astype(np.uint64) + np.uint64(1))
                signs[i] = (low >> np.uint64(40)).astype(np.uint8).tobytes()
                found.append(keys(low))
                size[i + 1] = len(found[-1])
            flat = np.concatenate(found) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts), pa.array(h[0].view(np.int64)), pa.array(h[1].view(np.int64)), pa.array(words, pa.binary()), pa.ListArray.from_arrays(pa.array(np.cumsum(size, dtype=np.int32)), pa.array(flat)), pa.array(signs, pa.binary())],
                names=["doc_id", "n_shingles", "h1", "h2", "words", "keys", "signature"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SIGNATURE)


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int = 75, shingle: int = 5) -> DataFrame:
    """Of pairs (a, b), a written table, those with 100 * |A and B| >= percent * |A or B| on the full shingle sets of texts (doc_id, text).

    A text that over a thousandth of all pairs have as their a is dealt to several tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, None
        for batch in batches:
            ids = batch.column(0).to_pylist()
            keep = np.zeros(len(batch), bool)
            first: dict[int, np.ndarray] = {}
            new = [i for i, a in enumerate(ids) if a != (ids[i - 1] if i else last)]
            for j, s in shingle_sets(batch.column(2).take(pa.array(new, pa.int64())), shingle):
                first[new[j]] = s
            for i, s in shingle_sets(batch.column(3), shingle):
                left = first.pop(i, left)
                both = len(s) if np.array_equal(left, s) else len(left) + len(s) - len(np.unique(np.concatenate([left, s])))
                keep[i] = both > 0 and 100 * both >= percent * (len(left) + len(s) - both)
            last = ids[-1] if ids else last
            yield batch.select([0, 1]).filter(pa.array(keep))

    a = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    b = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    hot = hot_keys(pairs.groupBy("a").agg(F.count("*").alias("n")), ["a"], pairs.count())
    return dealt_join(pairs.join(b, "b"), a, ["a"], "b", hot).select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _near(signs: np.ndarray, c: np.ndarray, side: np.ndarray, most: float) -> Iterator[tuple[int, np.ndarray]]:
    """Row numbers (i, js) of a block pair whose c differs and whose signatures are within `most` symbols."""
    apart = bool(side.any())
    for i in np.flatnonzero(side == 0):
        js = np.flatnonzero((side == 1) & (c != c[i])) if apart else i + 1 + np.flatnonzero(c[i + 1 :] != c[i])
        js = js[(signs[js] != signs[i]).sum(axis=1) <= most]
        if len(js):
            yield i, js


def _forest(n: int, hits: Iterator[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links (i, js) among n rows, as stars around each tree's first row."""
    tree = np.arange(n)
    for i, js in hits:
        roots = np.unique(np.append(tree[js], tree[i]))
        if len(roots) > 1:
            tree[np.isin(tree, roots)] = roots[0]
    rest = np.flatnonzero(tree != np.arange(n))
    return tree[rest], rest


def crossing(rows: DataFrame, by: str, percent: int, symbols: int, shingle: int = 0) -> DataFrame:
    """Links (a, b) between rows (`by`, doc_id, c, signature) with the same `by`, other c and signatures near enough, reduced to forests.

    With `shingle`, rows have text too, and only pairs that are similar enough on their full shingle sets count.
    """
    p = 1 - percent / 100
    most = symbols * p + 5 * (symbols * p * (1 - p)) ** 0.5

    def exact(g: pa.Table, hits: list[tuple[int, np.ndarray]]) -> Iterator[tuple[int, np.ndarray]]:
        need = np.unique(np.concatenate([np.zeros(0, np.int64), *(np.append(js, i) for i, js in hits)]))
        sets, at = {}, 0
        for part in g.column("text").take(pa.array(need)).chunks:
            sets.update((int(need[at + i]), s) for i, s in shingle_sets(part, shingle))
            at += len(part)
        for i, js in hits:
            both = np.array([len(sets[i]) + len(sets[j]) - len(np.unique(np.concatenate([sets[i], sets[j]]))) for j in js])
            total = len(sets[i]) + np.array([len(sets[j]) for j in js]) - both
            if (good := 100 * both >= percent * total).any():
                yield i, js[good]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, [by, "lo", "hi"]):
            ids, c, side = (g.column(x).to_numpy() for x in ("doc_id", "c", "side"))
            signs = np.frombuffer(b"".join(g.column("signature").to_pylist()), np.uint8).reshape(len(ids), -1)
            hits = _near(signs, c, side, most)
            i, j = _forest(len(ids), exact(g, list(hits)) if shingle else hits)
            yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[j])], names=["a", "b"])

    weight = F.octet_length("text") if shingle else None
    return block_pairs(rows, [by], "doc_id", BLOCK, weight, BLOCK_BYTES).mapInArrow(run, "a long, b long")


def linked(texts: DataFrame, work: str, percent: int, shingle: int, chunks: int, width: int, errors: int, symbols: int) -> DataFrame:
    """texts (doc_id, text), each doc_id once and none null -> doc_id, n_shingles, component (null for a document without links)."""
    every = save(signatures(texts, chunks, width, errors, shingle, symbols), f"{work}/signatures")
    filled = every.where("n_shingles > 0")

    # documents with the same words, and with the same set: one representative; hot groups shrink before the shuffle
    total = every.count()
    same = ["h1", "h2", "n_shingles"]
    texts_of = save(filled.groupBy(*same, "words").agg(F.min("doc_id").alias("one"), F.count("*").alias("n")), f"{work}/words")
    copies = dealt_join(filled.select("words", *same, "doc_id"), texts_of.where("n > 1").drop("n"), [*same, "words"], "doc_id", hot_keys(texts_of, [*same, "words"], total))
    copies = copies.where("doc_id <> one").select(F.col("one").alias("a"), F.col("doc_id").alias("b"))
    reps = save(texts_of.groupBy(*same).agg(F.min("one").alias("rep"), F.count("*").alias("n")), f"{work}/sets")
    others = dealt_join(texts_of.select(*same, "one"), reps.where("n > 1").drop("n"), same, "one", hot_keys(reps, same, total))
    others = others.where("one <> rep").select(F.col("rep").alias("a"), F.col("one").alias("b"))

    # the index: keys that several representatives have, with the least of them as hub
    index = filled.join(reps.select("rep"), F.col("doc_id") == F.col("rep"), "left_semi").select("doc_id", F.explode(F.array_distinct("keys")).alias("key"))
    hubs = save(index.groupBy("key").agg(F.min("doc_id").alias("hub"), F.count("*").alias("n")).where("n > 1"), f"{work}/hubs")
    hot = hot_keys(hubs, ["key"], hubs.agg(F.sum("n")).first()[0] or 0)
    members = save(dealt_join(index, hubs.drop("n"), ["key"], "doc_id", hot), f"{work}/members")
    star = members.where("doc_id <> hub").groupBy("hub", "doc_id").count()
    best = star.groupBy("doc_id").agg(F.max(F.struct("count", F.negative("hub"))).alias("m")).select(F.negative(F.col("m.col2")).alias("a"), F.col("doc_id").alias("b"))
    links = save(confirmed(save(best.union(others), f"{work}/pairs"), texts, percent, shingle), f"{work}/links")
    part = save(connected_components(links, f"{work}/parts"), f"{work}/part")

    # what is left: pairs under one key that lie in different components
    placed = members.join(part, members.doc_id == part.id, "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("c"))
    mixed = placed.groupBy("key").agg(F.min("c").alias("from_c"), F.max("c").alias("to_c")).where("from_c <> to_c").select("key")
    signs = filled.select("doc_id", "signature")
    open_ = save(dealt_join(placed, mixed, ["key"], "doc_id", hot).join(signs, "doc_id"), f"{work}/open")
    close = connected_components(crossing(open_, "key", percent, symbols), f"{work}/close")
    close = close.select(F.col("id").alias("doc_id"), F.col("component").alias("g")).join(open_.select("doc_id", "c", "signature").dropDuplicates(["doc_id"]), "doc_id")
    more = save(crossing(close.join(texts, "doc_id"), "g", percent, symbols, shingle), f"{work}/more")

    ends = connected_components(copies.union(links).union(more), f"{work}/ends")
    return every.join(ends, every.doc_id == ends.id, "left").select("doc_id", "n_shingles", "component")


def near_duplicates(docs: DataFrame, percent: int = 75, shingle: int = 5, chunks: int = 10, width: int = 4, errors: int = 1, symbols: int = 256) -> DataFrame:
    """docs (doc_id, text) -> one row per row of docs: doc_id, n_shingles, component_id, kept."""
    work = work_dir(docs.sparkSession, "minhash")
    options = (percent, shingle, chunks, width, errors, symbols)
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    named = every.where("doc_id is not null")
    alone = signatures(every.where("doc_id is null"), chunks, width, errors, shingle, symbols).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    if named.groupBy("doc_id").count().where("count > 1").isEmpty():
        out = linked(named, work, *options).select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    else:
        rows = numbered(named.withColumnRenamed("doc_id", "id"), f"{work}/rows", "doc_id")
        parts = save(linked(rows, work, *options).join(rows.select("doc_id", "id"), "doc_id"), f"{work}/numbered")
        tied = parts.where("component is not null")
        least = tied.groupBy("component").agg(F.min("id").alias("least"), F.count("*").alias("n"))
        tied = dealt_join(tied, least.drop("n"), ["component"], "doc_id", hot_keys(least, ["component"], parts.count())).select("id", "n_shingles", "least")
        out = tied.union(parts.where("component is null").select("id", "n_shingles", "id")).toDF("doc_id", "n_shingles", "component_id")
    return out.union(alone).withColumn("kept", F.col("component_id").eqNullSafe(F.col("doc_id")))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
