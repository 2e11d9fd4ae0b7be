"""Periodic runs of words by a descending-LCP Kruskal.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) that no neighbouring word extends and that is
long enough (`long_enough`). A run that starts at s makes the suffixes at s and s + q share exactly length - q words, and no suffix between
them shares as many, for else q weren't its smallest period. So the suffixes of a text are united in classes by descending LCP, like the
edges of a minimum spanning tree: the edges are the neighbours of the suffix array with their LCP, a union-find holds the classes as
ordered sets of positions, and the smaller set goes into the larger. Positions that a union makes neighbours at a distance d within their LCP
seed a run of period d; the seed is the run where the word before doesn't extend it.

Each text is worked on alone, many texts of an Arrow batch at a time, in tasks of Spark: only texts where some five words in a row (what the
shortest run repeats) come twice get a suffix array. It is made by prefix doubling over ids of words, with numpy: after the first step only positions
that are still tied are sorted, and the classes of each step are kept for such positions only, from which LCPs follow by descending
powers of two. Memory is a small multiple of the words of `PART` bytes, or of one text where that is longer.

A null text has no words. Texts of any length are used whole. Repeated rows and null or repeated doc_ids give a row each. An empty table gives no
rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are worked on at once, unless one text is longer.
PART = 4 << 20
#: A run has so many words, and so many periods, at least. Its seed shares `LEAST - 1` words or more.
LEAST, PERIODS = 6, 4


def long_enough(length: np.ndarray, period: np.ndarray) -> np.ndarray:
    return length >= np.maximum(LEAST, PERIODS * period)


def repeated(ids: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the texts in which some n words in a row come twice (or, with a chance of about 2^-40, others that hash alike)."""
    if len(ids) <= n:
        return np.zeros(0, np.int64)
    key = text[: len(ids) - n + 1].astype(np.uint64)
    for k in range(n):
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + ids[k : len(ids) - n + 1 + k].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    whole = np.flatnonzero(text[: len(ids) - n + 1] == text[n - 1 :])
    key = key[whole]
    order = np.argsort(key, kind="stable")
    twice = key[order[1:]] == key[order[:-1]]
    return np.unique(text[whole[order[1:][twice]]])


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted order of keys, the place in it where each one's equals begin, and how many they are (both in that order)."""
    order = np.argsort(keys, kind="stable")
    first = np.append(True, keys[order[1:]] != keys[order[:-1]]) if len(keys) else np.zeros(0, bool)
    at = np.flatnonzero(first)
    size = np.diff(np.append(at, len(keys)))
    return order, np.repeat(at, size), np.repeat(size, size)


def suffix_edges(ids: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbours in the suffix array of ids that share `least` words or more: (position, position, LCP).

    ids end every text with an id of its own, so that no suffix is tied with one of another text.
    """
    n = len(ids)
    order, start, size = _numbered(ids)
    rank = np.empty(n, np.int64)
    rank[order] = start
    place = np.empty(n, np.int64)  # a suffix' place in the suffix array, once it is alone
    place[order] = start
    tied = np.sort(order[size > 1])
    levels = []  # (positions tied after 2^k words, their classes)
    step = 1
    while len(tied):
        levels.append((tied, rank[tied]))
        # a tied position has no text's end within its first `step` words, so that position + step exists
        order, start, size = _numbered(rank[tied] * (n + 1) + rank[tied + step])
        own = tied[order]
        head = np.flatnonzero(np.append(True, rank[own[1:]] != rank[own[:-1]]))  # where classes of the last step begin
        new = rank[own] + start - np.repeat(head, np.diff(np.append(head, len(own))))
        rank[own] = new
        place[own] = new
        tied = np.sort(own[size > 1])
        step *= 2
    array = np.empty(n, np.int64)
    array[place] = np.arange(n)
    # neighbours that are tied on the way, the rest share less than `least` words
    known = int(np.log2(least)) if least > 1 else 0
    if len(levels) <= known:
        none = np.zeros(0, np.int64)
        return none, none, none
    near = np.zeros(n, bool)
    near[levels[known][0]] = True
    at = np.flatnonzero(near[array[:-1]] & near[array[1:]])
    a, b = array[at], array[at + 1]
    shared = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        positions, classes = levels[k]
        i, j = (np.minimum(np.searchsorted(positions, x + shared), len(positions) - 1) for x in (a, b))
        same = (positions[i] == a + shared) & (positions[j] == b + shared) & (classes[i] == classes[j])
        shared += same.astype(np.int64) << k
    keep = shared >= least
    return a[keep], b[keep], shared[keep]


def seeds(a: np.ndarray, b: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, distance, LCP) of positions that become neighbours in a class, at a distance within the LCP that a run asks for."""
    found: list[tuple[int, int, int]] = []
    nodes = np.unique(np.concatenate([a, b]))
    parent = list(range(len(nodes)))
    members = [[p] for p in nodes.tolist()]
    order = np.argsort(-shared, kind="stable")
    for x, y, lcp in zip(np.searchsorted(nodes, a[order]).tolist(), np.searchsorted(nodes, b[order]).tolist(), shared[order].tolist(), strict=True):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        while parent[y] != y:
            parent[y] = parent[parent[y]]
            y = parent[y]
        if len(members[x]) < len(members[y]):
            x, y = y, x
        small, large = members[y], members[x]
        parent[y] = x
        members[y] = []
        for p in small:
            insort(large, p)
        most = min(lcp // (PERIODS - 1), lcp)
        for p in small:
            i = bisect_left(large, p)
            if i and p - large[i - 1] <= most:
                found.append((large[i - 1], p - large[i - 1], lcp))
            if i + 1 < len(large) and large[i + 1] - p <= most:
                found.append((p, large[i + 1] - p, lcp))
    return tuple(np.array(found, np.int64).reshape(-1, 3).T)


def _first(order: np.ndarray, columns: tuple, keys: tuple) -> list[np.ndarray]:
    """Of columns in this order the first row of each run of equal keys."""
    once = np.append(True, np.any([k[order[1:]] != k[order[:-1]] for k in keys], axis=0)) if len(order) else np.zeros(0, bool)
    return [c[order[once]] for c in columns]


def runs(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs in ids, texts that each end with an id of their own; in order of start, then period."""
    start, period, shared = seeds(*suffix_edges(ids, LEAST - 1))
    length = period + shared
    ok = long_enough(length, period) & ((start == 0) | (ids[start - 1] != ids[start - 1 + period]))
    start, length, period = start[ok], length[ok], period[ok]
    # of one start and period the first seed had the whole LCP; those of later unions found the same positions in one set already
    start, length, period = _first(np.lexsort((-length, period, start)), (start, length, period), (start, period))
    # a stretch that was seeded before its class was whole is there with its smallest period too
    start, length, period = _first(np.lexsort((period, length, start)), (start, length, period), (start, length))
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def find_runs(texts: list[list[bytes]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The runs of each text, a list of words."""
    none = np.zeros(0, np.int64)
    out = [(none, none, none)] * len(texts)
    count = np.array([len(t) for t in texts], np.int64)
    words = pa.array([w for t in texts for w in t], pa.large_binary())
    if not len(words):
        return out
    ids = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    some = repeated(ids, np.repeat(np.arange(len(texts)), count), LEAST - 1)
    if not len(some):
        return out
    ends = np.cumsum(count)
    kinds = int(ids.max()) + 1
    joined = np.concatenate([x for i, t in enumerate(some.tolist()) for x in (ids[ends[t] - count[t] : ends[t]], np.array([kinds + i]))])
    base = np.concatenate([[0], np.cumsum(count[some] + 1)])
    start, length, period = runs(joined)
    cut = np.searchsorted(start, base)
    for i, t in enumerate(some.tolist()):
        at = slice(cut[i], cut[i + 1])
        out[t] = (start[at] - base[i], length[at], period[at])
    return out


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words as the query takes them: of one document in ten by its number's checksum, a tail is made periodic."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * -(-(n - a) // p))[: n - a]


SCHEMA = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, runs array<struct<start: bigint, length: bigint, period: bigint>>"
)


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices of PART bytes of text, or of one text."""
    size = np.cumsum([0, *(len(t) for t in (x.as_buffer() if x.is_valid else b"" for x in batch.column(1)))])
    i = 0
    while i < len(batch):
        j = max(i + 1, int(np.searchsorted(size, size[i] + PART, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def periodic_runs(docs: DataFrame, change=None) -> DataFrame:
    """docs (doc_id, text) -> SCHEMA: how many runs, the longest (ties: smallest start, then period), digests of all and of the words
    without what a run repeats, and the runs. `change(words, doc_id)` gives the words to look at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in _parts(b)):
            rows = []
            ids = part.column(0).to_pylist()
            texts = [(t or b"").split() for t in part.column(1).to_pylist()]
            if change:
                texts = [change(t, i) for t, i in zip(texts, ids, strict=True)]
            for i, words, (start, length, period) in zip(ids, texts, find_runs(texts), strict=True):
                top = [None] * 4
                if len(start):
                    k = np.lexsort((period, start, -length))[0]
                    top = [int(start[k]), int(length[k]), int(period[k]), int(1000 * length[k] // period[k])]
                    depth = np.zeros(len(words) + 1, np.int64)
                    np.add.at(depth, start + period, 1)
                    np.add.at(depth, start + length, -1)
                    kept = np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()
                    words = [words[w] for w in kept]
                listed = "".join(f"{s},{n},{q}\n" for s, n, q in zip(start.tolist(), length.tolist(), period.tolist(), strict=True))
                all_ = [{"start": s, "length": n, "period": q} for s, n, q in zip(start.tolist(), length.tolist(), period.tolist(), strict=True)]
                rows.append((i, len(start), *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest(), all_))
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=arrow)

    names = [c.split()[0] for c in SCHEMA.split(", runs array")[0].split(", ")] + ["runs"]
    whole = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    arrow = pa.schema([(c, pa.string() if c.endswith("sha256") else pa.int64()) for c in names[:-1]] + [("runs", pa.list_(whole))])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, SCHEMA)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return periodic_runs(docs, planted).drop("runs")
