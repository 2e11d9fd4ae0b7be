"""Quality scores by Bradley-Terry ranking.

A text's features are the shares of its pairs of neighbouring character classes (lower and upper case, digits, each punctuation
mark, spaces, line ends, other bytes) and of words that repeat the one or two words before, square-rooted and standardised: whole texts,
any language, a fixed number of features. A text of n bytes counts for n / (n + 50) of its distance from the mean, as the shares of a short
one say little. All labelled rows are learned from: they are dealt by hash to blocks of about `sample` rows of each label (the scarcer label's
groups come again in several blocks). In the task of a block preference pairs (good over bad) are drawn, several for each row on average, and
weights are learned by logistic loss on the feature differences: P(a over b) = sigmoid(w . (x_a - x_b)). The model is the mean of the blocks'
weights and mean texts. The threshold is the exact quantile of all labelled rows' scores at the share of label 0, found by counts of the
scores' leading bits. score = sigmoid(w . (x - mean) - threshold).

The labels' counts, two rows of features a block and counts of scores reach the driver. Empty and null texts are scored as the mean text, texts of any length
whole. Where a label has no training row (as in an empty table) nothing can be learned: every score is 0.5 and nothing is rejected. A doc_id
with several labels counts with the largest; of a doc_id with several texts the greatest is learned from. Rows that repeat are scored alike.
Scores that tie at the quantile are the threshold, so that all of them are accepted. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_batches, save, spread_join, word_hashes, work_dir
from .op6_language import held_out

_CLASS = np.full(256, 1, np.uint16)
_CLASS[:128] = 0
_CLASS[[9, 10, 11, 12, 13, 32]] = [2, 3, 2, 2, 2, 4]
_CLASS[48:58] = 5
_CLASS[65:91] = 6
_CLASS[97:123] = 7
_MARKS = [c for c in range(33, 127) if not chr(c).isalnum()]
_CLASS[_MARKS] = np.arange(8, 8 + len(_MARKS))
CLASSES = 8 + len(_MARKS)


PAIRS = CLASSES**2
SHORT = 50
_REST = np.int64(2**63 - 1)


def features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slice by slice (rows, PAIRS + 2) square roots of shares, and what part of its distance from the mean each row counts for."""
    for _, data, offsets in byte_batches(column, 1 << 20, 512):
        n = len(offsets) - 1
        kind = _CLASS[data].astype(np.int64)
        rows = np.repeat(np.arange(n), np.diff(offsets))
        inside = rows[1:] == rows[:-1]
        at = (rows[1:] * CLASSES + kind[:-1]) * CLASSES + kind[1:]
        pairs = np.bincount(at[inside], minlength=n * PAIRS).reshape(n, PAIRS)
        words, limits = word_hashes(data, offsets, lower=False)
        owner = np.repeat(np.arange(n), np.diff(limits))
        again = [np.bincount(owner[k:][(words[k:] == words[:-k]) & (owner[k:] == owner[:-k])], minlength=n) for k in (1, 2)]
        counts = np.column_stack([pairs / np.maximum(pairs.sum(axis=1, keepdims=True), 1), *(a / np.maximum(np.diff(limits), 1) for a in again)])
        yield np.sqrt(counts).astype(np.float32), np.diff(offsets) / (np.diff(offsets) + SHORT)


def bradley_terry(x: np.ndarray, y: np.ndarray, pairs: int, seed: int, decay: float = 1e-3, steps: int = 300, rate: float = 0.05) -> np.ndarray:
    """Weights from preference pairs of rows labelled 1 over rows labelled 0, by Adam on the mean logistic loss."""
    rng = np.random.default_rng(seed)
    good, bad = rng.choice(np.flatnonzero(y == 1), pairs), rng.choice(np.flatnonzero(y == 0), pairs)
    w = np.zeros(x.shape[1], np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        s = x @ w
        lost = 1 / (1 + np.exp(np.clip(s[good] - s[bad], -50, 50)))
        by_row = np.bincount(bad, lost, len(x)) - np.bincount(good, lost, len(x))
        g = x.T @ by_row.astype(np.float32) / np.float32(pairs) + np.float32(decay) * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= (rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return w.astype(np.float64)


def weighted_quantile(s: np.ndarray, weight: np.ndarray, share: float) -> float:
    """The middle of the gap at which `share` of the weight lies below."""
    order = np.argsort(s)
    s, c = s[order], np.cumsum(weight[order]) / weight.sum()
    k = int(np.searchsorted(c, share - 1e-9))
    return float(s[k] + s[min(k + 1, len(s) - 1)]) / 2


def blocks(known: DataFrame, counts: dict[int, int], sample: int, seed: int) -> DataFrame:
    """known (doc_id, quality) with a column block: each label's rows are dealt by hash to groups of about `sample`, and the groups of the label
    with fewer of them come again until each of the other's has met one.
    """
    n = {q: -(-counts[q] // sample) for q in (0, 1)}
    most = max(n.values())
    group = F.when(F.col("quality") == 1, F.lit(n[1])).otherwise(F.lit(n[0]))
    own = F.pmod(F.xxhash64("doc_id", F.lit(seed)), group).cast("int")
    return known.withColumn("block", F.explode(F.sequence(own, F.lit(most - 1), group)))


def learner(pairs: int, seed: int):
    """A function over batches (block, quality, text), sorted by block -> (block, weights on features, mean text) of each block with both labels."""

    def learn(block: int, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        y = np.concatenate([q for q, _, _ in parts])
        if y.min() == y.max():
            return
        part = np.concatenate([w for _, _, w in parts]).astype(np.float32)
        x, at = np.empty((len(y), parts[0][1].shape[1]), np.float32), len(y)
        while parts:  # from the last, so that the memory of a part is free before the next one's is filled
            at -= len(f := parts.pop()[1])
            x[at : at + len(f)] = f
            del f
        mean = x.mean(axis=0, dtype=np.float64).astype(np.float32)
        x -= mean
        x *= part[:, None]
        spread = np.sqrt(np.einsum("ij,ij->j", x, x, dtype=np.float64) / len(x) - x.mean(axis=0, dtype=np.float64) ** 2).astype(np.float32) + np.float32(0.02)
        x /= spread
        w = bradley_terry(x, y, pairs, seed) / spread
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([w.astype(np.float64).tobytes()], pa.binary()), pa.array([mean.astype(np.float64).tobytes()], pa.binary())], names=["block", "w", "mean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in batches:
            of, y, at = batch.column(0).to_numpy(), batch.column(1).to_numpy(), 0
            cuts = np.append(np.flatnonzero(np.append(True, of[1:] != of[:-1])), len(of)) if len(of) else []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if parts and of[a] != now:
                    yield from learn(now, parts)
                    parts = []
                now, at = int(of[a]), a
                for x, weight in features(batch.column(2).slice(a, b - a)):
                    parts.append((y[at : at + len(x)], x, weight))
                    at += len(x)
        if parts:
            yield from learn(now, parts)

    return run


def quantile(scores: DataFrame, rank: int) -> float:
    """Of scores (key: a double's bits in the order of doubles) the middle of the gap above the rank-th least, by counts of 16 bits at a time."""
    value = lambda k: float(np.int64(k ^ ((k >> 63) & _REST)).view(np.float64))
    prefix, below = 0, 0
    for shift in (48, 32, 16, 0):
        inside = scores if shift == 48 else scores.where(F.shiftright("key", shift + 16) == prefix)
        for r in sorted(inside.groupBy(F.shiftright("key", shift).alias("k")).count().collect()):
            prefix, same = r["k"], r["count"]
            if below + same >= rank:
                break
            below += same
    above = scores.where(F.col("key") > prefix).agg(F.min("key").alias("k"), F.count("*").alias("n")).first()
    # the scores that tie at the rank, up to it and from it on, and the next
    s = np.array([value(prefix), value(prefix), value(above["k"]) if above["n"] else 0.0])
    weight = np.array([rank, below + same - rank, above["n"]], np.float64)
    return weighted_quantile(s[weight > 0], weight[weight > 0], rank / weight.sum())


def train(docs: DataFrame, labels: DataFrame, sample: int = 4000, pairs: int = 60_000, seed: int = 9) -> tuple[np.ndarray, float, float] | None:
    """docs (doc_id, text), labels (doc_id, quality) -> weights, the mean text's sum and the threshold, or None where a label has no row.

    `sample`: rows of each label in a block, about; `pairs`: preference pairs of a block.
    """
    path = work_dir(docs.sparkSession, "quality")
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    texts = docs.where("doc_id is not null").select("doc_id", F.col("text").cast("string").alias("text"))
    rows = spread_join(texts, known, ["doc_id"], "text")
    rows = save(rows.groupBy("doc_id", "quality").agg(F.max("text").alias("text")), f"{path}/rows", "zstd")  # of a doc_id that repeats, one text
    counts = {0: 0, 1: 0} | {r["quality"]: r["count"] for r in rows.groupBy("quality").count().collect()}
    if not all(counts.values()):
        return None
    dealt = blocks(rows, counts, sample, seed).repartition("block").sortWithinPartitions("block", "doc_id")  # the same order in every run
    got = sorted((r["block"], bytes(r["w"]), bytes(r["mean"])) for r in dealt.select("block", "quality", "text").mapInArrow(learner(pairs, seed), "block int, w binary, mean binary").collect())
    if not got:
        return None
    w, mean = (np.mean([np.frombuffer(r[k]) for r in got], axis=0) for k in (1, 2))
    middle = float(mean @ w)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, weight in features(batch.column(0)):
                k = (weight * (x @ w - middle) + 0.0).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(k ^ ((k >> 63) & _REST))], names=["key"])

    scores = save(rows.select("text").mapInArrow(score, "key long"), f"{path}/scores")
    return w, middle, quantile(scores, counts[0])


def scorer(spark: SparkSession, model: tuple[np.ndarray, float, float] | None):
    """A column function text -> score."""
    if model is None:
        return lambda text: F.lit(0.5)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        w, middle, threshold = shared.value
        s = [weight * (x @ w - middle) - threshold for x, weight in features(column)]
        return pa.array(1 / (1 + np.exp(-np.clip(np.concatenate([np.zeros(0), *s]), -500, 500))))

    return score


def whole(text: str = "text") -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out("doc_id"))
    score = scorer(spark, train(docs, labels))
    out = docs.select("doc_id", held_out("doc_id").alias("held_out"), score(whole()).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
