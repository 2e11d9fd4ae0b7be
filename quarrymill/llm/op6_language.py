"""Language identification by multinomial naive Bayes over hashed character n-grams.

Training counts the hashed 1- to `orders`-grams of the lower-cased texts of every labelled row. A task counts into one vector per
language and sends on only its sums, which are added up by language and bucket; the model, a log-probability matrix of languages x
2^bits, is the one thing that reaches the driver, language by language, and is broadcast. Its size is fixed by the parameters and the number
of languages, which is checked against `most_languages` (52 MB at the default limits). All languages are equally likely beforehand. A batch
of texts is scored at once: n-gram buckets in one array, gathers of 16 MB at most from the matrix, one sum for each document.

A text that is null or has no letter gets `und` and score 0. Without any labelled row (an empty table, say) every text gets `und`; of equal
posteriors the first language in order wins. Texts of any length are used whole, in slices of n-grams. Rows that repeat are scored alike;
null and repeated doc_ids are passed through. Other columns are kept, but for lang_pred and score, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh

#: Characters of a slice, and numbers that a gather from the model gives.
SLICE, GATHER = 1 << 20, 1 << 22


def held_out(doc_id):
    """True for the fold that no model learns from; a null doc_id is in it."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(True))


def gram_buckets(texts: list[str], orders: int, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yields (order, buckets, text numbers) slice by slice; n-grams don't cross texts."""
    lowered = [t.lower() for t in texts]
    i = 0
    while i < len(lowered):
        j, total = i, 0
        while j < len(lowered) and (j == i or total + len(lowered[j]) <= SLICE):
            total += len(lowered[j])
            j += 1
        points = np.frombuffer("".join(lowered[i:j]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        rows = np.repeat(np.arange(i, j), [len(t) for t in lowered[i:j]])
        key = np.zeros(len(points), np.uint64)
        for n in range(1, orders + 1):
            if len(points) < n:
                break
            key = key[: len(points) - n + 1] * np.uint64(0x110001) + points[n - 1 :]
            whole = rows[n - 1 :] == rows[: len(rows) - n + 1]
            mixed = (key * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)) * np.uint64(0xBF58476D1CE4E5B9)
            yield n, (mixed >> np.uint64(64 - bits)).astype(np.int32)[whole], rows[n - 1 :][whole]
        i = j


def train(labelled: DataFrame, orders: int = 3, bits: int = 16, most_languages: int = 200, smoothing: float = 0.5) -> tuple[list[str], np.ndarray]:
    """labelled (text, lang) -> the languages in order, and the matrix of log probabilities (2^bits, languages)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            texts = np.array(batch.column(0).to_pylist(), object)
            for lang in set(langs):
                into = counts.setdefault(lang, np.zeros(1 << bits, np.int64))
                for _, buckets, _ in gram_buckets(texts[langs == lang].tolist(), orders, bits):
                    into += np.bincount(buckets, minlength=1 << bits)
        for lang, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at])], names=["lang", "bucket", "n"])

    rows = labelled.where("text is not null and lang is not null").select("text", "lang")
    sums = rows.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    langs = [r["lang"] for r in rows.select("lang").distinct().orderBy("lang").limit(most_languages + 1).collect()]
    if len(langs) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    matrix = np.full((1 << bits, max(len(langs), 1)), smoothing, np.float32)
    by_lang = sums.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("s"))  # 2^bits entries at most
    for lang, buckets, n in by_lang.select("lang", "s.bucket", "s.n").toLocalIterator():
        column = np.full(1 << bits, smoothing)
        column[buckets] += n
        matrix[:, langs.index(lang)] = np.log(column) - np.log(column.sum())
    return langs, matrix


def identify(docs: DataFrame, langs: list[str], matrix: np.ndarray, orders: int = 3, text: str = "text") -> DataFrame:
    """Adds lang_pred and score, the posterior of the language predicted under equal priors."""
    if not langs:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    model = docs.sparkSession.sparkContext.broadcast(matrix)
    bits = int(np.log2(len(matrix)))
    step = max(1, GATHER // len(langs))

    @F.pandas_udf("lang string, score double")
    def predict(column: pd.Series) -> pd.DataFrame:
        texts = column.fillna("").tolist()
        total = np.zeros((len(texts), len(langs)))
        for _, buckets, rows in gram_buckets(texts, orders, bits):
            if len(rows):
                for a in range(0, len(rows), step):
                    some = rows[a : a + step]
                    at = np.flatnonzero(np.append(True, some[1:] != some[:-1]))
                    total[some[at]] += np.add.reduceat(model.value[buckets[a : a + step]], at, axis=0, dtype=np.float64)
        best = total.argmax(axis=1)
        score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        return pd.DataFrame({"lang": np.array(langs, object)[best], "score": score})

    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    own = fresh(docs, "_predicted")
    out = docs.withColumn(own, predict(F.col(text).cast("string")))
    return out.withColumns({"lang_pred": F.when(letters, F.col(f"{own}.lang")).otherwise("und"), "score": F.when(letters, F.col(f"{own}.score")).otherwise(0.0)}).drop(own)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    langs, matrix = train(docs.where(~held_out("doc_id")).select("text", "lang"))
    return identify(docs.select("doc_id", held_out("doc_id").alias("held_out"), "text"), langs, matrix).drop("text")
