"""Operators over the paragraphs of templates and drafts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ARABIC


def body_block(documents: DataFrame, paragraphs: DataFrame, letters: str = ARABIC, least: int = 30, by: str = "document_id") -> DataFrame:
    """paragraphs (by, pos, text, align) -> (by, start, length) of each document's longest run of body paragraphs, the first on a tie.

    A body paragraph has `least` letters or more and is aligned neither center nor left; where a document has none, any paragraph with a letter
    counts. Without either, (0, 0).
    """
    n = F.regexp_count(F.col("text"), F.lit(letters))
    rows = paragraphs.select(by, "pos", ((n >= least) & ~F.coalesce(F.col("align"), F.lit("")).isin("center", "left")).alias("strict"), (n > 0).alias("loose"))

    def longest(flag: str, name: str) -> DataFrame:
        island = F.col("pos") - F.row_number().over(Window.partitionBy(by).orderBy("pos"))
        runs = rows.where(flag).withColumn("island", island).groupBy(by, "island").agg(F.min("pos").alias("start"), F.count("*").alias("length"))
        return runs.groupBy(by).agg(F.max_by(F.struct("start", "length"), F.struct(F.col("length"), -F.col("start"))).alias(name))

    out = documents.select(by).join(longest("strict", "a"), by, "left").join(longest("loose", "b"), by, "left")
    best = F.coalesce("a", "b")
    return out.select(by, F.coalesce(best["start"], F.lit(0)).alias("start"), F.coalesce(best["length"], F.lit(0)).alias("length"))
