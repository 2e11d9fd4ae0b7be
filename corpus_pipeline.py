"""A training corpus from `documents`: judge quality, drop exact and near copies, mix the sources, encode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm import op2_mixing, op7_minhash, op8_pieces, op9_quality, op10_exact
from quarrymill.llm.common import fresh, numbered, quoted, save, work_dir
from quarrymill.llm.op6_language import held_out


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts.

    Null and empty texts count as the mean text, texts of any length are judged whole, rows that repeat are judged alike; scores that tie with
    the threshold are accepted. No labels, or those of one kind, reject nothing. An empty table stays empty; other columns are kept.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out("doc_id"))
    score = op9_quality.scorer(spark, op9_quality.train(docs, labels))
    return docs.where(score(op9_quality.whole()) >= 0.5)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: that of the largest doc_id (null least), of rows that tie the last.

    Null counts as empty, texts of any length are compared whole. An empty table stays empty; other columns are kept, whatever their names.
    """
    return op10_exact.keep_first_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that of the least doc_id (null last), of rows that tie the first. Every row is judged by its own text.

    Null and empty texts are linked with nothing and stay, texts of any length are compared whole. An empty table stays empty; other columns
    are kept, whatever their names.
    """
    row = fresh(docs, "_row")
    rows = numbered(docs, f"{work_dir(spark, 'near')}/rows", row)
    parts = op7_minhash.near_duplicates(rows.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    ids = rows.select(F.col(row).alias("row"), "doc_id")
    kept = ids.join(parts, "row").groupBy("component_id").agg(first.alias("k")).select(F.col("k.row").alias(row))
    return rows.join(kept, row, "left_semi").select(*quoted(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it.

    Null and empty texts have no words: they are repeated with their source's epochs only. Rows that repeat, or whose doc_id is null, count
    each on their own, texts of any length whole; equal keys go by doc_id, size and row. An empty table stays empty; other columns are kept.
    """
    return op2_mixing.mixed(docs, op2_mixing.label_weights(spark.read.parquet(f"{sf_dir}/labels.parquet")))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as piece ids. Each row, repeated ones too, has merges of its own by its number in docs.

    Null and empty texts have no ids, texts of any length are encoded whole. An empty table stays empty; other columns are left out.
    """
    encode, _ = op8_pieces.coder(spark)
    out = docs.select("doc_id", "source", encode(op9_quality.whole(), F.monotonically_increasing_id()).alias("ids"))
    return out.withColumn("n_ids", F.size("ids").cast("long"))


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mix", mix), ("pieces", pieces)]

#: The classifier's training and the piece encoding have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    work = work_dir(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"{work}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
