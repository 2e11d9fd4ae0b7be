"""Mixing sources to target weights by weighted sampling without replacement (Efraimidis-Spirakis).

Sources share all words by weight. A source's target stops at `most_epochs` times its size; what it can't take goes to the others by
weight until none is above. This is one pass over the sources in the order of size / weight: a source is stopped iff its limit is under the
share that is left for it once all before it have stopped.

A source's target is that many complete epochs of all its documents, then a fraction: documents in the order of -ln(u) / w (u a keyed hash
of doc_id, w the document's quality weight), as many as bring their sizes nearest to the words that are left. The order is laid out by a
range partitioning over (source, key, the row's number); sizes are summed within ranges, ranges are prefix-summed, so a source with a third
of all rows, or one doc_id on as many, is spread over many tasks. Sizes are written before, so texts are read once.

Only DataFrame and SQL functions. A null text has size 0. Null sources are one source, the last. Documents of size 0 are repeated with
their source's epochs and never in the fraction; a source without words has target 0. Rows with a null doc_id, and rows that repeat one,
count each on their own: the key of a null doc_id is drawn from the row's number, equal keys are ordered by doc_id, size and number. Texts of
any length count whole. Empty tables give no rows; other columns, whatever their names, are kept by `mixed` only, which joins by the row's number, never by
doc_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, numbered, quoted, save, work_dir

WORD = r"[^\x20\x09-\x0D]+"


def uniform(drawn: Column, seed: int) -> Column:
    """52 bits of an MD5 as a number in (0, 1)."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), drawn).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most_epochs: int = 3) -> DataFrame:
    """sized (source, size) -> source, source_size, target; weights repeat over the sources by code point, null last. One row per source."""
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())  # over sources, not rows
    place = (F.row_number().over(order) - 1) % len(weights)
    s = by_source.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")).cast("long")).withColumn("most", F.col("source_size") * most_epochs)
    full = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumns(
        {
            "left_words": F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0)),
            "left_w": F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0)),
        }
    )
    # in this order the stopped sources come first
    s = s.withColumn("stopped", F.col("most") * F.col("left_w") <= F.col("left_words") * F.col("w"))
    words = F.sum("source_size").over(every) - F.coalesce(F.sum(F.when(F.col("stopped"), F.col("most"))).over(every), F.lit(0))
    share = F.sum(F.when(~F.col("stopped"), F.col("w"))).over(every)
    target = F.when(F.col("stopped"), F.col("most").cast("double")).otherwise(words * F.col("w") / share)
    return s.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, quality: DataFrame | None = None, weights: tuple[int, ...] = (5, 2, 1), most_epochs: int = 3, seed: int = 2, number: str | None = None) -> DataFrame:
    """docs (doc_id, text, source), quality (doc_id, weight > 0) -> doc_id, size, source, source_size, target, copies, taken for each row.

    `number` names a column that numbers the rows of docs; it comes along as row.
    """
    work = work_dir(docs.sparkSession, "mixing")
    source, size = F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long").alias("size")
    if number:
        sized = docs.select("doc_id", F.col(number).alias("row"), source, size)
    else:
        sized = numbered(docs.select("doc_id", source, size), f"{work}/sizes", "row")
    if quality is None:
        sized = sized.withColumn("weight", F.lit(1.0))
    else:
        one = quality.where("doc_id is not null").groupBy("doc_id").agg(F.max("weight").alias("weight")).withColumn("_spread", F.lit(0).cast("long"))
        # rows without doc_id find nothing, and are spread over the tasks of the join by their numbers
        sized = sized.withColumn("_spread", F.when(F.col("doc_id").isNull(), F.col("row")).otherwise(0)).join(one, ["doc_id", "_spread"], "left").drop("_spread")
        sized = sized.withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    drawn = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row "), F.col("row").cast("string")))
    keyed = sized.withColumn("key", -F.ln(uniform(drawn, seed)) / F.col("weight"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = keyed.repartitionByRange(parts, F.col("source").asc_nulls_last(), "key", "doc_id", "size", "row").withColumn("range", F.spark_partition_id())
    ranged = save(ranged, f"{work}/ranges")

    sums = ranged.groupBy("source", "range").agg(F.sum("size").alias("n"))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # at most one row for each range
    sums = sums.select("source", "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    targets = source_targets(ranged, weights, most_epochs).withColumnRenamed("source", "_source")
    plan = sums.join(targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumnRenamed("source", "_source").withColumnRenamed("range", "_range")
    rows = ranged.join(plan, (F.col("range") == F.col("_range")) & F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "_range")

    inside = Window.partitionBy("range", "source").orderBy("key", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    out = rows.withColumns({"before": before, "epochs": epochs})
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    more = (F.col("size") > 0) & (2 * F.col("before") + F.col("size") <= 2 * rest)
    out = out.withColumn("copies", F.col("epochs") + F.when(more, 1).otherwise(0))
    return out.select("doc_id", *(["row"] if number else []), "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def label_weights(labels: DataFrame) -> DataFrame:
    """(doc_id, weight): good documents come up twice as readily as unlabelled ones, bad ones half as readily."""
    return labels.select("doc_id", F.when(F.col("quality") == 1, 2.0).when(F.col("quality") == 0, 0.5).otherwise(1.0).alias("weight"))


def mixed(docs: DataFrame, quality: DataFrame | None = None, **options) -> DataFrame:
    """docs as the mix has them: each row as often as it is taken, with all columns. docs is written to a work table, whose rows are numbered."""
    row = fresh(docs, "_row")
    rows = numbered(docs, f"{work_dir(docs.sparkSession, 'mixed')}/rows", row)
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies").cast("long")))
    times = mix(rows, quality, number=row, **options).where("copies > 0").select(F.col("row").alias(row), each.alias(fresh(docs, "_copy")))
    return rows.join(times, row).select(*quoted(docs))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    quality = label_weights(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), quality).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = r"""
WITH q AS (
  SELECT doc_id, max(CASE quality WHEN 1 THEN 2.0::DOUBLE WHEN 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END) AS weight FROM labels GROUP BY doc_id
), d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, coalesce(weight, 1.0::DOUBLE) AS weight
  FROM documents LEFT JOIN q USING (doc_id)
), k AS (
  SELECT *, -ln(((('0x' || substr(md5('2:' || doc_id::VARCHAR), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE) / weight AS key FROM d
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, [5, 2, 1][1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT]::BIGINT AS w, source_size * 3 AS most FROM s
), r AS (
  SELECT *, (sum(source_size) OVER ())::BIGINT - coalesce(sum(most) OVER f, 0)::BIGINT AS left_words, (sum(w) OVER ())::BIGINT - coalesce(sum(w) OVER f, 0)::BIGINT AS left_w
  FROM w WINDOW f AS (ORDER BY most::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), c AS (
  SELECT *, most * left_w <= left_words * w AS stopped FROM r
), t AS (
  SELECT source, source_size, CASE WHEN stopped THEN most::DOUBLE ELSE
    (((sum(source_size) OVER ())::BIGINT - coalesce((sum(most) FILTER (stopped) OVER ())::BIGINT, 0)) * w)::DOUBLE / ((sum(w) FILTER (NOT stopped) OVER ())::BIGINT)::DOUBLE END AS target
  FROM c
), b AS (
  SELECT k.*, source_size, target, coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
    CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       size * (epochs + CASE WHEN size > 0 AND 2 * before + size <= 2 * (target - epochs * source_size) THEN 1 ELSE 0 END) AS taken
FROM b
"""
