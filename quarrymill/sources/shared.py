"""Folders that the driver and all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, or the one set by setCheckpointDir. Where neither is set a local master gets a temporary folder
    for the application, as in tests; on a cluster that is an error, as executors would write to disks of their own.
    """
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not where:
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = context.applicationId
        where = _own[app] = _own.get(app) or tempfile.mkdtemp(prefix="spark-")
    return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def folder_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in whatever store its path names."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder in whatever store its path names; one that isn't there is left."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def save(df: DataFrame, path: str) -> DataFrame:
    """Writes df as Parquet and reads it back: cuts lineage and survives lost executors."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A value that more than a SHARE-th of all rows have, and more than LEAST rows, is dealt to several tasks.
SHARE, LEAST = 1000, 200


def hot_values(sizes: DataFrame, key: str) -> list[tuple]:
    """Of sizes (key, n), a written table, the values that too many rows have, and the number of tasks to deal each to: SHARE values at most."""
    most = max((sizes.agg(F.sum("n")).first()[0] or 0) // SHARE, LEAST)
    return [tuple(r) for r in sizes.where(F.col("n") > most).select(key, F.ceil(F.col("n") / most).cast("int")).collect()]


def dealt_left_join(left: DataFrame, right: DataFrame, key: str, by: str, hot: list[tuple]) -> DataFrame:
    """left.join(right, key, "left") where right has one row a value at most: rows of hot values are dealt by a hash of `by`, and right's row is copied to each part.

    Rows with a null key meet no join.
    """
    own, none = left.where(F.col(key).isNotNull()), left.where(F.col(key).isNull())
    if hot:
        few = F.broadcast(left.sparkSession.createDataFrame(hot, f"`{key}` {left.schema[key].dataType.simpleString()}, _parts int"))
        n = F.coalesce("_parts", F.lit(1))
        one = own.join(few, key, "left").withColumn("_part", F.pmod(F.xxhash64(F.lit(29), by), n).cast("int")).drop("_parts")
        many = right.join(few, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), n - 1))).drop("_parts")
        out = one.join(many, [key, "_part"], "left").drop("_part")
    else:
        out = own.join(right, key, "left")
    return out.unionByName(none, allowMissingColumns=True)
