"""Work tables in the shared folder, and word shingles over whole Arrow batches."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

#: 1 where a byte parts words: space and \x09-\x0D.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


_own: dict[str, str] = {}
_made: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or the one set by setCheckpointDir. Where neither is set a local master gets a temporary folder for
    the application, as in tests; on a cluster that is an error, as executors would write to disks of their own.
    """
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not where:
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = context.applicationId
        where = _own[app] = _own.get(app) or tempfile.mkdtemp(prefix="spark-")
    return where.rstrip("/")


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder for one run of an operator. It may be deleted once the run's result has been written."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def drop_work(spark: SparkSession) -> int:
    """Deletes the work folders of all runs in this application, whose results must have been written; gives their number."""
    jvm = spark.sparkContext._jvm
    paths = _made.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return len(paths)


def save(df: DataFrame, path: str, codec: str = "snappy") -> DataFrame:
    """Writes df as Parquet and reads it back: cuts lineage, survives lost executors and gives joins true sizes."""
    df.write.mode("overwrite").option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """name, with underscores before it until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def quoted(df: DataFrame) -> list[str]:
    """The names of all columns of df, for select, whatever they hold."""
    return ["`" + c.replace("`", "``") + "`" for c in df.columns]


def numbered(df: DataFrame, path: str, name: str) -> DataFrame:
    """df written under path, with a number of its own for each row in the column name, which df must not have."""
    return save(df.withColumn(name, F.monotonically_increasing_id()), path, "zstd")


#: A key with more than a PARTS-th of all rows, and more than LEAST_HOT, is dealt to several tasks.
PARTS, LEAST_HOT = 1000, 200


def hot_keys(sizes: DataFrame, keys: list[str], total: int) -> list:
    """Of sizes (keys, n) the keys with too many of `total` rows, each with the number of tasks to deal it to: PARTS of them at most."""
    most = max(total // PARTS, LEAST_HOT)
    return sizes.where(F.col("n") > most).select(*keys, F.ceil(F.col("n") / most).cast("int").alias("_parts")).collect()


def dealt_join(left: DataFrame, right: DataFrame, keys: list[str], by: str, hot: list) -> DataFrame:
    """left.join(right, keys) where right has one row a key at most: rows of hot keys are dealt by a hash of `by`, and right's row is copied to each part.

    Hot keys are told by their hashes, in the tasks, so that no row meets a table of them; their parts are powers of two, each one set of hashes.
    A key that has a hot one's hash is dealt as well, on either side alike.
    """
    if not hot:
        return left.join(right, keys)
    schema = StructType([left.schema[k] for k in keys] + [StructField("_parts", IntegerType())])
    typed = F.xxhash64(*[F.col(k).cast(left.schema[k].dataType) for k in keys])
    sets: dict[int, list[int]] = {}
    for r in left.sparkSession.createDataFrame([tuple(r) for r in hot], schema).select("_parts", typed.alias("h")).collect():
        sets.setdefault(1 << (r["_parts"] - 1).bit_length(), []).append(r["h"])
    parts = F.lit(1)
    for n, hashes in sorted(sets.items()):
        parts = F.when(typed.isin(hashes), F.lit(n)).otherwise(parts)
    one = left.withColumn("_part", F.pmod(F.xxhash64(F.lit(29), by), parts).cast("int"))
    many = right.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return one.join(many, [*keys, "_part"]).drop("_part")


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], by: str) -> DataFrame:
    """dealt_join of a written table left, whose hot keys are counted first."""
    sizes = left.groupBy(*keys).agg(F.count("*").alias("n"))
    return dealt_join(left, right, keys, by, hot_keys(sizes, keys, left.count()))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finisher of 64-bit hashes (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_batches(column: pa.Array, most: int = 1 << 21, rows: int = 1 << 30):
    """Slices a string column: yields (first row, bytes, offsets) of up to `most` bytes and `rows` rows, or one row; null is empty."""
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = min(i + rows, max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1))
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def segment_hash(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hash of each non-empty run data[start:start+length]; runs are in order and don't overlap, data holds nothing else."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    powers = np.ones(int(lengths.max()), np.uint64)
    powers[1:] = 0x9E3779B97F4A7C15
    powers = np.multiply.accumulate(powers)
    at = np.arange(len(data)) - np.repeat(starts, lengths)
    return mix64(np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * powers[at], starts))


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each row in order, and the rows' limits in them. Words are runs of other bytes than white space."""
    solid = ~_SPACE[data]
    first = solid.copy()
    if len(data):
        first[1:] &= ~solid[:-1]
        cut = offsets[:-1][offsets[:-1] < len(data)]
        first[cut] = solid[cut]
    kept = np.cumsum(solid)
    begins = np.flatnonzero(first)
    starts = kept[begins] - 1
    ends = np.append(starts[1:], kept[-1] if len(kept) else 0)
    body = data[solid]
    return segment_hash(_LOWER[body] if lower else body, starts, ends - starts), np.searchsorted(begins, offsets)


def word_digests(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """SHA-256 of each row's words, lower-cased and parted by one space."""
    solid = ~_SPACE[data]
    kept = solid.copy()
    kept[1:] |= solid[:-1]  # of white space the first after a word
    at = np.concatenate([[0], np.cumsum(kept)])[offsets]
    body = np.where(solid, _LOWER[data], np.uint8(32))[kept].tobytes()
    return [hashlib.sha256(body[a:b].strip()).digest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def shingles(data: np.ndarray, offsets: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles of each row, repeats included, and the rows' limits in them.

    A row of fewer words is one shingle of all its words; a row without words has none.
    """
    words, at = word_hashes(data, offsets)
    count = np.diff(at)
    total = len(words)
    parts = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    limits = np.concatenate([[0], np.cumsum(parts)])
    begin = np.repeat(at[:-1], parts) + np.arange(limits[-1]) - np.repeat(limits[:-1], parts)
    span = np.repeat(np.minimum(count, n), parts)
    out = span.astype(np.uint64)
    for k in range(n):
        out = np.where(k < span, out * np.uint64(0xD6E8FEB86659FD93) + words[np.minimum(begin + k, max(total - 1, 0))], out) if len(out) else out
    return mix64(out), limits


def shingle_sets(column: pa.Array, n: int = 5, digests: list[bytes] | None = None):
    """Yields (row, sorted distinct shingle hashes) of every row of a string column; digests gets the word_digests of all rows."""
    for first, data, offsets in byte_batches(column):
        flat, limits = shingles(data, offsets, n)
        if digests is not None:
            digests += word_digests(data, offsets)
        for i in range(len(offsets) - 1):
            yield first + i, np.unique(flat[limits[i] : limits[i + 1]])


def block_pairs(df: DataFrame, keys: list[str], by: str, most: int, weight: Column | None = None, most_weight: int = 1) -> DataFrame:
    """Deals the rows of each key to tasks that meet every pair of its rows exactly once, however large the group.

    A group of n rows is cut into ceil(n / most) blocks by a hash of `by`, more where its weights add up to more than most_weight a block, and
    a row goes to each pair of blocks that holds its own. Adds lo, hi (the blocks) and side (0: the row is of block lo). The result is
    partitioned and sorted by keys, lo, hi, side.
    """
    blocks = F.ceil(F.count("*") / most)
    if weight is not None:
        blocks = F.greatest(blocks, F.ceil(F.sum(weight) / most_weight))
    sizes = df.groupBy(*keys).agg(blocks.cast("int").alias("_blocks")).where("_blocks > 1")
    out = df.join(sizes, keys, "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    out = out.withColumn("_own", F.pmod(F.xxhash64(by, F.lit(11)), F.col("_blocks")).cast("int"))
    out = out.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    out = out.withColumns({"lo": F.least("_own", "_other"), "hi": F.greatest("_own", "_other")}).withColumn("side", (F.col("_own") > F.col("lo")).cast("int"))
    group = [*keys, "lo", "hi"]
    return out.drop("_blocks", "_own", "_other").repartition(*group).sortWithinPartitions(*group, "side")


def groups(batches, keys: list[str]):
    """Joins sorted Arrow batches into whole groups: yields a table for each run of equal keys."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(len(batch), bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        now = tuple(c[0] for c in columns)
        if held and now != last:
            yield pa.Table.from_batches(held)
            held = []
        cuts = [0, *np.flatnonzero(change).tolist(), len(batch)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)
