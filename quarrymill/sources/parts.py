"""Tables in parts, of which a change reads and writes only those that it touches.

A table is a Parquet folder partitioned by `part`, a function of its key: `hashed` spreads any key over a fixed number of parts, `ranged` keeps
numbers near each other together, so that a batch of new documents touches few parts of a table of any size. Rows with a null key match
nothing; those of each batch are a part of their own, which the batch replaces if it runs again.

A change is written beside the table first and counts once it was written whole; putting it in place (dynamic partition overwrite) can be done
again from there, so that a run that breaks off at any step leaves either the old table or a change that `recover`, or the next change,
carries through. A table takes one change at a time; who reads while parts are put in place reads again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, StringType, StructField, StructType, VariantType

from .shared import drop_folder, folder_exists, save, shared_folder


def hashed(parts: int = 256) -> Callable[[Column], Column]:
    """Any key, over so many parts."""
    return lambda key: F.pmod(F.xxhash64(key, F.lit(47)), F.lit(parts))


def ranged(width: int) -> Callable[[Column], Column]:
    """Numbers, so many to a part."""
    return lambda key: F.floor(key / width)


@dataclass
class PartedTable:
    """path, the columns and which of them is the key, the part of a key, and the files that a part is written in at most. It may be empty."""

    spark: SparkSession
    path: str
    schema: StructType
    key: str
    part: Callable[[Column], Column] = hashed()
    files: int = 4

    def rows(self) -> DataFrame:
        return self._read().drop("part")

    def create(self, rows: DataFrame) -> None:
        """The whole table, in place of what is there."""
        self._write(self._parted(rows, 0), self.path, "overwrite", "static")

    def merge(self, batch: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame], number: int) -> list[str]:
        """change(old, batch) in place of old, the rows of the parts that the batch's keys are in; the parts that were rewritten.

        `change` works key by key, and passes rows with a null key through. A batch that comes again with its number gives the same table if
        `change` does.
        """
        self.recover()
        new = save(self._parted(batch, number), shared_folder(self.spark, "batch"))  # it is read twice
        touched = _values(new)
        old = self._read().where(F.col("part").isin(touched) & F.col(self.key).isNotNull()).drop("part")
        return self._put(self._parted(change(old, new.drop("part")), number), touched)

    def drop(self, keys: DataFrame, on: str | None = None) -> list[str]:
        """Without the rows whose `on` (the key, or another column) is among keys; the parts that were rewritten.

        Of parts that hold none, only that column is read, and nothing where it is the key.
        """
        self.recover()
        on = on or self.key
        gone = save(keys.select(on).where(F.col(on).isNotNull()).distinct(), shared_folder(self.spark, "gone"))
        near = self._read()
        if on == self.key:
            near = near.where(F.col("part").isin(_values(self._parted(gone, 0))))
        touched = _values(near.select(on, "part").join(gone, on, "left_semi"))
        left = self._read().where(F.col("part").isin(touched)).join(gone, on, "left_anti")
        return self._put(left, touched)

    def recover(self) -> None:
        """Carries through a change that was written whole and not put in place; one that wasn't written whole is forgotten."""
        if folder_exists(self.spark, f"{self._staged()}/rows/_SUCCESS"):
            self._apply()

    def _staged(self) -> str:
        return f"{self.path.rstrip('/')}-staged"

    def _read(self) -> DataFrame:
        return self._at(self.path)

    def _at(self, path: str) -> DataFrame:
        """With part as text, whatever the folders look like."""
        return self.spark.read.schema(StructType([*self.schema.fields, StructField("part", StringType())])).parquet(path)

    def _parted(self, rows: DataFrame, number: int) -> DataFrame:
        key = F.col(self.key)
        return rows.withColumn("part", F.when(key.isNull(), F.lit(f"none-{number}")).otherwise(self.part(key).cast("string")))

    def _write(self, rows: DataFrame, path: str, mode: str, overwrite: str) -> None:
        # null keys have one part for many rows, so rows are dealt within a part by all that they hold
        own = [f.name for f in self.schema if isinstance(f.dataType, AtomicType) and not isinstance(f.dataType, VariantType)]
        dealt = rows.select(*self.schema.names, "part").repartition("part", F.pmod(F.xxhash64(*own, F.lit(53)), F.lit(self.files)))
        dealt.write.mode(mode).option("partitionOverwriteMode", overwrite).partitionBy("part").parquet(path)

    def _put(self, rows: DataFrame, touched: list[str]) -> list[str]:
        if not touched:
            return []
        self.spark.createDataFrame([(p,) for p in touched], "name string").coalesce(1).write.mode("overwrite").parquet(f"{self._staged()}/touched")
        self._write(rows, f"{self._staged()}/rows", "overwrite", "static")
        self._apply()
        return touched

    def _apply(self) -> None:
        """Puts the written change in place. Parts that lost all their rows are in no partition of it and go by their folder."""
        rows = self._at(f"{self._staged()}/rows")
        touched = [r[0] for r in self.spark.read.schema("name string").parquet(f"{self._staged()}/touched").collect()]
        filled = set(_values(rows))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(self.path)
        for name in touched:
            if name not in filled:
                drop_folder(self.spark, f"{self.path}/part={name}")
        drop_folder(self.spark, self._staged())


def _values(rows: DataFrame) -> list[str]:
    """The parts of rows: as many as the table has at most."""
    return [r[0] for r in rows.select("part").distinct().collect()]
