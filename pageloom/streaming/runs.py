"""Keyed tables that a stream adds to, batch by batch.

What micro-batch N adds is a run, a folder of its own, dealt to buckets by a hash of the key. ``fan`` runs of one size are
merged into one of the next size as soon as they are there, so after N batches there are at most ``(fan - 1) * log(N)`` runs
and a row is copied ``log(N)`` times in all. Of several rows of a key the newest stays, or the columns named in ``sums`` are
added up. Which runs are there follows from N alone: no list has to be kept, and a batch that is replayed writes and merges
the same folders again. A look-up reads the buckets of its keys only.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.session import remove


#: What a batch's marker tells; it is written last and makes the batch count.
MARKER = T.StructType([
    T.StructField("rows", T.LongType()), T.StructField("late", T.LongType()), T.StructField("latest", T.TimestampNTZType()),
])


def mark(spark: SparkSession, folder: str, batch_id: int, rows: int, late: int = 0, latest=None) -> None:
    spark.createDataFrame([(rows, late, latest)], MARKER).coalesce(1).write.mode("overwrite").parquet(f"{folder}/done/batch_id={batch_id}")


def marker(spark: SparkSession, folder: str, batch_id: int | None = None) -> Row | None:
    """The marker of one batch, or of the last one, with its ``batch_id``; None when there is none."""
    if batch_id is not None and batch_id < 0:
        return None
    full = T.StructType([*MARKER.fields, T.StructField("batch_id", T.LongType())])
    try:
        found = spark.read.option("basePath", f"{folder}/done").schema(full).parquet(f"{folder}/done" if batch_id is None else f"{folder}/done/batch_id={batch_id}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    rows = found.orderBy(F.desc("batch_id")).limit(1).collect()
    return rows[0] if rows else None


class Runs(NamedTuple):
    folder: str
    schema: T.StructType
    key: tuple[str, ...]
    buckets: int = 64
    fan: int = 8
    sums: tuple[str, ...] = ()

    def names(self, batches: int) -> list[str]:
        """Folders that hold the batches 0 to ``batches - 1``: the digits of that number to the base ``fan``."""
        level = 0
        while self.fan ** (level + 1) <= batches:
            level += 1
        out, done = [], 0
        for at in range(level, -1, -1):
            size = self.fan**at
            while done + size <= batches:
                out.append(f"{self.folder}/level={at}/run={done // size}")
                done += size
        return out

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _read(self, spark: SparkSession, names: list[str]) -> DataFrame:
        own = T.StructType([*self.schema.fields, T.StructField("batch_id", T.LongType())])
        folders = [("level", T.IntegerType()), ("run", T.LongType()), ("bucket", T.IntegerType())]
        full = T.StructType([*own.fields, *[T.StructField(n, t) for n, t in folders]])
        found = spark.read.schema(full).option("basePath", self.folder).parquet(*names) if names else spark.createDataFrame([], full)
        return found.select(*own.fieldNames(), "bucket")

    def _put(self, rows: DataFrame, name: str) -> None:
        rows.withColumn("bucket", self._bucket()).repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(name)

    def add(self, rows: DataFrame, batch_id: int) -> None:
        """Store the rows of a micro-batch, one per key, and merge what has become enough."""
        spark, names = rows.sparkSession, self.schema.fieldNames()
        own, *merged = self.made(batch_id)
        self._put(rows.select(*names, F.lit(batch_id).cast("bigint").alias("batch_id")), own)
        for level, name in enumerate(merged, 1):
            last = (batch_id + 1) // self.fan**level
            parts = [f"{self.folder}/level={level - 1}/run={i}" for i in range((last - 1) * self.fan, last * self.fan)]
            self._put(self._merged(self._read(spark, parts)), name)

    def _merged(self, rows: DataFrame) -> DataFrame:
        """One row per key, combined before the shuffle."""
        names = [*self.schema.fieldNames(), "batch_id"]
        if self.sums:
            made = [F.sum(c).cast(self.schema[c].dataType).alias(c) for c in self.sums]
            return rows.groupBy(*self.key).agg(*made, F.max("batch_id").alias("batch_id")).select(*names)
        last = rows.groupBy(*self.key).agg(F.max_by(F.struct(*names), "batch_id").alias("_row"))
        return last.select(*[F.col(f"_row.{c}").alias(c) for c in names])

    def made(self, batch_id: int) -> list[str]:
        """The runs that a micro-batch writes: its own, and those it completes."""
        out, level, n = [], 0, batch_id + 1
        while n % self.fan**level == 0:
            out.append(f"{self.folder}/level={level}/run={n // self.fan**level - 1}")
            level += 1
        return out

    def forget(self, spark: SparkSession, batch_id: int) -> None:
        """Remove the runs that batches before ``batch_id - 1`` have merged. What the last two batches saw stays, for replays and readers."""
        if batch_id >= 2:
            for name in (set(self.names(batch_id - 2)) | set(self.made(batch_id - 2))) - set(self.names(batch_id - 1)):
                remove(spark, name)

    def among(self, keys: DataFrame, batches: int) -> DataFrame:
        """The stored rows of the keys, out of the buckets that hold any of them."""
        spark = keys.sparkSession
        if not batches:
            return self._read(spark, []).drop("bucket")
        asked = keys.select(*self.key).distinct()
        # At most ``buckets`` rows.
        touched = [r[0] for r in asked.select(self._bucket().alias("b")).distinct().collect()]
        held = self._read(spark, self.names(batches)).filter(F.col("bucket").isin(touched))
        return self._merged(held.join(asked, list(self.key), "left_semi"))

    def all(self, spark: SparkSession, batches: int) -> DataFrame:
        """One row of every key."""
        return self._merged(self._read(spark, self.names(batches)))
