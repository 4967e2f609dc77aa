"""What the operators share: reading tables, running Arrow functions over them, keeping intermediate tables."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.session import materialize, ship_package

__all__ = ["by_rows", "materialize", "may_be_among", "ship_package", "table"]


#: Rows of a record batch on its way to Python: texts of some kilobytes make it some megabytes.
BATCH_ROWS = 2048


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's rows per Arrow batch to ``BATCH_ROWS``, unless they are lower already.

    Python tracebacks are left whole as well: with the setting that shortens them Spark starts Python workers of two
    kinds (grouped functions don't know it), each with its own memory.
    """
    spark.conf.set("spark.sql.execution.pyspark.udf.simplifiedTraceback.enabled", "false")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship_package(spark)
    bounded_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def give_back() -> None:
    """Return freed memory of this Python worker to the system; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def by_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | dict | None], schema: str) -> DataFrame:
    """Apply a function to bounded record batches; it returns a batch, columns by name, or None for no rows."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = fn(batch)
            if got is not None:
                yield as_batch(got, target)
        give_back()

    return df.mapInArrow(run, schema)


def as_batch(columns: pa.RecordBatch | dict, target: pa.Schema) -> pa.RecordBatch:
    if isinstance(columns, pa.RecordBatch):
        return columns
    arrays = []
    for field in target:
        values = columns[field.name]
        if not isinstance(values, pa.Array):
            values = pa.array(values)
        arrays.append(values if values.type == field.type else values.cast(field.type))
    return pa.RecordBatch.from_arrays(arrays, schema=target)


#: Bits of the fixed bitmap that ``may_be_among`` sets; it takes 8 MB whatever the number of ids.
FILTER_BITS = 1 << 26


def may_be_among(ids: DataFrame) -> Callable[[Column], Column]:
    """A test of a bigint column against ``ids`` (one column): true for all that are among them and for few others.

    The ids set bits of one bitmap of fixed size, so what the driver holds and sends does not grow; with far more ids than
    bits the test passes more values, never fewer. It spares a join the shuffle of rows that it would drop anyway.
    """
    import numpy as np

    width = 32768
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS).cast("bigint"))
    parts = (
        ids.select(slot(F.col(ids.columns[0])).alias("s"))
        .groupBy((F.col("s") / width).cast("bigint").alias("part")).agg(F.bitmap_construct_agg(F.col("s") % width).alias("bits"))
    ).toArrow()
    bitmap = np.zeros((FILTER_BITS // width, width // 8), dtype=np.uint8)
    for part, bits in zip(parts.column("part").to_pylist(), parts.column("bits").to_pylist(), strict=True):
        bitmap[part] = np.frombuffer(bits, np.uint8)
    shared = ids.sparkSession.sparkContext.broadcast(bitmap.reshape(-1))

    @F.arrow_udf("boolean")
    def met(slots: pa.Array) -> pa.Array:
        s = slots.to_numpy(zero_copy_only=False)
        return pa.array((shared.value[s >> 3] >> (s & 7).astype(np.uint8)) & 1 == 1)

    return lambda column: F.coalesce(met(slot(F.coalesce(column, F.lit(0).cast("bigint")))) & column.isNotNull(), F.lit(False))
