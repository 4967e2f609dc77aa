"""Joins and rankings that hold when one key owns a large part of all rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SALTS = 16


def _salt(*columns: Column | str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int")


def null_safe(left: Sequence[Column | str], right: Sequence[Column | str]) -> Column:
    """All pairs of columns are equal, two nulls included."""
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    return reduce(lambda a, b: a & b, [as_col(x).eqNullSafe(as_col(y)) for x, y in zip(left, right, strict=True)])


def per_key_limit(
    df: DataFrame, key: str | Sequence[str], order: Sequence[Column | str], n: int | str, spread: str
) -> DataFrame:
    """First ``n`` rows per key in the given order; ``n`` is a number or a column that is equal within a key.

    No task sorts a whole hot key: a first cut within salted parts of each key leaves at most
    ``SALTS * n`` rows per key.
    """
    keys = [key] if isinstance(key, str) else list(key)
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    limit = F.col(n) if isinstance(n, str) else F.lit(n)
    part = W.partitionBy(*keys, "_salt").orderBy(*order)
    df = df.withColumn("_salt", _salt(spread)).withColumn("_n", F.row_number().over(part))
    df = df.filter(F.col("_n") <= limit).drop("_salt")
    whole = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(whole)).filter(F.col("_n") <= limit).drop("_n")


def spread_rank(
    df: DataFrame,
    keys: Sequence[str],
    lead: Sequence[tuple[str, bool]],
    unique: str,
    out: str,
    start: DataFrame | None = None,
) -> DataFrame:
    """Gapless rank within ``keys`` by ``lead`` columns (name, descending), then by the hash of ``unique``.

    The rows of a key are numbered in 4096 hash parts per lead value; running sums over the part
    counts turn part numbers into ranks. Neither step brings a whole key to one task. ``start``
    is a one-row frame with a column ``n``: the rank to begin after (only without keys). Null keys and
    values rank like any other: nulls are one key, and a null ``unique`` hashes like an empty text.
    """
    hashed = F.md5(F.coalesce(F.col(unique).cast("string"), F.lit("")))
    parts = df.withColumn("_hash", hashed).withColumn("_part", F.substring("_hash", 1, 3))
    group = [*keys, *[name for name, _ in lead], "_part"]
    counts = parts.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    if start is not None:
        first = start.select(F.lit("").alias("_part"), F.coalesce("n", F.lit(0)).cast("long").alias("_n"))
        counts = counts.unionByName(first)
    lead_order = [F.col(name).desc() if desc else F.col(name).asc() for name, desc in lead]
    running = W.partitionBy(*[F.col(k) for k in keys]).orderBy(*lead_order, F.col("_part"))
    before = counts.withColumn(
        "_before", F.sum("_n").over(running.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_n")
    ).drop("_n")
    inside = W.partitionBy(*group).orderBy("_hash", unique)
    known = before.select(*[F.col(c).alias(f"_of_{c}") for c in group], "_before")
    return (
        parts.withColumn("_row", F.row_number().over(inside))
        .join(known, null_safe(group, [f"_of_{c}" for c in group]))
        .withColumn(out, (F.col("_before") + F.col("_row")).cast("long"))
        .drop("_hash", "_part", "_row", "_before", *[f"_of_{c}" for c in group])
    )


def assign_ids(new: DataFrame, unique: str, current: DataFrame | None = None, id_col: str = "id") -> DataFrame:
    """Number new rows after the largest id of ``current``, in the order of the hash of ``unique``."""
    start = None if current is None else current.agg(F.max(id_col).alias("n"))
    return spread_rank(new, [], [], unique, id_col, start)
