"""Table scans. Columns are named by the caller so that only they are read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom import schemas


def table(spark: SparkSession, folder: str, name: str, cols: Sequence[str] | None = None) -> DataFrame:
    """A table of the folder. How finely it is read is up to ``spark.sql.files.maxPartitionBytes`` and the like."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*cols) if cols else df


def stored_articles(spark: SparkSession, path: str, cols: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.schema(schemas.ARTICLES).parquet(path)
    return df.select(*cols) if cols else df


def fetched_pages(pages: DataFrame) -> DataFrame:
    """Page rows in the shape of a fetch log: final url, status and error next to the html.

    A table that already has those columns passes through; a plain crawl dump counts as fetched.
    """
    have = set(pages.columns)
    defaults: dict[str, Column] = {
        "final_url": F.col("url"),
        "status": F.lit(200),
        "error": F.lit(None).cast("string"),
    }
    missing = {name: value for name, value in defaults.items() if name not in have}
    return pages.withColumns(missing) if missing else pages


def with_json(df: DataFrame, col: str, schema: T.StructType | str | None = None, out: str | None = None) -> DataFrame:
    """Read a JSON text column: as a struct when its shape is known, else as VARIANT."""
    parsed = F.try_parse_json(col) if schema is None else F.from_json(F.col(col), schema)
    return df.withColumn(out or col, parsed)


def search_results(df: DataFrame) -> DataFrame:
    """Stored web search results in their fixed column order."""
    return df.select("topic", "provider", F.col("rank").cast("int").alias("rank"), "url", "title")
