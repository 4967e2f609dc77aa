"""The article table as a bucketed table: batches are merged without moving what is stored.

The table is clustered by url into as many buckets as it has partitions, one each: the partition column ``bucket`` is the
bucket's number. A batch is dealt by url to the same number of parts and meets the stored rows bucket by bucket, so no stored
row is shuffled; only the partitions that the batch touches are read, and dynamic partition overwrite replaces only them. New
files are staged and swapped in, partition by partition, when all tasks are done; a job lost before that leaves the old rows,
and merging the same batch again gives the same rows.

``buckets`` is chosen once, for buckets of some hundred megabytes. The next free id is a property of the table; it is moved on
before rows are written, so a lost job leaves a gap and never an id twice.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom import schemas
from pageloom.operators.mutations import READ_COLS, enriched_values, last_per_url
from pageloom.operators.skew import assign_ids
from pageloom.session import discard, materialize

_NEXT = "pageloom.next_id"


class Stored(NamedTuple):
    """A bucketed article table of the session's catalog."""

    name: str
    buckets: int

    def bucket(self) -> Column:
        """The number Spark gives a url's bucket."""
        return F.pmod(F.hash("url"), F.lit(self.buckets)).cast("int")

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.table(self.name).drop("bucket")

    def next_id(self, spark: SparkSession) -> int:
        found = spark.sql(f"SHOW TBLPROPERTIES {self.name}").filter(F.col("key") == _NEXT).head()
        return int(found["value"]) if found else 1


def store_articles(articles: DataFrame, name: str, folder: str, buckets: int = 64) -> Stored:
    """Write the article table (``id``, ``url`` and any other of its columns) as a bucketed table in ``folder``."""
    spark, stored = articles.sparkSession, Stored(name, buckets)
    (
        articles.withColumn("bucket", stored.bucket()).repartition(buckets, "url")
        .write.partitionBy("bucket").bucketBy(buckets, "url").sortBy("url").option("path", folder).saveAsTable(name)
    )
    last = stored.rows(spark).agg(F.max("id")).head()[0] or 0
    _set_next(spark, stored, last + 1)
    return stored


def _set_next(spark: SparkSession, stored: Stored, value: int) -> None:
    spark.sql(f"ALTER TABLE {stored.name} SET TBLPROPERTIES ('{_NEXT}' = '{value}')")


def touched(spark: SparkSession, stored: Stored, batch: DataFrame) -> DataFrame:
    """The stored rows of the buckets that hold a url of the batch: a bounded list of partitions."""
    numbers = [r[0] for r in batch.select(stored.bucket().alias("b")).distinct().collect()]
    return spark.table(stored.name).filter(F.col("bucket").isin(numbers))


def dealt(stored: Stored, batch: DataFrame) -> DataFrame:
    """The batch in the parts that the table's buckets have."""
    return batch.repartition(stored.buckets, "url")


def _write(stored: Stored, rows: DataFrame) -> None:
    """Replace the buckets that the rows are in."""
    spark = rows.sparkSession
    name = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(name)
    columns = spark.table(stored.name).columns
    try:
        spark.conf.set(name, "dynamic")
        rows.select(*columns).write.mode("overwrite").insertInto(stored.name)
    finally:
        spark.conf.set(name, before)


def merged_batch(stored: Stored, held: DataFrame, rows: DataFrame, ts: Column) -> DataFrame:
    """The held buckets with the rows (url, ``_id`` of new ones, columns that a reading replaces) merged into them."""
    updates = [c for c in READ_COLS if c in rows.columns and c in held.columns]
    new = dealt(stored, rows.select(F.col("url").alias("_url"), F.col("url"), "_id", *[F.col(c).alias(f"_new_{c}") for c in updates]))
    joined = held.withColumn("_held", F.lit(True)).join(new.drop("_url").withColumn("_hit", F.lit(True)), "url", "full")
    hit, old = F.col("_hit").isNotNull(), F.col("_held").isNotNull()
    values = {c: F.when(hit, F.col(f"_new_{c}")).otherwise(F.col(c)) for c in updates}
    values |= {
        "id": F.coalesce("id", "_id"), "ai_status": F.when(hit, schemas.PENDING).otherwise(F.col("ai_status")),
        "bucket": F.coalesce("bucket", stored.bucket()),
    }
    if "ai_error_log" in held.columns:
        values["ai_error_log"] = F.when(~hit, F.col("ai_error_log"))
    if "created_at" in held.columns:
        values["created_at"] = F.when(old, F.col("created_at")).otherwise(ts)
    return joined.select(*[values[c].alias(c) if c in values else F.col(c) for c in held.columns])


def upsert_stored(stored: Stored, batch: DataFrame, ts: Column, seq: str = "seq") -> None:
    """Merge freshly read pages into the table, as ``mutations.upsert_articles`` does; urls may repeat, the last ``seq`` counts."""
    spark = batch.sparkSession
    names = [c for c in READ_COLS if c in batch.columns]
    rows = materialize(last_per_url(batch.filter("url is not null").select("url", seq, *names), seq))
    held = touched(spark, stored, rows)
    fresh = materialize(dealt(stored, rows.select("url")).join(held.select("url"), "url", "left_anti"))
    first = stored.next_id(spark)
    _set_next(spark, stored, first + fresh.count())
    start = spark.createDataFrame([(first - 1,)], "id bigint")
    numbered = rows.join(assign_ids(fresh, "url", start).select("url", F.col("id").alias("_id")), "url", "left")
    _write(stored, merged_batch(stored, held, numbered, ts))
    discard(rows)
    discard(fresh)


def enriched_batch(stored: Stored, held: DataFrame, rows: DataFrame) -> DataFrame:
    """The held buckets with analysis and vectors (by url) written to the articles that were asked for."""
    joined = held.join(dealt(stored, rows), "url", "left")
    values = enriched_values(F.col("_asked").isNotNull() & ~F.col("ai_status").eqNullSafe(schemas.COMPLETED))
    return joined.select(*[values[c].alias(c) if c in values else F.col(c) for c in held.columns])


def enrich_stored(stored: Stored, asked: DataFrame, analysis: DataFrame, embeddings: DataFrame) -> None:
    """Write analysis and vectors (by id) to the articles ``asked`` (id, url), as ``mutations.apply_enrichment`` does.

    Articles that were not asked for, and completed ones, stay as they are; asked ones without an analysis have failed.
    """
    spark = asked.sparkSession
    found = analysis.select("id", F.lit(True).alias("_found"), *[F.col(c).alias(f"_{c}") for c in ("summary", "tags", "category", "urgency")])
    vectors = embeddings.select("id", F.col("embedding").alias("_embedding"))
    rows = asked.filter("url is not null").select("id", "url", F.lit(True).alias("_asked")).dropDuplicates(["url"])
    rows = materialize(rows.join(found, "id", "left").join(vectors, "id", "left").drop("id"))
    _write(stored, enriched_batch(stored, touched(spark, stored, rows), rows))
    discard(rows)
