"""Article tables kept by streams as two append-only logs.

``article_log/batch_id=N`` holds what micro-batch N read, ``enrich_log/batch_id=N`` what it enriched, ``logs/batch_id=N`` its
log rows. The ids of stored urls and the sources of stored domains are keyed runs (see ``runs``), so a batch looks up its own
keys in their buckets and never reads the logs of earlier batches. ``manifest/batch_id=N`` is written last and holds the next
free ids: it makes articles, sources and log rows of the batch count, all or none. A micro-batch only overwrites its own
folders, so a replay after a lost executor or driver leaves the same rows, and no batch rewrites older data.
``current_articles`` merges the logs on reading.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from pageloom import schemas
from pageloom.functions import fixed_values as V
from pageloom.functions.urls import netloc
from pageloom.operators.enrich import Analyzer, Embedder, analysis, embedding
from pageloom.operators.mutations import register_sources
from pageloom.operators.skew import assign_ids
from pageloom.plans.composites import page_log_rows, page_verdicts, read_articles
from pageloom.session import discard, materialize
from pageloom.streaming.runs import Runs

_READ = [f for f in schemas.ARTICLES.fields if f.name not in (
    "embedding", "ai_status", "ai_error_log", "ai_tags", "ai_category", "ai_urgency")]
ARTICLE_LOG = T.StructType(_READ)
ARTICLE_KEYS = T.StructType([f for f in schemas.ARTICLES.fields if f.name in ("id", "url", "created_at")])
MANIFEST = T.StructType([
    T.StructField(name, T.LongType())
    for name in ("next_id", "next_source", "articles", "created", "blocked", "failed")
])
ENRICH_LOG = T.StructType([
    T.StructField("url", T.StringType(), False),
    T.StructField("version", T.LongType()),
    T.StructField("analysis", schemas.ANALYSIS),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
])


def _log(spark: SparkSession, folder: str, name: str, schema: T.StructType) -> DataFrame:
    full = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    try:
        return spark.read.schema(full).parquet(f"{folder}/{name}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], full)


def committed(spark: SparkSession, folder: str) -> int:
    """Number of batches whose manifest is written."""
    last = _log(spark, folder, "manifest", MANIFEST).agg(F.max("batch_id")).head()[0]
    return 0 if last is None else last + 1


def article_log(spark: SparkSession, folder: str) -> DataFrame:
    """The articles of all committed batches."""
    return _log(spark, folder, "article_log", ARTICLE_LOG).filter(F.col("batch_id") < committed(spark, folder))


def ingest_log(spark: SparkSession, folder: str) -> DataFrame:
    """The log rows of all committed batches."""
    return _log(spark, folder, "logs", schemas.LOGS).filter(F.col("batch_id") < committed(spark, folder))


def article_keys(folder: str) -> Runs:
    return Runs(f"{folder}/keys", ARTICLE_KEYS, ("url",))


def source_keys(folder: str) -> Runs:
    return Runs(f"{folder}/sources", schemas.SOURCES, ("domain",))


def current_sources(spark: SparkSession, folder: str, sources: DataFrame) -> DataFrame:
    """The source table: the given one with what the stream registered and stamped."""
    found = source_keys(folder).all(spark, committed(spark, folder)).select(*schemas.SOURCES.fieldNames())
    return sources.join(found, "domain", "left_anti").select(*found.columns).unionByName(found)


def enrich_log(spark: SparkSession, folder: str) -> DataFrame:
    return _log(spark, folder, "enrich_log", ENRICH_LOG)


_LOST = "the log holds batches after {}: the stream's checkpoint was lost, use its copy or a new folder"


def _same_history(spark: SparkSession, log: DataFrame, batch_id: int) -> None:
    """Refuse to number batches anew over a log that holds later ones: readings would mix."""
    if not log.filter(F.col("batch_id") > batch_id).isEmpty():
        raise RuntimeError(_LOST.format(batch_id))


def _manifest(spark: SparkSession, folder: str, batch_id: int) -> Row | None:
    """The manifest of one batch, read by its path."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest/batch_id={batch_id}").head()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def stream_ingest(
    pages: DataFrame, robots_files: DataFrame, sources: DataFrame, folder: str, checkpoint: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Read new page files as they land: articles keyed by url, sources by domain, and a log row per page, by micro-batch.

    A batch costs what its pages cost, whatever is stored: the text moves once, by url; urls and domains are looked up in
    the buckets that hold them. ``sources`` is the source table the stream starts with. ``trigger`` holds the arguments of
    Spark's trigger; without it all that is there is read and the stream ends. A new checkpoint over a log of later batches
    is refused.
    """

    def read(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if _manifest(spark, folder, batch_id + 1) is not None:
            raise RuntimeError(_LOST.format(batch_id))
        before = _manifest(spark, folder, batch_id - 1)
        urls_known, domains_known = article_keys(folder), source_keys(folder)
        urls_known.forget(spark, batch_id)
        domains_known.forget(spark, batch_id)
        ts = F.lit(spark.range(1).select(F.current_timestamp().cast("timestamp_ntz")).head()[0]).cast("timestamp_ntz")

        work = batch.withColumn("seq", F.col("page_id"))
        checked = materialize(page_verdicts(work, robots_files))
        known = domains_known.among(checked.select(netloc("url").alias("domain")), batch_id).select(*schemas.SOURCES.fieldNames())
        held = sources.join(known.select("domain"), "domain", "left_anti").select(*known.columns).unionByName(known)
        seen = checked.select(netloc("url").alias("domain")).distinct()
        first_source = before.next_source if before else (sources.agg(F.max("id")).head()[0] or 0) + 1
        ids = spark.createDataFrame([(first_source - 1,)], "id bigint")
        registered = materialize(register_sources(held.join(seen, "domain", "left_semi"), checked.select("url"), ts, ids=ids))
        domains_known.add(registered, batch_id)

        stored = urls_known.among(checked.select("url"), batch_id).select("url", F.col("id").alias("_id"), F.col("created_at").alias("_created"))
        rows = materialize(read_articles(work, checked, registered, ts).join(stored, "url", "left"))
        first_id = before.next_id if before else 1
        fresh = assign_ids(rows.filter("_id is null").drop("id"), "url", spark.createDataFrame([(first_id - 1,)], "id bigint"))
        fresh = materialize(fresh.withColumn("created_at", ts).select("url", "id", "created_at"))
        urls_known.add(fresh, batch_id)
        numbered = rows.join(fresh, "url", "left").withColumns(
            {"id": F.coalesce("_id", "id"), "created_at": F.coalesce("_created", "created_at")})
        numbered.select(*ARTICLE_LOG.fieldNames()).write.mode("overwrite").parquet(f"{folder}/article_log/batch_id={batch_id}")
        page_log_rows(checked, stored.select("url"), ts).write.mode("overwrite").parquet(f"{folder}/logs/batch_id={batch_id}")

        created = fresh.count()
        told = checked.agg(F.count_if(~F.col("allowed")), F.count_if(F.col("allowed") & ~F.col("ok"))).head()
        done = (first_id + created, first_source + registered.filter(F.col("id") >= first_source).count(), rows.count(), created, told[0], told[1])
        spark.createDataFrame([done], MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest/batch_id={batch_id}")
        for used in (checked, registered, rows, fresh):
            discard(used)

    return (
        pages.writeStream.foreachBatch(read).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def article_log_stream(spark: SparkSession, folder: str) -> DataFrame:
    full = T.StructType([*ARTICLE_LOG.fields, T.StructField("batch_id", T.LongType())])
    return spark.readStream.schema(full).parquet(f"{folder}/article_log")


def stream_enrich(
    read: DataFrame,
    folder: str,
    checkpoint: str,
    analyzers: Sequence[Analyzer] | None = None,
    model: Embedder | None = None,
    dim: int = V.EMBEDDING_DIM,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Enrich articles as the ingest stream hands them over; ``trigger`` and a lost checkpoint as in ``stream_ingest``."""

    def enrich(batch: DataFrame, batch_id: int) -> None:
        _same_history(batch.sparkSession, enrich_log(batch.sparkSession, folder), batch_id)
        text = F.col("clean_text")
        batch.select(
            "url", F.col("batch_id").alias("version"), analysis(text, analyzers).alias("analysis"),
            embedding(text, model, dim).alias("embedding"),
        ).write.mode("overwrite").parquet(f"{folder}/enrich_log/batch_id={batch_id}")

    return (
        read.writeStream.foreachBatch(enrich).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def current_articles(spark: SparkSession, folder: str) -> DataFrame:
    """The article table out of the logs: newest reading of each url with the newest enrichment.

    An article read again after its last enrichment is pending and keeps its older tags and vector.
    """
    newest = W.partitionBy("url").orderBy(F.desc("batch_id"))
    read = (
        article_log(spark, folder).withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")
        .withColumnRenamed("batch_id", "_read")
    )
    order = F.struct("version", "batch_id")
    found = enrich_log(spark, folder).groupBy("url").agg(
        F.max("version").alias("_version"),
        F.max_by(F.col("analysis").isNotNull(), order).alias("_ok"),
        F.max_by("analysis", F.when(F.col("analysis").isNotNull(), order)).alias("_a"),
        F.max_by("embedding", F.when(F.col("embedding").isNotNull(), order)).alias("embedding"),
    )
    up_to_date = F.col("_version") >= F.col("_read")
    failed = up_to_date & ~F.col("_ok")
    # The analysis wrote the summary; a newer reading of the page replaces it.
    summary = F.when(up_to_date & F.col("_ok"), F.coalesce("_a.summary", "summary")).otherwise(F.col("summary"))
    values = {
        "summary": summary,
        "ai_status": F.when(failed, schemas.FAILED).when(up_to_date, schemas.COMPLETED).otherwise(schemas.PENDING),
        "ai_error_log": F.when(failed, V.NO_ANALYSIS),
        "ai_tags": F.col("_a.tags"),
        "ai_category": F.col("_a.category"),
        "ai_urgency": F.col("_a.urgency"),
    }
    joined = read.join(found, "url", "left")
    return joined.select(
        *[values[f.name].alias(f.name) if f.name in values else F.col(f.name) for f in schemas.ARTICLES.fields]
    )
