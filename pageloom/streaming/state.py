"""Stateful operators that run alike over a table and over a stream.

All are built-in aggregations: Spark combines the rows of a key before the shuffle and keeps one state
row per key, so a busy key costs no more than a quiet one.

A stream that never ends keeps its state by key and period of event time, in RocksDB, and hands over the rows a micro-batch has
touched, no others (``keep_state``). A period's state expires when the watermark has passed it; what it came to is in the kept rows,
which are maxima and counts and so add up over periods.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from pageloom import schemas
from pageloom.functions import fixed_values as V
from pageloom.operators.jobs import interval_state
from pageloom.operators.research import gap_poll
from pageloom.session import discard, materialize
from pageloom.streaming.runs import Runs, mark, marker

_ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def _start_on_rocksdb(writer, spark: SparkSession) -> StreamingQuery:
    """Start a query with its state in RocksDB; a query keeps the settings it was started with."""
    before = {name: spark.conf.get(name, None) for name in _ROCKSDB}
    try:
        for name, value in _ROCKSDB.items():
            spark.conf.set(name, value)
        return writer.start()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _by_period(events: DataFrame, length: str, delay: str) -> tuple[DataFrame, Column]:
    """The events with a watermark, and the period that each falls into."""
    timed = events.withColumn("_at", F.col("ts").cast("timestamp")).withWatermark("_at", delay)
    return timed, F.window("_at", length).alias("period")


def _runs(folder: str, schema: T.StructType, key: tuple[str, ...]) -> Runs:
    return Runs(f"{folder}/state", schema, key)


def keep_state(states: DataFrame, key: str, folder: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Keep the rows of a streaming aggregation by ``key`` and ``period``: each micro-batch stores the ones it has changed."""
    spark = states.sparkSession
    flat = states.withColumn("period", F.col("period.start"))
    runs = _runs(folder, flat.schema, (key, "period"))

    def store(batch: DataFrame, batch_id: int) -> None:
        runs.forget(batch.sparkSession, batch_id)
        runs.add(batch, batch_id)
        mark(batch.sparkSession, folder, batch_id, rows=batch.count())

    writer = flat.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", checkpoint)
    return _start_on_rocksdb(writer.trigger(**(trigger or {"availableNow": True})), spark)


def kept_state(spark: SparkSession, states: DataFrame, key: str, folder: str) -> DataFrame:
    """What ``keep_state`` has stored of the aggregation ``states``: a row per key and period."""
    schema = states.withColumn("period", F.col("period.start")).schema
    last = marker(spark, folder)
    return _runs(folder, schema, (key, "period")).all(spark, last.batch_id + 1 if last else 0).drop("batch_id")


def schedule_periods(history: DataFrame, period: str = "30 days", delay: str = "2 days") -> DataFrame:
    """Schedule state per job and period of a stream of enriched articles; ``merged_state`` adds the periods up."""
    return interval_state(*_by_period(history, period, delay))


def status_periods(events: DataFrame, period: str = "30 days", delay: str = "2 days") -> DataFrame:
    """Status state per article and period of a stream of status events; ``merged_status`` adds the periods up."""
    return status_state(*_by_period(events, period, delay))


def merged_status(states: DataFrame) -> DataFrame:
    return states.groupBy("article_id").agg(F.max("settled").alias("settled"), F.max("started").alias("started"))


def stream_dedupe(stream: DataFrame, delay: str, event_time: str = "ts", stored: DataFrame | None = None) -> DataFrame:
    """Each url once within the delay; rows of a table are simply made distinct by url.

    Urls in ``stored`` (url), a table that each micro-batch reads anew, are left out, so a copy that comes
    after the delay does no harm once the first one is stored.
    """
    if stream.isStreaming:
        once = stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["url"])
    else:
        once = stream.dropDuplicates(["url"])
    return once if stored is None else once.join(stored.select("url").distinct(), "url", "left_anti").select(*stream.columns)


def status_state(events: DataFrame, *by: Column) -> DataFrame:
    """What the status events of each article leave behind: (article_id, ts, seq, status) to one row per article (and ``by``).

    The one illegal move is from completed to processing. So the last event that is not a
    processing event decides, unless it is overtaken by processing and not completed.
    """
    at = F.struct("ts", "seq")
    processing = F.col("status") == schemas.PROCESSING
    known = F.col("status").isin(*schemas.AI_STATUSES)
    return events.filter(known).groupBy("article_id", *by).agg(
        F.max(F.when(~processing, F.struct(at.alias("at"), "status"))).alias("settled"),
        F.max(F.when(processing, at)).alias("started"),
    )


def status_of(state: DataFrame) -> DataFrame:
    overtaken = F.col("settled").isNull() | (
        (F.col("settled.status") != schemas.COMPLETED)
        & F.coalesce(F.col("started") > F.col("settled.at"), F.lit(False))
    )
    return state.select(
        "article_id", F.when(overtaken, schemas.PROCESSING).otherwise(F.col("settled.status")).alias("status")
    )


def stream_status(events: DataFrame) -> DataFrame:
    return status_of(status_state(events))


def stream_schedule(history: DataFrame) -> DataFrame:
    """Running schedule state per job; join it with the job table by ``adapted_intervals``."""
    return interval_state(history)


def stream_gap_answers(requests: DataFrame, completions: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """Requests (run, url, asked_at) of a stream with the poll that saw them done: (run, url, poll).

    A left outer join with the stream of completions (url, done_at): a request is answered by completions within the longest wait after
    it (or before it), and given up, with a null poll, when the watermarks of both streams have passed that. Spark then drops
    both from its state.
    """
    wait = V.GAP_POLL_SECONDS * (V.GAP_POLLS_MAX - 1)
    asked = requests.withColumn("asked_at", F.col("asked_at").cast("timestamp")).withWatermark("asked_at", delay)
    done = completions.select(F.col("url").alias("_url"), F.col("done_at").cast("timestamp").alias("done_at")).withWatermark("done_at", delay)
    in_time = (
        (F.col("url") == F.col("_url")) & (F.col("done_at") <= F.col("asked_at") + F.expr(f"interval {wait} seconds"))
        & (F.col("done_at") >= F.col("asked_at") - F.expr("interval 1 day"))
    )
    return asked.join(done, in_time, "left_outer").select("run", "url", gap_poll(F.col("asked_at"), F.col("done_at")).alias("poll"))


HOURS = T.StructType([
    T.StructField("hour", T.TimestampNTZType()), T.StructField("urgency", T.DoubleType()), T.StructField("rows", T.LongType()),
])


def _hours(folder: str) -> Runs:
    return Runs(f"{folder}/hours", HOURS, ("hour",), buckets=16, sums=("urgency", "rows"))


def keep_trend(rows: DataFrame, folder: str, checkpoint: str, delay: str = "2 hours", event_time: str = "ts", trigger: dict | None = None) -> StreamingQuery:
    """Urgency sums and counts per hour of a stream, and the rows that come too late for theirs as an output of their own.

    An hour is closed when the latest event of earlier micro-batches lies ``delay`` or more behind its end. Rows of closed hours
    are stored under ``late`` and counted in the batch's marker. Neither output is ever rewritten; hours add up on reading.
    Rows without an event time count as late.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        spark, runs = batch.sparkSession, _hours(folder)
        before = marker(spark, folder, batch_id - 1)
        rows = batch.withColumn(event_time, F.col(event_time).cast("timestamp_ntz"))
        rows = materialize(rows.withColumn("hour", F.date_trunc("hour", event_time).cast("timestamp_ntz")))
        mark_of = F.lit(before.latest if before else None).cast("timestamp_ntz")
        open_hour = F.col("hour").isNotNull() & (mark_of.isNull() | (F.col("hour") + F.expr("interval 1 hour") > mark_of - F.expr(f"interval {delay}")))
        late = rows.filter(~F.coalesce(open_hour, F.lit(False)))
        late.drop("hour").write.mode("overwrite").parquet(f"{folder}/late/batch_id={batch_id}")
        runs.forget(spark, batch_id)
        runs.add(hour_sums(rows.filter(open_hour), "hour"), batch_id)
        seen = rows.agg(F.greatest(F.max(event_time), mark_of).alias("latest"), F.count_if(~F.coalesce(open_hour, F.lit(False))).alias("late"), F.count(F.lit(1)).alias("n")).head()
        mark(spark, folder, batch_id, rows=seen.n, late=seen.late, latest=seen.latest)
        discard(rows)

    writer = rows.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def hour_sums(rows: DataFrame, hour: str) -> DataFrame:
    return rows.groupBy(F.col(hour).alias("hour")).agg(
        F.sum(F.coalesce(F.col("urgency").cast("double"), F.lit(0.0))).alias("urgency"), F.count(F.lit(1)).alias("rows"))


def kept_trend(spark: SparkSession, folder: str) -> DataFrame:
    """Sums and counts per hour of the rows that were in time."""
    last = marker(spark, folder)
    return _hours(folder).all(spark, last.batch_id + 1 if last else 0).drop("batch_id")


def late_rows(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """The rows that came too late, with the batch that brought them."""
    last = marker(spark, folder)
    if last is None:
        return spark.createDataFrame([], schema).withColumn("batch_id", F.lit(None).cast("bigint"))
    full = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    return spark.read.schema(full).parquet(f"{folder}/late").filter(F.col("batch_id") <= last.batch_id)


def trend_of(hours: DataFrame) -> DataFrame:
    """Mean urgency per hour out of sums and counts, several rows of an hour added up."""
    whole = hours.groupBy("hour").agg(F.sum("urgency").alias("urgency"), F.sum("rows").alias("rows"))
    return whole.select("hour", (F.col("urgency") / F.col("rows")).alias("mean_urgency"), "rows")


def stream_trend(rows: DataFrame, delay: str = "2 hours", event_time: str = "ts") -> DataFrame:
    """Mean urgency per hour; a stream drops rows later than ``delay``. Missing urgency counts as 0."""
    timed = rows.withColumn(event_time, F.col(event_time).cast("timestamp"))
    if rows.isStreaming:
        timed = timed.withWatermark(event_time, delay)
    return timed.groupBy(F.window(event_time, "1 hour").alias("w")).agg(
        F.avg(F.coalesce(F.col("urgency").cast("double"), F.lit(0.0))).alias("mean_urgency"),
        F.count(F.lit(1)).alias("rows"),
    ).select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "mean_urgency", "rows")
