"""Monitoring jobs: which are due, what they start, how often they should run."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom import schemas
from pageloom.functions import fixed_values as V
from pageloom.functions.schedule import is_due
from pageloom.functions.urls import netloc


def active_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.filter("is_active")


def due_jobs(jobs: DataFrame, now: Column) -> DataFrame:
    """Active jobs that never ran or whose interval has passed."""
    return active_jobs(jobs).filter(is_due(F.col("last_triggered_at"), F.col("interval_seconds"), now))


def jobs_newest(jobs: DataFrame) -> DataFrame:
    return jobs.orderBy(F.desc_nulls_first("created_at"), F.desc("id"))


def job_caption(jobs: DataFrame) -> DataFrame:
    caption = F.format_string(
        "%s | %s items | %ss", F.upper("job_type"), F.col("items_limit").cast("string"),
        F.col("interval_seconds").cast("string"),
    )
    return jobs.select("id", "name", caption.alias("caption"))


def resolve_jobs(jobs: DataFrame, sources: DataFrame) -> DataFrame:
    """Add ``source_id`` by the domain of the job url; null marks a job without a source."""
    domains = sources.select("domain", F.col("id").alias("source_id"))
    return jobs.withColumn("domain", netloc("url")).join(domains, "domain", "left")


def work_rows(resolved: DataFrame) -> DataFrame:
    """Work to start for jobs with a resolved source: one row per job, routed by type.

    A discovery job without a source starts nothing.
    """
    kind = F.col("job_type")
    task = F.when(kind == schemas.RSS, "poll_feed").when(kind == schemas.DISCOVERY, "discover").otherwise("ingest")
    return resolved.filter((kind != schemas.DISCOVERY) | F.col("source_id").isNotNull()).select(
        F.col("id").alias("job_id"),
        task.alias("task"),
        F.when(kind != schemas.DISCOVERY, F.col("url")).alias("url"),
        F.when(kind == schemas.DISCOVERY, F.col("source_id")).alias("source_id"),
        F.when(kind != schemas.SINGLE, F.col("items_limit")).alias("items_limit"),
    )


def interval_state(history: DataFrame, *by: Column) -> DataFrame:
    """What the enriched articles of each job leave behind: (job_id, ts, seq, urgency) to one row per job (and ``by``).

    Only maxima and a count, which Spark computes partially before the shuffle, so the history of a
    busy job never meets in one task. The same aggregation runs over a stream.
    """
    at = F.struct("ts", "seq")
    urgency = F.coalesce(F.col("urgency"), F.lit(0))
    reset = F.when(urgency >= V.HOT_URGENCY, V.HOT_INTERVAL).when(urgency >= V.WARM_URGENCY, V.WARM_INTERVAL)
    calm = (urgency != 0) & (urgency < V.WARM_URGENCY)
    return history.groupBy("job_id", *by).agg(
        F.max(F.when(urgency != 0, F.col("ts"))).alias("last_seen"),
        F.max(F.when(reset.isNotNull(), F.struct(at.alias("at"), reset.alias("value")))).alias("reset"),
        F.max(F.when(calm, at)).alias("last_calm"),
        F.count_if(calm).alias("n_calm"),
    )


def merged_state(states: DataFrame) -> DataFrame:
    """One row per job out of several, each of another part of its history."""
    return states.groupBy("job_id").agg(
        F.max("last_seen").alias("last_seen"), F.max("reset").alias("reset"), F.max("last_calm").alias("last_calm"),
        F.sum("n_calm").alias("n_calm"))


def adapted_intervals(jobs: DataFrame, state: DataFrame) -> DataFrame:
    """Interval of each job after the articles summed up in ``interval_state``, in their time order.

    Urgent articles set a constant; after one, any calmer article gives the minimum and keeps it;
    without one, each calmer article shrinks the first interval.
    """
    joined = jobs.join(state.withColumnRenamed("job_id", "id"), "id", "left")
    return joined.select(F.col("id").alias("job_id"), "last_seen", folded_interval().alias("interval_seconds"))


#: After so many steps the largest 32-bit interval has shrunk to the minimum; cutting off fractions only hastens it.
_STEPS = math.ceil(math.log(V.MIN_INTERVAL / (1 << 31)) / math.log(V.SHRINK))


def folded_interval() -> Column:
    """Interval out of the columns ``reset``, ``last_calm``, ``n_calm`` and ``interval_seconds``."""
    start = F.col("interval_seconds")
    steps = F.least(F.coalesce("n_calm", F.lit(0)), F.lit(_STEPS)).cast("int")
    shrunk = F.when(steps == 0, start).otherwise(
        F.aggregate(
            F.sequence(F.lit(1), F.greatest(steps, F.lit(1))),
            start,
            lambda acc, _: F.greatest(F.lit(V.MIN_INTERVAL), (acc * F.lit(V.SHRINK)).cast("int")),
        )
    )
    return (
        F.when(F.col("reset").isNull(), shrunk)
        .when(F.col("last_calm") > F.col("reset.at"), F.lit(V.MIN_INTERVAL))
        .otherwise(F.col("reset.value"))
    )
