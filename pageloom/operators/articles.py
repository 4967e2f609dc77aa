"""Reading the article table: lists, search, newest rows, dashboard tables, lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pageloom import schemas
from pageloom.functions import fixed_values as V
from pageloom.functions.jsonx import tags_text
from pageloom.functions.schedule import numeric_urgency, to_ts
from pageloom.functions.urls import netloc

LIST_COLS = ("id", "url", "title", "author", "published_date", "summary", "main_image", "created_at")
DASHBOARD_COLS = (
    "id", "url", "title", "created_at", "ai_category", "ai_urgency", "ai_tags", "summary",
    "ai_status", "ai_error_log", "source_id",
)


def newest_first() -> list[Column]:
    """Missing dates lead, as in the store this replaces; equal dates by id, newest id first."""
    return [F.desc_nulls_first("created_at"), F.desc("id")]


def article_list(articles: DataFrame) -> DataFrame:
    return articles.select(*LIST_COLS)


def article_detail(articles: DataFrame, article_id: int) -> DataFrame:
    return articles.filter(F.col("id") == article_id).select(*LIST_COLS, "clean_text")


def keyword_search(articles: DataFrame, term: str | None) -> DataFrame:
    """Title or summary holds the term in any case; ``%`` and ``_`` are wildcards, a backslash is itself; no term, no filter."""
    if not term:
        return articles
    escaped = term.replace("\\", "\\\\")
    like = f"%{escaped}%"
    return articles.filter(F.col("title").ilike(like) | F.col("summary").ilike(like))


def filter_category(articles: DataFrame, categories: Sequence[str]) -> DataFrame:
    return articles.filter(F.col("ai_category").isin(list(categories))) if categories else articles


def filter_embedded(articles: DataFrame) -> DataFrame:
    return articles.filter(F.col("embedding").isNotNull())


def filter_pending(articles: DataFrame) -> DataFrame:
    """Rows still to be enriched: they have an id and are not completed."""
    return articles.filter(F.col("id").isNotNull() & ~F.col("ai_status").eqNullSafe(schemas.COMPLETED))


def latest_page(articles: DataFrame, skip: int = 0, limit: int = 20) -> DataFrame:
    return articles.orderBy(*newest_first()).offset(skip).limit(limit)


def latest(articles: DataFrame, n: int = V.NEWEST) -> DataFrame:
    """The newest rows, as the dashboard reads them. Filters belong after this cut, not before."""
    return articles.select(*DASHBOARD_COLS).orderBy(*newest_first()).limit(n)


def coerced(newest: DataFrame) -> DataFrame:
    return newest.withColumns({
        "ai_urgency": numeric_urgency(F.col("ai_urgency")),
        "created_at": to_ts(F.col("created_at")),
        "ai_tags": F.coalesce("ai_tags", F.array().cast("array<string>")),
    })


def priority_articles(newest: DataFrame, threshold: int = V.PRIORITY_URGENCY) -> DataFrame:
    return newest.filter(F.col("ai_urgency") >= threshold)


def top_priority(newest: DataFrame, n: int = V.PRIORITY_CARDS) -> DataFrame:
    """The first rows of high urgency within the newest ones."""
    return priority_articles(newest).orderBy(*newest_first()).limit(n)


def stream_cards(newest: DataFrame) -> DataFrame:
    status = (
        F.when(F.col("ai_status") == schemas.COMPLETED, "✅")
        .when(F.col("ai_status") == schemas.PENDING, "⏳")
        .otherwise("❌")
    )
    score = F.col("ai_urgency").cast("double").cast("string")
    return newest.select(
        "id",
        status.alias("icon"),
        "ai_category",
        "title",
        "summary",
        tags_text(F.col("ai_tags")).alias("tags"),
        F.concat(score, F.lit("/10")).alias("urgency"),
        F.date_format("created_at", "HH:mm a").alias("clock"),
        "url",
    )


def priority_cards(newest: DataFrame) -> DataFrame:
    return top_priority(newest).select("id", "title", F.col("ai_urgency").cast("int").alias("score"), "ai_category")


def category_mix(newest: DataFrame) -> DataFrame:
    """Rows and share per category; the input is already cut to the newest rows."""
    counts = newest.groupBy("ai_category").agg(F.count(F.lit(1)).alias("n"))
    everything = W.partitionBy(F.lit(0))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(everything))


def urgency_trend(newest: DataFrame) -> DataFrame:
    """Mean urgency per hour; hours between the first and the last without rows are there with null."""
    hourly = (
        newest.filter(F.col("created_at").isNotNull())
        .groupBy(F.date_trunc("hour", F.col("created_at")).cast("timestamp_ntz").alias("hour"))
        .agg(F.avg(numeric_urgency(F.col("ai_urgency"))).alias("mean_urgency"))
    )
    spine = hourly.agg(F.min("hour").alias("a"), F.max("hour").alias("b")).filter("a is not null").select(
        F.explode(F.sequence("a", "b", F.expr("interval 1 hour"))).alias("hour")
    )
    return spine.join(hourly, "hour", "left")


def distinct_categories(newest: DataFrame) -> DataFrame:
    return newest.select("ai_category").distinct()


def with_source(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """Add ``source_id`` by the domain of the url; null when the domain is not registered."""
    domains = sources.select("domain", F.col("id").alias("source_id"))
    keyed = articles.drop("source_id").withColumn("domain", netloc("url"))
    return keyed.join(domains, "domain", "left").drop("domain")


def source_articles(sources: DataFrame, articles: DataFrame) -> DataFrame:
    """Articles of each source, one row per pair; sources without articles are absent."""
    wanted = sources.select("domain", F.col("id").alias("source_id"))
    keyed = articles.drop("source_id").withColumn("domain", netloc("url"))
    return keyed.join(wanted, "domain")


def new_urls(candidates: DataFrame, articles: DataFrame) -> DataFrame:
    """Candidates whose url is not stored yet."""
    return candidates.join(articles.select("url"), "url", "left_anti")


def articles_by_ids(articles: DataFrame, ids: DataFrame) -> DataFrame:
    return articles.join(ids.select("id"), "id", "left_semi")
