"""Deduplication and limits per feed, source, topic and query."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.functions import fixed_values as V
from pageloom.functions.urls import is_useful, score_sitemap
from pageloom.operators.skew import per_key_limit, spread_rank
from pageloom.session import materialize


def dedupe_urls(df: DataFrame, pos: str = "pos") -> DataFrame:
    """Each url once, with its first position."""
    return df.groupBy("url").agg(F.min(pos).alias(pos))


def usable_sitemaps(sitemaps: DataFrame) -> DataFrame:
    return sitemaps.withColumn("score", score_sitemap("sitemap_url")).filter(F.col("score") > V.SITEMAP_CUT)


def rank_sitemaps(sitemaps: DataFrame) -> DataFrame:
    """Usable sitemaps of each host by falling score; equal scores in the order of the url hash."""
    return spread_rank(usable_sitemaps(sitemaps), ["host"], [("score", True)], "sitemap_url", "rank")


def feed_limit(items: DataFrame, n: int | str = 10) -> DataFrame:
    """First ``n`` items of each feed; ``n`` may be the feed's own limit column.

    Items carry their place in the feed, counted before items without a link are dropped, so the
    cut is a filter.
    """
    return items.filter(F.col("pos") < (F.col(n) if isinstance(n, str) else F.lit(n)))


def discovery_limit(links: DataFrame, n: int) -> DataFrame:
    """First ``n`` distinct urls per source over its ranked sitemaps: (source, rank, pos, url)."""
    first = links.groupBy("source", "url").agg(F.min(F.struct("rank", "pos")).alias("at"))
    return per_key_limit(first, "source", ["at", "url"], n, spread="url").select("source", "url")


def search_targets(results: DataFrame, n: int = 10) -> DataFrame:
    """Urls to read per topic: the first provider's useful ones, else ``n`` of the second provider's.

    The second provider is asked for twice as many and its useful results are cut to ``n``.
    """
    excluded = reduce(lambda a, b: a | b, (F.col("url").contains(d) for d in V.EXCLUDED_SEARCH_DOMAINS))
    useful = results.filter(F.coalesce(F.col("url"), F.lit("")) != "").filter(is_useful("url"))
    first = useful.filter((F.col("provider") == "A") & ~excluded & (F.col("rank") <= n))
    served = first.select("topic").distinct()
    fetched = useful.filter((F.col("provider") == "B") & (F.col("rank") <= 2 * n))
    fallback = per_key_limit(fetched.join(served, "topic", "left_anti"), "topic", ["rank", "url"], n, spread="url")
    return first.unionByName(fallback).select("topic", "provider", "rank", "url")


def gap_targets(targets: DataFrame, n: int, per_query: int = V.URLS_PER_QUERY) -> DataFrame:
    """Urls to fetch for a run: the first of each query, each once, ``n`` per run.

    ``targets``: (run, query_pos, rank, url).
    """
    each = per_key_limit(targets, ["run", "query_pos"], ["rank", "url"], per_query, spread="url")
    first = each.groupBy("run", "url").agg(F.min(F.struct("query_pos", "rank")).alias("at"))
    if n <= 0:
        return first.select("run", "url").limit(0)
    return per_key_limit(first, "run", ["at", "url"], n, spread="url").select("run", "url")


def union_results(*frames: DataFrame) -> DataFrame:
    """All result rows, duplicates kept."""
    return reduce(lambda a, b: a.unionByName(b), frames)


def union_discovery(sitemap_urls: DataFrame, crawl_urls: DataFrame, force: bool = False) -> DataFrame:
    """Urls per source (source, url): from its sitemaps, else, or when forced, from the crawl.

    The listed urls are used twice and written once.
    """
    crawled = crawl_urls.select("source", "url")
    if force:
        return crawled.distinct()
    listed = materialize(sitemap_urls.select("source", "url").distinct())
    unlisted = crawled.join(listed.select("source").distinct(), "source", "left_anti").distinct()
    return listed.unionByName(unlisted)


def run_counts(rows: DataFrame, by: str, **conditions) -> DataFrame:
    """Row count and one count per named condition, for each value of ``by``."""
    counts = [F.count_if(condition).alias(name) for name, condition in conditions.items()]
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("rows"), *counts)
