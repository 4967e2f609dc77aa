"""Breadth-first walk over the stored link graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.functions.urls import classify_link, is_useful, netloc, path, without_www
from pageloom.operators.skew import per_key_limit
from pageloom.session import bucketed, discard, materialize


def _step(frontier: DataFrame, links: DataFrame) -> DataFrame:
    """Pages one link away from the frontier, each with its first way there. Links stay on their host, and so does the walk."""
    dealt = frontier.withColumn("page", F.rtrim(F.col("url"), F.lit("/"))).drop("url")
    way = F.min(F.concat("way", F.array(F.col("pos").cast("int")))).alias("way")
    return dealt.join(links, "page").groupBy("seed", "dst_url", "kind").agg(way).select("seed", F.col("dst_url").alias("url"), "kind", "way")


def crawl_frontier(seeds: DataFrame, edges: DataFrame, max_articles: int = 50, depth: int = 2) -> DataFrame:
    """Article links within ``depth`` index pages of each seed: the first ``max_articles`` in crawl order.

    ``seeds``: (seed) base urls. ``edges``: (src_url, pos, dst_url). Internal, useful links count; index links are followed,
    articles collected, the rest dropped. A page is placed by the link positions on the way to it, so comparing those arrays
    within a level is comparing queue order. A url with and without a slash at its end is the same page.

    Links that stay on a seed's host are written once, clustered by page; each level joins only the pages first met in the level
    before to them, and moves these, not the links. A seed that has its articles is not followed further.
    """
    host = lambda url: without_www(netloc(url))
    seeds = materialize(seeds.filter("seed is not null").select("seed").distinct())
    links = edges.filter(is_useful("dst_url")).select(
        F.rtrim(F.col("src_url"), F.lit("/")).alias("page"), "pos", "dst_url", classify_link(path("dst_url")).alias("kind"), host("src_url").alias("host")
    ).filter((F.col("kind") != "unknown") & (F.col("host") == host("dst_url")))
    links = links.join(seeds.select(host("seed").alias("host")).distinct(), "host", "left_semi").drop("host")
    links = bucketed(links, "page")
    frontier = seeds.select("seed", F.col("seed").alias("url"), F.array().cast("array<int>").alias("way"))
    visited = frontier.select("seed", "url")
    found: DataFrame | None = None
    for level in range(depth + 1):
        stepped = materialize(_step(frontier, links))
        articles = stepped.filter("kind = 'article'").select(
            "seed", "url", F.struct(F.lit(level).alias("depth"), "way").alias("at")
        )
        found = articles if found is None else (
            found.unionByName(articles).groupBy("seed", "url").agg(F.min("at").alias("at"))
        )
        if level == depth:
            break
        full = found.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= max_articles)
        frontier = materialize(
            stepped.filter("kind = 'index'").select("seed", "url", "way")
            .join(visited, ["seed", "url"], "left_anti")
            .join(full, "seed", "left_anti")
        )
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier.select("seed", "url"))
    out = materialize(per_key_limit(found, "seed", ["at"], max_articles, spread="url").select("seed", "url", F.col("at.depth").alias("depth")))
    discard(links)
    return out
