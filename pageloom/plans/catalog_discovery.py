"""Queries of limits, discovery, crawling and extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from pageloom.functions.jsonx import content_json
from pageloom.functions.urls import netloc
from pageloom.operators import limits as L
from pageloom.operators.articles import with_source
from pageloom.operators.crawl import crawl_frontier as crawl
from pageloom.operators.extract import extract_articles as extract
from pageloom.operators.redirects import normalized_sources
from pageloom.plans import composites as C
from pageloom.plans import derived as D
from pageloom.plans import oracle_views as O
from pageloom.plans.catalog_tables import now
from pageloom.plans.registry import query
from pageloom.sources import feeds as S
from pageloom.sources.links import link_edges


def _job_feeds(spark, folder):
    """Feeds with the limit of the job that asked for them."""
    limit = (F.length("feed_url") % 5).cast("int")
    return S.feed_items(D.feeds(spark, folder)).withColumn("items_limit", limit)


@query("SELECT feed_url, CAST(pos AS INTEGER) AS pos, url FROM feed_items WHERE pos < length(feed_url) % 5", "feed_items")
def feed_limit(spark, folder):
    return L.feed_limit(_job_feeds(spark, folder), "items_limit").select("feed_url", "pos", "url")


@query("SELECT url, CAST(min(pos) AS INTEGER) AS pos FROM page_links GROUP BY url", "page_links")
def dedupe_urls(spark, folder):
    links = D.pages(spark, folder)
    edges = link_edges(links).select("pos", F.regexp_replace("dst_url", "^http:", "https:").alias("url"))
    return L.dedupe_urls(edges)


def _listed(spark, folder):
    ranked = L.rank_sitemaps(D.sitemap_names(spark, folder)).select("sitemap_url", F.col("host").alias("source"), "rank")
    return S.sitemap_links(D.sitemap_docs(spark, folder)).join(ranked, "sitemap_url").select(
        "source", "rank", F.struct("child", "pos").alias("pos"), "url")


_LISTED = """
    , listed AS (SELECT source, url, row_number() OVER (PARTITION BY source ORDER BY rank, child, pos, url) AS n FROM (
      SELECT r.host AS source, l.url, r.rank, l.child, l.pos,
        row_number() OVER (PARTITION BY r.host, l.url ORDER BY r.rank, l.child, l.pos) AS k
      FROM sitemap_links l JOIN ranked_sitemaps r ON r.sitemap_url = l.sitemap_url) WHERE k = 1)"""


@query(_LISTED + " SELECT source, url FROM listed WHERE n <= 7", "sitemap_links", "ranked_sitemaps")
def discovery_limit(spark, folder):
    return L.discovery_limit(_listed(spark, folder), 7)


@query("SELECT topic, provider, rank, url FROM search_picked", "search_picked")
def search_limit(spark, folder):
    return L.search_targets(D.search_rows(spark, folder), 3)


# A run per language; its queries are the topics, in the order of their names' first letters.
_GAP = """
    , asked AS (SELECT split_part(topic, ' ', 1) AS run, ascii(split_part(topic, ' ', 2)) AS query_pos, rank, url FROM search_picked),
    each AS (SELECT *, row_number() OVER (PARTITION BY run, query_pos ORDER BY rank, url) AS n FROM asked),
    firsts AS (SELECT run, url, query_pos, rank, row_number() OVER (PARTITION BY run, url ORDER BY query_pos, rank) AS k
      FROM each WHERE n <= 3),
    ranked AS (SELECT run, url, row_number() OVER (PARTITION BY run ORDER BY query_pos, rank, url) AS n FROM firsts WHERE k = 1)
    SELECT run, url FROM ranked WHERE n <= 5"""


@query(_GAP, "search_picked")
def gap_fill_targets(spark, folder):
    picked = L.search_targets(D.search_rows(spark, folder), 3)
    asked = picked.select(
        F.substring_index("topic", " ", 1).alias("run"),
        F.ascii(F.element_at(F.split("topic", " "), 2)).alias("query_pos"), "rank", "url")
    return L.gap_targets(asked, 5)


@query("SELECT topic, url FROM search_rows WHERE provider = 'A' UNION ALL SELECT topic, url FROM search_rows WHERE provider = 'B' "
       "UNION ALL SELECT topic, url FROM search_picked", "search_rows", "search_picked")
def union_results(spark, folder):
    rows = D.search_rows(spark, folder)
    parts = [rows.filter(F.col("provider") == p).select("topic", "url") for p in "AB"]
    return L.union_results(*parts, L.search_targets(rows, 3).select("topic", "url"))


@query("SELECT DISTINCT host AS source, url FROM (SELECT r.host, l.url FROM sitemap_links l JOIN ranked_sitemaps r "
       "ON r.sitemap_url = l.sitemap_url WHERE md5(r.host) < '8') UNION "
       f"SELECT {O.netloc('src_url')}, url FROM page_links WHERE {O.netloc('src_url')} NOT IN (SELECT r.host FROM sitemap_links l "
       "JOIN ranked_sitemaps r ON r.sitemap_url = l.sitemap_url WHERE md5(r.host) < '8')",
       "sitemap_links", "ranked_sitemaps", "page_links")
def union_discovery(spark, folder):
    listed = _listed(spark, folder).filter(F.md5("source") < "8")
    crawled = link_edges(D.pages(spark, folder)).select(
        netloc("src_url").alias("source"), F.regexp_replace("dst_url", "^http:", "https:").alias("url"))
    return L.union_discovery(listed, crawled)


@query("SELECT seed, url, CAST(depth AS INTEGER) AS depth FROM host_crawl WHERE n <= 50", "host_crawl")
def crawl_frontier(spark, folder):
    """From every host's root over the links of its pages."""
    seeds = D.hosts(spark, folder).select(F.concat(F.lit("https://"), F.col("host")).alias("seed"))
    return crawl(seeds, link_edges(D.host_pages(spark, folder)))


# A chain down to every 64th page, and a loop of two before it.
@query("""SELECT page_id, 'https://r.example.com/' || page_id AS url, CASE WHEN page_id % 64 IN (62, 63) THEN 'https://r.example.com/' || page_id
            ELSE 'https://r.example.com/' || (page_id - page_id % 64) END AS base FROM pages""")
def redirect_chains(spark, folder):
    to = F.expr("case page_id % 64 when 62 then page_id + 1 else page_id - 1 end")
    place = lambda c: F.concat(F.lit("https://r.example.com/"), c.cast("string"))
    rows = D.page_urls(spark, folder).select("page_id", place(F.col("page_id")).alias("url"))
    hops = D.page_urls(spark, folder).filter("page_id % 64 <> 0").select(place(F.col("page_id")).alias("url"), place(to).alias("final_url"))
    return normalized_sources(rows, hops)


@query("SELECT host AS source, base AS seed FROM host_bases", "host_bases")
def source_addresses(spark, folder):
    """Where discovery of each source starts."""
    return C.find_sitemaps(D.sources(spark, folder), D.redirects(spark, folder), D.robots_files(spark, folder), D.fetches(spark, folder))[0]


# The drop, container and line rules of the extraction, in the other engine's regular expressions.
_DROP = (r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)|<head\b.*?</head\s*>"
         r"|<nav\b.*?</nav\s*>|<header\b.*?</header\s*>|<footer\b.*?</footer\s*>|<div class=\"ad\">.*?</div\s*>")
EXTRACTED = rf"""
    SELECT page_id, url, coalesce(nullif(h1, ''), doc_title) AS title, clean_text, {O.excerpt('clean_text')} AS summary FROM (
      SELECT page_id, url, trim(regexp_replace(replace(regexp_extract(html, '(?is)<h1\b[^>]*>(.*?)</h1\s*>', 1), '&amp;', '&'), '\s+', ' ', 'g')) AS h1,
        trim(replace(regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title\s*>', 1), '&amp;', '&')) AS doc_title,
        regexp_replace(regexp_replace(regexp_replace(t, '[ \t\r]+', ' ', 'g'), ' *\n\s*', chr(10), 'g'), '^\s+|\s+$', '', 'g') AS clean_text
      FROM (SELECT page_id, url, html, replace(replace(replace(replace(replace(regexp_replace(regexp_replace(
          regexp_extract(regexp_replace(html, '{_DROP}', '', 'g'), '(?is)<article\b[^>]*>(.*)</article\s*>', 1),
          '(?i)<br\s*/?>|</?(?:p|h[1-6]|li|tr|div)\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g'),
          '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS t FROM page_log WHERE html IS NOT NULL))"""


@query(EXTRACTED, "page_log")
def extract_articles(spark, folder):
    pages = D.page_log(spark, folder).filter("html is not null").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "title", "clean_text", "summary")


@query(f"SELECT page_id, CAST(json_object('scraped_at', '2024-01-31T00:00:00', 'raw_metadata', json_object('title', title, 'author', NULL, "
       "'published_date', NULL, 'clean_text', clean_text, 'main_image', NULL, 'summary', summary)) AS VARCHAR) AS content "
       f"FROM ({EXTRACTED})", "page_log")
def article_content_json(spark, folder):
    pages = D.page_log(spark, folder).filter("html is not null").select("page_id", "url", "html")
    return extract(pages).select("page_id", content_json(now()).alias("content"))


# Stored before the run: an article for every third page.
_INGESTED = f"""
    , x AS ({EXTRACTED}),
    ok AS (SELECT x.* FROM x JOIN robots_allowed r ON r.url = x.url AND r.allowed),
    old AS (SELECT page_id AS id, url, 'old title' AS title FROM pages WHERE page_id % 3 = 0)
    SELECT o.id, o.url, coalesce(k.title, o.title) AS title, CASE WHEN k.url IS NULL THEN 'completed' ELSE 'pending' END AS ai_status,
      k.clean_text, CASE WHEN k.url IS NOT NULL THEN {O.netloc('o.url')} END AS domain FROM old o LEFT JOIN ok k ON k.url = o.url
    UNION ALL SELECT (SELECT max(id) FROM old) + row_number() OVER (ORDER BY md5(url), url), url, title, 'pending', clean_text,
      {O.netloc('url')} FROM ok WHERE url NOT IN (SELECT url FROM old)"""


def _stored(spark, folder):
    none = [F.lit(None).cast(t).alias(n) for n, t in (
        ("source_id", "bigint"), ("author", "string"), ("published_date", "string"), ("summary", "string"),
        ("main_image", "string"), ("clean_text", "string"), ("content", "string"), ("ai_error_log", "string"))]
    return D.page_urls(spark, folder).filter("page_id % 3 = 0").select(
        F.col("page_id").alias("id"), "url", F.lit("old title").alias("title"), F.lit("completed").alias("ai_status"),
        now().alias("created_at"), *none)


def _ingested(spark, folder):
    return C.ingest_pages(
        D.page_log(spark, folder), D.robots_files(spark, folder), _stored(spark, folder), D.sources(spark, folder, "8"), now())


@query(_INGESTED, "page_log", "robots_allowed")
def ingest_pages(spark, folder):
    done = _ingested(spark, folder)
    domains = done.sources.select(F.col("id").alias("source_id"), "domain")
    return done.articles.join(domains, "source_id", "left").select("id", "url", "title", "ai_status", "clean_text", "domain")


@query(f"""SELECT p.url, CASE WHEN NOT r.allowed THEN 'WARN' WHEN p.html IS NULL THEN 'ERROR' ELSE 'INFO' END AS level,
             CASE WHEN NOT r.allowed THEN 'Blocked by robots.txt: ' || p.url WHEN p.html IS NULL THEN 'Network Error: HTTP 503'
               WHEN p.page_id % 3 = 0 THEN 'Updated basic data for ' || {O.netloc('p.url')}
               ELSE 'Created basic data for ' || {O.netloc('p.url')} END AS message
           FROM page_log p JOIN robots_allowed r ON r.url = p.url""", "page_log", "robots_allowed")
def ingest_logs(spark, folder):
    return _ingested(spark, folder).logs.select("url", "level", "message")


@query("""
    , listed AS (SELECT host AS source, url, row_number() OVER (PARTITION BY host ORDER BY pos, url) AS n FROM (
      SELECT h.host, l.url, min(l.pos) AS pos FROM host_sitemaps h JOIN page_links l ON l.page_id = h.page_id WHERE h.page_id % 4 <> 3 GROUP BY ALL)),
    picked AS (SELECT source, url FROM listed WHERE n <= 20)
    SELECT * FROM (SELECT source, url FROM picked UNION SELECT replace(seed, 'https://', ''), url FROM host_crawl WHERE n <= 20
      AND replace(seed, 'https://', '') IN (SELECT host FROM host_bases WHERE NOT starts_with(base, 'https://home.'))
      AND replace(seed, 'https://', '') NOT IN (SELECT source FROM picked))
    WHERE url NOT IN (SELECT url FROM pages)""",
       "page_links", "host_sitemaps", "host_crawl", "host_bases")
def discover_urls(spark, folder):
    """All hosts: redirects, robots files, guessed places and ranks first, then sitemaps, else a crawl of the host's pages."""
    sources = D.sources(spark, folder)
    seeds, sitemaps = C.find_sitemaps(sources, D.redirects(spark, folder), D.robots_files(spark, folder), D.fetches(spark, folder))
    stored = D.page_urls(spark, folder).select("url")
    return C.discover_urls(
        sources, sitemaps, D.host_sitemap_docs(spark, folder), link_edges(D.host_pages(spark, folder)), stored, now(), limit=20, seeds=seeds).urls


@query("""SELECT j.id AS job_id, f.feed_url, CAST(f.pos AS INTEGER) AS pos, f.url FROM feed_items f
          JOIN (SELECT page_id AS id, url, 2 + page_id % 3 AS n FROM pages WHERE page_id % 2 = 0) j ON j.url = f.feed_url
          WHERE f.pos < j.n AND f.url NOT IN (SELECT url FROM page_links WHERE page_id % 10 = 1)""", "feed_items", "page_links")
def poll_feeds(spark, folder):
    feed_jobs = D.page_urls(spark, folder).filter("page_id % 2 = 0").select(
        F.col("page_id").alias("id"), "url", F.lit("rss").alias("job_type"), (F.col("page_id") % 3 + 2).cast("int").alias("items_limit"))
    stored = link_edges(D.pages(spark, folder).filter("page_id % 10 = 1")).select(
        F.regexp_replace("dst_url", "^http:", "https:").alias("url"))
    return C.poll_feeds(D.feeds(spark, folder), feed_jobs, stored)
