"""Canonical inputs of the registered queries, derived by Spark from the given tables.

Every view is a row-by-row or partially aggregated function of a given table, so it grows with it.
``oracle_views.py`` states the same views in SQL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.functions.text import excerpt
from pageloom.functions.urls import netloc
from pageloom.operators.skew import assign_ids, spread_rank
from pageloom.sources.links import hrefs
from pageloom.sources.tables import table


def ts(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


_NULL_TEXT = "cast(null as string)"
# Article columns as expressions over documents (d), labels (l) and embeddings (e).
_ARTICLE = {
    "id": "doc_id",
    "source_id": "cast(null as bigint)",
    "url": "concat('https://', source, '.example.com/', lang, '/', doc_id)",
    "title": "substring_index(text, '\\n', 1)",
    "author": _NULL_TEXT,
    "published_date": _NULL_TEXT,
    "summary": "case when length(text) > 200 then concat(substring(text, 1, 200), '...') else text end",
    "main_image": _NULL_TEXT,
    "clean_text": "text",
    "embedding": "embedding",
    "content": _NULL_TEXT,
    "ai_status": "case when toxic is null then 'pending' when toxic = 1 then 'failed' else 'completed' end",
    "ai_error_log": "case when toxic = 1 then 'AI returned no data' end",
    "ai_tags": "case when toxic is not null then array(lang, source) end",
    "ai_category": "lang",
    "ai_urgency": "case when toxic is not null then cast(doc_id % 10 + 1 as int) end",
    "created_at": "timestamp_ntz'2024-01-01 00:00:00' + (doc_id % 1000000) * interval '137' minute",
}
_LABELLED = {"ai_status", "ai_error_log", "ai_tags", "ai_urgency"}


def articles(
    spark: SparkSession, folder: str, cols: Sequence[str] | None = None
) -> DataFrame:
    """The article table; only the tables behind the asked columns are read."""
    cols = list(cols or _ARTICLE)
    df = table(spark, folder, "documents")
    if _LABELLED & set(cols):
        df = df.join(table(spark, folder, "labels", ["doc_id", "toxic"]), "doc_id", "left")
    if "embedding" in cols:
        vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
        df = df.join(vectors, "doc_id", "left")
    return df.selectExpr(*[f"{_ARTICLE[c]} as {c}" for c in cols])


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages")


def page_urls(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages", ["page_id", "url"])


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def page_log(spark: SparkSession, folder: str) -> DataFrame:
    """Fetch log: every tenth page answered 503 and has no content."""
    lost = F.col("page_id") % 10 == 9
    return pages(spark, folder).select(
        "page_id", "url", F.col("url").alias("final_url"),
        F.when(~lost, F.col("html")).alias("html"),
        F.when(lost, 503).otherwise(200).alias("status"),
        F.when(lost, "HTTP 503").alias("error"),
    )


def hosts(spark: SparkSession, folder: str) -> DataFrame:
    return page_urls(spark, folder).select(netloc("url").alias("host")).distinct()


def sources(spark: SparkSession, folder: str, registered: str = "~") -> DataFrame:
    """Source table of the page hosts; only hosts whose hash sorts before ``registered`` are in it."""
    some = hosts(spark, folder).filter(F.md5("host") < registered).select(F.col("host").alias("domain"))
    return assign_ids(some, "domain").select(
        "id", "domain",
        F.concat(F.lit("https://"), F.col("domain"), F.lit("/robots.txt")).alias("robots_url"),
        F.lit(None).cast("timestamp_ntz").alias("last_crawled"),
        F.lit(True).alias("is_active"),
        ts("2024-01-01 00:00:00").alias("created_at"),
    )


def robots_files(spark: SparkSession, folder: str) -> DataFrame:
    """One robots file per page host; its kind follows the first hash digit of the host."""
    h, digit = F.col("host"), F.substring(F.md5("host"), 1, 1)
    general = F.concat(
        F.lit("# all robots\nUser-agent: *\nDisallow: /en/1 # archive\nCrawl-delay: 5\nDisallow: /fr\nAllow: /\n\n"
              "Disallow: /de\nSitemap: https://"), h, F.lit("/sitemap.xml\n"))
    named = F.concat(
        F.lit("User-agent: otherbot\nUser-agent: MyBot\nDisallow: /de\nAllow: /de/1\n\nUser-agent: *\nDisallow: /\n"
              "sitemap: https://"), h, F.lit("/sitemap-news.xml  \nSitemap:https://"), h, F.lit("/hindi.xml\n"))
    opened = F.lit("User-agent: lonely\n\nUser-agent: *\nDisallow:\nDisallow: /es\n")
    text = (
        F.when(digit < "4", general).when(digit < "8", named).when(digit < "c", opened)
    )
    status = (
        F.when(digit < "c", 200).when(digit == "c", 403).when(digit == "d", 404).when(digit == "e", 500)
    )
    return hosts(spark, folder).select("host", status.alias("status"), text.alias("robots_txt"))


def jobs(spark: SparkSession, folder: str) -> DataFrame:
    """One job per event user, of the type its number gives; the last event is its last run."""
    u = F.col("user_id")
    site = F.concat(F.lit("https://src"), (u % 30).cast("string"), F.lit(".example.com"))
    kind = F.when(u % 3 == 0, "rss").when(u % 3 == 1, "discovery").otherwise("single")
    per_user = table(spark, folder, "events", ["user_id", "ts"]).groupBy("user_id").agg(
        F.min("ts").alias("first"), F.max("ts").alias("last")
    )
    return per_user.select(
        u.alias("id"),
        F.concat(F.lit("job "), u.cast("string")).alias("name"),
        F.when(u % 3 == 0, F.concat(site, F.lit("/feed"))).when(u % 3 == 1, site)
        .otherwise(F.concat(site, F.lit("/2024/05/x"))).alias("url"),
        kind.alias("job_type"),
        F.when(u % 3 == 2, 1).otherwise(10).alias("items_limit"),
        F.when(u % 3 == 0, 300).when(u % 3 == 1, 3600).otherwise(86400).alias("interval_seconds"),
        (u % 5 != 0).alias("is_active"),
        F.when(u % 7 != 0, F.col("last")).alias("last_triggered_at"),
        F.col("first").alias("created_at"),
    )


def history(spark: SparkSession, folder: str) -> DataFrame:
    """Enriched articles per job: every event of a user; users of every third number stay calm."""
    e, u = F.col("event_id"), F.col("user_id")
    urgency = F.when(u % 3 == 0, e % 4 + 1).otherwise(e % 10).cast("int")
    return table(spark, folder, "events").select(
        u.alias("job_id"), "ts", e.alias("seq"), urgency.alias("urgency")
    )


def status_events(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_type")
    status = (
        F.when(kind == "view", "pending").when(kind == "purchase", "completed").when(kind == "error", "failed")
        .otherwise("processing")
    )
    return table(spark, folder, "events").select(
        F.col("user_id").alias("article_id"), "ts", F.col("event_id").alias("seq"), status.alias("status")
    )


def replies(spark: SparkSession, folder: str) -> DataFrame:
    """Model replies: four providers per article, wrapped by event type."""
    kind, props = F.col("event_type"), F.col("props")
    raw = (
        F.when(kind == "view", F.concat(F.lit("```json\n"), props, F.lit("\n```")))
        .when(kind == "click", F.concat(F.lit("Sure, here it is: "), props, F.lit(" Anything else?")))
        .when(kind == "error", "I cannot answer that {today}")
        .when(kind == "purchase", "{}")
        .otherwise(None)
    )
    e = F.col("event_id")
    return table(spark, folder, "events").select(
        F.floor(e / 4).alias("article_id"), F.concat(F.lit("p"), (e % 4).cast("string")).alias("provider"),
        (e % 4).cast("int").alias("priority"), raw.alias("raw"),
    )


def search_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Stored search results: page rows by two providers, one topic per language and host."""
    p = F.col("page_id")
    lang = F.regexp_extract("url", r"//[^/]+/([a-z]+)/", 1)
    return page_urls(spark, folder).select(
        F.concat(lang, F.lit(" "), netloc("url")).alias("topic"),
        F.when(p % 2 == 0, "A").otherwise("B").alias("provider"),
        (F.floor(p / 2) % 12 + 1).cast("int").alias("rank"), "url",
        F.concat(F.lit("page "), p.cast("string")).alias("title"),
    )


def _page_links() -> Column:
    root = F.concat(F.lit("https://"), netloc("url"))
    return F.transform(hrefs(F.col("html")), lambda h: F.concat(root, h))


def _xml(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def feeds(spark: SparkSession, folder: str) -> DataFrame:
    """One feed per page, its items being the page's links: RSS, Atom, or RSS that is cut short.

    Every fourth item lacks a link.
    """

    def rss(link: Column, i: Column) -> Column:
        tag = F.when(i % 4 == 3, "").otherwise(F.concat(F.lit("<link> "), _xml(link), F.lit("</link>")))
        return F.concat(F.lit("<item><title>Item "), i.cast("string"), F.lit("</title>"), tag, F.lit("</item>"))

    def atom(link: Column, i: Column) -> Column:
        tag = F.when(i % 4 == 3, "").otherwise(F.concat(
            F.lit('<link rel="self" href="https://self.example.com"/><link rel="alternate" href="'),
            _xml(link), F.lit('"/>')))
        return F.concat(F.lit("<entry><title>Item "), i.cast("string"), F.lit("</title>"), tag, F.lit("</entry>"))

    head = F.lit('<rss version="2.0"><channel><title>Feed</title>')
    as_rss = F.array_join(F.transform(_page_links(), rss), "")
    as_atom = F.array_join(F.transform(_page_links(), atom), "")
    p = F.col("page_id")
    xml = (
        F.when(p % 5 == 4, F.concat(head, as_rss, F.lit("<item><title>cut")))
        .when(p % 2 == 0, F.concat(head, as_rss, F.lit("</channel></rss>")))
        .otherwise(F.concat(F.lit("<feed><title>Feed</title>"), as_atom, F.lit("</feed>")))
    )
    return pages(spark, folder).select(F.col("url").alias("feed_url"), xml.alias("xml"))


_MAP_NAME = (
    "concat('https://maps.example.com/', case page_id % 4 when 0 then 'sitemap-news' when 1 then 'hindi' "
    "when 2 then 'sitemap' else 'world' end, '-', page_id, '.xml')"
)


def sitemap_names(spark: SparkSession, folder: str) -> DataFrame:
    """(host, sitemap_url): one sitemap per page."""
    return page_urls(spark, folder).select(netloc("url").alias("host"), F.expr(_MAP_NAME).alias("sitemap_url"))


def sitemap_docs(spark: SparkSession, folder: str) -> DataFrame:
    """Sitemap documents: the links of a page, or for every fourth page an index naming the page before."""
    before = F.expr(_MAP_NAME.replace("page_id", "(page_id - 1)"))
    urls = F.array_join(F.transform(_page_links(), lambda u: F.concat(F.lit("<url><loc>"), _xml(u), F.lit("</loc></url>"))), "")
    url_set = F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), urls, F.lit("</urlset>"))
    index = F.concat(F.lit("<sitemapindex><sitemap><loc> "), before, F.lit(" </loc></sitemap></sitemapindex>"))
    return pages(spark, folder).select(
        F.expr(_MAP_NAME).alias("sitemap_url"),
        F.when(F.col("page_id") % 4 == 3, index).otherwise(url_set).alias("xml"),
    )


def _site_path(i: Column) -> Column:
    return (
        F.when(i % 3 == 0, F.concat(F.lit("/news/p"), i.cast("string")))
        .when(i % 3 == 1, F.concat(F.lit("/2024/05/p"), i.cast("string")))
        .otherwise(F.concat(F.lit("/about/p"), i.cast("string")))
    )


#: Links that a page of the crawl graph has to later pages of its host.
GRAPH_LINKS = 12


def host_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The pages as a graph per host: page i of a host links to pages 12i+1 to 12i+12, and where its own html links to.

    Pages are numbered in the order of their hash; page 0 is the host's root.
    """
    numbered = spread_rank(
        pages(spark, folder).select("html", netloc("url").alias("host"), F.concat("url", F.lit("|"), F.col("page_id").cast("string")).alias("key")),
        ["host"], [], "key", "n")
    i, root = F.col("n") - 1, F.concat(F.lit("https://"), F.col("host"))
    targets = F.transform(F.sequence(F.lit(1), F.lit(GRAPH_LINKS)), lambda c: _site_path(i * GRAPH_LINKS + c))
    anchors = F.array_join(F.transform(targets, lambda h: F.concat(F.lit('<a href="'), h, F.lit('">x</a>'))), "")
    return numbered.select(
        F.when(i == 0, root).otherwise(F.concat(root, _site_path(i))).alias("url"), F.concat(anchors, F.coalesce("html", F.lit(""))).alias("html"))


def _kind() -> Column:
    return F.substring(F.md5("host"), 1, 1)


def redirects(spark: SparkSession, folder: str) -> DataFrame:
    """Redirects of host addresses, by the first hash digit of the host: a chain to its home name, a loop, a slash, or none."""
    h = F.col("host")
    hop = lambda a, b: F.struct(a.alias("url"), b.alias("final_url"))
    own, home = F.concat(F.lit("https://"), h), F.concat(F.lit("https://home."), h, F.lit("//"))
    m = lambda p: F.concat(F.lit("http://m."), h, F.lit(p))
    chain = F.array(hop(own, m("/a")), hop(m("/a"), m("/b")), hop(m("/b"), home))
    loop = F.array(hop(own, F.concat(own, F.lit("/loop"))), hop(F.concat(own, F.lit("/loop")), own))
    hops = F.when(_kind().isin("0", "1", "8", "9"), chain).when(_kind() == "2", loop).when(_kind() == "3", F.array(hop(own, F.concat(own, F.lit("/")))))
    return hosts(spark, folder).select(F.inline(hops))


def fetches(spark: SparkSession, folder: str) -> DataFrame:
    """Fetch log (url, status) of guessed sitemap places: half of the hosts with a home name have one."""
    place = F.concat(F.lit("https://home."), F.col("host"), F.lit("/sitemap.xml"))
    return hosts(spark, folder).select(place.alias("url"), F.when(_kind().isin("0", "8"), 200).otherwise(404).alias("status"))


def host_sitemap_docs(spark: SparkSession, folder: str) -> DataFrame:
    """Sitemaps of hosts, index documents that name the sitemap of their first or last page, and those sitemaps."""
    ends = page_urls(spark, folder).groupBy(netloc("url").alias("host")).agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"))

    def index(url: Column, page: str) -> Column:
        named = F.expr(_MAP_NAME.replace("page_id", page))
        return F.struct(url.alias("sitemap_url"), F.concat(F.lit("<sitemapindex><sitemap><loc>"), named, F.lit("</loc></sitemap></sitemapindex>")).alias("xml"))

    h = F.col("host")
    docs = F.array(
        index(F.concat(F.lit("https://"), h, F.lit("/sitemap.xml")), "first"), index(F.concat(F.lit("https://home."), h, F.lit("/sitemap.xml")), "first"),
        index(F.concat(F.lit("https://"), h, F.lit("/sitemap-news.xml")), "last"))
    return ends.select(F.inline(docs)).unionByName(sitemap_docs(spark, folder))


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """Research runs: one per conversation, its opening being the prompt."""
    c = F.col("conv_id")
    none = F.array().cast("array<string>")
    return table(spark, folder, "conversations").filter("turn = 0").select(
        c.alias("id"),
        F.concat(F.lit("gen_"), c.cast("string")).alias("task_id"),
        F.col("text").alias("user_prompt"),
        F.when(c % 3 == 1, excerpt(F.col("text"))).alias("generated_text"),
        F.when(c % 3 == 1, "completed").when(c % 7 == 0, "failed").otherwise("processing").alias("status"),
        F.when(c % 2 == 0, F.array(F.lit("query one"), F.lit("query two"))).when(c % 5 == 0, none).alias("search_queries"),
        F.when(c % 3 == 1, F.sequence(F.lit(1), c % 10 + 1).cast("array<bigint>")).alias("used_article_ids"),
        ts("2024-01-01 00:00:00").alias("created_at"),
        ts("2024-01-01 00:00:00").alias("updated_at"),
    )


def topics(spark: SparkSession, folder: str) -> DataFrame:
    """Research queries: the benchmark items, each with the vector of its number, if there is one."""
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    items = table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("prompt"))
    return items.join(vectors, "query_id", "left")
