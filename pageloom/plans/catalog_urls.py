"""Queries of url, text and link functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from pageloom.functions import text as X
from pageloom.functions import urls as U
from pageloom.operators import limits as L
from pageloom.operators.robots_join import allowed_urls as allowed
from pageloom.operators.robots_join import robots_join as robots
from pageloom.plans import derived as D
from pageloom.plans import oracle_views as O
from pageloom.plans.registry import query
from pageloom.sources import feeds as S
from pageloom.sources import robots as R
from pageloom.sources.links import extract_links as links_of
from pageloom.sources.tables import fetched_pages, search_results, table


@query("SELECT page_id, url, final_url, status, error, CAST(length(html) AS INTEGER) AS chars, md5(html) AS digest FROM page_log",
       "page_log")
def scan_pages(spark, folder):
    return fetched_pages(D.page_log(spark, folder)).select(
        "page_id", "url", "final_url", "status", "error", F.length("html").alias("chars"), F.md5("html").alias("digest")
    )


@query("SELECT src_url, CAST(pos AS INTEGER) AS pos, href FROM links", "links")
def extract_links(spark, folder):
    return links_of(D.pages(spark, folder))


@query("SELECT feed_url, CAST(pos AS INTEGER) AS pos, url, title FROM feed_items", "feed_items")
def scan_feed_items(spark, folder):
    return S.feed_items(D.feeds(spark, folder))


@query("SELECT sitemap_url, kind, CAST(pos AS INTEGER) AS pos, loc FROM sitemap_rows", "sitemap_rows")
def scan_sitemap_urls(spark, folder):
    return S.sitemap_urls(D.sitemap_docs(spark, folder))


@query("SELECT sitemap_url, CAST(child AS INTEGER) AS child, CAST(pos AS INTEGER) AS pos, url FROM sitemap_links", "sitemap_links")
def scan_sitemap_index(spark, folder):
    return S.sitemap_links(D.sitemap_docs(spark, folder))


@query("SELECT DISTINCT host, trim(s) AS sitemap_url FROM (SELECT host, "
       r"unnest(regexp_extract_all(robots_txt, '(?im)^Sitemap:\s*(.+)$', 1)) AS s FROM robots_files)", "robots_files")
def scan_robots_sitemaps(spark, folder):
    return R.robots_sitemaps(D.robots_files(spark, folder))


@query("""SELECT host, 'https://' || host || p AS sitemap_url FROM hosts,
            (SELECT unnest(['/sitemap.xml', '/sitemap_index.xml', '/sitemap-news.xml']) AS p)
          WHERE substring(md5(host), 1, 1) >= '8' AND ((p = '/sitemap.xml' AND substring(md5(host), 2, 1) < '8')
            OR (p = '/sitemap-news.xml' AND substring(md5(host), 2, 1) > 'b'))""", "hosts")
def guess_sitemaps(spark, folder):
    hosts, h = D.hosts(spark, folder), F.md5("host")
    declared = R.robots_sitemaps(D.robots_files(spark, folder))
    digit = F.substring(h, 2, 1)
    answers = F.array(
        F.struct(F.lit("/sitemap.xml").alias("p"), F.when(digit < "8", 200).otherwise(404).alias("status")),
        F.struct(F.lit("/sitemap-news.xml").alias("p"), F.when(digit > "b", 200).otherwise(404).alias("status")),
    )
    fetches = hosts.select("host", F.inline(answers)).select(
        F.concat(F.lit("https://"), F.col("host"), F.col("p")).alias("url"), "status"
    )
    return R.guess_sitemaps(hosts.join(declared, "host", "left_anti"), fetches)


@query("SELECT host, grp, array_to_string(agents, '|') AS agents, CAST(seq AS INTEGER) AS seq, allow, prefix FROM robots_rules",
       "robots_rules")
def scan_robots_rules(spark, folder):
    rules = R.robots_rules(D.robots_files(spark, folder))
    return rules.withColumn("agents", F.array_join("agents", "|"))


@query("SELECT topic, provider, rank, url, title FROM search_rows", "search_rows")
def scan_search_results(spark, folder):
    return search_results(D.search_rows(spark, folder))


@query("SELECT url, allowed FROM robots_allowed", "robots_allowed")
def robots_join(spark, folder):
    return robots(D.page_urls(spark, folder).select("url"), D.robots_files(spark, folder))


@query("SELECT url FROM robots_allowed WHERE allowed", "robots_allowed")
def allowed_urls(spark, folder):
    return allowed(D.page_urls(spark, folder).select("url"), D.robots_files(spark, folder))


@query(f"SELECT page_id, url, {O.useful('url')} AS useful FROM pages")
def useful_links(spark, folder):
    return D.page_urls(spark, folder).select("page_id", "url", U.is_useful("url").alias("useful"))


# Targets of each page: its links, the same on its host without www., and one link to another host.
_TARGETS = f"""
    SELECT src_url, dst, replace(regexp_extract(dst, {O.NETLOC}, 1), 'www.', '') = replace({O.netloc('src_url')}, 'www.', '')
      AS internal
    FROM (SELECT src_url, CASE pos % 3 WHEN 0 THEN url WHEN 1 THEN replace(url, '//www.', '//') ELSE
      'https://other.example.com' || href END AS dst FROM (SELECT p.src_url, p.pos, p.url, l.href FROM page_links p
      JOIN links l ON l.page_id = p.page_id AND l.pos = p.pos))"""


@query(_TARGETS, "page_links")
def internal_links(spark, folder):
    url = U.url_join("src_url", "href")
    dst = (
        F.when(F.col("pos") % 3 == 0, F.regexp_replace(url, "^http:", "https:"))
        .when(F.col("pos") % 3 == 1, F.replace(F.regexp_replace(url, "^http:", "https:"), F.lit("//www."), F.lit("//")))
        .otherwise(F.concat(F.lit("https://other.example.com"), F.col("href")))
    )
    rows = links_of(D.pages(spark, folder)).select("src_url", dst.alias("dst"))
    return rows.withColumn("internal", U.is_internal("dst", "src_url"))


@query(f"SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme, {O.netloc('url')} AS netloc, "
       f"{O.path('url')} AS path FROM pages")
def url_parts(spark, folder):
    return D.page_urls(spark, folder).select(
        "page_id", U.scheme("url").alias("scheme"), U.netloc("url").alias("netloc"), U.path("url").alias("path")
    )


# Hrefs of every form but dot segments, on each page url.
_FORMS = ("'https://x.example.org/a?b=1#c'", "'//cdn.example.org/lib'", "'/root/' || page_id", "'?page=' || page_id", "'#part'",
          "'mailto:a@example.org'", "'leaf' || page_id", "''")
_JOINED = f"""
    SELECT page_id, f, CASE f WHEN 0 THEN 'https://x.example.org/a?b=1#c' WHEN 1 THEN s || '://cdn.example.org/lib'
        WHEN 2 THEN root || '/root/' || page_id WHEN 3 THEN root || p || '?page=' || page_id
        WHEN 4 THEN root || p || q || '#part' WHEN 5 THEN 'mailto:a@example.org'
        WHEN 6 THEN root || regexp_replace(p, '[^/]*$', '') || 'leaf' || page_id ELSE url END AS joined
    FROM (SELECT page_id, url, unnest(range(8)) AS f, regexp_extract(url, '^[a-z]+') AS s,
        regexp_extract(url, '^[a-z]+://[^/?#]*') AS root, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS p,
        regexp_extract(url, '\\?[^#]*') AS q FROM pages)"""


@query(_JOINED)
def url_join(spark, folder):
    forms = F.array(*[F.expr(f.replace("||", "||")) for f in _FORMS])
    rows = D.page_urls(spark, folder).select("page_id", "url", F.posexplode(forms).alias("f", "href"))
    return rows.select("page_id", F.col("f").cast("long").alias("f"), U.url_join("url", "href").alias("joined"))


@query()
def url_join_dots(spark, folder):
    """Dot segments; checked against the standard library in the tests."""
    forms = F.array(*[F.lit(h) for h in ("../up", "./here", "a/../b", "/x/./y/../z", "../../..", ".")])
    rows = D.page_urls(spark, folder).select("page_id", "url", F.posexplode(forms).alias("f", "href"))
    return rows.select("page_id", "f", "href", U.url_join("url", "href").alias("joined"))


@query(f"""SELECT s.page_id, s.raw, regexp_replace(coalesce(r.url, u), '/+$', '') AS base FROM (
             SELECT page_id, raw, CASE WHEN starts_with(raw, 'http') THEN raw ELSE 'https://' || raw END AS u FROM (
               SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE {O.netloc('url')} || '/' END AS raw FROM pages)) s
           LEFT JOIN (SELECT DISTINCT 'https://' || host || '/' AS src, 'https://www.' || host || '//' AS url FROM hosts
             WHERE md5(host) < '8') r ON r.src = s.u""", "hosts")
def normalize_source(spark, folder):
    raw = F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.concat(U.netloc("url"), F.lit("/")))
    given = D.page_urls(spark, folder).select("page_id", raw.alias("raw")).withColumn("asked", U.with_scheme("raw"))
    redirects = D.hosts(spark, folder).filter(F.md5("host") < "8").select(
        F.concat(F.lit("https://"), F.col("host"), F.lit("/")).alias("asked"),
        F.concat(F.lit("https://www."), F.col("host"), F.lit("//")).alias("final_url"),
    )
    resolved = given.join(redirects, "asked", "left")
    return resolved.select("page_id", "raw", U.strip_trailing_slashes(F.coalesce("final_url", "asked")).alias("base"))


# Page paths, some led by a date, month, index word or long id.
_CASES = """CASE page_id % 6 WHEN 0 THEN '/2024/01' || p WHEN 1 THEN '/news' || p WHEN 2 THEN p || '-' || (page_id + 10000)
    WHEN 3 THEN '/MAY' || p WHEN 4 THEN '/x' || p || '/tags' ELSE p END"""


@query(f"SELECT page_id, path, {O.classify('path')} AS kind FROM (SELECT page_id, {_CASES} AS path FROM "
       f"(SELECT page_id, {O.path('url')} AS p FROM pages))")
def classify_link(spark, folder):
    rows = D.page_urls(spark, folder).select("page_id", U.path("url").alias("p")).select("page_id", F.expr(_CASES).alias("path"))
    return rows.select("page_id", "path", U.classify_link("path").alias("kind"))


_SCORED = "url || CASE page_id % 5 WHEN 0 THEN '/sitemap-news.xml' WHEN 1 THEN '/hindi/world.xml' WHEN 2 THEN '/top-uk' ELSE '' END"


@query(f"SELECT page_id, CAST({O.score('u')} AS INTEGER) AS score FROM (SELECT page_id, {_SCORED} AS u FROM pages)")
def score_sitemap(spark, folder):
    return D.page_urls(spark, folder).select("page_id", F.expr(_SCORED).alias("u")).select(
        "page_id", U.score_sitemap("u").alias("score")
    )


@query(f"SELECT host, sitemap_url, CAST(s AS INTEGER) AS score FROM (SELECT *, {O.score('sitemap_url')} AS s FROM sitemap_names) "
       "WHERE s > -500", "sitemap_names")
def usable_sitemaps(spark, folder):
    return L.usable_sitemaps(D.sitemap_names(spark, folder))


@query("SELECT host, sitemap_url, CAST(score AS INTEGER) AS score, rank FROM ranked_sitemaps", "ranked_sitemaps")
def rank_sitemaps(spark, folder):
    return L.rank_sitemaps(D.sitemap_names(spark, folder))


_TYPED = "CASE page_id % 4 WHEN 0 THEN ' ' || url || '/FEED ' WHEN 1 THEN url || '/2024/05/x' WHEN 2 THEN url || '-' || (page_id + 1000000) ELSE url END"


@query(f"""SELECT page_id, kind AS job_type, CAST(CASE kind WHEN 'rss' THEN 600 WHEN 'single' THEN 0 ELSE 3600 END AS INTEGER)
             AS interval_seconds, CASE kind WHEN 'rss' THEN 'RSS Feed' WHEN 'single' THEN 'Single Article' ELSE 'Site Discovery' END
             AS label FROM (SELECT page_id, {O.source_type('u')} AS kind FROM (SELECT page_id, {_TYPED} AS u FROM pages))""")
def detect_source_type(spark, folder):
    return D.page_urls(spark, folder).select("page_id", F.expr(_TYPED).alias("u")).select(
        "page_id", U.detect_source_type("u").alias("k")
    ).select("page_id", "k.*")


@query(f"SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'mine' ELSE 'Site Discovery: ' || {O.netloc('url')} END AS name FROM pages")
def default_job_name(spark, folder):
    given = F.when(F.col("page_id") % 3 == 0, "mine").when(F.col("page_id") % 3 == 1, "")
    return D.page_urls(spark, folder).select(
        "page_id", U.job_name(given, F.lit("Site Discovery"), F.col("url")).alias("name")
    )


@query(f"SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN lang ELSE {O.excerpt('text')} END AS summary FROM documents")
def summary_fallback(spark, folder):
    given = F.when(F.col("doc_id") % 4 == 0, F.col("lang")).when(F.col("doc_id") % 4 == 1, "")
    return table(spark, folder, "documents").select(
        "doc_id", X.summary_fallback(given, F.col("text")).alias("summary")
    )


@query(r"""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'given' WHEN page_id % 5 = 0 THEN 'No Title'
             ELSE replace(trim(regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title\s*>', 1)), '&amp;', '&') END AS title
           FROM pages""")
def title_fallback(spark, folder):
    given = F.when(F.col("page_id") % 3 == 0, "given").when(F.col("page_id") % 3 == 1, "")
    html = F.when(F.col("page_id") % 5 == 0, F.replace(F.col("html"), F.lit("title>"), F.lit("nope>"))).otherwise(F.col("html"))
    return D.pages(spark, folder).select("page_id", X.title_fallback(given, html).alias("title"))


@query("SELECT doc_id, substring(text, 1, 3000) AS analysis, substring(text, 1, 2000) AS embedding, substring(text, 1, 5000) AS draft, "
       "substring(text, 1, 500) AS log FROM documents")
def truncate_text(spark, folder):
    cuts = {"analysis": 3000, "embedding": 2000, "draft": 5000, "log": 500}
    return table(spark, folder, "documents").select(
        "doc_id", *[X.truncate(F.col("text"), n).alias(name) for name, n in cuts.items()]
    )


# Auditor replies out of conversation turns: yes, no with the turn's lines, bare no, blank.
_REPLY = """CASE (conv_id + turn) % 4 WHEN 0 THEN '  Yes, enough.' || chr(10) || text WHEN 1 THEN 'NO' || chr(10) || 'ab' || chr(10) || text
    WHEN 2 THEN 'no' WHEN 3 THEN ' ' || chr(10) END"""


@query(f"""SELECT conv_id, turn, (conv_id + turn) % 4 = 0 AS sufficient,
             array_to_string(CASE WHEN (conv_id + turn) % 4 = 0 THEN [] WHEN len(q) = 0 THEN ['prompt ' || conv_id] ELSE q END, '|') AS queries
           FROM (SELECT conv_id, turn, list_filter(list_transform(string_split(r, chr(10)), lambda x: trim(x))[2:],
             lambda x: length(x) > 3)[1:3] AS q FROM (SELECT conv_id, turn, trim({_REPLY}) AS r FROM conversations))""")
def parse_audit_reply(spark, folder):
    rows = table(spark, folder, "conversations").select("conv_id", "turn", F.expr(_REPLY).alias("reply"))
    parsed = X.parse_audit(F.col("reply"), F.concat(F.lit("prompt "), F.col("conv_id").cast("string")))
    return rows.select("conv_id", "turn", parsed.alias("p")).select(
        "conv_id", "turn", "p.sufficient", F.array_join("p.queries", "|").alias("queries")
    )


@query("SELECT item_id, 'Query: ' || text || chr(10) || chr(10) || 'Stored knowledge, best matches first:' || chr(10) || 'No info.' "
       "|| chr(10) || chr(10) || 'Is this specific and recent enough for a thorough article on the query?' || chr(10) || "
       "'First line: YES or NO. After a NO: three search queries, one per line.' AS prompt FROM benchmark")
def audit_prompt(spark, folder):
    return table(spark, folder, "benchmark").select(
        "item_id", X.audit_prompt(F.col("text"), F.lit("No info.")).alias("prompt")
    )


@query("SELECT doc_id, 'Text:' || chr(10) || substring(text, 1, 3000) || chr(10) || chr(10) || 'Reply with one JSON object with the keys "
       "summary (three sentences), tags (three words), category (one word) and urgency (1 to 10).' AS prompt FROM documents")
def analysis_prompt(spark, folder):
    return table(spark, folder, "documents").select("doc_id", X.analysis_prompt(F.col("text")).alias("prompt"))
