"""The derived inputs as SQL views, for checking results with another engine."""

from __future__ import annotations

from collections.abc import Iterable

from pageloom.functions import fixed_values as V

NETLOC = r"'^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)'"
HIDDEN = r"'(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>'"
HREF = r"""'(?is)<a\s(?:[^>]*?\s)?href\s*=\s*"([^"]*)"'"""


def netloc(url: str) -> str:
    return f"regexp_extract({url}, {NETLOC}, 1)"


def excerpt(text: str) -> str:
    n = V.SUMMARY_CHARS
    return f"CASE WHEN length({text}) > {n} THEN substring({text}, 1, {n}) || '...' ELSE {text} END"


def _holds_any(text: str, terms: Iterable[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{t}')" for t in terms) + ")"


def _hits(text: str, terms: Iterable[str]) -> str:
    return "(" + " + ".join(f"CAST(contains({text}, '{t}') AS BIGINT)" for t in terms) + ")"


def useful(url: str) -> str:
    low = f"lower({url})"
    asset = " OR ".join(f"ends_with({low}, '{s}')" for s in V.ASSET_SUFFIXES)
    return f"NOT ({asset}) AND NOT {_holds_any(low, V.UTILITY_TERMS)}"


def classify(path: str) -> str:
    low = f"lower({path})"
    article = " OR ".join(f"regexp_matches({low}, '{p}')" for p in (V.YEAR_IN_PATH, V.MONTH_IN_PATH, V.ID_AT_END))
    index = _holds_any(low, [f"/{k}" for k in V.INDEX_KEYWORDS])
    return f"CASE WHEN {article} THEN 'article' WHEN {index} THEN 'index' ELSE 'unknown' END"


def score(url: str) -> str:
    low = f"lower({url})"
    news = f"CAST({_holds_any(low, V.NEWS_SITEMAP_TERMS)} AS BIGINT)"
    return (
        f"({news} * {V.NEWS_SCORE} + {_hits(low, V.PRIORITY_TERMS)} * {V.PRIORITY_SCORE} "
        f"+ {_hits(low, V.SKIP_TERMS)} * ({V.SKIP_SCORE}))"
    )


def source_type(url: str) -> str:
    low = f"trim(lower({url}))"
    single = " OR ".join(f"regexp_matches({low}, '{p}')" for p in (V.DATE_IN_URL, V.ID_IN_URL))
    return f"CASE WHEN {_holds_any(low, V.FEED_MARKERS)} THEN 'rss' WHEN {single} THEN 'single' ELSE 'discovery' END"


def path(url: str) -> str:
    return (
        rf"regexp_replace(regexp_extract({url}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1), ';[^/]*$', '')"
    )


def site_path(i: str) -> str:
    return (
        f"CASE ({i}) % 3 WHEN 0 THEN '/news/p' || ({i}) WHEN 1 THEN '/2024/05/p' || ({i}) ELSE '/about/p' || ({i}) END"
    )


MAP_NAME = (
    "'https://maps.example.com/' || CASE (page_id) % 4 WHEN 0 THEN 'sitemap-news' WHEN 1 THEN 'hindi' "
    "WHEN 2 THEN 'sitemap' ELSE 'world' END || '-' || (page_id) || '.xml'"
)

# name -> (views it reads, text)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "articles": ((), f"""
        SELECT d.doc_id AS id, CAST(NULL AS BIGINT) AS source_id,
          'https://' || d.source || '.example.com/' || d.lang || '/' || d.doc_id AS url,
          split_part(d.text, chr(10), 1) AS title, CAST(NULL AS VARCHAR) AS author,
          CAST(NULL AS VARCHAR) AS published_date, {excerpt('d.text')} AS summary,
          CAST(NULL AS VARCHAR) AS main_image, d.text AS clean_text, e.embedding, CAST(NULL AS VARCHAR) AS content,
          CASE WHEN l.toxic IS NULL THEN 'pending' WHEN l.toxic = 1 THEN 'failed' ELSE 'completed' END AS ai_status,
          CASE WHEN l.toxic = 1 THEN 'AI returned no data' END AS ai_error_log,
          CASE WHEN l.toxic IS NOT NULL THEN [d.lang, d.source] END AS ai_tags, d.lang AS ai_category,
          CASE WHEN l.toxic IS NOT NULL THEN CAST(d.doc_id % 10 + 1 AS INTEGER) END AS ai_urgency,
          TIMESTAMP '2024-01-01 00:00:00' + to_minutes(d.doc_id % 1000000 * 137) AS created_at
        FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN embeddings e ON e.vec_id = d.doc_id"""),
    "newest": (("articles",), """
        SELECT id, url, title, created_at, ai_category, coalesce(CAST(ai_urgency AS DOUBLE), 0.0) AS ai_urgency,
          ai_tags, summary, ai_status, ai_error_log, source_id
        FROM articles ORDER BY created_at DESC NULLS FIRST, id DESC LIMIT 200"""),
    "page_log": ((), """
        SELECT page_id, url, url AS final_url, CASE WHEN page_id % 10 <> 9 THEN html END AS html,
          CAST(CASE WHEN page_id % 10 = 9 THEN 503 ELSE 200 END AS INTEGER) AS status,
          CASE WHEN page_id % 10 = 9 THEN 'HTTP 503' END AS error FROM pages"""),
    "hosts": ((), f"SELECT DISTINCT {netloc('url')} AS host FROM pages"),
    "sources": (("hosts",), """
        SELECT CAST(row_number() OVER (ORDER BY md5(host), host) AS BIGINT) AS id, host AS domain,
          'https://' || host || '/robots.txt' AS robots_url, CAST(NULL AS TIMESTAMP) AS last_crawled,
          TRUE AS is_active, TIMESTAMP '2024-01-01 00:00:00' AS created_at FROM hosts"""),
    "half_sources": (("sources",), "SELECT * FROM sources WHERE md5(domain) < '8'"),
    "robots_files": (("hosts",), """
        SELECT host, CAST(CASE WHEN d < 'c' THEN 200 WHEN d = 'c' THEN 403 WHEN d = 'd' THEN 404
            WHEN d = 'e' THEN 500 END AS INTEGER) AS status,
          CASE WHEN d < '4' THEN concat('# all robots', chr(10), 'User-agent: *', chr(10), 'Disallow: /en/1 # archive',
              chr(10), 'Crawl-delay: 5', chr(10), 'Disallow: /fr', chr(10), 'Allow: /', chr(10), chr(10), 'Disallow: /de',
              chr(10), 'Sitemap: https://', host, '/sitemap.xml', chr(10))
            WHEN d < '8' THEN concat('User-agent: otherbot', chr(10), 'User-agent: MyBot', chr(10), 'Disallow: /de', chr(10),
              'Allow: /de/1', chr(10), chr(10), 'User-agent: *', chr(10), 'Disallow: /', chr(10), 'sitemap: https://', host,
              '/sitemap-news.xml  ', chr(10), 'Sitemap:https://', host, '/hindi.xml', chr(10))
            WHEN d < 'c' THEN concat('User-agent: lonely', chr(10), chr(10), 'User-agent: *', chr(10), 'Disallow:', chr(10),
              'Disallow: /es', chr(10)) END AS robots_txt
        FROM (SELECT host, substring(md5(host), 1, 1) AS d FROM hosts)"""),
    "robots_lines": (("robots_files",), """
        SELECT host, unnest(string_split(robots_txt, chr(10))) AS line,
          generate_subscripts(string_split(robots_txt, chr(10)), 1) - 1 AS seq
        FROM robots_files WHERE robots_txt IS NOT NULL"""),
    "robots_kinds": (("robots_lines",), """
        SELECT host, seq, v, CASE WHEN line = '' THEN 'blank' WHEN k = 'user-agent' THEN 'agent'
            WHEN k IN ('allow', 'disallow') THEN k WHEN k IN ('crawl-delay', 'request-rate') THEN 'pace' END AS kind
        FROM (SELECT host, seq, line, CASE WHEN contains(body, ':') THEN lower(trim(split_part(body, ':', 1))) END AS k,
            trim(substr(body, strpos(body, ':') + 1)) AS v
          FROM (SELECT host, seq, line, trim(regexp_replace(line, '#.*$', '')) AS body FROM robots_lines))"""),
    "robots_groups": (("robots_kinds",), """
        SELECT host, seq, v, kind,
          sum(CASE WHEN kind = 'blank' OR (kind = 'agent' AND coalesce(before, 'blank') <> 'agent') THEN 1 ELSE 0 END)
            OVER (PARTITION BY host ORDER BY seq) AS grp
        FROM (SELECT *, lag(kind) OVER (PARTITION BY host ORDER BY seq) AS before FROM robots_kinds WHERE kind IS NOT NULL)"""),
    "robots_rules": (("robots_groups",), """
        SELECT r.host, CAST(r.grp AS INTEGER) AS grp, a.agents, r.seq, r.kind <> 'disallow' OR r.v = '' AS allow,
          CASE WHEN r.kind <> 'pace' THEN r.v END AS prefix
        FROM robots_groups r JOIN (SELECT host, grp, list(lower(v) ORDER BY seq) AS agents FROM robots_groups
          WHERE kind = 'agent' GROUP BY host, grp) a ON a.host = r.host AND a.grp = r.grp
        WHERE r.kind IN ('allow', 'disallow', 'pace')"""),
    "robots_choice": (("robots_rules",), """
        SELECT host, coalesce(
            min(grp) FILTER (WHERE NOT list_contains(agents, '*') AND len(list_filter(agents, lambda a: contains('mybot', a))) > 0),
            min(grp) FILTER (WHERE list_contains(agents, '*'))) AS grp
        FROM robots_rules GROUP BY host"""),
    "robots_allowed": (("robots_rules", "robots_choice", "robots_files"), f"""
        SELECT p.url, coalesce(
            CASE WHEN f.status IN (401, 403) THEN FALSE WHEN f.status BETWEEN 400 AND 499 THEN TRUE
              WHEN f.status >= 500 THEN FALSE END,
            m.allow, TRUE) AS allowed
        FROM (SELECT url, {netloc('url')} AS host, regexp_replace(url, '^[a-z]+://[^/?#]*', '') AS target FROM pages) p
        LEFT JOIN robots_files f ON f.host = p.host
        LEFT JOIN (SELECT q.url, arg_min(r.allow, r.seq) AS allow
          FROM (SELECT url, {netloc('url')} AS host,
              CASE WHEN regexp_replace(url, '^[a-z]+://[^/?#]*', '') = '' THEN '/'
                ELSE regexp_replace(url, '^[a-z]+://[^/?#]*', '') END AS target FROM pages) q
          JOIN robots_choice c ON c.host = q.host JOIN robots_rules r ON r.host = c.host AND r.grp = c.grp
          WHERE r.prefix IS NOT NULL AND starts_with(q.target, r.prefix) GROUP BY q.url) m ON m.url = p.url"""),
    "jobs": ((), """
        SELECT user_id AS id, 'job ' || user_id AS name,
          'https://src' || (user_id % 30) || '.example.com' || CASE user_id % 3 WHEN 0 THEN '/feed' WHEN 1 THEN ''
            ELSE '/2024/05/x' END AS url,
          CASE user_id % 3 WHEN 0 THEN 'rss' WHEN 1 THEN 'discovery' ELSE 'single' END AS job_type,
          CAST(CASE WHEN user_id % 3 = 2 THEN 1 ELSE 10 END AS INTEGER) AS items_limit,
          CAST(CASE user_id % 3 WHEN 0 THEN 300 WHEN 1 THEN 3600 ELSE 86400 END AS INTEGER) AS interval_seconds,
          user_id % 5 <> 0 AS is_active, CASE WHEN user_id % 7 <> 0 THEN max(ts) END AS last_triggered_at,
          min(ts) AS created_at FROM events GROUP BY user_id"""),
    "history": ((), """
        SELECT user_id AS job_id, ts, event_id AS seq,
          CAST(CASE WHEN user_id % 3 = 0 THEN event_id % 4 + 1 ELSE event_id % 10 END AS INTEGER) AS urgency FROM events"""),
    "replies": ((), """
        SELECT event_id // 4 AS article_id, 'p' || (event_id % 4) AS provider, CAST(event_id % 4 AS INTEGER) AS priority,
          CASE event_type WHEN 'view' THEN '```json' || chr(10) || props || chr(10) || '```'
            WHEN 'click' THEN 'Sure, here it is: ' || props || ' Anything else?'
            WHEN 'error' THEN 'I cannot answer that {today}' WHEN 'purchase' THEN '{}' END AS raw, event_type, props
        FROM events"""),
    "search_rows": ((), rf"""
        SELECT regexp_extract(url, '//[^/]+/([a-z]+)/', 1) || ' ' || {netloc('url')} AS topic,
          CASE WHEN page_id % 2 = 0 THEN 'A' ELSE 'B' END AS provider, CAST(page_id // 2 % 12 + 1 AS INTEGER) AS rank, url,
          'page ' || page_id AS title FROM pages"""),
    "search_picked": (("search_rows",), f"""
        WITH u AS (SELECT * FROM search_rows WHERE {useful('url')}),
        a AS (SELECT topic, provider, rank, url FROM u WHERE provider = 'A' AND rank <= 3
          AND NOT {_holds_any('url', V.EXCLUDED_SEARCH_DOMAINS)}),
        b AS (SELECT topic, provider, rank, url, row_number() OVER (PARTITION BY topic ORDER BY rank, url) AS n
          FROM u WHERE provider = 'B' AND rank <= 6 AND topic NOT IN (SELECT topic FROM a))
        SELECT * FROM a UNION ALL SELECT topic, provider, rank, url FROM b WHERE n <= 3"""),
    "links": ((), f"""
        SELECT page_id, url AS src_url, unnest(h) AS href, generate_subscripts(h, 1) - 1 AS pos
        FROM (SELECT page_id, url, regexp_extract_all(regexp_replace(html, {HIDDEN}, '', 'g'), {HREF}, 1) AS h FROM pages)"""),
    "page_links": (("links",), f"""
        SELECT page_id, src_url, pos, 'https://' || {netloc('src_url')} || href AS url FROM links"""),
    "feed_items": (("page_links",), """
        SELECT src_url AS feed_url, pos, url, 'Item ' || pos AS title FROM page_links WHERE pos % 4 <> 3"""),
    "sitemap_names": ((), f"SELECT {netloc('url')} AS host, {MAP_NAME} AS sitemap_url FROM pages"),
    "ranked_sitemaps": (("sitemap_names",), f"""
        SELECT host, sitemap_url, s AS score, CAST(row_number() OVER (PARTITION BY host ORDER BY s DESC,
          md5(sitemap_url), sitemap_url) AS BIGINT) AS rank
        FROM (SELECT *, {score('sitemap_url')} AS s FROM sitemap_names) WHERE s > -500"""),
    "sitemap_rows": (("page_links",), f"""
        SELECT {MAP_NAME} AS sitemap_url, 'url' AS kind, pos, url AS loc FROM page_links WHERE page_id % 4 <> 3
        UNION ALL SELECT {MAP_NAME}, 'sitemap', 0, {MAP_NAME.replace('(page_id)', '(page_id - 1)')}
        FROM pages WHERE page_id % 4 = 3"""),
    "sitemap_links": (("sitemap_rows",), """
        SELECT sitemap_url, -1 AS child, pos, loc AS url FROM sitemap_rows WHERE kind = 'url'
        UNION ALL SELECT i.sitemap_url, i.pos, u.pos, u.loc FROM sitemap_rows i JOIN sitemap_rows u
          ON i.kind = 'sitemap' AND u.kind = 'url' AND u.sitemap_url = i.loc"""),
    "host_edges": (("links",), f"""
        WITH numbered AS (SELECT page_id, {netloc('url')} AS host,
          row_number() OVER (PARTITION BY {netloc('url')} ORDER BY md5(url || '|' || page_id), url || '|' || page_id) - 1 AS i FROM pages),
        own AS (SELECT page_id, host, i, 'https://' || host AS root,
          CASE WHEN i = 0 THEN 'https://' || host ELSE 'https://' || host || {site_path('i')} END AS src_url FROM numbered)
        SELECT src_url, c - 1 AS pos, root || {site_path('12 * i + c')} AS dst_url, root FROM (SELECT *, unnest(range(1, 13)) AS c FROM own)
        UNION ALL SELECT o.src_url, 12 + l.pos, o.root || l.href, o.root FROM own o JOIN links l ON l.page_id = o.page_id"""),
    "host_crawl": (("host_edges",), f"""
        WITH e AS (SELECT * FROM (SELECT *, {classify(path('dst_url'))} AS kind FROM host_edges) WHERE kind <> 'unknown' AND {useful('dst_url')}),
        s0 AS (SELECT root AS seed, dst_url AS url, kind, min([pos]) AS way FROM e WHERE src_url = root GROUP BY ALL),
        s1 AS (SELECT f.seed, e.dst_url AS url, e.kind, min(list_append(f.way, e.pos)) AS way FROM s0 f JOIN e
          ON e.src_url = rtrim(f.url, '/') WHERE f.kind = 'index' GROUP BY ALL),
        f2 AS (SELECT * FROM s1 WHERE kind = 'index' AND (seed, url) NOT IN (SELECT (seed, url) FROM s0)),
        s2 AS (SELECT f.seed, e.dst_url AS url, e.kind, min(list_append(f.way, e.pos)) AS way FROM f2 f JOIN e
          ON e.src_url = rtrim(f.url, '/') GROUP BY ALL),
        found AS (SELECT seed, url, 0 AS depth, way FROM s0 WHERE kind = 'article'
          UNION ALL SELECT seed, url, 1, way FROM s1 WHERE kind = 'article'
          UNION ALL SELECT seed, url, 2, way FROM s2 WHERE kind = 'article'),
        firsts AS (SELECT *, row_number() OVER (PARTITION BY seed, url ORDER BY depth, way) AS k FROM found)
        SELECT seed, url, depth, row_number() OVER (PARTITION BY seed ORDER BY depth, way) AS n FROM firsts WHERE k = 1"""),
    "host_kinds": (("hosts",), "SELECT host, substr(md5(host), 1, 1) AS d FROM hosts"),
    "host_bases": (("host_kinds",), """
        SELECT host, CASE WHEN d IN ('0', '1', '8', '9') THEN 'https://home.' || host ELSE 'https://' || host END AS base, d FROM host_kinds"""),
    "host_sitemaps": (("host_bases",), f"""
        SELECT b.host, CASE WHEN b.d IN ('2', '3', '0', '8') THEN p.first ELSE p.last END AS page_id
        FROM host_bases b JOIN (SELECT {netloc('url')} AS host, min(page_id) AS first, max(page_id) AS last FROM pages GROUP BY 1) p ON p.host = b.host
        WHERE b.d IN ('0', '8', '2', '3', '4', '5', '6', '7')"""),
    "runs": ((), f"""
        SELECT conv_id AS id, 'gen_' || conv_id AS task_id, text AS user_prompt,
          CASE WHEN conv_id % 3 = 1 THEN {excerpt('text')} END AS generated_text,
          CASE WHEN conv_id % 3 = 1 THEN 'completed' WHEN conv_id % 7 = 0 THEN 'failed' ELSE 'processing' END AS status,
          CASE WHEN conv_id % 2 = 0 THEN ['query one', 'query two'] WHEN conv_id % 5 = 0 THEN CAST([] AS VARCHAR[]) END
            AS search_queries,
          CASE WHEN conv_id % 3 = 1 THEN range(1, conv_id % 10 + 2) END AS used_article_ids,
          TIMESTAMP '2024-01-01 00:00:00' AS created_at, TIMESTAMP '2024-01-01 00:00:00' AS updated_at
        FROM conversations WHERE turn = 0"""),
    "hits": (("articles",), """
        SELECT query_id, id, distance, rank FROM (
          SELECT q.item_id AS query_id, a.id, 1 - list_cosine_similarity(CAST(a.embedding AS DOUBLE[]),
              CAST(v.embedding AS DOUBLE[])) AS distance,
            row_number() OVER (PARTITION BY q.item_id ORDER BY 1 - list_cosine_similarity(CAST(a.embedding AS DOUBLE[]),
              CAST(v.embedding AS DOUBLE[])), a.id) AS rank
          FROM benchmark q JOIN embeddings v ON v.vec_id = q.item_id CROSS JOIN articles a WHERE a.embedding IS NOT NULL)
        WHERE rank <= 10"""),
}


def with_views(body: str, *names: str) -> str:
    """``body`` with the named views, and those they read, as common table expressions."""
    order: list[str] = []

    def add(name: str) -> None:
        for needed in VIEWS[name][0]:
            add(needed)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in order) + "\n" + body
