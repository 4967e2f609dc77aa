"""Queries of enrichment, research and promotion."""

from __future__ import annotations

from pyspark.sql import functions as F

from pageloom.functions.jsonx import clean_json as cleaned
from pageloom.functions.jsonx import flatten_summary as flattened
from pageloom.functions.urls import netloc
from pageloom.operators import enrich as E
from pageloom.operators import research as R
from pageloom.operators.memory import knn_join
from pageloom.operators.memory import search_by_text as text_search
from pageloom.plans import composites as C
from pageloom.plans import derived as D
from pageloom.plans import oracle_views as O
from pageloom.plans.catalog_tables import _NOW, now
from pageloom.plans.registry import query
from pageloom.session import materialize
from pageloom.sources.tables import table


@query("""SELECT article_id, provider, event_type IN ('view', 'click', 'purchase') AS parsed,
            CASE WHEN event_type IN ('view', 'click') THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM replies""", "replies")
def clean_json(spark, folder):
    rows = D.replies(spark, folder).select("article_id", "provider", cleaned(F.col("raw")).alias("v"))
    return rows.select(
        "article_id", "provider", F.col("v").isNotNull().alias("parsed"), F.try_variant_get("v", "$.k", "bigint").alias("k"))


@query("""SELECT article_id, arg_min(provider, priority) FILTER (WHERE event_type IN ('view', 'click')) AS provider,
            replace(arg_min(props, priority) FILTER (WHERE event_type IN ('view', 'click')), ' ', '') AS reply
          FROM replies GROUP BY article_id""", "replies")
def provider_waterfall(spark, folder):
    return E.provider_waterfall(D.replies(spark, folder))


@query("""SELECT article_id, arg_min(provider, priority) FILTER (WHERE raw <> '') AS provider,
            trim(arg_min(raw, priority) FILTER (WHERE raw <> '')) AS reply FROM replies GROUP BY article_id""", "replies")
def chat_waterfall(spark, folder):
    return E.chat_waterfall(D.replies(spark, folder))


# Summaries as text, list, object, empty list, number and missing.
_SUMMARY = """case doc_id % 6 when 0 then concat('"', source, ' ', lang, '"') when 1 then concat('["', source, '", "', lang, '", 7]')
    when 2 then concat('{"a": "', source, '", "b": "', lang, '"}') when 3 then '[]' when 4 then cast(doc_id as string) end"""


@query("""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN source || ' ' || lang WHEN 1 THEN source || ' ' || lang || ' 7'
            WHEN 2 THEN source || ' ' || lang WHEN 4 THEN CAST(doc_id AS VARCHAR) ELSE 'old' END AS summary FROM documents""")
def flatten_summary(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", F.try_parse_json(F.expr(_SUMMARY)).alias("v"))
    return rows.select("doc_id", flattened(F.col("v"), F.lit("old")).alias("summary"))


# The default vectors: hashed words and pairs counted by slot and scaled; a digest weighs every slot, in twelfths of the least, by its number.
_VECTORS = """
    WITH words AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}_]+'), lambda w: w <> '') AS w
      FROM documents WHERE regexp_replace(text, '\\s+', '', 'g') <> ''),
    grams AS (SELECT doc_id, unnest(w) AS g FROM words UNION ALL
      SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words),
    codes AS (SELECT doc_id, CAST('0x' || substr(md5(g), 1, 8) AS BIGINT) AS c FROM grams),
    slots AS (SELECT doc_id, c % 768 AS slot, sum(CASE WHEN (c // 65536) % 2 = 1 THEN 1 ELSE -1 END) AS n FROM codes GROUP BY ALL),
    least AS (SELECT doc_id, min(abs(n)) AS m FROM slots WHERE n <> 0 GROUP BY doc_id)
    SELECT d.doc_id, CAST(CASE WHEN w.doc_id IS NULL THEN NULL ELSE 768 END AS INTEGER) AS dims,
      CAST(CASE WHEN w.doc_id IS NOT NULL THEN coalesce(sum(round(12.0::DOUBLE * s.n / l.m) * (s.slot + 1)), 0) END AS BIGINT) AS weighed,
      CAST(CASE WHEN w.doc_id IS NOT NULL THEN count(s.n) FILTER (WHERE s.n <> 0) END AS BIGINT) AS filled
    FROM documents d LEFT JOIN words w ON w.doc_id = d.doc_id LEFT JOIN slots s ON s.doc_id = d.doc_id LEFT JOIN least l ON l.doc_id = d.doc_id
    GROUP BY d.doc_id, w.doc_id"""


@query(_VECTORS)
def embed_documents(spark, folder):
    """Default model over whole documents."""
    docs = D.documents(spark, folder).select("doc_id", "text")
    least = F.array_min(F.filter(F.transform("embedding", lambda x: F.abs(x.cast("double"))), lambda x: x != 0))
    vectors = E.embed_documents(docs, "text").select("doc_id", "embedding", F.explode(F.array(least)).alias("least"))
    parts = F.transform("embedding", lambda x, i: F.coalesce(F.round(12 * x.cast("double") / F.col("least")), F.lit(0.0)).cast("bigint") * (i + 1))
    return vectors.select(
        "doc_id", F.size("embedding").alias("dims"), F.aggregate(parts, F.lit(0).cast("bigint"), lambda s, x: s + x).alias("weighed"),
        F.size(F.filter("embedding", lambda x: x != 0)).cast("bigint").alias("filled"))


_ANALYSIS = f"""
    WITH heads AS (SELECT doc_id, text AS h FROM documents),
    words AS (SELECT doc_id, unnest(string_split_regex(lower(h), '[^\\p{{L}}]+')) AS w FROM heads),
    counted AS (SELECT doc_id, w, count(*) AS n FROM words WHERE length(w) >= 4 GROUP BY doc_id, w),
    ranked AS (SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, w) AS r FROM counted),
    tags AS (SELECT doc_id, string_agg(w, ', ' ORDER BY r) AS tags FROM ranked WHERE r <= 3 GROUP BY doc_id)
    SELECT h.doc_id, {O.excerpt('h.h')} AS summary, coalesce(t.tags, '') AS tags,
      CASE WHEN regexp_matches(lower(h.h), 'software|computer|internet|technology') THEN 'Technology'
        WHEN regexp_matches(lower(h.h), 'government|election|parliament|minister') THEN 'Politics'
        WHEN regexp_matches(lower(h.h), 'research|science|study|university') THEN 'Science' ELSE 'General' END AS category,
      CAST(least(10, 1 + len(regexp_extract_all(h.h, '[!?]|[0-9]+'))) AS INTEGER) AS urgency
    FROM heads h LEFT JOIN tags t ON t.doc_id = h.doc_id"""


@query(_ANALYSIS)
def analyze_documents(spark, folder):
    docs = D.documents(spark, folder).select("doc_id", "text")
    return E.analyze_documents(docs, "text").select(
        "doc_id", "analysis.summary", F.array_join("analysis.tags", ", ").alias("tags"), "analysis.category", "analysis.urgency")


@query(f"""WITH d AS ({_ANALYSIS}), a AS (SELECT doc_id, toxic FROM labels)
           SELECT d.doc_id AS id, 'completed' AS ai_status, CASE WHEN a.toxic = 0 THEN x.lang ELSE d.category END AS ai_category,
             CAST(CASE WHEN a.toxic = 0 THEN d.doc_id % 10 + 1 ELSE d.urgency END AS INTEGER) AS ai_urgency,
             CASE WHEN a.toxic = 0 THEN x.lang || ', ' || x.source ELSE d.tags END AS tags,
             CAST(CASE WHEN a.toxic = 0 THEN len(e.embedding) ELSE 768 END AS INTEGER) AS dims
           FROM d JOIN documents x ON x.doc_id = d.doc_id LEFT JOIN a ON a.doc_id = d.doc_id
           LEFT JOIN embeddings e ON e.vec_id = d.doc_id""")
def enrich_articles(spark, folder):
    cols = ["id", "clean_text", "summary", "embedding", "ai_status", "ai_error_log", "ai_tags", "ai_category", "ai_urgency"]
    done = C.enrich_articles(D.articles(spark, folder, cols))
    return done.select("id", "ai_status", "ai_category", "ai_urgency", F.array_join("ai_tags", ", ").alias("tags"), F.size("embedding").alias("dims"))


_ADAPTED = f"""WITH d AS ({_ANALYSIS}), open AS (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 0)),
      h AS (SELECT d.doc_id % 50 AS job_id, list(d.urgency ORDER BY d.doc_id) AS us FROM d JOIN open o ON o.doc_id = d.doc_id GROUP BY 1)
    SELECT j.user_id AS id, CAST(list_reduce(list_prepend(CAST(j.start AS BIGINT), coalesce(CAST(h.us AS BIGINT[]), CAST([] AS BIGINT[]))),
      lambda cur, u: CASE WHEN u >= 8 THEN 300 WHEN u >= 5 THEN 1800 ELSE greatest(3600, CAST(floor(cur * 0.95::DOUBLE) AS BIGINT)) END)
      AS INTEGER) AS interval_seconds
    FROM (SELECT DISTINCT user_id, CASE user_id % 3 WHEN 0 THEN 300 WHEN 1 THEN 3600 ELSE 86400 END AS start FROM events) j
    LEFT JOIN h ON h.job_id = j.user_id"""


@query(_ADAPTED)
def adapt_jobs(spark, folder):
    """Articles enriched for fifty jobs, and the intervals of all jobs after that."""
    cols = ["id", "clean_text", "summary", "embedding", "ai_status", "ai_error_log", "ai_tags", "ai_category", "ai_urgency"]
    a = D.articles(spark, folder, cols)
    asked = a.select("id", (F.col("id") % 50).alias("job_id"), now().alias("ts"))
    return C.enrich_for_jobs(a, asked, D.jobs(spark, folder)).jobs.select("id", "interval_seconds")


@query()
def search_by_text(spark, folder):
    """Documents nearest to each benchmark text, both under the default model."""
    docs = E.embed_documents(D.documents(spark, folder).select(F.col("doc_id").alias("id"), "text"), "text")
    asked = table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return text_search(docs, asked)


_QUERY = "'topic ' || (item_id % 40)"


@query(f"""SELECT run, url FROM (SELECT run, url, row_number() OVER (PARTITION BY run ORDER BY place, url) AS n FROM (
             SELECT run, url, min(pos * 1000000 + rank) AS place FROM (
               SELECT b.run, b.pos, s.rank, s.url, row_number() OVER (PARTITION BY b.run, b.pos ORDER BY s.rank, s.url) AS k
               FROM (SELECT item_id AS run, 0 AS pos, {_QUERY} AS q FROM benchmark WHERE item_id % 3 <> 0
                     UNION ALL SELECT item_id, 1, 'topic ' || (item_id % 7) FROM benchmark WHERE item_id % 3 = 1) b
               JOIN (SELECT 'topic ' || (page_id % 40) AS q, page_id // 40 AS rank, url FROM pages) s ON s.q = b.q) WHERE k <= 3
             GROUP BY run, url)) WHERE n <= 4""")
def gap_list(spark, folder):
    """Auditor replies: enough, two searches, or none (the prompt itself is searched)."""
    items = table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"))
    own = F.concat(F.lit("topic "), (F.col("query_id") % 40).cast("string"))
    other = F.concat(F.lit("topic "), (F.col("query_id") % 7).cast("string"))
    reply = F.when(F.col("query_id") % 3 == 0, "yes, enough").when(F.col("query_id") % 3 == 1, F.concat(F.lit("NO\n\n "), own, F.lit(" \n-\n"), other))
    asked = items.select("query_id", own.alias("prompt"))
    pages = table(spark, folder, "pages").select(
        F.concat(F.lit("topic "), (F.col("page_id") % 40).cast("string")).alias("query"), F.expr("page_id div 40").alias("rank"), "url")
    return C.gap_list(asked, items.select("query_id", reply.alias("reply")), pages, 4)


def _hits(spark, folder, k=10):
    found = materialize(knn_join(D.articles(spark, folder, ["id", "embedding"]), D.topics(spark, folder), k))
    return found.join(D.articles(spark, folder, ["id", "title", "summary"]), "id")


@query("""SELECT b.item_id AS query_id, coalesce(string_agg('- ' || a.title || ': ' || a.summary, chr(10) ORDER BY h.rank), 'No info.') AS audit,
            string_agg(w.line, chr(10) || chr(10) ORDER BY w.rank) AS writer
          FROM benchmark b
          LEFT JOIN (SELECT query_id, h.rank, 'Source: ' || a.title || chr(10) || 'Content: ' || a.summary AS line FROM hits h
            JOIN articles a ON a.id = h.id) w ON w.query_id = b.item_id
          LEFT JOIN hits h ON h.query_id = b.item_id AND h.rank = w.rank AND h.rank <= 5 LEFT JOIN articles a ON a.id = h.id
          GROUP BY b.item_id""", "hits", "articles")
def context_block(spark, folder):
    hits = _hits(spark, folder)
    audit = R.audit_context(D.topics(spark, folder), hits).withColumnRenamed("context", "audit")
    return audit.join(R.context_block(hits, "writer").withColumnRenamed("context", "writer"), "query_id", "left")


@query("SELECT query_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY rank) AS ids FROM hits GROUP BY query_id", "hits")
def used_article_ids(spark, folder):
    hits = knn_join(D.articles(spark, folder, ["id", "embedding"]), D.topics(spark, folder), 10)
    used = R.used_article_ids(hits)
    return used.select("query_id", F.array_join(F.col("used_article_ids").cast("array<string>"), ",").alias("ids"))


@query(f"""SELECT run, count(*) AS requested, count(*) FILTER (WHERE done) AS ready,
            count(*) FILTER (WHERE done) >= count(*) OR (count(*) FILTER (WHERE done) > 0 AND 25 > 20) AS stop
          FROM (SELECT DISTINCT {O.netloc('url')} AS run, url, ai_status = 'completed' AS done FROM articles) GROUP BY run""", "articles")
def gap_fill_status(spark, folder):
    a = D.articles(spark, folder, ["id", "url", "ai_status"])
    asked = a.select(netloc("url").alias("run"), "url")
    return R.gap_fill_status(asked, a, F.lit(25))


# Job urls in mixed case, one of them a longer host around a domain.
_WATCHED = """(SELECT id, CASE WHEN id % 2 = 0 THEN upper(url) ELSE replace(url, '//src', '//m.src') || '/news' END AS url, job_type
    FROM jobs)"""
_FRESH = f"""SELECT domain FROM domains d WHERE NOT EXISTS (SELECT 1 FROM {_WATCHED} j WHERE j.job_type = 'discovery'
    AND j.url ILIKE '%' || d.domain || '%')"""
_DOMAINS = f", domains AS (SELECT DISTINCT {O.netloc('url')} AS domain FROM articles UNION SELECT host FROM hosts) "


def _watched(spark, folder):
    u = F.col("url")
    url = F.when(F.col("id") % 2 == 0, F.upper(u)).otherwise(
        F.concat(F.replace(u, F.lit("//src"), F.lit("//m.src")), F.lit("/news")))
    return D.jobs(spark, folder).withColumn("url", url)


@query(_DOMAINS + _FRESH, "articles", "hosts", "jobs")
def unmonitored_domains(spark, folder):
    domains = D.articles(spark, folder, ["url"]).select(netloc("url").alias("domain")).unionByName(
        D.hosts(spark, folder).withColumnRenamed("host", "domain")).distinct()
    return R.unmonitored_domains(domains, _watched(spark, folder))


_PROMOTED = f"""
    , domains AS (SELECT DISTINCT {O.netloc('url')} AS domain FROM articles WHERE id IN (SELECT doc_id FROM labels WHERE quality = 1)),
    fresh AS ({_FRESH})
    SELECT (SELECT max(id) FROM {_WATCHED}) + row_number() OVER (ORDER BY md5(domain), domain) AS id, 'Auto-Discovery: ' || domain AS name,
      'https://' || domain AS url, 'discovery' AS job_type, CAST(5 AS INTEGER) AS items_limit, CAST(86400 AS INTEGER) AS interval_seconds,
      {_NOW} AS created_at FROM fresh"""


@query(_PROMOTED, "articles", "jobs")
def promote_domains(spark, folder):
    used = table(spark, folder, "labels").filter("quality = 1").select(F.col("doc_id").alias("id"))
    jobs = _watched(spark, folder)
    out = C.promote_domains(used, D.articles(spark, folder, ["id", "url"]), jobs, D.sources(spark, folder), now())
    return out.jobs.filter(F.col("name").startswith("Auto-Discovery: ")).select(
        "id", "name", "url", "job_type", "items_limit", "interval_seconds", "created_at")


@query("""SELECT h.query_id, string_agg(CAST(h.id AS VARCHAR), ',' ORDER BY h.rank) AS used,
            string_agg('Source: ' || a.title || chr(10) || 'Content: ' || a.summary, chr(10) || chr(10) ORDER BY h.rank) AS context
          FROM hits h JOIN articles a ON a.id = h.id GROUP BY h.query_id""", "hits", "articles")
def research_report(spark, folder):
    a = D.articles(spark, folder, ["id", "url", "title", "summary", "embedding"])
    out = C.research_report(D.topics(spark, folder), a, D.jobs(spark, folder), D.sources(spark, folder), now())
    used = out.used.select("query_id", F.array_join(F.col("used_article_ids").cast("array<string>"), ",").alias("used"))
    return used.join(out.writer, "query_id")


@query(f"""SELECT j.id AS job_id, CASE job_type WHEN 'rss' THEN 'poll_feed' WHEN 'discovery' THEN 'discover' ELSE 'ingest' END AS task,
             CASE WHEN job_type <> 'discovery' THEN j.url END AS url, CASE WHEN job_type = 'discovery' THEN s.id END AS source_id,
             CAST(CASE WHEN job_type <> 'single' THEN items_limit END AS INTEGER) AS items_limit
           FROM jobs j LEFT JOIN known s ON s.domain = {O.netloc('j.url')}
           WHERE is_active AND (last_triggered_at IS NULL OR epoch({_NOW} - last_triggered_at) >= interval_seconds)
             AND (job_type <> 'discovery' OR s.id IS NOT NULL)""".replace(
    "known", "(SELECT CAST(substring(source, 4) AS BIGINT) AS id, source || '.example.com' AS domain FROM (SELECT DISTINCT source FROM documents))"),
    "jobs")
def dispatch_jobs(spark, folder):
    known = table(spark, folder, "documents").select("source").distinct().select(
        F.substring("source", 4, 10).cast("bigint").alias("id"), F.concat("source", F.lit(".example.com")).alias("domain"))
    return C.dispatch_jobs(D.jobs(spark, folder), known, now()).work
