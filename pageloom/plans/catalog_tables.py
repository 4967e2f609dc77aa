"""Queries that change tables, and queries over jobs and runs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pageloom.functions import schedule as T
from pageloom.operators import articles as A
from pageloom.operators import jobs as J
from pageloom.operators import limits as L
from pageloom.operators import mutations as M
from pageloom.operators import research as R
from pageloom.operators import stored as ST
from pageloom.plans import composites as C
from pageloom.plans import derived as D
from pageloom.plans import oracle_views as O
from pageloom.plans.registry import query
from pageloom.session import ensure_checkpoint_dir
from pageloom.sources.tables import table

NOW = "2024-01-31 00:00:00"
_NOW = f"TIMESTAMP '{NOW}'"


def now():
    return D.ts(NOW)


_STORED = ["id", "url", "title", "ai_status", "ai_error_log", "ai_category", "ai_urgency", "created_at"]

# Two thirds of the documents are stored; the even ones are read again, every tenth of them twice.
_UPSERT = f"""
    , stored AS (SELECT * FROM articles WHERE id % 3 <> 0),
    batch AS (SELECT url, CASE WHEN id % 10 = 0 THEN 'last: ' ELSE 'new: ' END || title AS title FROM articles WHERE id % 2 = 0)
    SELECT s.id, s.url, coalesce(b.title, s.title) AS title, CASE WHEN b.url IS NULL THEN s.ai_status ELSE 'pending' END AS ai_status,
      CASE WHEN b.url IS NULL THEN s.ai_error_log END AS ai_error_log, s.ai_category, s.ai_urgency, s.created_at
    FROM stored s LEFT JOIN batch b ON b.url = s.url
    UNION ALL
    SELECT (SELECT max(id) FROM stored) + row_number() OVER (ORDER BY md5(url), url), url, title, 'pending', NULL, NULL, NULL, {_NOW}
    FROM batch WHERE url NOT IN (SELECT url FROM stored)"""


@query(_UPSERT, "articles")
def upsert_articles(spark, folder):
    a = D.articles(spark, folder, _STORED)
    again = a.filter("id % 2 = 0")
    first = again.select("url", F.concat(F.lit("new: "), "title").alias("title"), F.col("id").alias("seq"))
    last = again.filter("id % 10 = 0").select(
        "url", F.concat(F.lit("last: "), "title").alias("title"), (F.col("id") + (1 << 40)).alias("seq"))
    return M.upsert_articles(a.filter("id % 3 <> 0"), first.unionByName(last), now())


def _store(articles):
    name = f"pageloom_articles_{uuid.uuid4().hex}"
    return ST.store_articles(articles, name, f"{ensure_checkpoint_dir(articles.sparkSession)}/{name}", buckets=16)


@query(_UPSERT, "articles")
def stored_upsert(spark, folder):
    """The same merge into a bucketed table, of which only the touched buckets are read and written."""
    a = D.articles(spark, folder, _STORED)
    again = a.filter("id % 2 = 0")
    first = again.select("url", F.concat(F.lit("new: "), "title").alias("title"), F.col("id").alias("seq"))
    last = again.filter("id % 10 = 0").select(
        "url", F.concat(F.lit("last: "), "title").alias("title"), (F.col("id") + (1 << 40)).alias("seq"))
    stored = _store(a.filter("id % 3 <> 0"))
    ST.upsert_stored(stored, first.unionByName(last), now())
    return stored.rows(spark)


@query(f"""SELECT id, domain, robots_url, {_NOW} AS last_crawled, is_active, created_at FROM half_sources
           UNION ALL SELECT coalesce((SELECT max(id) FROM half_sources), 0) + row_number() OVER (ORDER BY md5(d), d), d,
             regexp_extract(u, '^[a-z]+') || '://' || d || '/robots.txt', {_NOW}, TRUE, {_NOW}
           FROM (SELECT {O.netloc('url')} AS d, min(url) AS u FROM pages GROUP BY 1) WHERE d NOT IN (SELECT domain FROM half_sources)""",
       "half_sources")
def register_sources(spark, folder):
    return M.register_sources(D.sources(spark, folder, "8"), D.page_urls(spark, folder).select("url"), now())


_LEVEL = "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' ELSE 'INFO' END"


@query(f"""SELECT {_LEVEL} AS level, 'task ' || user_id AS task_id, 'https://u.example.com/' || event_id AS url,
             substring(repeat(props || ' ' || event_type || ' ', 40), 1, 500) AS message, ts AS created_at FROM events""")
def append_logs(spark, folder):
    events = table(spark, folder, "events").select(
        "event_type", "props", "ts", F.expr("concat('task ', user_id)").alias("task_id"),
        F.expr("concat('https://u.example.com/', event_id)").alias("url"))
    text = F.expr("repeat(concat(props, ' ', event_type, ' '), 40)")
    return M.log_rows(events, F.expr(_LEVEL), text, F.col("ts"))


@query("""SELECT a.id, CASE WHEN a.ai_status = 'completed' THEN a.ai_status WHEN l.doc_id IS NOT NULL THEN 'completed' ELSE 'failed' END
             AS ai_status, CASE WHEN a.ai_status = 'completed' THEN a.ai_error_log WHEN l.doc_id IS NULL THEN 'AI returned no data' END
             AS ai_error_log, CASE WHEN a.ai_status <> 'completed' AND l.doc_id IS NOT NULL THEN 'label' ELSE a.ai_category END AS ai_category,
             CAST(CASE WHEN a.ai_status <> 'completed' AND l.doc_id IS NOT NULL THEN 3 + l.quality ELSE a.ai_urgency END AS INTEGER) AS ai_urgency,
             CASE WHEN a.ai_status <> 'completed' AND l.doc_id IS NOT NULL THEN 'quality ' || l.quality ELSE a.summary END AS summary,
             CAST(coalesce(len(CASE WHEN a.ai_status = 'completed' THEN a.embedding ELSE coalesce(e.embedding, a.embedding) END), -1) AS INTEGER)
             AS dims
           FROM articles a LEFT JOIN labels l ON l.doc_id = a.id
           LEFT JOIN (SELECT vec_id + 200 AS id, embedding FROM embeddings) e ON e.id = a.id""", "articles")
def apply_enrichment(spark, folder):
    a = D.articles(spark, folder)
    analysis = table(spark, folder, "labels").select(
        F.col("doc_id").alias("id"), F.expr("concat('quality ', quality)").alias("summary"),
        F.array(F.lit("label")).alias("tags"), F.lit("label").alias("category"), (F.col("quality") + 3).alias("urgency"))
    vectors = table(spark, folder, "embeddings").select((F.col("vec_id") + 200).alias("id"), "embedding")
    return M.apply_enrichment(a, analysis, vectors).select(
        "id", "ai_status", "ai_error_log", "ai_category", "ai_urgency", "summary", F.coalesce(F.size("embedding"), F.lit(-1)).alias("dims"))


@query("""SELECT a.id, CASE WHEN a.id % 4 = 0 OR a.ai_status = 'completed' THEN a.ai_status WHEN l.doc_id IS NOT NULL THEN 'completed' ELSE 'failed' END
             AS ai_status, CASE WHEN a.id % 4 = 0 OR a.ai_status = 'completed' THEN a.ai_error_log WHEN l.doc_id IS NULL
             THEN 'AI returned no data' END AS ai_error_log,
             CASE WHEN a.id % 4 <> 0 AND a.ai_status <> 'completed' AND l.doc_id IS NOT NULL THEN 'quality ' || l.quality ELSE a.summary END AS summary,
             round(list_sum(list_transform(CASE WHEN a.id % 4 = 0 OR a.ai_status = 'completed' THEN a.embedding
               ELSE coalesce(e.embedding, a.embedding) END, lambda x: abs(CAST(x AS DOUBLE)))), 6) AS weight
           FROM articles a LEFT JOIN labels l ON l.doc_id = a.id
           LEFT JOIN (SELECT vec_id + 200 AS id, embedding FROM embeddings) e ON e.id = a.id""", "articles")
def stored_enrichment(spark, folder):
    """Analyses and vectors for three of four articles of a bucketed table; the others are not asked for."""
    a = D.articles(spark, folder)
    analysis = table(spark, folder, "labels").select(
        F.col("doc_id").alias("id"), F.expr("concat('quality ', quality)").alias("summary"),
        F.array(F.lit("label")).alias("tags"), F.lit("label").alias("category"), (F.col("quality") + 3).alias("urgency"))
    vectors = table(spark, folder, "embeddings").select((F.col("vec_id") + 200).alias("id"), "embedding")
    stored = _store(a)
    ST.enrich_stored(stored, D.articles(spark, folder, ["id", "url"]).filter("id % 4 <> 0"), analysis, vectors)
    weight = F.aggregate(F.transform("embedding", lambda x: F.abs(x.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return stored.rows(spark).select("id", "ai_status", "ai_error_log", "summary", F.round(weight, 6).alias("weight"))


@query("SELECT id, url, ai_status FROM articles WHERE ai_status <> 'failed'", "articles")
def delete_failed(spark, folder):
    return M.delete_failed(D.articles(spark, folder, ["id", "url", "ai_status"]))


@query("SELECT id, name, url FROM jobs WHERE id NOT IN (SELECT user_id FROM events WHERE value > 200)", "jobs")
def delete_job(spark, folder):
    gone = table(spark, folder, "events").filter("value > 200").select(F.col("user_id").alias("id"))
    return M.delete_jobs(D.jobs(spark, folder), gone).select("id", "name", "url")


# Requests: a page url as given, as a feed, or forced to a single article.
_REQUEST = "CASE page_id % 3 WHEN 0 THEN url || '/feed' ELSE url END"
_CREATED = f"""
    SELECT CAST(row_number() OVER (ORDER BY md5(url), url) AS BIGINT) AS id, CASE WHEN page_id % 4 = 0 THEN 'named ' || page_id ELSE
        CASE kind WHEN 'rss' THEN 'RSS Feed' WHEN 'single' THEN 'Single Article' ELSE 'Site Discovery' END || ': ' || {O.netloc('url')}
        END AS name, url, kind AS job_type, CAST(CASE kind WHEN 'single' THEN 1 ELSE 10 END AS INTEGER) AS items_limit,
      CAST(CASE kind WHEN 'rss' THEN 600 WHEN 'single' THEN 0 ELSE 3600 END AS INTEGER) AS interval_seconds, TRUE AS is_active,
      CAST(NULL AS TIMESTAMP) AS last_triggered_at, {_NOW} AS created_at
    FROM (SELECT page_id, u AS url, CASE WHEN page_id % 5 = 1 THEN 'single' ELSE {O.source_type('u')} END AS kind
      FROM (SELECT page_id, {_REQUEST} AS u FROM pages))"""


def _created(spark, folder):
    asked = D.page_urls(spark, folder).select(
        F.expr(_REQUEST).alias("url"), F.expr("case when page_id % 4 = 0 then concat('named ', page_id) end").alias("name"),
        F.expr("case when page_id % 5 = 1 then true end").alias("force_single"))
    return M.create_jobs(asked, now())


@query(_CREATED)
def create_jobs(spark, folder):
    return _created(spark, folder)


@query(f"""WITH made AS ({_CREATED}), hs AS (SELECT DISTINCT {O.netloc('url')} AS host FROM pages),
           old AS (SELECT CAST(row_number() OVER (ORDER BY md5(host), host) AS BIGINT) AS id, host AS domain FROM hs WHERE md5(host) < '8'),
           src AS (SELECT * FROM old UNION ALL SELECT coalesce((SELECT max(id) FROM old), 0) + row_number() OVER (ORDER BY md5(d), d), d
             FROM (SELECT DISTINCT {O.netloc('url')} AS d FROM made WHERE job_type = 'discovery') WHERE d NOT IN (SELECT domain FROM old))
           SELECT m.id AS job_id, CASE job_type WHEN 'rss' THEN 'poll_feed' WHEN 'discovery' THEN 'discover' ELSE 'ingest' END AS task,
             CASE WHEN job_type <> 'discovery' THEN url END AS url, CASE WHEN job_type = 'discovery' THEN s.id END AS source_id,
             CASE WHEN job_type <> 'single' THEN items_limit END AS items_limit
           FROM made m LEFT JOIN src s ON s.domain = {O.netloc('m.url')}""")
def initial_job_dispatch(spark, folder):
    return C.initial_dispatch(_created(spark, folder), D.sources(spark, folder, "8"), now()).work


@query(f"""SELECT task_id, CASE WHEN id % 2 = 0 THEN 'completed' ELSE status END AS status,
             CASE WHEN id % 2 = 0 THEN coalesce(CASE WHEN id % 4 = 0 THEN 'done' END, generated_text) ELSE generated_text END AS generated_text,
             CASE WHEN id % 2 = 0 AND id % 6 = 0 THEN NULL ELSE array_to_string(search_queries, '|') END AS search_queries,
             CASE WHEN id % 2 = 0 THEN {_NOW} ELSE updated_at END AS updated_at FROM runs""", "runs")
def update_generation_status(spark, folder):
    runs = D.runs(spark, folder)
    patch = runs.filter("id % 2 = 0").select(
        "task_id", F.lit("completed").alias("status"), F.when(F.col("id") % 4 == 0, "done").alias("generated_text"),
        F.lit(None).cast("array<string>").alias("search_queries"), (F.col("id") % 6 == 0).alias("search_queries_set"))
    out = M.update_runs(runs, patch, now())
    return out.select(
        "task_id", "status", "generated_text", F.array_join("search_queries", "|").alias("search_queries"), "updated_at")


@query(f"SELECT domain, CASE WHEN domain IN (SELECT {O.netloc('url')} FROM page_log WHERE status = 200) THEN {_NOW} ELSE last_crawled END "
       "AS last_crawled FROM sources", "sources", "page_log")
def touch_last_crawled(spark, folder):
    from pageloom.functions.urls import netloc

    read = D.page_log(spark, folder).filter("status = 200").select(netloc("url").alias("domain"))
    return M.touch(D.sources(spark, folder), read, "domain", "last_crawled", now()).select("domain", "last_crawled")


_DUE = f"is_active AND (last_triggered_at IS NULL OR epoch({_NOW} - last_triggered_at) >= interval_seconds)"


@query(f"SELECT id, CASE WHEN {_DUE} THEN {_NOW} ELSE last_triggered_at END AS last_triggered_at FROM jobs", "jobs")
def touch_last_triggered(spark, folder):
    jobs = D.jobs(spark, folder)
    due = J.due_jobs(jobs, now()).select("id")
    return M.touch(jobs, due, "id", "last_triggered_at", now()).select("id", "last_triggered_at")


@query("SELECT id, name FROM jobs WHERE is_active", "jobs")
def active_jobs(spark, folder):
    return J.active_jobs(D.jobs(spark, folder)).select("id", "name")


@query(f"SELECT id, name FROM jobs WHERE {_DUE}", "jobs")
def due_jobs(spark, folder):
    return J.due_jobs(D.jobs(spark, folder), now()).select("id", "name")


@query("SELECT id, name, upper(job_type) || ' | ' || items_limit || ' items | ' || interval_seconds || 's' AS caption FROM jobs", "jobs")
def job_caption(spark, folder):
    return J.job_caption(D.jobs(spark, folder))


@query("SELECT id, name, created_at FROM jobs", "jobs")
def jobs_newest(spark, folder):
    return J.jobs_newest(D.jobs(spark, folder)).select("id", "name", "created_at")


@query("SELECT id, CAST(epoch(date_trunc('second', last_triggered_at)) AS BIGINT) IS NOT NULL AS ran, "
       f"CAST(floor(epoch_us({_NOW} - last_triggered_at) / 1000000) AS BIGINT) AS seconds FROM jobs", "jobs")
def elapsed_seconds(spark, folder):
    last = F.col("last_triggered_at")
    return D.jobs(spark, folder).select(
        "id", last.isNotNull().alias("ran"), T.elapsed_seconds(last, now()).alias("seconds"))


@query("""SELECT event_id, CAST(CASE WHEN NOT has_new THEN least(86400, CAST(floor(cur * 1.5::DOUBLE) AS BIGINT)) WHEN u IS NULL OR u = 0
             THEN cur WHEN u >= 8 THEN 300 WHEN u >= 5 THEN 1800 ELSE greatest(3600, CAST(floor(cur * 0.95::DOUBLE) AS BIGINT)) END AS INTEGER)
             AS next_interval FROM (SELECT event_id, CAST(event_id % 90000 AS INTEGER) AS cur, user_id % 4 <> 0 AS has_new,
             CASE WHEN user_id % 7 <> 0 THEN user_id % 11 END AS u FROM events)""")
def adjust_interval(spark, folder):
    u = F.col("user_id")
    return table(spark, folder, "events").select(
        "event_id",
        T.adjust_interval(
            (F.col("event_id") % 90000).cast("int"), F.when(u % 7 != 0, u % 11).cast("int"), u % 4 != 0
        ).alias("next_interval"))


@query("SELECT j.id, j.url, s.id AS source_id FROM (SELECT page_id AS id, url FROM pages) j "
       f"LEFT JOIN half_sources s ON s.domain = {O.netloc('j.url')}", "half_sources")
def job_source_join(spark, folder):
    made = D.page_urls(spark, folder).select(F.col("page_id").alias("id"), "url")
    return J.resolve_jobs(made, D.sources(spark, folder, "8")).select("id", "url", "source_id")


@query(f"SELECT p.page_id, p.url, s.id AS source_id FROM pages p LEFT JOIN half_sources s ON s.domain = {O.netloc('p.url')}",
       "half_sources")
def article_source_join(spark, folder):
    return A.with_source(D.page_urls(spark, folder).select("page_id", "url"), D.sources(spark, folder, "8"))


@query(f"SELECT p.page_id, p.url, s.id AS source_id, s.domain FROM pages p JOIN half_sources s ON s.domain = {O.netloc('p.url')}",
       "half_sources")
def source_articles(spark, folder):
    return A.source_articles(D.sources(spark, folder, "8"), D.page_urls(spark, folder).select("page_id", "url"))


@query("SELECT 'https://' || source || '.example.com/' || lang || '/' || (doc_id + 100) AS url FROM documents EXCEPT SELECT url FROM articles",
       "articles")
def new_urls(spark, folder):
    wanted = table(spark, folder, "documents").selectExpr(
        "concat('https://', source, '.example.com/', lang, '/', doc_id + 100) as url")
    return A.new_urls(wanted, D.articles(spark, folder, ["url"]))


@query("SELECT id, title FROM articles WHERE id IN (SELECT item_id FROM benchmark)", "articles")
def articles_by_ids(spark, folder):
    ids = table(spark, folder, "benchmark").select(F.col("item_id").alias("id"))
    return A.articles_by_ids(D.articles(spark, folder, ["id", "title"]), ids)


@query("SELECT task_id, user_prompt, status FROM runs WHERE task_id = 'gen_7'", "runs")
def run_by_id(spark, folder):
    return R.run_by_id(D.runs(spark, folder), "gen_7").select("task_id", "user_prompt", "status")


@query("""SELECT task_id, status, CASE WHEN status = 'processing' AND coalesce(len(search_queries), 0) > 0 THEN 'Hunting for new data...'
             WHEN status = 'processing' THEN 'Analyzing & Synthesizing...' ELSE status END AS progress, generated_text,
             CAST(coalesce(len(used_article_ids), 0) AS BIGINT) AS articles_used, created_at FROM runs""", "runs")
def run_progress(spark, folder):
    return R.run_progress(D.runs(spark, folder))


@query("""SELECT ai_category, count(*) AS rows, count(*) FILTER (WHERE ai_status = 'completed') AS completed,
             count(*) FILTER (WHERE ai_status = 'failed') AS failed FROM articles GROUP BY ai_category""", "articles")
def run_counts(spark, folder):
    a = D.articles(spark, folder, ["ai_category", "ai_status"])
    return L.run_counts(a, "ai_category", completed=F.col("ai_status") == "completed", failed=F.col("ai_status") == "failed")


@query("""SELECT id, CASE WHEN id % 2 = 0 THEN CAST(least(86400, floor(interval_seconds * 1.5)) AS INTEGER) ELSE interval_seconds END
            AS interval_seconds FROM jobs""", "jobs")
def rest_jobs(spark, folder):
    jobs = D.jobs(spark, folder)
    return C.rest_jobs(jobs, jobs.filter("id % 2 = 0").select("id")).select("id", "interval_seconds")
