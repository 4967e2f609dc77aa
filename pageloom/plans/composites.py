"""Whole jobs, chained from the operators. Each takes and returns DataFrames."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom import schemas
from pageloom.functions import fixed_values as V
from pageloom.functions.jsonx import content_json
from pageloom.functions.schedule import adjust_interval
from pageloom.functions.text import audit_prompt, parse_audit
from pageloom.functions.urls import netloc
from pageloom.operators import articles as A
from pageloom.operators import jobs as J
from pageloom.operators import limits as L
from pageloom.operators import mutations as M
from pageloom.operators import research as R
from pageloom.operators.crawl import crawl_frontier
from pageloom.operators.enrich import Analyzer, Embedder, answer_of, embedding, told_analysis
from pageloom.operators.extract import extract_articles
from pageloom.operators.memory import knn_join
from pageloom.operators.redirects import normalized_sources
from pageloom.operators.robots_join import robots_join
from pageloom.session import materialize
from pageloom.sources.feeds import feed_items, sitemap_links
from pageloom.sources.robots import guess_sitemaps, robots_sitemaps
from pageloom.sources.tables import fetched_pages


class Ingested(NamedTuple):
    articles: DataFrame
    sources: DataFrame
    logs: DataFrame


class Discovered(NamedTuple):
    urls: DataFrame
    sources: DataFrame


class Dispatched(NamedTuple):
    work: DataFrame
    jobs: DataFrame
    unmatched: DataFrame


class Promoted(NamedTuple):
    sources: DataFrame
    jobs: DataFrame


class Researched(NamedTuple):
    hits: DataFrame
    audit: DataFrame
    writer: DataFrame
    used: DataFrame
    promoted: Promoted
    gaps: DataFrame | None = None


class Dashboard(NamedTuple):
    newest: DataFrame
    priority: DataFrame
    stream: DataFrame
    trend: DataFrame
    mix: DataFrame


def page_verdicts(pages: DataFrame, robots_files: DataFrame) -> DataFrame:
    """What becomes of each page: (url, seq, error, allowed, ok). No html takes part."""
    narrow = fetched_pages(pages).select("url", "seq", "error", F.col("html").isNotNull().alias("_has"))
    checked = robots_join(narrow, robots_files)
    return checked.withColumn("ok", F.col("allowed") & F.col("error").isNull() & F.col("_has")).drop("_has")


def read_articles(pages: DataFrame, verdicts: DataFrame, sources: DataFrame, ts: Column) -> DataFrame:
    """Article columns of the last readable page of each url: extraction, content document, source.

    Pages are extracted where they are scanned; verdicts and sources meet as narrow rows, and the text then moves once, by url.
    """
    wanted = verdicts.filter("ok and url is not null").groupBy("url").agg(F.max("seq").alias("_last"))
    fetched = fetched_pages(pages).filter("error is null and html is not null").select("url", "html", "seq")
    read = extract_articles(fetched).withColumn("content", content_json(ts)).drop("html")
    found = read.join(A.with_source(wanted, sources), "url").filter("seq = _last").drop("_last")
    return M.last_per_url(found.withColumn("_seq", F.col("seq")), "_seq")


def page_log_rows(verdicts: DataFrame, stored: DataFrame, ts: Column) -> DataFrame:
    """A log row for every page: blocked, failed, updated (its url is in ``stored``) or created."""
    told = verdicts.join(stored.select("url", F.lit(True).alias("_stored")), "url", "left")
    level = F.when(~F.col("allowed"), "WARN").when(~F.col("ok"), "ERROR").otherwise("INFO")
    verb = F.when(F.col("_stored"), "Updated").otherwise("Created")
    message = (
        F.when(~F.col("allowed"), F.concat(F.lit(V.BLOCKED), F.col("url")))
        .when(~F.col("ok"), F.concat(F.lit(V.FETCH_FAILED), F.coalesce("error", F.lit("no content"))))
        .otherwise(F.concat(verb, F.lit(" basic data for "), netloc("url")))
    )
    return M.log_rows(told, level, message, ts)


def ingest_pages(
    pages: DataFrame, robots_files: DataFrame, articles: DataFrame, sources: DataFrame, ts: Column, seq: str = "page_id"
) -> Ingested:
    """Register sources, apply robots, extract, merge into the article table, and log every page.

    Verdicts and extracted rows are used several times, so each is written once to the checkpoint folder.
    """
    registered = materialize(M.register_sources(sources, pages.select("url"), ts))
    work = pages.withColumn("seq", F.col(seq))
    checked = materialize(page_verdicts(work, robots_files))
    rows = materialize(read_articles(work, checked, registered, ts))
    merged = M.upsert_articles(articles, rows, ts)
    return Ingested(merged, registered, page_log_rows(checked, articles, ts))


def enrich_articles(
    articles: DataFrame,
    analyzers: Sequence[Analyzer] | None = None,
    model: Embedder | None = None,
    dim: int = V.EMBEDDING_DIM,
) -> DataFrame:
    """Analyse and embed every article that is not completed; completed ones pass through unread.

    One scan; analysis and vector are computed next to the row they belong to, so nothing is shuffled. The error log of an
    article that has failed holds the analyser's error, if there was one.
    """
    marked = articles.withColumn("_open", F.col("id").isNotNull() & ~F.col("ai_status").eqNullSafe(schemas.COMPLETED))
    text = F.when(F.col("_open"), F.col("clean_text"))
    told = marked.withColumns({"_told": told_analysis(text, analyzers), "_v": embedding(text, model, dim)})
    read = told.withColumn("_a", answer_of(F.col("_told")))
    done, lost = F.col("_open") & F.col("_a").isNotNull(), F.col("_open") & F.col("_a").isNull()
    values = {
        "summary": F.when(done, F.coalesce(F.nullif(F.col("_a.summary"), F.lit("")), "summary")).otherwise(F.col("summary")),
        "ai_tags": F.when(done, F.col("_a.tags")).otherwise(F.col("ai_tags")),
        "ai_category": F.when(done, F.col("_a.category")).otherwise(F.col("ai_category")),
        "ai_urgency": F.when(done, F.col("_a.urgency")).otherwise(F.col("ai_urgency")).cast("int"),
        "embedding": F.coalesce("_v", "embedding"),
        "ai_status": F.when(done, schemas.COMPLETED).when(lost, schemas.FAILED).otherwise(F.col("ai_status")),
        "ai_error_log": F.when(lost, F.coalesce("_told.error", F.lit(V.NO_ANALYSIS))).when(~F.col("_open"), F.col("ai_error_log")),
    }
    return read.select(*[values[c].alias(c) if c in values else F.col(c) for c in articles.columns])


class Enriched(NamedTuple):
    articles: DataFrame
    jobs: DataFrame


def enrich_for_jobs(
    articles: DataFrame, asked: DataFrame, jobs: DataFrame,
    analyzers: Sequence[Analyzer] | None = None, model: Embedder | None = None, dim: int = V.EMBEDDING_DIM,
) -> Enriched:
    """Enrich articles and give the jobs that asked for them the intervals their urgency calls for.

    ``asked``: (id, job_id, ts), an article that a job has brought and when. Every article that became completed in this run and has an
    urgency counts once for its job, in the order of ``ts``, then id. The enriched table is written once.
    """
    out = materialize(enrich_articles(articles, analyzers, model, dim))
    fresh = articles.filter(~F.col("ai_status").eqNullSafe(schemas.COMPLETED)).select("id")
    done = out.filter((F.col("ai_status") == schemas.COMPLETED) & (F.coalesce("ai_urgency", F.lit(0)) != 0)).select("id", F.col("ai_urgency").alias("urgency"))
    history = asked.dropDuplicates(["id", "job_id"]).join(done.join(fresh, "id", "left_semi"), "id").select("job_id", "ts", F.col("id").alias("seq"), "urgency")
    return Enriched(out, adapt_jobs(jobs, history))


def adapt_jobs(jobs: DataFrame, history: DataFrame) -> DataFrame:
    """Job table with the interval each job has after its newly enriched articles."""
    adapted = J.adapted_intervals(jobs, J.interval_state(history)).select(
        F.col("job_id").alias("id"), F.col("interval_seconds").alias("_interval")
    )
    joined = jobs.join(adapted, "id", "left")
    return joined.select(
        *[F.coalesce("_interval", c).alias(c) if c == "interval_seconds" else F.col(c) for c in jobs.columns]
    )


def rest_jobs(jobs: DataFrame, quiet: DataFrame) -> DataFrame:
    """Job table after runs without anything new: the jobs in ``quiet`` (id) wait longer."""
    hits = quiet.select("id").distinct().withColumn("_quiet", F.lit(True))
    longer = adjust_interval(F.col("interval_seconds"), F.lit(None).cast("int"), F.lit(False))
    joined = jobs.join(hits, "id", "left")
    interval = F.when(F.col("_quiet"), longer).otherwise(F.col("interval_seconds"))
    return joined.select(*[interval.alias(c) if c == "interval_seconds" else F.col(c) for c in jobs.columns])


def find_sitemaps(
    sources: DataFrame, redirects: DataFrame, robots_files: DataFrame, fetches: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Where discovery starts: the base address of each source (source, seed), and its sitemaps (host, sitemap_url).

    A source's address is followed through its redirects. The robots file of the host it leads to names the sitemaps, if it was answered
    with 200; hosts without any are asked for the usual places, of which those with status 200 in ``fetches`` (url, status) count.
    """
    given = sources.filter("domain is not null").select(F.col("domain").alias("source"), F.concat(F.lit("https://"), F.col("domain")).alias("url")).distinct()
    bases = materialize(normalized_sources(given, redirects).select("source", F.col("base").alias("seed"), netloc("base").alias("at")))
    declared = materialize(robots_sitemaps(robots_files.filter("status = 200")).withColumnRenamed("host", "at"))
    hosts = bases.select("at").distinct()
    silent = hosts.join(declared, "at", "left_anti").select(F.col("at").alias("host"))
    guessed = guess_sitemaps(silent, fetches).withColumnRenamed("host", "at")
    sitemaps = bases.join(declared.unionByName(guessed), "at").select(F.col("source").alias("host"), "sitemap_url")
    return bases.select("source", "seed"), sitemaps


def discover_urls(
    sources: DataFrame,
    sitemaps: DataFrame,
    sitemap_docs: DataFrame,
    edges: DataFrame,
    articles: DataFrame,
    ts: Column,
    limit: int = 50,
    force: bool = False,
    seeds: DataFrame | None = None,
) -> Discovered:
    """Urls to read for each source: from its ranked sitemaps, else from a crawl; stored ones left out.

    ``sitemaps``: (host, sitemap_url); ``sitemap_docs``: (sitemap_url, xml); ``seeds``: (source, seed), the address at which a source's
    crawl starts, by default its domain. ``find_sitemaps`` makes sitemaps and seeds.
    """
    domains = sources.select(F.col("domain").alias("source"))
    ranked = L.rank_sitemaps(sitemaps).select("sitemap_url", F.col("host").alias("source"), "rank")
    ranked = materialize(ranked.join(domains, "source", "left_semi"))
    listed = (
        sitemap_links(sitemap_docs, ranked).join(ranked, "sitemap_url")
        .select("source", "rank", F.struct("child", "pos").alias("pos"), "url")
    )
    from_sitemaps = materialize(L.discovery_limit(listed, limit))
    open_sources = domains if force else domains.join(from_sitemaps.select("source").distinct(), "source", "left_anti")
    if seeds is None:
        seeds = domains.select("source", F.concat(F.lit("https://"), F.col("source")).alias("seed"))
    wanted = materialize(seeds.join(open_sources.distinct(), "source", "left_semi").select("source", "seed"))
    crawled = crawl_frontier(wanted.select("seed"), edges, max_articles=limit).join(wanted, "seed").select("source", "url")
    urls = A.new_urls(L.union_discovery(from_sitemaps, crawled, force), articles)
    return Discovered(urls, M.touch(sources, sources.select("domain"), "domain", "last_crawled", ts))


def poll_feeds(feeds: DataFrame, jobs: DataFrame, articles: DataFrame) -> DataFrame:
    """New urls of each feed job: its first items, cut before the stored ones are left out."""
    asked = jobs.filter(F.col("job_type") == schemas.RSS).select(
        F.col("url").alias("feed_url"), F.col("id").alias("job_id"), "items_limit"
    )
    watched = feeds.join(asked.select("feed_url").distinct(), "feed_url", "left_semi")
    items = feed_items(watched).join(asked, "feed_url")
    return A.new_urls(L.feed_limit(items, "items_limit"), articles).select("job_id", "feed_url", "pos", "url")


def dispatch_jobs(jobs: DataFrame, sources: DataFrame, now: Column) -> Dispatched:
    """Work rows of the due jobs, the job table with their stamps, and discovery jobs without a source."""
    due = J.resolve_jobs(J.due_jobs(jobs, now), sources)
    stamped = M.touch(jobs, due.select("id"), "id", "last_triggered_at", now)
    unmatched = due.filter((F.col("job_type") == schemas.DISCOVERY) & F.col("source_id").isNull())
    return Dispatched(J.work_rows(due), stamped, unmatched.select("id", "domain"))


def initial_dispatch(new_jobs: DataFrame, sources: DataFrame, ts: Column) -> Dispatched:
    """Work rows of jobs just created, due or not; discovery jobs register their domain first."""
    wanted = new_jobs.filter(F.col("job_type") == schemas.DISCOVERY).select("url")
    registered = M.register_sources(sources, wanted, ts, crawled=False, https=True)
    resolved = J.resolve_jobs(new_jobs, registered)
    stamped = new_jobs.withColumn("last_triggered_at", ts)
    return Dispatched(J.work_rows(resolved), stamped, registered)


def promote_domains(
    used: DataFrame, articles: DataFrame, jobs: DataFrame, sources: DataFrame, ts: Column
) -> Promoted:
    """Daily discovery jobs, and sources, for the unmonitored domains of the used articles."""
    fresh = materialize(R.promotions(used, articles, jobs))
    urls = fresh.select(F.concat(F.col("scheme"), F.lit("://"), F.col("domain")).alias("url"))
    return Promoted(
        M.register_sources(sources, urls, ts, crawled=False),
        jobs.unionByName(R.promoted_jobs(fresh, jobs, ts).select(*jobs.columns)),
    )


def gap_list(queries: DataFrame, replies: DataFrame, results: DataFrame, n: int) -> DataFrame:
    """Urls to fetch for each query (query_id, prompt) that the auditor found lacking: (run, url), ``n`` per run.

    ``replies``: (query_id, reply) of the auditor; ``results``: (query, rank, url) of the web search. A query without a
    reply counts as lacking and is searched by its own prompt.
    """
    asked = queries.select("query_id", "prompt").join(replies.select("query_id", "reply"), "query_id", "left")
    searches = asked.withColumn("audit", parse_audit(F.col("reply"), F.col("prompt"))).select(
        F.col("query_id").alias("run"), F.posexplode("audit.queries").alias("query_pos", "query")
    )
    return L.gap_targets(searches.join(results.select("query", "rank", "url"), "query").select("run", "query_pos", "rank", "url"), n)


def research_report(
    queries: DataFrame, articles: DataFrame, jobs: DataFrame, sources: DataFrame, ts: Column,
    replies: DataFrame | None = None, results: DataFrame | None = None, fetch: int = V.WRITER_HITS,
) -> Researched:
    """For each query (query_id, prompt, embedding): audit text, writer context, used articles, promotions.

    One search for ten hits, written once, serves the audit, which takes the first five, and the writer. With the
    auditor's ``replies`` and search ``results`` there is also the list of urls to fetch (see ``gap_list``).
    """
    found = materialize(knn_join(articles, queries, V.WRITER_HITS))
    hits = found.join(articles.select("id", "title", "summary"), "id")
    audit = R.audit_context(queries, hits).join(queries.select("query_id", "prompt"), "query_id").select(
        "query_id", "context", audit_prompt(F.col("prompt"), F.col("context")).alias("audit_prompt")
    )
    promoted = promote_domains(found.select("id").distinct(), articles, jobs, sources, ts)
    gaps = gap_list(queries, replies, results, fetch) if replies is not None and results is not None else None
    return Researched(found, audit, R.context_block(hits, "writer"), R.used_article_ids(found), promoted, gaps)


def dashboard_tables(articles: DataFrame) -> Dashboard:
    """The newest rows, read once, and what the dashboard shows of them."""
    newest = A.coerced(A.latest(articles)).cache()
    return Dashboard(
        newest, A.priority_cards(newest), A.stream_cards(newest), A.urgency_trend(newest), A.category_mix(newest)
    )
