"""Research runs: context, gaps, progress, promotion of new domains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom import schemas
from pageloom.functions import fixed_values as V
from pageloom.functions import urls as U
from pageloom.operators.skew import assign_ids
from pageloom.session import materialize


def context_block(hits: DataFrame, form: str) -> DataFrame:
    """Titles and summaries of each query's hits in rank order, as one text.

    ``hits``: (query_id, rank, title, summary). Only the leading hits of the form enter, so the list
    per query is bounded. A missing value reads ``None``, as in the text this replaces.
    """
    n, sep, pattern = {
        "audit": (V.AUDIT_HITS, "\n", "- %s: %s"),
        "writer": (V.WRITER_HITS, "\n\n", "Source: %s\nContent: %s"),
    }[form]
    line = F.format_string(
        pattern, F.coalesce("title", F.lit("None")), F.coalesce("summary", F.lit("None"))
    )
    lines = F.sort_array(F.collect_list(F.struct("rank", line.alias("line"))))
    text = F.array_join(F.transform(lines, lambda x: x["line"]), sep)
    return hits.filter(F.col("rank") <= n).groupBy("query_id").agg(text.alias("context"))


def audit_context(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Audit context of every query, also of those without a hit."""
    blocks = context_block(hits, "audit")
    return queries.select("query_id").join(blocks, "query_id", "left").select(
        "query_id", F.coalesce("context", F.lit(V.NO_CONTEXT)).alias("context")
    )


def used_article_ids(hits: DataFrame, n: int = V.WRITER_HITS) -> DataFrame:
    ranked = F.sort_array(F.collect_list(F.struct("rank", "id")))
    return hits.filter(F.col("rank") <= n).groupBy("query_id").agg(
        F.transform(ranked, lambda x: x["id"]).alias("used_article_ids")
    )


def gap_fill_status(requested: DataFrame, articles: DataFrame, poll: Column) -> DataFrame:
    """Per run (run, url): urls asked for, urls ready, and whether to stop waiting at this poll."""
    done = articles.filter(F.col("ai_status") == schemas.COMPLETED).select("url", F.lit(True).alias("_done"))
    counted = (
        requested.select("run", "url").distinct().join(done, "url", "left")
        .groupBy("run")
        .agg(F.count(F.lit(1)).alias("requested"), F.count_if(F.col("_done").isNotNull()).alias("ready"))
    )
    stop = (
        (F.col("ready") >= F.col("requested"))
        | ((F.col("ready") > 0) & (poll > V.GAP_POLLS_PARTIAL))
        | (poll >= V.GAP_POLLS_MAX)
    )
    return counted.withColumn("stop", stop)


def gap_poll(asked_at: Column, done_at: Column) -> Column:
    """The first poll, from 0, that sees a url done; polls are ``GAP_POLL_SECONDS`` apart from the request on."""
    waited = (F.unix_micros(done_at.cast("timestamp")) - F.unix_micros(asked_at.cast("timestamp"))) / (V.GAP_POLL_SECONDS * 1_000_000)
    return F.when(waited.isNotNull(), F.greatest(F.ceil(waited), F.lit(0))).cast("int")


def gap_outcomes(requested: DataFrame, answers: DataFrame) -> DataFrame:
    """How the wait of each run ended: (run, requested, answered, ready, stop_poll, state).

    ``requested``: (run, url); ``answers``: (run, url, poll), the poll that saw the url done, or null when the wait for it ran out.
    A run stops at the poll at which all its urls are done (``ready``); else at the first poll after ``GAP_POLLS_PARTIAL`` that sees
    any of them done (``partial``); else at the last one (``timed_out``). A run with urls that are neither done nor given up is
    ``waiting``; it has no poll yet.
    """
    last = V.GAP_POLLS_MAX - 1
    told = answers.groupBy("run", "url").agg(F.min("poll").alias("poll"))
    in_time = F.when(F.col("poll") <= last, F.col("poll"))
    asked = requested.select("run", "url").distinct()
    polls = asked.join(told.withColumn("_told", F.lit(True)), ["run", "url"], "left").withColumn("poll", in_time)
    runs = polls.groupBy("run").agg(
        F.count(F.lit(1)).alias("requested"), F.count_if(F.col("_told").isNotNull()).alias("answered"), F.count("poll").alias("done"),
        F.min("poll").alias("first"), F.max("poll").alias("slowest"))
    partial = F.when(F.col("first").isNotNull(), F.greatest(F.col("first"), F.lit(V.GAP_POLLS_PARTIAL + 1)))
    whole = F.when(F.col("done") == F.col("requested"), F.col("slowest"))
    stop = F.when(F.col("answered") == F.col("requested"), F.coalesce(F.least(whole, partial), F.lit(last)))
    stopped = runs.withColumn("stop_poll", stop)
    ready = polls.join(stopped.select("run", "stop_poll"), "run").groupBy("run").agg(F.count_if(F.col("poll") <= F.col("stop_poll")).alias("ready"))
    state = (
        F.when(F.col("stop_poll").isNull(), "waiting").when(F.col("ready") >= F.col("requested"), "ready")
        .when(F.col("ready") > 0, "partial").otherwise("timed_out")
    )
    return stopped.join(ready, "run").select("run", "requested", "answered", "ready", "stop_poll", state.alias("state"))


def run_by_id(runs: DataFrame, task_id: str) -> DataFrame:
    return runs.filter(F.col("task_id") == task_id)


def run_progress(runs: DataFrame) -> DataFrame:
    """What to tell about a run, and how many articles it used."""
    hunting = F.coalesce(F.size("search_queries") > 0, F.lit(False))
    progress = (
        F.when((F.col("status") == schemas.PROCESSING) & hunting, V.HUNTING)
        .when(F.col("status") == schemas.PROCESSING, V.SYNTHESIZING)
        .otherwise(F.col("status"))
    )
    used = F.when(F.col("used_article_ids").isNull(), 0).otherwise(F.size("used_article_ids"))
    return runs.select(
        "task_id", "status", progress.alias("progress"), "generated_text",
        used.cast("long").alias("articles_used"), "created_at",
    )


# Characters of the piece by which a domain looks for the urls that hold it.
_ANCHOR = 8


def _parts(text: Column, length: Column) -> Column:
    """All runs of ``length`` characters of a text, as an array."""
    places = F.sequence(F.lit(1), F.length(text) - length + 1)
    none = F.array().cast("array<string>")
    return F.when(F.length(text) >= length, F.transform(places, lambda i: F.substring(text, i, length))).otherwise(none)


def unmonitored_domains(domains: DataFrame, jobs: DataFrame) -> DataFrame:
    """Domains that no discovery job's url contains, in any case; a null domain is left out.

    ``_`` and ``%`` in a domain match any character and any run, as in the store this replaces. A domain is looked up by
    one piece of its plain text (of its longest plain run, for a pattern): the piece of up to ``_ANCHOR`` characters
    that the fewest urls hold. Urls with that piece are then compared. A url has one piece per place and length, so the
    work grows with the length of the urls. A pattern without plain text only asks whether some url is long enough.
    """
    watched = jobs.filter(F.col("job_type") == schemas.DISCOVERY).select(F.lower("url").alias("_url")).filter("_url is not null").distinct()
    low = F.lower("domain")
    runs = F.array_sort(F.split(low, "[%_]"), lambda a, b: F.length(b) - F.length(a))
    wanted = domains.filter("domain is not null").select(
        "domain", low.alias("_low"), F.element_at(runs, 1).alias("_run"), F.concat(F.lit("%"), F.replace(low, F.lit("\\"), F.lit("\\\\")), F.lit("%")).alias("_like"),
        (F.length("domain") - F.length(F.replace("domain", F.lit("_"), F.lit("")))).alias("_least"),
    ).distinct().withColumn("_length", F.least(F.lit(_ANCHOR), F.length("_run")))
    # one number, and at most _ANCHOR lengths
    longest = watched.agg(F.max(F.length("_url")).alias("n")).head()["n"]
    lengths = sorted(r["_length"] for r in wanted.select("_length").distinct().collect() if r["_length"])
    pieces = materialize(watched.select("_url", F.explode(F.array_distinct(F.concat(F.array().cast("array<string>"), *[_parts(F.col("_url"), F.lit(n)) for n in lengths]))).alias("_piece")))
    held = pieces.groupBy("_piece").agg(F.count(F.lit(1)).alias("_urls"))
    asked = wanted.filter("_length > 0").withColumn("_piece", F.explode(F.array_distinct(_parts(F.col("_run"), F.col("_length")))))
    anchors = asked.join(held, "_piece", "left").groupBy("domain", "_like").agg(
        F.min(F.struct(F.coalesce("_urls", F.lit(0)).alias("_urls"), "_piece")).alias("_best")
    ).select("domain", "_like", "_best._piece", "_best._urls").filter("_urls > 0").drop("_urls")
    found = anchors.join(pieces, "_piece").filter(F.expr("_url like _like")).select("domain")
    if longest is not None:
        found = found.unionByName(wanted.filter((F.col("_length") == 0) & (F.col("_least") <= longest)).select("domain"))
    return domains.filter("domain is not null").join(found.distinct(), "domain", "left_anti")


def promotions(used: DataFrame, articles: DataFrame, jobs: DataFrame) -> DataFrame:
    """Unmonitored domains of the used articles (``id``), each with the scheme of its first article."""
    urls = articles.select("id", "url").join(used.select("id"), "id", "left_semi")
    domains = (
        urls.select("id", U.netloc("url").alias("domain"), U.scheme("url").alias("scheme"))
        .filter("domain <> ''")
        .groupBy("domain")
        .agg(F.min_by("scheme", "id").alias("scheme"))
    )
    return unmonitored_domains(domains, jobs)


def promoted_jobs(new_domains: DataFrame, jobs: DataFrame, ts: Column) -> DataFrame:
    """A daily discovery job for each new domain."""
    return assign_ids(new_domains, "domain", jobs).select(
        "id",
        F.concat(F.lit(V.PROMOTED_NAME), F.col("domain")).alias("name"),
        F.concat(F.col("scheme"), F.lit("://"), F.col("domain")).alias("url"),
        F.lit(schemas.DISCOVERY).alias("job_type"),
        F.lit(V.PROMOTED_ITEMS).alias("items_limit"),
        F.lit(V.PROMOTED_INTERVAL).alias("interval_seconds"),
        F.lit(True).alias("is_active"),
        F.lit(None).cast("timestamp_ntz").alias("last_triggered_at"),
        ts.alias("created_at"),
    )
