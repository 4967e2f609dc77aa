"""Changing tables. Each operator returns the new content; the caller writes it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pageloom import schemas
from pageloom.functions import fixed_values as V
from pageloom.functions import urls as U
from pageloom.functions.text import non_empty, truncate
from pageloom.operators.skew import assign_ids
from pageloom.session import materialize

# Columns a fresh read of a page replaces. Everything else of a stored article stays as it is.
READ_COLS = (
    "source_id", "title", "author", "published_date", "main_image", "clean_text", "summary", "content",
)


def _null(df: DataFrame, name: str) -> Column:
    return F.lit(None).cast(df.schema[name].dataType).alias(name)


def last_per_url(batch: DataFrame, seq: str) -> DataFrame:
    """Last row of each url; Spark keeps one row per url and task before the shuffle."""
    order = W.partitionBy("url").orderBy(F.desc(seq))
    return batch.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n", seq)


def upsert_articles(current: DataFrame, batch: DataFrame, ts: Column, seq: str = "seq") -> DataFrame:
    """Merge freshly read pages (``url``, ``seq`` and any of ``READ_COLS``) into the article table.

    A stored url keeps id, creation time and enrichment values, takes the new page columns and goes
    back to pending without an error. A small batch is joined without moving the article table:
    the table is only on the streamed side of a left join and of a semi join on its url. The new
    rows are written once to the checkpoint folder, as numbering them reads them twice.
    """
    updates = [c for c in READ_COLS if c in batch.columns and c in current.columns]
    rows = last_per_url(batch.select("url", seq, *updates), seq)
    hit = F.col("_hit").isNotNull()
    renamed = rows.select("url", F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in updates])
    changed = {c: F.when(hit, F.col(f"_new_{c}")).otherwise(F.col(c)) for c in updates}
    changed["ai_status"] = F.when(hit, schemas.PENDING).otherwise(F.col("ai_status"))
    if "ai_error_log" in current.columns:
        changed["ai_error_log"] = F.when(~hit, F.col("ai_error_log"))
    kept = current.join(renamed, "url", "left").select(
        *[changed[c].alias(c) if c in changed else F.col(c) for c in current.columns]
    )
    known = current.select("url").join(rows.select("url"), "url", "left_semi")
    fresh = assign_ids(materialize(rows.join(known, "url", "left_anti")), "url", current.select("id"))
    added = fresh.select(
        *[
            F.col(c) if c in ("id", "url", *updates)
            else F.lit(schemas.PENDING).alias(c) if c == "ai_status"
            else ts.alias(c) if c == "created_at"
            else _null(current, c)
            for c in current.columns
        ]
    )
    return kept.unionByName(added)


def register_sources(
    sources: DataFrame, urls: DataFrame, ts: Column, crawled: bool = True, https: bool = False, ids: DataFrame | None = None
) -> DataFrame:
    """Add a source for every new domain of ``urls``; ``crawled`` stamps the seen ones.

    The robots address takes the scheme of the domain's first url, or https. New sources are numbered after the largest
    id in ``ids``, by default that of ``sources``.
    """
    seen = (
        urls.select(U.netloc("url").alias("domain"), "url")
        .filter("domain <> ''")
        .groupBy("domain")
        .agg(F.min("url").alias("url"))
    )
    stamp = ts if crawled else F.lit(None).cast("timestamp_ntz")
    scheme = F.lit("https") if https else U.scheme("url")
    hits = seen.select("domain", F.lit(True).alias("_hit"))
    kept = sources.join(hits, "domain", "left").select(
        "id", "domain", "robots_url",
        F.when(F.col("_hit") & F.lit(crawled), ts).otherwise(F.col("last_crawled")).alias("last_crawled"),
        "is_active", "created_at",
    )
    added = assign_ids(seen.join(sources.select("domain"), "domain", "left_anti"), "domain", sources if ids is None else ids).select(
        "id", "domain",
        F.concat(scheme, F.lit("://"), F.col("domain"), F.lit("/robots.txt")).alias("robots_url"),
        stamp.alias("last_crawled"), F.lit(True).alias("is_active"), ts.alias("created_at"),
    )
    return kept.unionByName(added)


def log_rows(df: DataFrame, level: Column | str, message: Column, ts: Column) -> DataFrame:
    """Log rows for ``df``; the message is cut to its stored length."""
    task = F.col("task_id") if "task_id" in df.columns else F.lit(None).cast("string")
    return df.select(
        (F.lit(level) if isinstance(level, str) else level).alias("level"),
        task.alias("task_id"),
        "url",
        truncate(message, V.LOG_CHARS).alias("message"),
        ts.alias("created_at"),
    )


def append_logs(logs: DataFrame, path: str) -> None:
    logs.write.mode("append").parquet(path)


def enriched_values(open_row: Column) -> dict[str, Column]:
    """What ``_found``, ``_summary``, ``_tags``, ``_category``, ``_urgency`` and ``_embedding`` make of the rows that are open."""
    done = open_row & F.col("_found").isNotNull()
    lost = open_row & F.col("_found").isNull()
    return {
        "summary": F.when(done, F.coalesce(non_empty(F.col("_summary")), F.col("summary"))).otherwise(F.col("summary")),
        "ai_tags": F.when(done, F.col("_tags")).otherwise(F.col("ai_tags")),
        "ai_category": F.when(done, F.col("_category")).otherwise(F.col("ai_category")),
        "ai_urgency": F.when(done, F.col("_urgency")).otherwise(F.col("ai_urgency")).cast("int"),
        "embedding": F.when(open_row, F.coalesce("_embedding", "embedding")).otherwise(F.col("embedding")),
        "ai_status": F.when(done, schemas.COMPLETED).when(lost, schemas.FAILED).otherwise(F.col("ai_status")),
        "ai_error_log": F.when(lost, V.NO_ANALYSIS).when(open_row, None).otherwise(F.col("ai_error_log")),
    }


def apply_enrichment(articles: DataFrame, analysis: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Write analysis (id, summary, tags, category, urgency) and vectors (id, embedding) to their articles.

    With an analysis an article is completed, without one it has failed; a vector is kept either
    way. Completed articles pass through untouched.
    """
    found = analysis.select(
        "id", F.lit(True).alias("_found"),
        *[F.col(c).alias(f"_{c}") for c in ("summary", "tags", "category", "urgency")],
    )
    vectors = embeddings.select("id", F.col("embedding").alias("_embedding"))
    changed = enriched_values(~F.col("ai_status").eqNullSafe(schemas.COMPLETED))
    joined = articles.join(found, "id", "left").join(vectors, "id", "left")
    return joined.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in articles.columns])


def delete_failed(articles: DataFrame, counts: Observation | None = None) -> DataFrame:
    """The articles that have not failed; ``counts`` receives ``deleted`` when the result is written."""
    if counts is not None:
        articles = articles.observe(counts, F.count_if(F.col("ai_status") == schemas.FAILED).alias("deleted"))
    return articles.filter(~F.col("ai_status").eqNullSafe(schemas.FAILED))


def delete_jobs(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    return jobs.join(ids.select("id"), "id", "left_anti")


def create_jobs(requests: DataFrame, ts: Column, jobs: DataFrame | None = None) -> DataFrame:
    """Job rows for requests (``url``, optional ``name`` and ``force_single``), numbered after ``jobs``."""
    name = F.col("name") if "name" in requests.columns else F.lit(None).cast("string")
    forced = F.coalesce(F.col("force_single"), F.lit(False)) if "force_single" in requests.columns else F.lit(False)
    interval, label = V.SOURCE_TYPES["single"]
    single = F.struct(
        F.lit("single").alias("job_type"), F.lit(interval).alias("interval_seconds"), F.lit(label).alias("label")
    )
    kind = F.when(forced, single).otherwise(U.detect_source_type("url"))
    typed = requests.select("url", name.alias("name"), kind.alias("k"))
    return assign_ids(typed, "url", jobs).select(
        "id",
        U.job_name(F.col("name"), F.col("k.label"), F.col("url")).alias("name"),
        "url",
        F.col("k.job_type").alias("job_type"),
        F.when(F.col("k.job_type") == schemas.SINGLE, 1).otherwise(10).alias("items_limit"),
        F.col("k.interval_seconds").alias("interval_seconds"),
        F.lit(True).alias("is_active"),
        F.lit(None).cast("timestamp_ntz").alias("last_triggered_at"),
        ts.alias("created_at"),
    )


def update_runs(runs: DataFrame, patch: DataFrame, ts: Column) -> DataFrame:
    """Partial update by ``task_id``: a column that is absent or null in the patch keeps its value.

    A boolean column ``<name>_set`` in the patch makes a null count as a value.
    """
    cols = [c for c in runs.columns if c in patch.columns and c not in ("id", "task_id", "created_at", "updated_at")]
    flags = [f"{c}_set" for c in cols if f"{c}_set" in patch.columns]
    renamed = patch.select(
        "task_id", F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in cols], *flags
    )

    def value(c: str) -> Column:
        new, old = F.col(f"_new_{c}"), F.col(c)
        if f"{c}_set" in flags:
            return F.when(F.col(f"{c}_set"), new).otherwise(old)
        return F.coalesce(new, old)

    changed = {c: value(c) for c in cols}
    changed["updated_at"] = F.when(F.col("_hit"), ts).otherwise(F.col("updated_at"))
    joined = runs.join(renamed, "task_id", "left")
    return joined.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in runs.columns])


def touch(df: DataFrame, keys: DataFrame, key: str, col: str, ts: Column) -> DataFrame:
    """Stamp ``col`` on the rows whose key is in ``keys``."""
    hits = keys.select(key).distinct().withColumn("_hit", F.lit(True))
    joined = df.join(hits, key, "left")
    stamped = F.when(F.col("_hit"), ts).otherwise(F.col(col))
    return joined.select(*[stamped.alias(c) if c == col else F.col(c) for c in df.columns])


