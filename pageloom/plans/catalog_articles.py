"""Queries over the article table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.functions.schedule import numeric_urgency, to_ts
from pageloom.functions.jsonx import parse_tags, tags_text
from pageloom.operators import articles as A
from pageloom.operators import limits as L
from pageloom.operators import memory as M
from pageloom.operators import pivots as P
from pageloom.operators import search_index as SI
from pageloom.plans import derived as D
from pageloom.plans.composites import dashboard_tables
from pageloom.plans.registry import query
from pageloom.session import ensure_checkpoint_dir
from pageloom.sources.tables import table, with_json

_LIST = "id, url, title, author, published_date, summary, main_image, created_at"


def _newest(spark: SparkSession, folder: str) -> DataFrame:
    return A.coerced(A.latest(D.articles(spark, folder, A.DASHBOARD_COLS)))


@query("SELECT id, url, title, ai_category, ai_status, ai_urgency, created_at FROM articles", "articles")
def scan_articles(spark, folder):
    return D.articles(spark, folder, ["id", "url", "title", "ai_category", "ai_status", "ai_urgency", "created_at"])


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, "
       "CAST(json_extract(props, '$.k') AS BIGINT) AS k_variant FROM events")
def scan_json_columns(spark, folder):
    events = table(spark, folder, "events", ["event_id", "props"])
    typed = with_json(with_json(events, "props", "k bigint", "as_struct"), "props", None, "as_variant")
    return typed.select(
        "event_id", F.col("as_struct.k").alias("k"),
        F.try_variant_get("as_variant", "$.k", "bigint").alias("k_variant"),
    )


@query(f"SELECT {_LIST} FROM articles", "articles")
def article_list(spark, folder):
    return A.article_list(D.articles(spark, folder, A.LIST_COLS))


@query(f"SELECT {_LIST}, clean_text FROM articles WHERE id = 42", "articles")
def article_detail(spark, folder):
    return A.article_detail(D.articles(spark, folder, [*A.LIST_COLS, "clean_text"]), 42)


@query(f"SELECT {_LIST} FROM articles WHERE title ILIKE '%the%' OR summary ILIKE '%the%'", "articles")
def keyword_search(spark, folder):
    return A.keyword_search(D.articles(spark, folder, A.LIST_COLS), "the")


@query(f"SELECT {_LIST} FROM articles WHERE title ILIKE '%license%' OR summary ILIKE '%license%'", "articles")
def keyword_search_indexed(spark, folder):
    """A stored table with an index of its files: only those that can hold the term are read."""
    place = f"{ensure_checkpoint_dir(spark)}/search-{uuid.uuid4().hex}"
    D.articles(spark, folder, A.LIST_COLS).write.parquet(f"{place}/articles")
    SI.index_files(spark, f"{place}/articles", f"{place}/index")
    return SI.indexed_search(spark, f"{place}/articles", f"{place}/index", "License")


@query("SELECT id, url, ai_category FROM articles WHERE ai_category IN ('en', 'fr')", "articles")
def filter_category(spark, folder):
    return A.filter_category(D.articles(spark, folder, ["id", "url", "ai_category"]), ["en", "fr"])


@query("SELECT id, url, CAST(len(embedding) AS INTEGER) AS dims FROM articles WHERE embedding IS NOT NULL", "articles")
def filter_embedded(spark, folder):
    return A.filter_embedded(D.articles(spark, folder, ["id", "url", "embedding"])).select(
        "id", "url", F.size("embedding").alias("dims")
    )


@query("SELECT id, url, ai_status FROM articles WHERE ai_status <> 'completed'", "articles")
def filter_pending(spark, folder):
    return A.filter_pending(D.articles(spark, folder, ["id", "url", "ai_status"]))


@query(f"SELECT {_LIST} FROM articles ORDER BY created_at DESC NULLS FIRST, id DESC LIMIT 20 OFFSET 40", "articles")
def latest_page(spark, folder):
    return A.latest_page(D.articles(spark, folder, A.LIST_COLS), 40, 20)


@query("SELECT id, url, title, created_at, ai_category, ai_urgency, array_to_string(ai_tags, ', ') AS tags, summary, "
       "ai_status, ai_error_log, source_id FROM articles ORDER BY created_at DESC NULLS FIRST, id DESC LIMIT 200", "articles")
def latest_200(spark, folder):
    newest = A.latest(D.articles(spark, folder, A.DASHBOARD_COLS))
    return newest.select(
        "id", "url", "title", "created_at", "ai_category", "ai_urgency", tags_text(F.col("ai_tags")).alias("tags"),
        "summary", "ai_status", "ai_error_log", "source_id",
    )


@query("SELECT id, title, ai_urgency FROM newest WHERE ai_urgency >= 7", "newest")
def priority_articles(spark, folder):
    return A.priority_articles(_newest(spark, folder)).select("id", "title", "ai_urgency")


@query("SELECT id, title, ai_urgency FROM newest WHERE ai_urgency >= 7 "
       "ORDER BY created_at DESC NULLS FIRST, id DESC LIMIT 4", "newest")
def top_priority(spark, folder):
    return A.top_priority(_newest(spark, folder)).select("id", "title", "ai_urgency")


@query("SELECT id, title, CAST(ai_urgency AS INTEGER) AS score, ai_category FROM newest WHERE ai_urgency >= 7 "
       "ORDER BY created_at DESC NULLS FIRST, id DESC LIMIT 4", "newest")
def priority_cards(spark, folder):
    return A.priority_cards(_newest(spark, folder))


_CARDS = """
    SELECT id, CASE ai_status WHEN 'completed' THEN '✅' WHEN 'pending' THEN '⏳' ELSE '❌' END AS icon, ai_category, title,
      summary, coalesce(array_to_string(ai_tags, ', '), '') AS tags, CAST(ai_urgency AS VARCHAR) || '/10' AS urgency,
      strftime(created_at, '%H:%M %p') AS clock, url FROM newest"""


@query(_CARDS, "newest")
def stream_cards(spark, folder):
    return A.stream_cards(_newest(spark, folder))


@query("SELECT ai_category, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM newest GROUP BY ai_category", "newest")
def category_mix(spark, folder):
    return A.category_mix(_newest(spark, folder))


_TREND = """
    , hourly AS (SELECT date_trunc('hour', created_at) AS hour, avg(ai_urgency) AS m FROM newest GROUP BY 1)
    SELECT CAST(s.hour AS TIMESTAMP) AS hour, round(h.m, 6) AS mean_urgency
    FROM (SELECT unnest(generate_series(min(hour), max(hour), INTERVAL 1 HOUR)) AS hour FROM hourly) s
    LEFT JOIN hourly h ON h.hour = s.hour"""


@query(_TREND, "newest")
def urgency_trend(spark, folder):
    return A.urgency_trend(_newest(spark, folder)).select("hour", F.round("mean_urgency", 6).alias("mean_urgency"))


@query("SELECT DISTINCT ai_category FROM newest", "newest")
def distinct_categories(spark, folder):
    return A.distinct_categories(_newest(spark, folder))


@query("SELECT 'priority' AS tab, 'score ' || CAST(ai_urgency AS INTEGER) AS label, 1.0::DOUBLE AS value FROM (SELECT * FROM newest "
       "WHERE ai_urgency >= 7 ORDER BY created_at DESC NULLS FIRST, id DESC LIMIT 4) UNION ALL "
       "SELECT 'mix', ai_category, CAST(count(*) AS DOUBLE) FROM newest GROUP BY ai_category UNION ALL "
       "SELECT 'stream', CASE ai_status WHEN 'completed' THEN '✅' WHEN 'pending' THEN '⏳' ELSE '❌' END, "
       "CAST(count(*) AS DOUBLE) FROM newest GROUP BY 2 UNION ALL "
       "SELECT 'trend', strftime(date_trunc('hour', created_at), '%Y-%m-%d %H'), round(avg(ai_urgency), 6) FROM newest GROUP BY 2",
       "newest", name="dashboard_tables")
def dashboard(spark, folder):
    board = dashboard_tables(D.articles(spark, folder, A.DASHBOARD_COLS))
    parts = [
        board.priority.select(F.lit("priority").alias("tab"), F.concat(F.lit("score "), "score").alias("label"),
                              F.lit(1.0).alias("value")),
        board.mix.select(F.lit("mix").alias("tab"), F.col("ai_category").alias("label"), F.col("n").cast("double").alias("value")),
        board.stream.groupBy("icon").count().select(
            F.lit("stream").alias("tab"), F.col("icon").alias("label"), F.col("count").cast("double").alias("value")),
        board.trend.filter("mean_urgency is not null").select(
            F.lit("trend").alias("tab"), F.date_format("hour", "yyyy-MM-dd HH").alias("label"),
            F.round("mean_urgency", 6).alias("value")),
    ]
    return L.union_results(*parts)


@query("SELECT event_id, coalesce(TRY_CAST(CASE WHEN event_id % 3 = 0 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS DOUBLE), 0.0) "
       "AS urgency FROM events", name="numeric_urgency")
def numeric_urgency_(spark, folder):
    raw = F.when(F.col("event_id") % 3 == 0, "n/a").otherwise(F.col("value").cast("string"))
    return table(spark, folder, "events").select("event_id", numeric_urgency(raw).alias("urgency"))


@query("SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN ts END AS at FROM events")
def to_timestamp(spark, folder):
    raw = F.when(F.col("event_id") % 3 == 0, "yesterday").otherwise(F.col("ts").cast("string"))
    return table(spark, folder, "events").select("event_id", to_ts(raw).alias("at"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN lang || ', ' || source WHEN 1 THEN source ELSE '' END AS tags, "
       "CAST(CASE doc_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS INTEGER) AS n FROM documents", name="parse_tags")
def parse_tags_(spark, folder):
    raw = (
        F.when(F.col("doc_id") % 4 == 0, F.format_string("['%s', '%s']", "lang", "source"))
        .when(F.col("doc_id") % 4 == 1, F.format_string('["%s"]', "source"))
        .when(F.col("doc_id") % 4 == 2, "oops")
    )
    tags = parse_tags(raw)
    return table(spark, folder, "documents").select("doc_id", tags_text(tags).alias("tags"), F.size(tags).alias("n"))


@query("SELECT id, coalesce(array_to_string(ai_tags, ', '), '') AS tags FROM articles WHERE ai_tags IS NOT NULL",
       "articles", name="tags_text")
def tags_text_(spark, folder):
    a = D.articles(spark, folder, ["id", "ai_tags"]).filter("ai_tags is not null")
    return a.select("id", tags_text(F.col("ai_tags")).alias("tags"))


def query_vector(spark: SparkSession, folder: str) -> list[float]:
    """The vector with number 0, which the single-query searches ask for."""
    return table(spark, folder, "embeddings").filter("vec_id = 0").select("embedding").first()["embedding"]


_NEAREST = """
    SELECT id, title, ai_category, round(distance, 6) AS distance FROM (
      SELECT id, title, ai_category, 1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]),
        (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) AS distance
      FROM articles WHERE embedding IS NOT NULL) ORDER BY distance, id LIMIT 10"""


@query(_NEAREST, "articles")
def memory_search(spark, folder):
    a = D.articles(spark, folder, ["id", "title", "ai_category", "embedding"])
    return M.memory_search(a, query_vector(spark, folder), 10).withColumn("distance", F.round("distance", 6))


@query("SELECT query_id, id, CAST(rank AS INTEGER) AS rank, round(distance, 6) AS distance FROM hits WHERE rank <= 5", "hits")
def memory_search_batch(spark, folder):
    hits = M.knn_join(D.articles(spark, folder, ["id", "embedding"]), D.topics(spark, folder), 5)
    return hits.select("query_id", "id", "rank", F.round("distance", 6).alias("distance"))


@query("SELECT query_id, id, CAST(rank AS INTEGER) AS rank, round(distance, 6) AS distance FROM hits WHERE rank <= 5", "hits")
def memory_search_pruned(spark, folder):
    """The same hits over slices around pivots; a question meets the slices only that can hold one of them."""
    found = P.pruned_knn(D.articles(spark, folder, ["id", "embedding"]), D.topics(spark, folder), 5)
    return found.hits.select("query_id", "id", "rank", F.round("distance", 6).alias("distance"))


@query("SELECT e.vec_id AS id, round(1 - list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) "
       "AS distance FROM embeddings e, embeddings q WHERE q.vec_id = 0", name="cosine_distance")
def cosine_distance_(spark, folder):
    from pageloom.functions.vectors import cosine_distance

    vector = F.array(*[F.lit(float(x)) for x in query_vector(spark, folder)])
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"), F.round(cosine_distance(F.col("embedding"), vector), 6).alias("distance")
    )
