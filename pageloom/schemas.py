"""Declared table schemas. All datetimes are zone-less and hold UTC."""

from pyspark.sql import types as T

SOURCES = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("domain", T.StringType(), False),
    T.StructField("robots_url", T.StringType()),
    T.StructField("last_crawled", T.TimestampNTZType()),
    T.StructField("is_active", T.BooleanType()),
    T.StructField("created_at", T.TimestampNTZType()),
])

LOGS = T.StructType([
    T.StructField("level", T.StringType()),
    T.StructField("task_id", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
])

RAW_METADATA = T.StructType([
    T.StructField(name, T.StringType())
    for name in ("title", "author", "published_date", "clean_text", "main_image", "summary")
])

CONTENT = T.StructType([
    T.StructField("scraped_at", T.StringType()),
    T.StructField("raw_metadata", RAW_METADATA),
])

ARTICLES = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("source_id", T.LongType()),
    T.StructField("url", T.StringType(), False),
    T.StructField("title", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("published_date", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("main_image", T.StringType()),
    T.StructField("clean_text", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType(), False)),
    T.StructField("content", T.StringType()),
    T.StructField("ai_status", T.StringType()),
    T.StructField("ai_error_log", T.StringType()),
    T.StructField("ai_tags", T.ArrayType(T.StringType())),
    T.StructField("ai_category", T.StringType()),
    T.StructField("ai_urgency", T.IntegerType()),
    T.StructField("created_at", T.TimestampNTZType()),
])

JOBS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("url", T.StringType(), False),
    T.StructField("job_type", T.StringType(), False),
    T.StructField("items_limit", T.IntegerType()),
    T.StructField("interval_seconds", T.IntegerType()),
    T.StructField("is_active", T.BooleanType()),
    T.StructField("last_triggered_at", T.TimestampNTZType()),
    T.StructField("created_at", T.TimestampNTZType()),
])

RUNS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("task_id", T.StringType(), False),
    T.StructField("user_prompt", T.StringType(), False),
    T.StructField("generated_text", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("search_queries", T.ArrayType(T.StringType())),
    T.StructField("used_article_ids", T.ArrayType(T.LongType())),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("updated_at", T.TimestampNTZType()),
])

ANALYSIS = T.StructType([
    T.StructField("summary", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("category", T.StringType()),
    T.StructField("urgency", T.IntegerType()),
])

PAGES = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
])

PENDING, PROCESSING, COMPLETED, FAILED = "pending", "processing", "completed", "failed"
AI_STATUSES = (PENDING, PROCESSING, COMPLETED, FAILED)
RSS, DISCOVERY, SINGLE = "rss", "discovery", "single"
JOB_TYPES = (RSS, DISCOVERY, SINGLE)
