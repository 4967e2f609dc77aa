"""The bucketed article table: same rows as the plain merge, no stored row shuffled, untouched buckets left alone."""

import datetime as dt
import re
import uuid

import pytest
from conftest import values
from pyspark.sql import functions as F

from pageloom import schemas
from pageloom.operators import mutations as M
from pageloom.operators import stored as ST

NOW = dt.datetime(2024, 5, 1)
BATCH = "url string, seq bigint, title string, clean_text string"


def articles(spark, n=40):
    rows = [(i, None, f"https://a.com/{i}", f"t{i}", None, None, f"s{i}", None, f"text {i}", None, None,
             ("completed", "pending", "failed", None)[i % 4], "lost" if i % 4 == 2 else None, None, None, None, NOW) for i in range(1, n + 1)]
    return spark.createDataFrame(rows, schemas.ARTICLES)


@pytest.fixture()
def stored(spark, tmp_path):
    name = f"t_{uuid.uuid4().hex}"
    yield ST.store_articles(articles(spark), name, str(tmp_path / "articles"), buckets=8)
    spark.sql(f"DROP TABLE {name}")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def stored_side(text: str) -> str:
    """The lines of a plan from the scan of the bucketed table up to the join above it."""
    lines = text.splitlines()
    at = next(i for i, x in enumerate(lines) if "FileScan" in x and "Bucketed: true" in x)
    indent, out = len(lines[at]) - len(lines[at].lstrip(" :+-")), [lines[at]]
    for line in reversed(lines[:at]):
        depth = len(line) - len(line.lstrip(" :+-"))
        if depth < indent:
            indent = depth
            if "Join" in line:
                return "\n".join(out)
            out.append(line)
    return "\n".join(out)


def test_merge_equals_the_plain_one(spark, stored):
    ts = F.lit(NOW).cast("timestamp_ntz")
    batch = spark.createDataFrame([(f"https://a.com/{i}", k, f"new {i} {k}", None) for i in (3, 7, 41, 42) for k in (1, 2)] + [(None, 1, "no url", None)], BATCH)
    want = M.upsert_articles(articles(spark), batch.filter("url is not null"), ts)
    ST.upsert_stored(stored, batch, ts)
    got = stored.rows(spark)
    names = ("id", "url", "title", "clean_text", "summary", "ai_status", "ai_error_log", "created_at")
    assert values(got, *names) == values(want, *names)
    ST.upsert_stored(stored, spark.createDataFrame([("https://b.com/1", 1, "B", None)], BATCH), ts)
    assert {r.url: r.id for r in stored.rows(spark).collect()}["https://b.com/1"] == 43
    ST.upsert_stored(stored, spark.createDataFrame([], BATCH), ts)
    assert stored.rows(spark).count() == 43


def test_only_touched_buckets_are_written(spark, stored, tmp_path):
    place = tmp_path / "articles"
    before = {p: p.stat().st_mtime_ns for p in place.glob("bucket=*/*.parquet")}
    batch = spark.createDataFrame([("https://a.com/5", 1, "again", None)], BATCH)
    number = batch.select(stored.bucket().alias("b")).head().b
    ST.upsert_stored(stored, batch, F.lit(NOW).cast("timestamp_ntz"))
    after = {p: p.stat().st_mtime_ns for p in place.glob("bucket=*/*.parquet")}
    changed = {p.parent.name for p in set(before.items()) ^ set(after.items()) for p in [p[0]]}
    assert changed == {f"bucket={number}"} and len({p.parent for p in before}) > 1


def test_no_stored_row_is_shuffled(spark, stored):
    rows = spark.createDataFrame([("https://a.com/5", None, "again", None)], "url string, _id bigint, title string, clean_text string")
    held = ST.touched(spark, stored, rows)
    merged = plan(ST.merged_batch(stored, held, rows, F.lit(NOW).cast("timestamp_ntz")))
    side = stored_side(merged)
    assert "Exchange" not in side and re.search(r"PartitionFilters: \[[^\]]*bucket", side), merged
    asked = rows.select("url", F.lit(True).alias("_asked"), F.lit(None).cast("boolean").alias("_found"), F.lit("s").alias("_summary"),
                        F.array(F.lit("x")).alias("_tags"), F.lit("c").alias("_category"), F.lit(1).alias("_urgency"), F.array().cast("array<float>").alias("_embedding"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        side = stored_side(plan(ST.enriched_batch(stored, held, asked)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in side and "Bucketed: true" in side


def test_enrichment_equals_the_plain_one(spark, stored):
    analysis = spark.createDataFrame([(1, "S", ["x"], "C", 5), (2, "", ["y"], "D", 6), (3, "T", [], "E", 7)], "id bigint, summary string, tags array<string>, category string, urgency int")
    vectors = spark.createDataFrame([(2, [1.0]), (4, [2.0]), (6, [3.0])], "id bigint, embedding array<float>")
    some = articles(spark).filter("id <= 20")
    ST.enrich_stored(stored, some.select("id", "url").unionByName(some.filter("id = 3").select("id", "url")), analysis, vectors)
    names = ("id", "summary", "ai_status", "ai_error_log", "ai_tags", "ai_category", "ai_urgency", "embedding")
    want = values(M.apply_enrichment(some, analysis, vectors).unionByName(articles(spark).filter("id > 20")), *names)
    assert values(stored.rows(spark), *names) == want
