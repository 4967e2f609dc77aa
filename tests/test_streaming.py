"""Streams over several files: same rows as over a table, replays harmless."""

import datetime as dt
import re
import shutil

from conftest import values
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom import schemas
from pageloom.operators import jobs as J
from pageloom.plans.catalog_streams import run_to_table
from pageloom.streaming import state as S
from pageloom.streaming import tables as ST
from pageloom.streaming.runs import Runs

OLD = dt.datetime(2024, 1, 1)


def land(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def ingest(spark, root):
    pages = spark.readStream.schema(schemas.PAGES).option("maxFilesPerTrigger", 1).parquet(f"{root}/pages")
    files = spark.createDataFrame([("a.com", 200, "User-agent: *\nDisallow: /no")], "host string, status int, robots_txt string")
    sources = spark.createDataFrame([(5, "a.com", None, None, True, OLD)], schemas.SOURCES)
    ST.stream_ingest(pages, files, sources, f"{root}/table", f"{root}/ck").awaitTermination()


def enrich(spark, root):
    ST.stream_enrich(
        ST.article_log_stream(spark, f"{root}/table"), f"{root}/table", f"{root}/ck2",
        [lambda t: {"summary": "S", "tags": ["g"], "category": "C", "urgency": 4} if "bad" not in t else None],
        lambda texts: [[1.0]] * len(texts)).awaitTermination()


def test_article_streams(spark, tmp_path):
    root = str(tmp_path)
    land(spark, f"{root}/pages", [(1, "https://a.com/1", "<h1>One</h1>"), (2, "https://a.com/no", "<h1>No</h1>")], schemas.PAGES)
    ingest(spark, root)
    land(spark, f"{root}/pages", [(3, "https://a.com/2", "<h1>bad</h1>"), (4, "https://b.com/3", "<h1>Three</h1>")], schemas.PAGES)
    ingest(spark, root)
    enrich(spark, root)
    cols = ("url", "title", "ai_status", "ai_category", "summary", "source_id")
    first = values(ST.current_articles(spark, f"{root}/table"), *cols)
    assert first == [("https://a.com/1", "One", "completed", "C", "S", 5), ("https://a.com/2", "bad", "failed", None, "bad", 5),
                     ("https://b.com/3", "Three", "completed", "C", "S", 6)]
    ids = dict(values(ST.current_articles(spark, f"{root}/table"), "url", "id"))
    assert sorted(ids.values()) == [1, 2, 3]

    land(spark, f"{root}/pages", [(5, "https://a.com/1", "<h1>One again</h1>")], schemas.PAGES)
    ingest(spark, root)
    again = {r.url: r for r in ST.current_articles(spark, f"{root}/table").collect()}["https://a.com/1"]
    assert (again.id, again.title, again.ai_status, again.ai_category, again.summary) == (ids["https://a.com/1"], "One again", "pending", "C", "One again")
    enrich(spark, root)
    done = {r.url: r for r in ST.current_articles(spark, f"{root}/table").collect()}["https://a.com/1"]
    assert (done.ai_status, done.summary, done.embedding) == ("completed", "S", [1.0])


def test_replay_leaves_the_same_rows(spark, tmp_path):
    root = str(tmp_path)
    land(spark, f"{root}/pages", [(1, "https://a.com/1", "<h1>One</h1>")], schemas.PAGES)
    ingest(spark, root)
    before = values(ST.current_articles(spark, f"{root}/table"), "id", "url", "title")
    # The batch was written but its commit was lost with the driver.
    for f in (tmp_path / "ck" / "commits").glob("*0*"):
        f.unlink()
    ingest(spark, root)
    assert values(ST.current_articles(spark, f"{root}/table"), "id", "url", "title") == before
    shutil.rmtree(tmp_path / "ck")
    ingest(spark, root)
    assert values(ST.current_articles(spark, f"{root}/table"), "id", "url", "title") == before


def test_ingest_writes_sources_logs_and_a_manifest_per_batch(spark, tmp_path):
    root = str(tmp_path)
    land(spark, f"{root}/pages", [(1, "https://a.com/1", "<h1>One</h1>"), (2, "https://a.com/no", "<h1>No</h1>"), (3, "https://b.com/x", None)], schemas.PAGES)
    ingest(spark, root)
    land(spark, f"{root}/pages", [(4, "https://a.com/1", "<h1>Again</h1>"), (5, "http://c.org/1", "<h1>C</h1>"), (6, "http://c.org/2", "<h1>D</h1>"), (7, None, "<h1>E</h1>")], schemas.PAGES)
    ingest(spark, root)
    logs = values(ST.ingest_log(spark, f"{root}/table"), "batch_id", "level", "message")
    assert logs == sorted([
        (0, "INFO", "Created basic data for a.com"), (0, "WARN", "Blocked by robots.txt: https://a.com/no"), (0, "ERROR", "Network Error: no content"),
        (1, "INFO", "Updated basic data for a.com"), (1, "INFO", "Created basic data for c.org"), (1, "INFO", "Created basic data for c.org"), (1, "INFO", None),
    ], key=repr)
    base = spark.createDataFrame([(5, "a.com", None, None, True, OLD), (50, "quiet.com", None, None, True, OLD)], schemas.SOURCES)
    rows = {r.domain: r for r in ST.current_sources(spark, f"{root}/table", base).collect()}
    assert {d: r.id for d, r in rows.items()} == {"a.com": 5, "quiet.com": 50, "b.com": 6, "c.org": 7}
    assert rows["c.org"].robots_url == "http://c.org/robots.txt" and rows["a.com"].last_crawled > OLD and rows["quiet.com"].last_crawled is None
    of = {r.url: r.source_id for r in ST.current_articles(spark, f"{root}/table").collect()}
    assert of == {"https://a.com/1": 5, "http://c.org/1": 7, "http://c.org/2": 7}


def test_batches_cost_the_same_however_much_is_stored(spark, tmp_path):
    """Fifty batches, every second url new: ids go on, and late batches read and write no more files than early ones."""
    root, runs = str(tmp_path), Runs(f"{tmp_path}/keys", ST.ARTICLE_KEYS, ("url",), buckets=2, fan=4)
    stored, files, written = {}, [], []
    for n in range(50):
        urls = [f"https://a.com/{n // 2}/{i}" for i in range(4)]
        asked = spark.createDataFrame([(u,) for u in urls], "url string")
        known = {u: i for u, i in stored.items() if u in urls}
        if n % 7 == 1:
            assert {r.url: r.id for r in runs.among(asked, n).collect()} == known
        fresh = [(len(stored) + k + 1, u, OLD) for k, u in enumerate(u for u in urls if u not in known)]
        runs.forget(spark, n)
        runs.add(spark.createDataFrame(fresh, ST.ARTICLE_KEYS), n)
        stored |= {u: i for i, u, _ in fresh}
        files.append(len(runs.names(n + 1)))
        written.append(len(list((tmp_path / "keys").glob("level=*/run=*"))))
    assert max(files) <= 3 * 3 and max(written) <= 3 * 3 + 2 * 3 + 2
    assert {r.url: r.id for r in runs.all(spark, 50).collect()} == stored
    # A replay of the last batch merges the same runs again.
    runs.add(spark.createDataFrame([], ST.ARTICLE_KEYS), 49)
    assert {r.url: r.id for r in runs.all(spark, 50).collect()} == stored


def test_look_ups_read_the_buckets_of_their_keys_only(spark, tmp_path):
    runs = Runs(f"{tmp_path}/keys", ST.ARTICLE_KEYS, ("url",), buckets=16)
    runs.add(spark.createDataFrame([(i, f"u{i}", OLD) for i in range(200)], ST.ARTICLE_KEYS), 0)
    found = runs.among(spark.createDataFrame([("u7",), ("nothing",)], "url string"), 1)
    assert values(found, "id") == [7]
    scanned = re.search(r"PartitionFilters: \[([^\]]*)\]", found._jdf.queryExecution().executedPlan().toString())[1]
    assert "bucket" in scanned and ("IN" in scanned or "=" in scanned)


def test_runs_add_up_sums(spark, tmp_path):
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("n", T.LongType())])
    runs = Runs(f"{tmp_path}/sums", schema, ("k",), buckets=2, fan=2, sums=("n",))
    for n in range(11):
        runs.add(spark.createDataFrame([("a", n), (f"b{n % 3}", 1)], schema), n)
    assert {r.k: r.n for r in runs.all(spark, 11).collect()} == {"a": 55, "b0": 4, "b1": 4, "b2": 3}


def test_kept_state_survives_a_restart_and_touches_few_rows(spark, tmp_path):
    """Update-mode state over micro-batches and restarts equals the fold of the whole table."""
    schema = "job_id bigint, ts timestamp_ntz, seq bigint, urgency int, status string"
    rows = [(i % 5, OLD + dt.timedelta(days=i), i, (i * 7) % 10 if i % 5 else i % 4 + 1,
             ["pending", "processing", "completed", "failed", "odd"][(i * 3) % 5]) for i in range(100)]
    jobs = spark.createDataFrame([(i, 50_000) for i in range(6)], "id bigint, interval_seconds int")

    def states(kind):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        return S.schedule_periods(stream) if kind == "job_id" else S.status_periods(stream.withColumnRenamed("job_id", "article_id"))

    for part in range(4):
        land(spark, f"{tmp_path}/in", rows[part * 25:(part + 1) * 25], schema)
        for kind in ("job_id", "article_id"):
            S.keep_state(states(kind), kind, f"{tmp_path}/{kind}", f"{tmp_path}/ck-{kind}").awaitTermination()
    table = spark.read.schema(schema).parquet(f"{tmp_path}/in")
    kept = S.kept_state(spark, states("job_id"), "job_id", f"{tmp_path}/job_id")
    assert values(J.adapted_intervals(jobs, J.merged_state(kept))) == values(J.adapted_intervals(jobs, J.interval_state(table)))
    status = S.kept_state(spark, states("article_id"), "article_id", f"{tmp_path}/article_id")
    assert values(S.status_of(S.merged_status(status))) == values(S.stream_status(table.withColumnRenamed("job_id", "article_id")))
    # 25 days touch two periods of 30 days at most, five jobs each; the state of passed periods is gone.
    done = spark.read.parquet(f"{tmp_path}/job_id/done")
    assert done.count() >= 4 and done.agg(F.max("rows")).head()[0] <= 10
    state = list((tmp_path / "ck-job_id" / "state" / "0").glob("*/*.zip")) + list((tmp_path / "ck-job_id" / "state" / "0").glob("*/*.changelog"))
    assert state, "the state is kept by RocksDB"


def test_late_rows_are_kept_apart_and_counted(spark, tmp_path):
    schema = "ts timestamp_ntz, urgency int"
    at = lambda h, m=0: OLD + dt.timedelta(hours=h, minutes=m)
    batches = [[(at(0), 4), (at(1), 6)], [(at(9), 2), (at(1, 30), None)], [(at(1, 40), 8), (at(8), 3), (None, 1)], [(at(20), 1)], [(at(9, 5), 5)]]
    for rows in batches:
        land(spark, f"{tmp_path}/in", rows, schema)
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        S.keep_trend(stream, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    late = S.late_rows(spark, f"{tmp_path}/out", stream.schema)
    assert values(late, "batch_id", "urgency") == [(2, 1), (2, 8), (4, 5)]
    assert values(spark.read.parquet(f"{tmp_path}/out/done"), "batch_id", "rows", "late") == [(0, 2, 0), (1, 2, 0), (2, 3, 2), (3, 1, 0), (4, 1, 1)]
    kept = S.kept_trend(spark, f"{tmp_path}/out")
    assert {r.hour.hour: (r.urgency, r.rows) for r in kept.collect()} == {0: (4, 1), 1: (6, 2), 9: (2, 1), 8: (3, 1), 20: (1, 1)}
    whole = S.trend_of(kept.unionByName(S.hour_sums(late.withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz")), "hour")))
    assert {r.hour.hour: r.rows for r in whole.filter("hour is not null").collect()} == {0: 1, 1: 3, 8: 1, 9: 2, 20: 1}


def test_schedule_and_status_streams_equal_tables(spark, tmp_path):
    schema = "job_id bigint, ts timestamp_ntz, seq bigint, urgency int, status string"
    rows = [(i % 4, OLD + dt.timedelta(minutes=(i * 37) % 100), i, (i * 7) % 10 if i % 4 else i % 4 + 1,
             ["pending", "processing", "completed", "failed", "odd"][(i * 3) % 5]) for i in range(80)]
    for part in range(4):
        land(spark, f"{tmp_path}/in", rows[part * 20:(part + 1) * 20], schema)
    table = spark.read.schema(schema).parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    jobs = spark.createDataFrame([(i, 50_000) for i in range(5)], "id bigint, interval_seconds int")
    state = run_to_table(S.stream_schedule(stream), "complete")
    assert values(J.adapted_intervals(jobs, state)) == values(J.adapted_intervals(jobs, J.interval_state(table)))

    def events(df):
        return df.select(F.col("job_id").alias("article_id"), "ts", "seq", "status")

    got = dict(values(S.status_of(run_to_table(S.status_state(events(stream)), "complete"))))
    assert got == dict(values(S.stream_status(events(table))))
    for key in range(4):
        cur = None
        for r in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])):
            if r[4] != "odd" and not (cur == "completed" and r[4] == "processing"):
                cur = r[4]
        assert got[key] == cur


def test_dedupe_and_trend_streams(spark, tmp_path):
    schema = "ts timestamp, url string, urgency int"
    rows = [(OLD + dt.timedelta(minutes=30 * i), f"u{i % 3}", i if i % 2 else None) for i in range(9)]
    for part in range(3):
        land(spark, f"{tmp_path}/in", rows[part * 3:(part + 1) * 3], schema)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    table = spark.read.schema(schema).parquet(f"{tmp_path}/in")
    assert values(run_to_table(S.stream_dedupe(stream, "1 day"), "append"), "url") == ["u0", "u1", "u2"]
    assert values(run_to_table(S.stream_trend(stream), "complete")) == values(S.stream_trend(table))
