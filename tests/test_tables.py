"""Table changes, job logic and research on literal rows."""

import datetime as dt
import random

from conftest import values
from pyspark.sql import Observation
from pyspark.sql import functions as F

from pageloom import schemas
from pageloom.operators import articles as A
from pageloom.operators import jobs as J
from pageloom.operators import limits as L
from pageloom.operators import mutations as M
from pageloom.operators import research as R
from pageloom.operators.skew import assign_ids, per_key_limit, spread_rank
from pageloom.plans import composites as C

OLD = dt.datetime(2024, 1, 1)


def at():
    return F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")


def stored(spark, *rows):
    """Articles (id, url, title, status, tags)."""
    full = [dict(id=i, url=u, title=t, ai_status=s, ai_error_log="e", ai_tags=g, created_at=OLD) for i, u, t, s, g in rows]
    names = schemas.ARTICLES.fieldNames()
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in full], schemas.ARTICLES)


def test_upsert(spark):
    current = stored(spark, (1, "a", "A", "completed", ["t"]), (7, "b", "B", "failed", None))
    batch = spark.createDataFrame([("a", "A2", 1), ("c", "C1", 2), ("c", "C2", 3)], "url string, title string, seq int")
    out = M.upsert_articles(current, batch, at())
    assert out.schema.names == schemas.ARTICLES.fieldNames()
    assert values(out, "id", "url", "title", "ai_status", "ai_error_log", "ai_tags") == [
        (1, "a", "A2", "pending", None, ["t"]), (7, "b", "B", "failed", "e", None), (8, "c", "C2", "pending", None, None)]
    assert values(out, "url", "created_at") == [("a", OLD), ("b", OLD), ("c", dt.datetime(2024, 2, 1))]
    again = M.upsert_articles(out, batch, at())
    assert values(again, "id", "url", "title", "ai_status") == values(out, "id", "url", "title", "ai_status")


def test_upsert_into_an_empty_table(spark):
    batch = spark.createDataFrame([("a", "A", 1)], "url string, title string, seq int")
    assert values(M.upsert_articles(stored(spark), batch, at()), "id", "url") == [(1, "a")]


def test_register_sources(spark):
    src = spark.createDataFrame([(4, "a.com", "r", None, True, OLD)], schemas.SOURCES)
    urls = spark.createDataFrame([("http://a.com/x",), ("http://b.com/1",), ("http://b.com/2",), ("nohost",), (None,)], "url string")
    ts = dt.datetime(2024, 2, 1)
    assert values(M.register_sources(src, urls, at()), "id", "domain", "robots_url", "last_crawled") == [
        (4, "a.com", "r", ts), (5, "b.com", "http://b.com/robots.txt", ts)]
    quiet = M.register_sources(src, urls, at(), crawled=False, https=True)
    assert values(quiet, "domain", "robots_url", "last_crawled") == [
        ("a.com", "r", None), ("b.com", "https://b.com/robots.txt", None)]


def test_apply_enrichment(spark):
    a = stored(spark, (1, "a", "A", "pending", None), (2, "b", "B", "pending", None), (3, "c", "C", "completed", ["old"]))
    analysis = spark.createDataFrame([(1, "sum", ["x"], "Tech", 8), (3, "no", ["no"], "No", 1)],
                                     "id bigint, summary string, tags array<string>, category string, urgency int")
    vectors = spark.createDataFrame([(1, [0.5]), (2, [0.25]), (3, [0.75])], "id bigint, embedding array<float>")
    out = M.apply_enrichment(a, analysis, vectors)
    assert values(out, "id", "ai_status", "ai_error_log", "ai_tags", "ai_urgency", "embedding", "summary") == [
        (1, "completed", None, ["x"], 8, [0.5], "sum"), (2, "failed", "AI returned no data", None, None, [0.25], None),
        (3, "completed", "e", ["old"], None, None, None)]


def test_small_mutations(spark):
    a = stored(spark, (1, "a", "A", "failed", None), (2, "b", "B", None, None))
    counts = Observation()
    assert values(M.delete_failed(a, counts), "id") == [2] and counts.get == {"deleted": 1}
    assert values(A.filter_pending(a), "id") == [1, 2]
    df = spark.createDataFrame([(1, None), (2, None)], "id bigint, last_crawled timestamp_ntz")
    keys = spark.createDataFrame([(2,), (2,), (9,)], "id bigint")
    assert values(M.touch(df, keys, "id", "last_crawled", at())) == [(1, None), (2, dt.datetime(2024, 2, 1))]
    assert values(M.delete_jobs(df, keys), "id") == [1]
    logs = M.log_rows(spark.createDataFrame([("u",)], "url string"), "INFO", F.repeat(F.lit("é"), 600), at())
    assert logs.select(F.length("message")).first()[0] == 500 and logs.columns == schemas.LOGS.fieldNames()


def test_append_logs(spark, tmp_path):
    rows = M.log_rows(spark.createDataFrame([("u",)], "url string"), "WARN", F.lit("m"), at())
    M.append_logs(rows, str(tmp_path / "logs"))
    M.append_logs(rows, str(tmp_path / "logs"))
    assert spark.read.schema(schemas.LOGS).parquet(str(tmp_path / "logs")).count() == 2


def test_null_dates_come_first(spark):
    rows = [(1, None), (2, OLD), (3, OLD), (4, dt.datetime(2025, 1, 1))]
    df = spark.createDataFrame(rows, "id bigint, created_at timestamp_ntz")
    assert [r.id for r in A.latest_page(df, 0, 3).collect()] == [1, 4, 3]
    assert [r.id for r in A.latest_page(df, 3, 3).collect()] == [2]


def test_trend_fills_hours(spark):
    rows = [(dt.datetime(2024, 1, 1, 0, 5), 4), (dt.datetime(2024, 1, 1, 0, 50), None), (dt.datetime(2024, 1, 1, 2, 1), 6)]
    out = A.urgency_trend(spark.createDataFrame(rows, "created_at timestamp_ntz, ai_urgency int"))
    assert values(out.select(F.hour("hour"), "mean_urgency")) == [(0, 2.0), (1, None), (2, 6.0)]
    empty = spark.createDataFrame([], "created_at timestamp_ntz, ai_urgency int")
    assert A.urgency_trend(empty).count() == 0


def test_filter_stays_above_the_limit(spark):
    rows = [(i, OLD + dt.timedelta(minutes=i), 9 if i < 5 else 1) for i in range(10)]
    df = spark.createDataFrame(rows, "id bigint, created_at timestamp_ntz, ai_urgency int")
    newest = df.orderBy(*A.newest_first()).limit(6)
    assert values(A.priority_articles(newest), "id") == [4]


def test_keyword_wildcards(spark):
    df = spark.createDataFrame([("Big News", None), ("x", "bigger"), ("b_g", "n"), (None, None)], "title string, summary string")
    assert A.keyword_search(df, "BIG").count() == 2
    assert A.keyword_search(df, "b_g").count() == 3
    assert A.keyword_search(df, "").count() == 4


def test_search_targets(spark):
    schema = "topic string, provider string, rank int, url string, title string"
    rows = [("t", "A", 1, "https://good.com/a", ""), ("t", "A", 2, "https://facebook.com/a", ""), ("t", "B", 1, "https://b.com/1", ""),
            ("f", "A", 1, "https://youtube.com/w", ""), ("f", "B", 1, "https://youtu.be/w", ""), ("f", "B", 2, "https://b.com/1", ""),
            ("f", "B", 3, "https://b.com/2", ""), ("f", "B", 4, "https://b.com/3", ""), ("f", "B", 5, "https://b.com/4", ""),
            ("f", "B", 4, None, "")]
    out = L.search_targets(spark.createDataFrame(rows, schema), 2)
    assert values(out, "topic", "url") == [("f", "https://b.com/1"), ("f", "https://b.com/2"), ("t", "https://good.com/a")]
    assert L.search_targets(spark.createDataFrame([], schema), 2).count() == 0


def test_gap_targets(spark):
    rows = [("r", 1, i, f"u{i}") for i in range(1, 6)] + [("r", 0, 1, "u9"), ("r", 0, 2, "u2")]
    df = spark.createDataFrame(rows, "run string, query_pos int, rank int, url string")
    assert values(L.gap_targets(df, 3), "url") == ["u1", "u2", "u9"]
    assert L.gap_targets(df, 0).count() == 0


def test_limits_hold_a_hot_key(spark):
    rows = [("hot", i) for i in range(3000)] + [("cold", 5), ("cold", 4)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "k string, pos int").withColumn("n", F.when(F.col("k") == "hot", 4).otherwise(1))
    assert values(per_key_limit(df, "k", ["pos"], 3, spread="pos"), "k", "pos") == [
        ("cold", 4), ("cold", 5), ("hot", 0), ("hot", 1), ("hot", 2)]
    assert per_key_limit(df, "k", ["pos"], 2000, spread="pos").count() == 2002
    assert values(per_key_limit(df, "k", ["pos"], "n", spread="pos"), "k", "pos") == [
        ("cold", 4), ("hot", 0), ("hot", 1), ("hot", 2), ("hot", 3)]


def test_ranks_are_gapless_and_ordered(spark):
    rows = [("hot" if i % 3 else "cold", i % 4, f"u{i}") for i in range(2000)]
    df = spark.createDataFrame(rows, "host string, score int, u string")
    ranked = spread_rank(df, ["host"], [("score", True)], "u", "rank").collect()
    for host in ("hot", "cold"):
        mine = sorted((r for r in ranked if r.host == host), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1))
        assert [r.score for r in mine] == sorted((r.score for r in mine), reverse=True)
    ids = assign_ids(df, "u", spark.createDataFrame([(5,), (10,)], "id bigint"))
    assert values(ids, "id") == sorted(range(11, 2011), key=repr)


def test_new_urls_and_stored_ones_are_all(spark):
    cand = spark.createDataFrame([(u,) for u in "aabcd"], "url string")
    have = spark.createDataFrame([("b",), ("z",)], "url string")
    assert values(A.new_urls(cand, have)) == ["a", "a", "c", "d"]


def test_unmonitored_domains(spark):
    jobs = spark.createDataFrame(
        [("https://WWW.News.example.com:80/feed?x=other.org", "discovery"), ("https://quiet.net", "rss"), ("https://user_1.io/a", "discovery")],
        "url string, job_type string")
    names = ["example.com", "news.example.com", "EXAMPLE.com", "other.org", "quiet.net", "m.example.com", "n_ws.example.com", "ne%com",
             "user_1.io", "userx1.io", "x_y.io", "a" * 300]
    out = R.unmonitored_domains(spark.createDataFrame([(d,) for d in names], "domain string"), jobs)
    assert values(out, "domain") == sorted(["quiet.net", "m.example.com", "userx1.io", "x_y.io", "a" * 300], key=repr)


def test_unmonitored_patterns(spark):
    jobs = spark.createDataFrame([("https://ab.io/" + "x" * 300, "discovery"), ("https://rss.only", "rss"), (None, "discovery")], "url string, job_type string")
    names = ["_", "%", "_" * 400, "x" * 300, "x" * 301, "b.i", "b_io", "ab%xx", "b\\io", "", "rss.only"]
    out = R.unmonitored_domains(spark.createDataFrame([(d,) for d in names] + [(None,)], "domain string"), jobs)
    assert values(out, "domain") == sorted(["_" * 400, "x" * 301, "b\\io", "rss.only"], key=repr)
    none = R.unmonitored_domains(spark.createDataFrame([("_",), ("a.b",)], "domain string"), jobs.filter("job_type = 'x'"))
    assert values(none, "domain") == ["_", "a.b"]


def test_null_urls_keep_their_rows(spark):
    new = spark.createDataFrame([("a",), (None,), ("b",), (None,)], "url string")
    assert sorted(r.id for r in assign_ids(new, "url").collect()) == [1, 2, 3, 4]
    ranked = spread_rank(spark.createDataFrame([(None, 1, "x"), ("h", None, None), (None, 2, None)], "host string, score int, u string"), ["host"], [("score", True)], "u", "rank")
    assert values(ranked, "host", "score", "rank") == sorted([(None, 2, 1), (None, 1, 2), ("h", None, 1)], key=repr)


def test_empty_summary_keeps_the_old_one(spark):
    art = spark.createDataFrame([(1, "old", "pending"), (2, "old", "pending")], "id long, summary string, ai_status string")
    for name, kind in (("ai_tags", "array<string>"), ("ai_category", "string"), ("ai_urgency", "int"), ("embedding", "array<float>"), ("ai_error_log", "string")):
        art = art.withColumn(name, F.lit(None).cast(kind))
    found = spark.createDataFrame([(1, "", ["t"], "c", 3), (2, "new", ["t"], "c", 3)], "id long, summary string, tags array<string>, category string, urgency int")
    out = M.apply_enrichment(art, found, spark.createDataFrame([], "id long, embedding array<float>"))
    assert values(out, "id", "summary") == [(1, "old"), (2, "new")]


def test_promote_domains(spark):
    arts = spark.createDataFrame([(1, "http://n.com/1"), (2, "https://n.com/2"), (3, "https://old.com/x"), (4, "bad")], "id bigint, url string")
    jobs = spark.createDataFrame([(9, "j", "https://www.old.com/feed", "discovery", 10, 3600, True, None, OLD)], schemas.JOBS)
    src = spark.createDataFrame([], schemas.SOURCES)
    used = spark.createDataFrame([(1,), (2,), (3,), (4,)], "id bigint")
    out = C.promote_domains(used, arts, jobs, src, at())
    assert values(out.jobs.filter("id > 9"), "id", "name", "url", "interval_seconds", "items_limit") == [
        (10, "Auto-Discovery: n.com", "http://n.com", 86400, 5)]
    assert values(out.sources, "domain", "robots_url") == [("n.com", "http://n.com/robots.txt")]


def fold(start, urgencies):
    for u in urgencies:
        if not u:
            continue
        start = 300 if u >= 8 else 1800 if u >= 5 else max(3600, int(start * 0.95))
    return start


def test_interval_fold_equals_one_by_one(spark):
    rnd = random.Random(7)
    starts = {j: rnd.choice([0, 300, 3600, 10_000, 86_400, 2**31 - 1]) for j in range(60)}
    calm = {j: rnd.random() < 0.5 for j in starts}
    rows = [(j, OLD + dt.timedelta(seconds=rnd.randrange(50)), i, rnd.choice([None, 0, 1, 3, 4] + ([] if calm[j] else [5, 7, 8, 10])))
            for i, j in enumerate(rnd.choice(list(starts)) for _ in range(2000))]
    rows += [(3, OLD + dt.timedelta(days=1), 10_000 + i, 1) for i in range(400)]
    jobs = spark.createDataFrame(list(starts.items()), "id bigint, interval_seconds int")
    history = spark.createDataFrame(rows, "job_id bigint, ts timestamp_ntz, seq int, urgency int")
    got = {r.job_id: r.interval_seconds for r in J.adapted_intervals(jobs, J.interval_state(history)).collect()}
    for j, start in starts.items():
        mine = [u for _, _, _, u in sorted((r for r in rows if r[0] == j), key=lambda r: r[1:3])]
        assert got[j] == fold(start, mine), j


def test_quiet_jobs_wait_longer(spark):
    jobs = spark.createDataFrame([(1, 1000), (2, 80_000), (3, 500)], "id bigint, interval_seconds int")
    quiet = spark.createDataFrame([(1,), (2,), (2,)], "id bigint")
    assert values(C.rest_jobs(jobs, quiet), "id", "interval_seconds") == [(1, 1500), (2, 86400), (3, 500)]


def test_dispatch(spark):
    now = F.lit("2024-01-02 00:00:00").cast("timestamp_ntz")
    rows = [(1, "f", "https://a.com/feed", "rss", 7, 600, True, None, OLD), (2, "d", "https://a.com", "discovery", 10, 86400, True, OLD, OLD),
            (3, "d", "https://b.com", "discovery", 10, 1, True, OLD, OLD), (4, "s", "https://c.com/x", "single", 1, 0, True, OLD, OLD),
            (5, "s", "https://c.com/y", "single", 1, 0, False, None, OLD), (6, "f", "https://a.com/f2", "rss", 7, 86401, True, OLD, OLD)]
    jobs = spark.createDataFrame(rows, schemas.JOBS)
    src = spark.createDataFrame([(11, "a.com", None, None, True, OLD)], schemas.SOURCES)
    out = C.dispatch_jobs(jobs, src, now)
    assert values(out.work) == [(1, "poll_feed", "https://a.com/feed", None, 7), (2, "discover", None, 11, 10),
                                (4, "ingest", "https://c.com/x", None, None)]
    assert values(out.unmatched) == [(3, "b.com")]
    assert values(out.jobs.filter("last_triggered_at = timestamp_ntz'2024-01-02 00:00:00'"), "id") == [1, 2, 3, 4]


def test_run_updates_and_progress(spark):
    runs = spark.createDataFrame([(1, "a", "p", "old", "processing", ["q"], None, OLD, OLD), (2, "b", "p", None, "processing", [], [1, 2], OLD, OLD),
                                  (3, "c", "p", None, "failed", None, None, OLD, OLD)], schemas.RUNS)
    told = R.run_progress(runs)
    assert values(told, "task_id", "progress", "articles_used") == [
        ("a", "Hunting for new data...", 0), ("b", "Analyzing & Synthesizing...", 2), ("c", "failed", 0)]
    patch = spark.createDataFrame([("a", "completed", None, None, True)],
                                  "task_id string, status string, generated_text string, search_queries array<string>, search_queries_set boolean")
    out = M.update_runs(runs, patch, at())
    assert values(out.filter("task_id = 'a'"), "status", "generated_text", "search_queries") == [("completed", "old", None)]
    assert values(out.filter("updated_at > created_at"), "task_id") == ["a"]


def test_gap_status(spark):
    arts = spark.createDataFrame([("u1", "completed"), ("u2", "pending")], "url string, ai_status string")
    asked = spark.createDataFrame([("r", "u1"), ("r", "u2"), ("s", "u1"), ("t", "u9")], "run string, url string")

    def stops(poll):
        return {r.run: r.stop for r in R.gap_fill_status(asked, arts, F.lit(poll)).collect()}

    assert stops(5) == {"r": False, "s": True, "t": False}
    assert stops(21) == {"r": True, "s": True, "t": False}
    assert stops(40) == {"r": True, "s": True, "t": True}


def test_context(spark):
    hits = spark.createDataFrame([(1, 2, "B", None), (1, 1, None, "a")] + [(1, i, f"t{i}", "s") for i in range(3, 12)],
                                 "query_id bigint, rank int, title string, summary string")
    queries = spark.createDataFrame([(1,), (2,)], "query_id bigint")
    out = {r.query_id: r.context for r in R.audit_context(queries, hits).collect()}
    assert out == {1: "- None: a\n- B: None\n- t3: s\n- t4: s\n- t5: s", 2: "No info."}
    writer = R.context_block(hits, "writer").first().context
    assert writer.startswith("Source: None\nContent: a\n\nSource: B\nContent: None") and writer.count("Source") == 10
