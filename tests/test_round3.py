"""Redirects, discovery from the start, waiting for gaps, default vectors, reasons of failure, and job intervals."""

import datetime as dt
import random
import zlib

import pytest
from conftest import values
from pyspark.sql import functions as F

from pageloom import schemas
from pageloom.operators import enrich as E
from pageloom.operators import redirects as RD
from pageloom.operators import research as R
from pageloom.plans import composites as C
from pageloom.plans.catalog_streams import run_to_table
from pageloom.streaming import state as S

OLD = dt.datetime(2024, 1, 1)


def follow(url, hops):
    seen = set()
    while url in hops:
        if url in seen:
            return None
        seen.add(url)
        url = hops[url]
    return url


@pytest.mark.parametrize("seed", range(3))
def test_redirects_lead_to_their_ends(spark, seed):
    rng = random.Random(seed)
    hops = {f"c{i}": f"c{i + 1}" for i in range(70)}  # a long chain
    hops |= {"l1": "l2", "l2": "l3", "l3": "l1", "into": "l2", "before": "into", "self": "self"}  # loops and what leads there
    hops |= {f"r{i}": f"r{rng.randrange(40)}" for i in range(25)}
    rows = [*hops.items(), ("c5", "c9x"), (None, "x"), ("x", None)]
    got = {r.url: (r.final_url, r.looped) for r in RD.resolve_redirects(spark.createDataFrame(rows, "url string, final_url string")).collect()}
    want = {}
    for url in hops:
        end = follow(url, hops)
        want[url] = (url, True) if end is None else (end, False)
    assert got == want
    assert RD.resolve_redirects(spark.createDataFrame([], "url string, final_url string")).count() == 0


def test_sources_are_normalized(spark):
    hops = spark.createDataFrame([("https://a.com", "https://www.a.com/"), ("https://www.a.com/", "https://www.a.com/en//"), ("https://b.com/", "https://b.com/")], "url string, final_url string")
    given = spark.createDataFrame([("a.com",), ("https://a.com",), ("b.com/",), ("http://c.com//",), (None,)], "url string")
    assert values(RD.normalized_sources(given, hops), "url", "base") == sorted([
        ("a.com", "https://www.a.com/en"), ("https://a.com", "https://www.a.com/en"), ("b.com/", "https://b.com/"), ("http://c.com//", "http://c.com"), (None, None)], key=repr)


def test_discovery_from_the_start(spark):
    """Redirects, robots files, guesses and ranks decide what is read; the rest is crawled from where the redirects lead."""
    sources = spark.createDataFrame([(i, d, None, None, True, OLD) for i, d in enumerate(["a.com", "b.com", "c.com", "d.com"], 1)], schemas.SOURCES)
    hops = spark.createDataFrame([("https://b.com", "https://www.b.com/"), ("https://d.com", "https://d.com/home"), ("https://d.com/home", "https://d.com")], "url string, final_url string")
    files = spark.createDataFrame([("a.com", 200, "Sitemap: https://a.com/hindi.xml\nSitemap: https://a.com/news.xml"), ("www.b.com", 404, "Sitemap: https://b.com/no.xml")], "host string, status int, robots_txt string")
    fetches = spark.createDataFrame([("https://www.b.com/sitemap.xml", 200), ("https://c.com/sitemap.xml", 404)], "url string, status int")
    seeds, sitemaps = C.find_sitemaps(sources, hops, files, fetches)
    assert values(seeds) == [("a.com", "https://a.com"), ("b.com", "https://www.b.com"), ("c.com", "https://c.com"), ("d.com", "https://d.com")]
    assert values(sitemaps, "host", "sitemap_url") == [("a.com", "https://a.com/hindi.xml"), ("a.com", "https://a.com/news.xml"), ("b.com", "https://www.b.com/sitemap.xml")]
    loc = lambda *urls: "<urlset>" + "".join(f"<url><loc>{u}</loc></url>" for u in urls) + "</urlset>"
    docs = spark.createDataFrame([
        ("https://a.com/hindi.xml", loc("https://a.com/hi")), ("https://a.com/news.xml", loc("https://a.com/1", "https://a.com/2", "https://a.com/3")),
        ("https://www.b.com/sitemap.xml", loc("https://b.com/1"))], "sitemap_url string, xml string")
    edges = spark.createDataFrame([("https://c.com", 0, "https://c.com/2024/05/x"), ("https://d.com", 0, "https://d.com/2024/05/y"), ("https://a.com", 0, "https://a.com/2024/05/z")], "src_url string, pos int, dst_url string")
    stored = spark.createDataFrame([("https://a.com/2",)], "url string")
    ts = F.lit(OLD).cast("timestamp_ntz")
    found = C.discover_urls(sources, sitemaps, docs, edges, stored, ts, limit=2, seeds=seeds)
    assert values(found.urls, "source", "url") == [("a.com", "https://a.com/1"), ("b.com", "https://b.com/1"), ("c.com", "https://c.com/2024/05/x"), ("d.com", "https://d.com/2024/05/y")]


def test_links_are_not_shuffled_by_the_crawl(spark):
    from pageloom.operators import crawl
    from pageloom.session import bucketed, discard

    links = bucketed(spark.createDataFrame([("https://a.com", 0, "https://a.com/news", "index")], "page string, pos int, dst_url string, kind string"), "page")
    frontier = spark.createDataFrame([("https://a.com", "https://a.com/", [])], "seed string, url string, way array<int>")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = crawl._step(frontier, links)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = text.splitlines()
    at = next(i for i, x in enumerate(lines) if "FileScan" in x)
    join = next(i for i, x in enumerate(lines) if "Join" in x)
    side = lines[at - 1 : at + 1] if at > join else []
    assert "Bucketed: true" in lines[at] and not any("Exchange" in x for x in side), text
    discard(links)


def polled(waits, n):
    """The wait loop: (stop poll, ready)."""
    for i in range(40):
        ready = sum(w is not None and w <= i * 3 for w in waits)
        if ready >= n or (ready > 0 and i > 20):
            return i, ready
    return 39, sum(w is not None and w <= 39 * 3 for w in waits)


def test_gap_outcomes_equal_the_wait_loop(spark, tmp_path):
    rng = random.Random(7)
    waits = {run: [rng.choice([None, rng.randrange(0, 160), rng.randrange(0, 40)]) for _ in range(rng.randrange(1, 5))] for run in range(60)}
    waits |= {100: [5, 6, 7], 101: [None, None], 102: [118, 119], 103: [0], 104: [66, None], 105: [117, None]}
    requests, done = [], []
    for k, (run, every) in enumerate(waits.items()):
        at = OLD + dt.timedelta(seconds=200 * k)
        for i, w in enumerate(every):
            requests.append((run, f"{run}/{i}", at))
            if w is not None:
                done.append((f"{run}/{i}", at + dt.timedelta(seconds=w)))
    far = OLD + dt.timedelta(days=100)
    parts = [(requests[:80], done[:60]), (requests[80:], done[60:]), ([(-1, "end", far)], [("over", far)])]
    requested = spark.createDataFrame(requests, "run int, url string, asked_at timestamp_ntz")
    for req, com in parts:
        spark.createDataFrame(req, "run int, url string, asked_at timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/req")
        spark.createDataFrame(com, "url string, done_at timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/done")
    answers = run_to_table(S.stream_gap_answers(
        spark.readStream.schema("run int, url string, asked_at timestamp").parquet(f"{tmp_path}/req"),
        spark.readStream.schema("url string, done_at timestamp").parquet(f"{tmp_path}/done")), "append")
    got = {r.run: r for r in R.gap_outcomes(requested, answers.filter("run >= 0")).collect()}
    assert set(got) == set(waits)
    for run, every in waits.items():
        stop, ready = polled(every, len(every))
        state = "ready" if ready >= len(every) else "partial" if ready else "timed_out"
        assert (got[run].requested, got[run].stop_poll, got[run].ready, got[run].state) == (len(every), stop, ready, state), (run, every)
    assert {"ready", "partial", "timed_out"} <= {r.state for r in got.values()}
    open_runs = R.gap_outcomes(requested, answers.filter("run >= 0 and url not like '%/0'")).filter("state = 'waiting'")
    assert open_runs.count() == len(waits)


def test_default_vectors(spark):
    import hashlib
    import re

    import numpy as np

    texts = ["One two, one TWO three!", "", None, " \n", "...", "naïve café 中文 x_1 x_1", "a"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3).select("i", E.embedding(F.col("t"), dim=32).alias("v")).collect()
    for r in got:
        t = texts[r.i]
        if t is None or not t.strip():
            assert r.v is None
            continue
        words = re.findall(r"\w+", t.lower())
        out = np.zeros(32)
        for g in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))]:
            code = int(hashlib.md5(g.encode()).hexdigest()[:8], 16)
            out[code % 32] += 1 if code >> 16 & 1 else -1
        norm = np.linalg.norm(out)
        assert np.allclose(r.v, out / norm if norm else out, atol=1e-6)
    assert zlib.crc32(b"") == 0


def test_a_failing_model_is_asked_in_halves(spark):
    asked = []

    def model(texts):
        asked.append(len(texts))
        if "bad" in texts:
            raise ValueError("no")
        return [[float(len(t))] for t in texts]

    texts = [f"t{i}" for i in range(15)] + ["bad"]
    assert E._vectors(model, texts) == [[float(len(t))] if t != "bad" else None for t in texts]
    assert len(asked) <= 2 * 4 + 1 and E._vectors(model, []) == []


def test_failure_reasons_are_kept(spark):
    def first(text):
        if "boom" in text:
            raise ValueError("out of words")
        return None if "none" in text else {"summary": "S", "tags": ["t"], "category": "C", "urgency": 9}

    rows = [(1, "boom here", "pending", None), (2, "none here", "pending", "old"), (3, "fine", "failed", "old"), (4, "boom", "completed", None), (5, None, "pending", None)]
    schema = "id bigint, clean_text string, ai_status string, ai_error_log string"
    blank = {"summary": "string", "ai_tags": "array<string>", "ai_category": "string", "ai_urgency": "int", "embedding": "array<float>"}
    df = spark.createDataFrame(rows, schema).withColumns({c: F.lit(None).cast(t) for c, t in blank.items()})
    got = {r.id: (r.ai_status, r.ai_error_log) for r in C.enrich_articles(df, [first], lambda t: [[1.0]] * len(t)).collect()}
    assert got == {1: ("failed", "out of words"), 2: ("failed", "AI returned no data"), 3: ("completed", None), 4: ("completed", None), 5: ("failed", "AI returned no data")}
    jobs = spark.createDataFrame([(7, "j", "u", "rss", 10, 50_000, True, None, OLD), (8, "k", "u", "rss", 10, 50_000, True, None, OLD)], schemas.JOBS)
    asked = spark.createDataFrame([(3, 7, OLD), (3, 7, OLD), (4, 8, OLD), (1, 8, OLD)], "id bigint, job_id bigint, ts timestamp_ntz")
    out = C.enrich_for_jobs(df, asked, jobs, [first], lambda t: [[1.0]] * len(t))
    assert values(out.jobs, "id", "interval_seconds") == [(7, 300), (8, 50_000)]


def test_html_is_in_no_exchange(spark):
    """Robots, sources and the merge move urls and extracted text only."""
    pages = spark.createDataFrame([(1, "https://a.com/p", "<h1>T</h1>")], schemas.PAGES).withColumn("seq", F.col("page_id"))
    files = spark.createDataFrame([("a.com", 200, "User-agent: *")], "host string, status int, robots_txt string")
    sources = spark.createDataFrame([(1, "a.com", None, None, True, OLD)], schemas.SOURCES)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        verdicts = C.page_verdicts(pages, files)
        rows = C.read_articles(pages, verdicts, sources, F.lit(OLD).cast("timestamp_ntz"))
        texts = [df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")) for df in (verdicts, rows)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for text in texts:
        blocks = [b for b in text.split("\n\n") if ") Exchange" in b]
        assert blocks and not any("html" in b for b in blocks), text
