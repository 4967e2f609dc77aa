"""Extraction, enrichment, nearest neighbours, crawl, composites: against expectations or brute force."""

import datetime as dt
import json
import random
from collections import deque
from urllib.parse import urlparse

import numpy as np
import pytest
from conftest import values
from pyspark.sql import functions as F

from pageloom import schemas
from pageloom.operators import enrich as E
from pageloom.operators.crawl import crawl_frontier
from pageloom.operators.extract import extract_articles
from pageloom.operators.memory import knn_join, memory_search
from pageloom.plans import composites as C

OLD = dt.datetime(2024, 1, 1)


def at():
    return F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")


def one(spark, html):
    return extract_articles(spark.createDataFrame([("u", html)], "url string, html string")).first()


def test_extract_article(spark):
    row = one(spark, """<!DOCTYPE html><html><head><title>Site &amp; Title</title>
      <meta content='Ann "A" Other' name="Author"><meta property="og:image" content="https://i/x.png">
      <meta property="article:published_time" content="2024-05-01"><script>var p="</p><article>no</article>";</script></head>
      <body><header>H</header><nav><ul><li>menu</li></ul></nav><!-- <p>gone</p> --><article><h1>Head <i>line</i></h1>
      <div class="ad">buy</div><p>One <b>bold&nbsp;text<br>two &lt;3&gt;</p><p>&copy; &eacute;nd &amp;lt;</p></article><footer>F</footer></body></html>""")
    assert row.title == "Head line" and row.author == 'Ann "A" Other' and row.main_image == "https://i/x.png"
    assert row.published_date == "2024-05-01"
    assert row.clean_text == "Head line\nOne bold\xa0text\ntwo <3>\n© énd &lt;" or row.clean_text.replace("\xa0", " ") == \
        "Head line\nOne bold text\ntwo <3>\n© énd &lt;"
    assert row.summary == row.clean_text


def test_extract_fallbacks(spark):
    row = one(spark, "<html><head><title>Fallback Title</title></head><body></body></html>")
    assert (row.title, row.clean_text, row.summary, row.author) == ("Fallback Title", None, None, None)
    assert one(spark, "").title == "No Title" and one(spark, None).title == "No Title"
    assert one(spark, "<main><p>in main</p></main><p>out</p>").clean_text == "in main"
    assert one(spark, "<body><p>body").clean_text == "body"
    assert one(spark, "plain words").clean_text == "plain words"
    assert one(spark, "<article><p>open <b>article").clean_text == "open article"


def test_extract_nested_blocks(spark):
    nested = '<body><div class="x ad"><div>buy <div>now</div></div> sale</div><p>text</p><nav>a<nav>b</nav>c</nav><div>kept</div></body>'
    assert one(spark, nested).clean_text == "text\nkept"


def test_extract_long_page(spark):
    body = "<p>word &amp; word</p>" * 40_000
    row = one(spark, f"<body><article>{body}</article></body>")
    assert row.clean_text.count("word & word") == 40_000 and row.summary.endswith("...") and len(row.summary) == 203


def test_provider_waterfall(spark):
    rows = [(1, "p0", 0, "{}"), (1, "p1", 1, '```json\n{"a":1}\n```'), (1, "p2", 2, '{"b":2}'), (2, "p0", 0, "no"), (2, "p1", 1, None),
            (3, "p1", 1, '{"summary": ["x","y"], "tags": ["t"], "category": "C", "urgency": "8"}'), (3, "p0", 0, "[1]")]
    best = E.provider_waterfall(spark.createDataFrame(rows, "article_id bigint, provider string, priority int, raw string"))
    got = {r.article_id: (r.provider, json.loads(r.reply) if r.reply else None) for r in best.collect()}
    assert got[1] == ("p1", {"a": 1}) and got[2] == (None, None) and got[3][0] == "p1"
    analysis = E.reply_analysis(best.filter("article_id = 3")).first()
    assert (analysis.summary, analysis.tags, analysis.category, analysis.urgency) == ("x y", ["t"], "C", 8)
    chat = E.chat_waterfall(spark.createDataFrame([(1, "a", 0, ""), (1, "b", 1, " hi \n"), (2, "a", 0, None)],
                                                  "article_id bigint, provider string, priority int, raw string"))
    assert values(chat) == [(1, "b", "hi"), (2, None, None)]


def test_embeddings(spark):
    df = spark.createDataFrame([(1, "Alpha beta"), (2, "alpha  BETA"), (3, ""), (4, None), (5, "  ")], "id int, t string")
    got = {r.id: r.embedding for r in E.embed_documents(df, "t", dim=32).collect()}
    assert got[1] == got[2] and len(got[1]) == 32 and np.linalg.norm(got[1]) == pytest.approx(1.0, abs=1e-6)
    assert got[3] is None and got[4] is None and got[5] is None

    def picky(texts):
        if any("bad" in t for t in texts):
            raise ValueError
        return [[float(len(t))] for t in texts]

    df = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "x" * 3000)], "id int, t string").coalesce(1)
    assert {r.id: r.embedding for r in E.embed_documents(df, "t", picky).collect()} == {1: [4.0], 2: None, 3: [3000.0]}
    got = {r.id: r.embedding for r in E.embed_documents(df, "t", picky, max_chars=2000).collect()}
    assert got == {1: [4.0], 2: None, 3: [2000.0]}


def test_pluggable_analysis(spark):
    def down(text):
        raise RuntimeError

    def short(text):
        return {"summary": text[:3], "tags": ["a"], "category": "K", "urgency": 9} if "no" not in text else {}

    df = spark.createDataFrame([(1, "yes it is"), (2, "no"), (3, None)], "id int, t string")
    got = {r.id: r.analysis for r in E.analyze_documents(df, "t", [down, short]).collect()}
    assert got[1].asDict() == {"summary": "yes", "tags": ["a"], "category": "K", "urgency": 9}
    assert got[2] is None and got[3] is None


def test_default_analysis(spark):
    text = "Beta beta alpha ALPHA gamma gamma! The minister spoke 3 times?"
    row = E.analyze_documents(spark.createDataFrame([(text,), ("",), ("a b",)], "t string"), "t").orderBy(F.length("t").desc()).collect()
    assert row[0].analysis.tags == ["alpha", "beta", "gamma"] and row[0].analysis.category == "Politics" and row[0].analysis.urgency == 4
    assert row[1].analysis.tags == [] and row[2].analysis is None


def vectors(spark, n, seed, zero=()):
    rng = np.random.default_rng(seed)
    m = rng.integers(-2, 3, size=(n, 4)).astype(float)
    m[m.any(axis=1) == False] = 1.0  # noqa: E712
    for z in zero:
        m[z] = 0
    return m


def brute(articles, queries, k):
    out = {}
    for qid, q in enumerate(queries):
        scored = []
        for aid, a in enumerate(articles):
            norm = np.linalg.norm(a) * np.linalg.norm(q)
            d = 1 - a @ q / norm if norm else float("inf")
            scored.append((round(d, 9), aid))
        out[qid] = [aid for _, aid in sorted(scored)[:k]]
    return out


@pytest.mark.parametrize("block", [100, 4])
def test_knn_equals_brute_force(spark, block):
    a, q = vectors(spark, 300, 1, zero=(5,)), vectors(spark, 11, 2)
    arts = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(a)] + [(999, None)], "id bigint, embedding array<float>").repartition(5)
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id bigint, embedding array<float>")
    hits = knn_join(arts, asked, 7, block=block, slice_=60)
    got = {}
    for r in hits.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    want = brute(a, q, 7)
    # Equal vectors are equally far up to rounding; compare distances, then ids where they differ.
    for qid in want:
        d = {i: 1 - a[i] @ q[qid] / (np.linalg.norm(a[i]) * np.linalg.norm(q[qid])) for i in set(want[qid]) | set(got[qid])}
        assert [round(d[i], 6) for i in got[qid]] == [round(d[i], 6) for i in want[qid]]
        assert len(set(got[qid])) == 7


def test_single_search_is_the_batch_search(spark):
    a = vectors(spark, 200, 3, zero=(0,))
    arts = spark.createDataFrame([(i, f"t{i}", "c", v.tolist()) for i, v in enumerate(a)],
                                 "id bigint, title string, ai_category string, embedding array<float>").repartition(4)
    single = [r.id for r in memory_search(arts, [1.0, 2.0, 0.0, -1.0], 9).collect()]
    asked = spark.createDataFrame([(1, [1.0, 2.0, 0.0, -1.0])], "query_id bigint, embedding array<float>")
    assert single == [r.id for r in knn_join(arts, asked, 9).orderBy("rank").collect()]
    everything = memory_search(arts, [1.0, 2.0, 0.0, -1.0], 500).collect()
    assert len(everything) == 200 and everything[-1].id == 0 and everything[-1].distance != everything[-1].distance
    assert knn_join(arts, asked.filter("query_id = 0"), 3).count() == 0


def queue_crawl(seed, graph, max_articles, depth_limit):
    """The walk with a queue, page by page."""
    def kind(url):
        p = urlparse(url).path
        return "article" if "/2024/" in p else "index" if "/news" in p else "unknown"

    visited, found, queue = set(), [], deque([(seed, 0)])
    while queue and len(found) < max_articles:
        url, depth = queue.popleft()
        if url in visited or depth > depth_limit:
            continue
        visited.add(url)
        for link in graph.get(url, []):
            if urlparse(link).netloc != urlparse(seed).netloc or "#" in link:
                continue
            if kind(link) == "article" and link not in found:
                found.append(link)
                if len(found) >= max_articles:
                    break
            elif kind(link) == "index" and link not in visited and link not in [u for u, _ in queue]:
                queue.append((link, depth + 1))
    return found


@pytest.mark.parametrize("cap,depth", [(50, 2), (6, 2), (1, 2), (50, 0), (1000, 4)])
def test_crawl_equals_a_queue(spark, cap, depth):
    rnd = random.Random(5)
    graph = {}
    for host in ("https://a.com", "https://b.com"):
        nodes = [host] + [f"{host}/news/{i}" for i in range(12)] + [f"{host}/2024/01/{i}" for i in range(30)] + [f"{host}/about/{i}" for i in range(5)]
        for n in nodes:
            graph[n] = [rnd.choice(nodes) for _ in range(rnd.randrange(6))] + [f"{host}/news/1#x", "https://c.com/2024/01/1"]
        graph[host] = [f"{host}/news/{i}" for i in (3, 1, 3)] + [f"{host}/2024/01/0"]
    edges = spark.createDataFrame([(s, i, d) for s, ds in graph.items() for i, d in enumerate(ds)], "src_url string, pos int, dst_url string")
    seeds = spark.createDataFrame([("https://a.com",), ("https://b.com",), ("https://empty.com",)], "seed string")
    got = {}
    for r in crawl_frontier(seeds, edges, cap, depth).collect():
        got.setdefault(r.seed, set()).add(r.url)
    for seed in ("https://a.com", "https://b.com"):
        assert got.get(seed, set()) == set(queue_crawl(seed, graph, cap, depth))
    assert "https://empty.com" not in got


def empty(spark, schema):
    return spark.createDataFrame([], schema)


def test_ingest(spark):
    pages = spark.createDataFrame(
        [(1, "https://a.com/p", "<h1>Test Title</h1>", 200, None), (2, "https://a.com/no", "<p>x</p>", 200, None),
         (3, "https://b.com/q", None, 503, "HTTP 503"), (4, "https://a.com/p", "<h1>Newer</h1>", 200, None)],
        "page_id bigint, url string, html string, status int, error string")
    files = spark.createDataFrame([("a.com", 200, "User-agent: *\nDisallow: /no")], "host string, status int, robots_txt string")
    out = C.ingest_pages(pages, files, empty(spark, schemas.ARTICLES), empty(spark, schemas.SOURCES), at())
    row = out.articles.collect()
    assert [(r.id, r.url, r.title, r.ai_status) for r in row] == [(1, "https://a.com/p", "Newer", "pending")]
    sources = {r.domain: r.id for r in out.sources.collect()}
    assert set(sources) == {"a.com", "b.com"} and row[0].source_id == sources["a.com"]
    assert json.loads(row[0].content)["raw_metadata"]["title"] == "Newer"
    assert values(out.logs, "level", "message") == sorted([
        ("INFO", "Created basic data for a.com"), ("INFO", "Created basic data for a.com"),
        ("WARN", "Blocked by robots.txt: https://a.com/no"), ("ERROR", "Network Error: HTTP 503")], key=repr)


def test_enrich(spark):
    names = schemas.ARTICLES.fieldNames()
    rows = [dict(id=1, url="a", clean_text="This is a test article about AI.", ai_status="pending", ai_error_log="x"),
            dict(id=2, url="b", clean_text=None, ai_status="failed"), dict(id=3, url="c", clean_text="t", ai_status="completed", ai_category="kept")]
    arts = spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schemas.ARTICLES)

    def analyzer(text):
        return {"summary": "Short summary", "tags": ["tech"], "category": "Technology", "urgency": 8}

    out = C.enrich_articles(arts, [analyzer], lambda texts: [[0.1, 0.2, 0.3]] * len(texts))
    got = {r.id: r for r in out.collect()}
    assert (got[1].ai_status, got[1].ai_error_log, got[1].ai_urgency, got[1].summary) == ("completed", None, 8, "Short summary")
    assert got[1].embedding == pytest.approx([0.1, 0.2, 0.3])
    assert (got[2].ai_status, got[2].ai_error_log) == ("failed", "AI returned no data")
    assert (got[3].ai_status, got[3].ai_category, got[3].embedding) == ("completed", "kept", None)


def test_adapted_jobs(spark):
    jobs = spark.createDataFrame([(1, "j", "u", "rss", 10, 3600, True, None, OLD), (2, "k", "v", "rss", 10, 7200, True, None, OLD)], schemas.JOBS)
    history = spark.createDataFrame([(1, OLD, 1, 8)], "job_id bigint, ts timestamp_ntz, seq int, urgency int")
    assert values(C.adapt_jobs(jobs, history), "id", "interval_seconds") == [(1, 300), (2, 7200)]


def test_poll_feeds_cuts_before_it_drops(spark):
    xml = "<rss><channel>" + "".join(f"<item><link>u{i}</link></item>" for i in range(5)) + "</channel></rss>"
    feeds = spark.createDataFrame([("f", xml)], "feed_url string, xml string")
    jobs = spark.createDataFrame([(1, "f", "rss", 3), (2, "f", "rss", 1), (3, "f", "single", 9)], "id bigint, url string, job_type string, items_limit int")
    stored = spark.createDataFrame([("u0",), ("u1",)], "url string")
    assert values(C.poll_feeds(feeds, jobs, stored), "job_id", "url") == [(1, "u2")]


def test_forced_discovery_crawls(spark):
    src = spark.createDataFrame([(1, "a.com", None, None, True, OLD)], schemas.SOURCES)
    maps = spark.createDataFrame([("a.com", "m")], "host string, sitemap_url string")
    docs = spark.createDataFrame([("m", "<urlset><url><loc>https://a.com/listed</loc></url></urlset>")], "sitemap_url string, xml string")
    edges = spark.createDataFrame([("https://a.com", 0, "https://a.com/2024/01/x")], "src_url string, pos int, dst_url string")
    stored = spark.createDataFrame([], "url string")
    plain = C.discover_urls(src, maps, docs, edges, stored, at())
    assert values(plain.urls, "url") == ["https://a.com/listed"]
    assert values(plain.sources, "last_crawled") == [dt.datetime(2024, 2, 1)]
    assert values(C.discover_urls(src, maps, docs, edges, stored, at(), force=True).urls, "url") == ["https://a.com/2024/01/x"]


def test_research_without_vectors_still_answers(spark):
    arts = spark.createDataFrame([(1, "https://n.com/1", "T", "S", [1.0, 0.0])], "id bigint, url string, title string, summary string, embedding array<float>")
    queries = spark.createDataFrame([(7, "what?", [1.0, 1.0]), (8, "none", None)], "query_id bigint, prompt string, embedding array<float>")
    out = C.research_report(queries, arts, empty(spark, schemas.JOBS), empty(spark, schemas.SOURCES), at())
    assert values(out.audit, "query_id", "context") == [(7, "- T: S"), (8, "No info.")]
    assert values(out.writer) == [(7, "Source: T\nContent: S")]
    assert [r.used_article_ids for r in out.used.collect()] == [[1]]
    assert values(out.promoted.jobs, "url") == ["https://n.com"]


def test_dashboard(spark):
    names = schemas.ARTICLES.fieldNames()
    rows = [dict(id=i, url=f"u{i}", title="t", ai_status="completed", ai_urgency=i % 10 + 1, ai_category="c", created_at=OLD + dt.timedelta(minutes=i))
            for i in range(230)]
    board = C.dashboard_tables(spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schemas.ARTICLES))
    assert values(board.mix) == [("c", 200, 1.0)]
    assert [r.id for r in board.priority.orderBy(F.desc("id")).collect()] == [229, 228, 227, 226]
    card = board.stream.filter("id = 229").first()
    assert (card.icon, card.urgency, card.clock, card.tags) == ("✅", "10.0/10", "03:49 AM", "")
