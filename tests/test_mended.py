"""Cases that once gave wrong answers."""

import numpy as np
import pytest
from conftest import values
from pyspark.sql import functions as F

from pageloom.operators import articles as A
from pageloom.operators import enrich as E
from pageloom.operators.crawl import crawl_frontier
from pageloom.operators.extract import extract_articles
from pageloom.operators.memory import _nearest, search_by_text
from pageloom.streaming.state import stream_dedupe


def test_entities_are_decoded_everywhere(spark):
    page = (
        "<html><head><title>A &mdash; B</title><meta name='author' content='Ren&eacute;e &#8212; &#x41;'>"
        "<meta name='description' content='Sch&ouml;n &amp; gut'></head><body><h1>It&#8217;s caf&eacute;</h1><p>Text &hellip;</p></body></html>"
    )
    row = extract_articles(spark.createDataFrame([("u", page), ("v", "<title>Caf&eacute;</title>")], "url string, html string"))
    got = {r.url: r for r in row.collect()}
    assert got["u"].title == "It\u2019s caf\u00e9" and got["u"].author == "Ren\u00e9e \u2014 A" and got["u"].summary == "Sch\u00f6n & gut"
    assert "Text \u2026" in got["u"].clean_text and got["v"].title == "Caf\u00e9"


def test_odd_answers_cost_a_column_at_most(spark):
    answers = {
        "list": {"summary": ["a", 1], "tags": ("x", None), "category": "c", "urgency": "7"},
        "object": {"summary": {"b": "y", "a": "x"}, "tags": "no", "category": ["p", "q"], "urgency": "high"},
        "text": "not an object",
        "number": {"summary": 5, "urgency": 3.9},
    }

    def model(text):
        return answers[text]

    df = spark.createDataFrame([(k,) for k in answers], "t string").select("t", E.analysis(F.col("t"), [model]).alias("a"))
    got = {r.t: r.a and tuple(r.a) for r in df.collect()}
    assert got == {"list": ("a 1", ["x"], "c", 7), "object": ("x y", None, "p q", None), "text": None, "number": ("5", None, None, 3)}


def test_whole_texts_count(spark):
    long = "quiet word " * 2000 + "research " * 3000
    df = spark.createDataFrame([(long,)], "t string").select(
        E.analysis(F.col("t")).alias("a"), E.embedding(F.col("t")).alias("e"), E.embedding(F.col("t"), max_chars=2000).alias("cut"))
    row = df.head()
    assert row.a.category == "Science" and row.a.tags[0] == "research" and row.e != row.cut


@pytest.mark.parametrize(("term", "hits"), [("a\\xb", ["a\\xb"]), ("\\", ["a\\xb"]), ("a_", ["a\\xb", "ab"]), ("", ["a\\xb", "ab", "c"])])
def test_backslash_in_a_search_term(spark, term, hits):
    df = spark.createDataFrame([("a\\xb", None), ("ab", None), ("c", None)], "title string, summary string")
    assert values(A.keyword_search(df, term), "title") == sorted(hits, key=repr)


def test_crawl_meets_home_pages_with_and_without_slash(spark):
    edges = [("https://a.com/", 0, "https://a.com/news/"), ("https://a.com/news", 0, "https://a.com/2024/05/x-1"), ("https://b.com/", 0, "https://b.com/2024/05/y")]
    edges = spark.createDataFrame([*edges, ("https://a.com/", 1, "https://b.com/2024/05/z")], "src_url string, pos int, dst_url string")
    got = crawl_frontier(spark.createDataFrame([("https://a.com",), (None,)], "seed string"), edges)
    assert values(got, "seed", "url", "depth") == [("https://a.com", "https://a.com/2024/05/x-1", 1)]


def test_equal_vectors_keep_k_rows(spark):
    same, queries = np.ones((5000, 8)), np.ones((600, 8))
    ids = np.arange(5000)[::-1].copy()
    q, found, _ = _nearest(np.arange(600), queries, [(ids[:2500], same[:2500]), (ids[2500:], same[2500:])], 3)
    assert len(q) == 1800 and set(found.tolist()) == {0, 1, 2}


def test_search_by_text_finds_the_text_itself(spark):
    texts = ["alpha beta gamma", "delta epsilon", "zeta eta theta iota", ""]
    docs = E.embed_documents(spark.createDataFrame(list(enumerate(texts)), "id bigint, text string"), "text")
    asked = spark.createDataFrame([(i + 10, t) for i, t in enumerate(texts)], "query_id bigint, text string")
    got = search_by_text(docs, asked, 1)
    assert values(got, "query_id", "id") == [(10, 0), (11, 1), (12, 2)]


def test_dedupe_leaves_out_stored_urls(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "url string, n int")
    stored = spark.createDataFrame([("b",), ("b",), ("z",)], "url string")
    assert values(stream_dedupe(rows, "1 hour", stored=stored), "url") == sorted(["a", None], key=repr)


def test_lost_checkpoint_is_refused(spark, tmp_path):
    from pageloom.streaming.tables import _same_history

    log = spark.createDataFrame([(0,), (2,)], "batch_id bigint")
    _same_history(spark, log, 2)
    with pytest.raises(RuntimeError, match="checkpoint"):
        _same_history(spark, log, 1)
