"""Branch tables of the scalar functions, on literal rows."""

import json
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from pageloom.functions import jsonx as J
from pageloom.functions import schedule as S
from pageloom.functions import text as X
from pageloom.functions import urls as U
from pageloom.functions.vectors import cosine_distance


def apply(spark, fn, rows, schema):
    """``fn`` of the columns of each row, in row order."""
    names = [c.split()[0] for c in schema.split(", ")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema)
    out = df.select("i", fn(*[F.col(n) for n in names]).alias("out")).orderBy("i").collect()
    return [r["out"] for r in out]


def test_classify_link(spark):
    cases = {"/2024/05/x": "article", "/may/x": "article", "/a-12345.html": "article", "/news/x": "index",
             "/about": "unknown", "/news/12345": "article", "/news/123": "index", "": "unknown"}
    assert apply(spark, U.classify_link, [(p,) for p in cases], "p string") == list(cases.values())


def test_is_useful(spark):
    cases = {"https://a.com/a.PDF": False, "https://a.com/a.pdf?x=1": True, "https://a.com/p#top": False,
             "https://a.com/discount-cart": False, "https://youtu.be/x": False, "https://a.com/story": True}
    assert apply(spark, U.is_useful, [(u,) for u in cases], "u string") == list(cases.values())


def test_is_internal(spark):
    rows = [("https://www.a.com/x", "https://a.com"), ("https://b.a.com", "https://a.com"), ("mailto:x", "https://a.com")]
    assert apply(spark, U.is_internal, rows, "u string, b string") == [True, False, False]


def test_score_sitemap(spark):
    cases = {"/sitemap-news.xml": 110, "/world.xml": 10, "/hindi.xml": -1000, "/sitemap.xml": 0}
    assert apply(spark, U.score_sitemap, [(u,) for u in cases], "u string") == list(cases.values())


def test_detect_source_type(spark):
    cases = {" https://a.com/FEED ": ("rss", 600), "https://a.com/2024/05/x": ("single", 0),
             "https://a.com/x-123456": ("single", 0), "https://a.com/x-12345": ("discovery", 3600)}
    out = apply(spark, U.detect_source_type, [(u,) for u in cases], "u string")
    assert [(r.job_type, r.interval_seconds) for r in out] == list(cases.values())


def test_url_parts(spark):
    rows = [("HTTPS://User@A.com:80/x;p?q#f",), ("//h/p",), ("/only/path",), ("nonsense",)]
    assert apply(spark, U.netloc, rows, "u string") == ["User@A.com:80", "h", "", ""]
    assert apply(spark, U.scheme, rows, "u string") == ["https", "", "", ""]
    assert apply(spark, U.path, rows, "u string") == ["/x", "/p", "/only/path", "nonsense"]


BASES = ["http://a.com/b/c/d;p?q", "https://a.com", "https://a.com/", "http://a.com/b/c/?x=1#f", "https://A.com:80/x"]
HREFS = ["g", "./g", "g/", "/g", "//g", "?y", "g?y", "#s", "g#s", "g?y#s", "", ".", "./", "..", "../", "../g", "../..",
         "../../", "../../g", "../../../g", "/./g", "/../g", "g.", "..g", "./../g", "g/./h", "g/../h", "http:g", "http://x/y",
         "HTTP://X/y", "mailto:x", "/x#", "x?", " /lead", "a b", "javascript:void(0)", "/a//b", "x//y", "//h/p/../q",
         "/a/b/../c/.", "g;x=1/../y"]


def test_url_join_agrees_with_the_standard_library(spark):
    rows = [(b, h) for b in BASES for h in HREFS]
    want = [urljoin(b, h) for b, h in rows]
    assert apply(spark, U.url_join, rows, "b string, h string") == want
    df = U.with_joined_url(spark.createDataFrame(rows, "b string, h string"), "b", "h", "out")
    assert [r.out for r in df.collect()] == want


def test_adjust_interval(spark):
    rows = [(7, 8, True), (7, 5, True), (10000, 3, True), (0, 1, True), (70000, None, False), (1001, None, False),
            (5000, None, True), (5000, 0, True), (2**31 - 1, None, False)]
    out = apply(spark, S.adjust_interval, rows, "c int, u int, n boolean")
    assert out == [300, 1800, 9500, 3600, 86400, 1501, 5000, 5000, 86400]


def test_due(spark):
    last, now = "timestamp_ntz'2024-01-01 00:00:00'", "timestamp_ntz'2024-01-01 01:00:00'"
    row = spark.range(1).select(*[
        S.is_due(F.expr(a), F.lit(n), F.expr(now)).alias(str(i))
        for i, (a, n) in enumerate([("cast(null as timestamp_ntz)", 9), (last, 3600), (last, 3601), (last, 0)])
    ]).first()
    assert tuple(row) == (True, True, False, True)


CLEAN = {
    '```json\n{"a": 1}\n```': {"a": 1}, 'Sure: {"a": {"b": 2}} ok?': {"a": {"b": 2}}, "[1]": [1],
    'x {"a":1} y {"b":2} z': None, "": None, "   ": None, "no": None, '{"a":': None, "null": None,
    '1] [2': None, '1, 2': None, '1} {"a": 1': None, '7 of {"a": 1}': {"a": 1}, '"t" x': None,
}


def test_clean_json(spark):
    out = apply(spark, lambda c: F.to_json(J.clean_json(c)), [(r,) for r in CLEAN], "r string")
    assert [json.loads(o) if o else None for o in out] == list(CLEAN.values())


def test_flatten_summary(spark):
    cases = {'"text"': "text", '["a", "b", 3]': "a b 3", '{"a": "x", "b": "y"}': "x y", "null": "old", "[]": "old", "{}": "old",
             '""': "old", "0": "old", "7": "7", "true": "True", "false": "old", '["a", null, true]': "a None True"}
    out = apply(spark, lambda c: J.flatten_summary(F.try_parse_json(c), F.lit("old")), [(r,) for r in cases], "r string")
    assert out == list(cases.values())
    assert apply(spark, lambda c: J.flatten_summary(F.try_parse_json(c), F.lit("old")), [(None,)], "r string") == ["old"]


def test_parse_tags(spark):
    cases = {"['a','b']": ["a", "b"], '["a"]': ["a"], None: [], "oops": [], "": []}
    assert apply(spark, J.parse_tags, [(r,) for r in cases], "r string") == list(cases.values())


def test_parse_audit(spark):
    cases = {"yes, enough": (True, []), "NO\nab\nquery one": (False, ["query one"]), "NO": (False, ["p"]), None: (False, ["p"]),
             " \n ": (False, ["p"]), "no\n one1 \n\n two2\nthree\nfour": (False, ["one1", "two2", "three"])}
    out = apply(spark, lambda c: X.parse_audit(c, F.lit("p")), [(r,) for r in cases], "r string")
    assert [(o.sufficient, o.queries) for o in out] == list(cases.values())


def test_fallbacks(spark):
    rows = [(None, "x" * 200), ("", "x" * 201), ("given", "text"), (None, None)]
    out = apply(spark, X.summary_fallback, rows, "e string, t string")
    assert out == ["x" * 200, "x" * 200 + "...", "given", ""]
    pages = [("T", "<title>P</title>"), ("", "<title>\n P &amp; Q </title>"), (None, "<p>none</p>")]
    assert apply(spark, X.title_fallback, pages, "t string, h string") == ["T", "P & Q", "No Title"]


def test_truncate_counts_characters(spark):
    assert apply(spark, lambda c: X.truncate(c, 2), [("é😀x",)], "t string") == ["é😀"]


def test_numbers_and_times(spark):
    assert apply(spark, S.numeric_urgency, [("7",), ("x",), (None,)], "u string") == [7.0, 0.0, 0.0]
    out = apply(spark, S.to_ts, [("2024-01-01 10:00:00",), ("soon",)], "t string")
    assert out[0].hour == 10 and out[1] is None


def test_cosine_distance(spark):
    rows = [([1.0, 0.0], [0.0, 2.0]), ([1.0, 1.0], [2.0, 2.0]), ([1.0, 0.0], [-1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0])]
    out = apply(spark, cosine_distance, rows, "a array<double>, b array<double>")
    assert out[:3] == pytest.approx([1.0, 0.0, 2.0]) and out[3] != out[3]
