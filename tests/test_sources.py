"""Links, feeds, sitemaps and robots files on literal rows."""

from urllib.robotparser import RobotFileParser

import pytest
from conftest import values
from pyspark.sql import functions as F

from pageloom.operators.robots_join import robots_join
from pageloom.sources import feeds as S
from pageloom.sources import robots as R
from pageloom.sources.links import extract_links, link_edges


def test_extract_links(spark):
    html = """<html><!-- <a href="/hidden"> --><script>var a='<a href="/js">';</script>
      <A class=x HREF='/one?a=1&amp;b=2'>1</A><a data-href="/no">n</a><a
      href=/two>2</a><a href="">e</a><abbr href="/no2"><a title="t" href="three">3</a></html>"""
    df = spark.createDataFrame([("https://a.com/d/p", html)], "url string, html string")
    assert values(extract_links(df), "pos", "href") == [(0, "/one?a=1&b=2"), (1, "/two"), (2, ""), (3, "three")]
    assert values(link_edges(df), "dst_url") == sorted(
        ["https://a.com/one?a=1&b=2", "https://a.com/two", "https://a.com/d/p", "https://a.com/d/three"], key=repr)


FEEDS = [
    ("rss", "<rss><channel><title>f</title><item><title>A</title><link> https://a/1 </link></item><item><title>no link</title></item>"
            "<item><link><![CDATA[https://a/2?x=1&y=2]]></link></item></channel></rss>"),
    ("atom", '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>T</title><link rel="self" href="https://s"/>'
             '<link href="https://a/3"/></entry></feed>'),
    ("cut", "<rss><channel><item><title>A</title><link>https://a/4</link></item><item><title>br<br></title>"),
    ("junk", "not xml at all"),
    ("none", None),
]


def test_feed_items(spark):
    got = values(S.feed_items(spark.createDataFrame(FEEDS, "feed_url string, xml string")), "feed_url", "pos", "url")
    assert got == [("atom", 0, "https://a/3"), ("cut", 0, "https://a/4"), ("rss", 0, "https://a/1"), ("rss", 2, "https://a/2?x=1&y=2")]


def test_sitemaps(spark):
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    docs = [
        ("i", f"<sitemapindex {ns}><sitemap><loc>b</loc></sitemap><sitemap><loc> a </loc></sitemap></sitemapindex>"),
        ("a", f"<urlset {ns}><url><loc>u1</loc></url><url><loc>u2</loc></url></urlset>"),
        ("b", f"<urlset {ns}><url><loc>u3</loc></url></urlset>"), ("x", "junk"),
    ]
    df = spark.createDataFrame(docs, "sitemap_url string, xml string")
    assert values(S.sitemap_urls(df), "sitemap_url", "kind", "pos", "loc") == [
        ("a", "url", 0, "u1"), ("a", "url", 1, "u2"), ("b", "url", 0, "u3"), ("i", "sitemap", 0, "b"), ("i", "sitemap", 1, "a")]
    assert values(S.sitemap_links(df), "sitemap_url", "child", "pos", "url") == [
        ("a", -1, 0, "u1"), ("a", -1, 1, "u2"), ("b", -1, 0, "u3"), ("i", 0, 0, "u3"), ("i", 1, 0, "u1"), ("i", 1, 1, "u2")]


ROBOTS = [
    "User-agent: *\nDisallow: /private\nAllow: /private/open",
    "User-agent: *\nAllow: /private/open\nDisallow: /private",
    "User-agent: *\nDisallow:\nDisallow: /x",
    "User-agent: MyBot\nDisallow: /a\n\nUser-agent: *\nDisallow: /",
    "User-agent: *\nDisallow: /\n\nUser-agent: mybot\nCrawl-delay: 3",
    "User-agent: lonely\n\nDisallow: /a\nUser-agent: *\nDisallow: /b",
    "User-agent: x\nUser-agent: bot # part of the name\nDisallow: /a%20b\nDisallow: /q?x",
    "Disallow: /\n# nothing before\nUser-agent: *\r\nDisallow: /c # note\r\n\r\nDisallow: /d",
    "User-agent: *\nUser-agent: mybot\nDisallow: /z\n\nUser-agent: mybot\nDisallow: /y",
    "User-agent: *\nDisallow: *\n",
    "User-agent: *\n \nDisallow: /space\nsitemap: x\nAllow: /space",
    "",
]
PATHS = ["", "/", "/private", "/private/open", "/x", "/a", "/a b", "/a%20b/c", "/b", "/c", "/d", "/q?x=1", "/y", "/z", "/space", "/p#f"]


def test_robots_agree_with_the_standard_library(spark):
    files = [(f"h{i}.com", 200, text) for i, text in enumerate(ROBOTS)]
    urls = [(f"https://{host}{p}",) for host, _, _ in files for p in PATHS]
    out = robots_join(spark.createDataFrame(urls, "url string"), spark.createDataFrame(files, "host string, status int, robots_txt string"))
    got = {r.url: r.allowed for r in out.collect()}
    for host, _, text in files:
        parser = RobotFileParser()
        parser.parse(text.splitlines())
        for p in PATHS:
            url = f"https://{host}{p}"
            assert got[url] == parser.can_fetch("MyBot/1.0", url), (text, url)


@pytest.mark.parametrize("status,allowed", [(401, False), (403, False), (404, True), (410, True), (500, False), (None, True)])
def test_robots_status(spark, status, allowed):
    files = spark.createDataFrame([("a.com", status, None)], "host string, status int, robots_txt string")
    urls = spark.createDataFrame([("https://a.com/x",), ("https://b.com/x",)], "url string")
    assert values(robots_join(urls, files), "url", "allowed") == [("https://a.com/x", allowed), ("https://b.com/x", True)]


def test_declared_and_guessed_sitemaps(spark):
    files = spark.createDataFrame(
        [("a.com", 200, "sitemap: x \nUser-agent: *\nSitemap:x\nSITEMAP: y\n# Sitemap: z"), ("b.com", 200, "")],
        "host string, status int, robots_txt string")
    assert values(R.robots_sitemaps(files)) == [("a.com", "x"), ("a.com", "y")]
    fetches = spark.createDataFrame([("https://b.com/sitemap.xml", 200), ("https://b.com/sitemap-news.xml", 404)], "url string, status int")
    guessed = R.guess_sitemaps(files.select("host").filter(F.col("host") == "b.com"), fetches)
    assert values(guessed) == [("b.com", "https://b.com/sitemap.xml")]
