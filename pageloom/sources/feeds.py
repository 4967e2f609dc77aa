"""Feed and sitemap documents, one document per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.text import strip, unescape_common
from pageloom.session import materialize

_ITEM = "struct<title:string,link:string>"
_ENTRY = "struct<title:string,link:array<struct<_href:string,_rel:string>>>"
_FEED = f"channel struct<item:array<{_ITEM}>>, item array<{_ITEM}>, entry array<{_ENTRY}>"
_SITEMAP = "url array<struct<loc:string>>, sitemap array<struct<loc:string>>"
_RESULT = "array<struct<title:string,link:string>>"


def _entry_link(links: Column) -> Column:
    """Atom: the alternate link, which is also the one without a relation."""
    alternate = F.filter(links, lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    return F.coalesce(F.get(alternate, F.lit(0))["_href"], F.get(links, F.lit(0))["_href"])


def _items_by_pattern(xml: Column) -> Column:
    """Items of a document that is not well formed, as far as they are closed."""
    blocks = F.regexp_extract_all(xml, F.lit(r"(?is)<(?:item|entry)\b[^>]*>(.*?)</(?:item|entry)\s*>"), 1)

    def tag(block: Column, name: str) -> Column:
        body = F.regexp_extract(block, rf"(?is)<{name}\b[^>]*>(.*?)</{name}\s*>", 1)
        return unescape_common(strip(F.regexp_replace(body, r"<!\[CDATA\[|\]\]>", "")))

    def link(block: Column) -> Column:
        href = F.regexp_extract(block, r"""(?is)<link\b[^>]*\bhref\s*=\s*["']([^"']*)["']""", 1)
        return F.coalesce(F.nullif(tag(block, "link"), F.lit("")), unescape_common(href))

    return F.transform(blocks, lambda b: F.struct(tag(b, "title").alias("title"), link(b).alias("link")))


def feed_items(feeds: DataFrame) -> DataFrame:
    """(feed_url, xml) to one row per item that has a link; RSS, RDF and Atom; bad documents tolerated."""
    doc = F.from_xml(F.col("xml"), _FEED, {"mode": "PERMISSIVE"})
    parsed = feeds.select("feed_url", "xml", doc.alias("doc"))
    entries = F.transform(
        F.col("doc.entry"),
        lambda e: F.struct(e["title"].alias("title"), _entry_link(e["link"]).alias("link")),
    )
    items = F.coalesce(
        F.col("doc.channel.item"), F.col("doc.item"), entries, _items_by_pattern(F.col("xml"))
    ).cast(_RESULT)
    return (
        parsed.select("feed_url", F.posexplode(items).alias("pos", "item"))
        .select("feed_url", "pos", strip(F.col("item.link")).alias("url"), strip(F.col("item.title")).alias("title"))
        .filter(F.coalesce(F.col("url"), F.lit("")) != "")
    )


def sitemap_urls(docs: DataFrame) -> DataFrame:
    """(sitemap_url, xml) to location rows: kind ``url`` from a url set, ``sitemap`` from an index."""
    parsed = docs.select("sitemap_url", F.from_xml(F.col("xml"), _SITEMAP).alias("doc"))

    def rows(kind: str) -> Column:
        return F.transform(
            F.coalesce(F.col(f"doc.{kind}"), F.array().cast("array<struct<loc:string>>")),
            lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("pos"), strip(x["loc"]).alias("loc")),
        )

    return (
        parsed.select("sitemap_url", F.inline(F.concat(rows("url"), rows("sitemap"))))
        .filter(F.coalesce(F.col("loc"), F.lit("")) != "")
    )


def sitemap_links(docs: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Page urls of each sitemap; the children of an index count as part of it, in index order.

    Only the ``wanted`` ones (sitemap_url) are parsed, if given, and after them the children that they name. The
    locations found first are written once.
    """
    top = docs if wanted is None else docs.join(wanted.select("sitemap_url").distinct(), "sitemap_url", "left_semi")
    found = materialize(sitemap_urls(top))
    own = found.filter("kind = 'url'").select("sitemap_url", F.lit(-1).alias("child"), "pos", F.col("loc").alias("url"))
    children = found.filter("kind = 'sitemap'").select("sitemap_url", F.col("pos").alias("child"), F.col("loc").alias("child_url"))
    named = docs.join(children.select(F.col("child_url").alias("sitemap_url")).distinct(), "sitemap_url", "left_semi")
    pages = sitemap_urls(named).filter("kind = 'url'").select(F.col("sitemap_url").alias("child_url"), "pos", F.col("loc").alias("url"))
    return own.unionByName(children.join(pages, "child_url").select("sitemap_url", "child", "pos", "url"))
