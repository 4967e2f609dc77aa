"""Links of stored pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.text import unescape_common
from pageloom.functions.urls import with_joined_url

_HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
_HREF = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


def hrefs(html: Column) -> Column:
    """Raw ``href`` values of the ``<a>`` tags, in document order."""
    found = F.regexp_extract_all(F.regexp_replace(html, _HIDDEN, ""), F.lit(_HREF), 1)
    return F.transform(found, lambda h: unescape_common(F.regexp_replace(h, r"""^["']|["']$""", "")))


def extract_links(pages: DataFrame) -> DataFrame:
    """One row per link: page url, position on the page, href as written."""
    return pages.select(
        F.col("url").alias("src_url"), F.posexplode(hrefs(F.col("html"))).alias("pos", "href")
    )


def link_edges(pages: DataFrame) -> DataFrame:
    """The link graph: page url, position, absolute target url."""
    return with_joined_url(extract_links(pages), "src_url", "href", "dst_url").drop("href")
