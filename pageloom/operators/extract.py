"""Article text and metadata out of raw pages.

The rule: drop comments, scripts, styles, navigation, headers, footers and ad blocks; take the
``<article>``, else ``<main>``, else ``<body>``, else all of it; end lines at paragraphs, breaks, headings,
list items, rows and blocks; strip tags; decode entities; squeeze blanks.
"""

from __future__ import annotations

import html as html_lib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.functions import fixed_values as V
from pageloom.functions.text import OTHER_ENTITY, non_empty, strip, summary_fallback, unescape_common

AD_BLOCK = r"""<div\b[^>]*\bclass\s*=\s*["'](?:[^"']*\s)?ads?(?:\s[^"']*)?["'][^>]*>.*?</div\s*>"""
DROPPED = (
    r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)"
    r"|<head\b.*?</head\s*>|<nav\b.*?</nav\s*>|<header\b.*?</header\s*>|<footer\b.*?</footer\s*>|" + AD_BLOCK
)
LINE_END = r"(?i)<br\s*/?>|</?(?:p|h[1-6]|li|tr|div)\b[^>]*>"
TAG = r"<[^>]*>"


def _group(text: Column, pattern: str) -> Column:
    return non_empty(F.regexp_extract(text, pattern, 1))


def _metas(head: Column) -> Column:
    """The ``<meta>`` tags as an array of (name, content)."""
    tags = F.regexp_extract_all(head, F.lit(r"(?is)<meta\b[^>]*>"), 0)

    def pair(tag: Column) -> Column:
        name = F.regexp_extract(tag, r"""(?is)\b(?:name|property|itemprop)\s*=\s*["']([^"']*)["']""", 1)
        content = r"""(?is)\bcontent\s*=\s*(?:"([^"]*)"|'([^']*)')"""
        value = F.concat(F.regexp_extract(tag, content, 1), F.regexp_extract(tag, content, 2))
        return F.struct(F.lower(name).alias("name"), strip(value).alias("content"))

    return F.transform(tags, pair)


def _meta(metas: Column, *names: str) -> Column:
    """Content of the first filled ``<meta>`` of the first name that has one, as it stands."""

    def named(name: str) -> Column:
        hits = F.filter(metas, lambda m: (m["name"] == name.lower()) & (m["content"] != ""))
        return F.get(hits, F.lit(0))["content"]

    return F.coalesce(*[named(n) for n in names])


_NESTABLE = re.compile(
    r"(?is)<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)|<(/?)(div|nav|header|footer|head)\b[^>]*>"
)
_AD_CLASS = re.compile(r"""(?is)\bclass\s*=\s*["'](?:[^"']*\s)?ads?(?:\s[^"']*)?["']""")


def _drop_nested(page: str) -> str:
    """Remove the dropped blocks of one page together with the blocks nested in them."""
    out, at, inside, depth = [], 0, None, 0
    for tag in _NESTABLE.finditer(page):
        name = (tag.group(3) or "").lower()
        if inside is None:
            if name and (tag.group(2) or (name == "div" and not _AD_CLASS.search(tag.group(0)))):
                continue
            out.append(page[at : tag.start()])
            at = tag.end()
            if name:
                inside, depth = name, 1
        elif name == inside:
            depth += -1 if tag.group(2) else 1
            if depth == 0:
                inside, at = None, tag.end()
    if inside is None:
        out.append(page[at:])
    return "".join(out)


@F.pandas_udf(T.StringType())
def drop_nested_blocks(pages: pd.Series) -> pd.Series:
    return pages.map(_drop_nested, na_action="ignore")


def _needs_nesting(page: Column) -> Column:
    """An ad or navigation block that holds a block of its own kind."""
    ads = F.regexp_extract_all(page, F.lit("(?is)" + AD_BLOCK), 0)
    navs = F.regexp_extract_all(page, F.lit(r"(?is)<nav\b.*?</nav\s*>"), 0)
    return F.exists(ads, lambda b: F.lower(F.substring(b, 5, 1 << 30)).contains("<div")) | F.exists(
        navs, lambda b: F.lower(F.substring(b, 5, 1 << 30)).contains("<nav")
    )


def tidy(text: Column) -> Column:
    text = F.regexp_replace(text, r"[ \t\r]+", " ")
    return strip(F.regexp_replace(text, r" *\n\s*", "\n"))


def clean_text(page: Column, nested: Column | None = None) -> Column:
    """Readable text of a page; ``nested`` is the page with nested blocks already dropped, or null."""
    bare = F.regexp_replace(page, DROPPED, "")
    if nested is not None:
        bare = F.coalesce(nested, bare)
    parts = [
        _group(bare, rf"(?is)<{tag}\b[^>]*>(.*)</{tag}\s*>") for tag in ("article", "main", "body")
    ] + [_group(bare, rf"(?is)<{tag}\b[^>]*>(.*)\z") for tag in ("article", "main", "body")]
    return F.regexp_replace(F.regexp_replace(F.coalesce(*parts, bare), LINE_END, "\n"), TAG, "")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _unescape_fields(fields: pd.Series) -> pd.Series:
    def decode(row):
        return None if row is None else [None if x is None else html_lib.unescape(x) for x in row]

    return fields.map(decode)


def _decoded(fields: Column, python_helpers: bool) -> Column:
    """An array of texts with their entities decoded; only rows with an uncommon entity leave the JVM."""
    common = F.transform(fields, lambda x: F.when(F.instr(x, "&") == 0, x).otherwise(unescape_common(x)))
    if not python_helpers:
        return common
    odd = F.exists(fields, lambda x: F.coalesce(x.rlike(OTHER_ENTITY), F.lit(False)))
    return F.coalesce(_unescape_fields(F.when(odd, fields)), common)


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that comes out of a generator, so that later steps use its value instead of repeating its expression."""
    return df.select(*df.columns, F.explode(F.array(value)).alias(name))


def extract_articles(pages: DataFrame, python_helpers: bool = True) -> DataFrame:
    """Pages (``url``, ``html``) to title, author, published_date, main_image, clean_text and summary.

    All work is in built-in functions but for two rare cases that a regular expression cannot do:
    blocks nested in dropped blocks, and entities beyond the common ones. Only those pages are handed
    to the Python helpers. A page without text keeps nulls in all columns but the title. Every step's values are computed once:
    raw fields, then all entities of a page's fields together, then the columns.
    """
    page = F.col("html")
    marked = pages
    if python_helpers:
        marked = marked.withColumn("_nested", drop_nested_blocks(F.when(_needs_nesting(page), page)))
    head = F.coalesce(non_empty(F.regexp_extract(page, r"(?is)<head\b.*?</head\s*>", 0)), page)
    marked = _once(marked, "_metas", _metas(head))
    metas, title = F.col("_metas"), r"(?is)<title\b[^>]*>(.*?)</title\s*>"
    raw = F.array(
        clean_text(page, F.col("_nested") if python_helpers else None),
        F.regexp_replace(F.regexp_extract(page, r"(?is)<h1\b[^>]*>(.*?)</h1\s*>", 1), TAG, ""),
        F.when(page.rlike(title), F.regexp_extract(page, title, 1)),
        _meta(metas, "og:title"), _meta(metas, "author", "article:author"), _meta(metas, "og:image"), _meta(metas, "description", "og:description"),
    )
    marked = _once(_once(marked, "_raw", raw), "_fields", _decoded(F.col("_raw"), python_helpers))
    text, heading, doc_title, og_title, author, image, description = (F.get("_fields", F.lit(i)) for i in range(7))
    marked = _once(marked, "clean_text", non_empty(tidy(text)))
    plain = lambda field: non_empty(strip(field))
    found, body = F.col("clean_text").isNotNull(), F.col("clean_text")
    published = F.coalesce(
        _meta(metas, "article:published_time", "datePublished", "date"),
        _group(page, r"""(?is)<time\b[^>]*\bdatetime\s*=\s*["']([^"']*)["']"""),
    )
    return marked.select(
        *pages.columns,
        F.coalesce(
            non_empty(F.when(found, F.coalesce(plain(og_title), non_empty(tidy(heading))))), strip(doc_title), F.lit(V.NO_TITLE)
        ).alias("title"),
        F.when(found, plain(author)).alias("author"),
        F.when(found, published).alias("published_date"),
        F.when(found, plain(image)).alias("main_image"),
        "clean_text",
        F.when(found, summary_fallback(plain(description), body)).alias("summary"),
    )
