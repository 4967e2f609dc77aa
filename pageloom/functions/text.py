"""Text helpers as Column expressions."""

from __future__ import annotations

import html as html_lib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.functions import fixed_values as V


def strip(text: Column) -> Column:
    """Remove white space, line ends included, from both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def non_empty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def truncate(text: Column, n: int) -> Column:
    """First ``n`` characters (code points)."""
    return F.substring(text, 1, n)


def excerpt(text: Column, n: int = V.SUMMARY_CHARS) -> Column:
    return F.when(F.length(text) > n, F.concat(truncate(text, n), F.lit("..."))).otherwise(text)


def summary_fallback(given: Column, text: Column) -> Column:
    """The page's own excerpt, else the head of the text."""
    return F.coalesce(non_empty(given), excerpt(F.coalesce(text, F.lit(""))))


# Entities decoded without leaving the JVM; the ampersand comes last so that nothing is decoded twice.
_ENTITIES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
    ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"),
)
OTHER_ENTITY = r"&(?!(?:lt|gt|quot|#39|apos|nbsp|copy|middot|amp);)(?:#[0-9]|#[xX][0-9a-fA-F]|[A-Za-z])"


def unescape_common(text: Column) -> Column:
    for entity, char in _ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


@F.pandas_udf(T.StringType())
def _unescape_all(texts: pd.Series) -> pd.Series:
    return texts.map(html_lib.unescape, na_action="ignore")


def unescape(text: Column) -> Column:
    """Decode every entity; only texts with one beyond the common ones leave the JVM."""
    return F.coalesce(_unescape_all(F.when(text.rlike(OTHER_ENTITY), text)), unescape_common(text))


def html_title(html: Column) -> Column:
    """Text of the first ``<title>``, stripped; null when the page has none."""
    pattern = r"(?is)<title\b[^>]*>(.*?)</title\s*>"
    found = F.regexp_extract(html, pattern, 1)
    return F.when(html.rlike(pattern), strip(unescape(found)))


def title_fallback(title: Column, html: Column) -> Column:
    return F.coalesce(non_empty(title), html_title(html), F.lit(V.NO_TITLE))


def parse_audit(reply: Column, prompt: Column) -> Column:
    """Auditor's reply as ``struct(sufficient, queries)``."""
    lines = F.filter(F.transform(F.split(reply, "\n"), strip), lambda line: line != "")
    found = F.slice(
        F.filter(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), lambda line: F.length(line) > 3),
        1,
        V.AUDIT_QUERIES,
    )
    blank = reply.isNull() | (F.size(lines) == 0)
    yes = F.upper(F.element_at(lines, 1)).startswith("YES")
    none = F.array().cast("array<string>")
    sufficient = F.when(blank, F.lit(False)).otherwise(yes)
    queries = (
        F.when(blank, F.array(prompt))
        .when(yes, none)
        .when(F.size(found) == 0, F.array(prompt))
        .otherwise(found)
    )
    return F.struct(sufficient.alias("sufficient"), queries.alias("queries"))


def audit_prompt(query: Column, context: Column) -> Column:
    """Question put to the auditor: is the stored knowledge enough to answer the query?"""
    return F.format_string(
        "Query: %s\n\nStored knowledge, best matches first:\n%s\n\n"
        "Is this specific and recent enough for a thorough article on the query?\n"
        "First line: YES or NO. After a NO: three search queries, one per line.",
        query,
        context,
    )


def analysis_prompt(text: Column) -> Column:
    """Question put to the analyser about the head of one article."""
    return F.format_string(
        "Text:\n%s\n\nReply with one JSON object with the keys summary (three sentences), "
        "tags (three words), category (one word) and urgency (1 to 10).",
        truncate(text, V.ANALYSIS_CHARS),
    )
