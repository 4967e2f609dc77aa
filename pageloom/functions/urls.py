"""URL helpers as Column expressions. Everything stays inside generated code except dot-segment folding."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions import fixed_values as V
from pageloom.functions.bind import bound

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*):"
_NETLOC = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"
_PATH = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _any(tests) -> Column:
    return reduce(lambda a, b: a | b, tests)


def scheme(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(_col(url), _SCHEME, 1))


def netloc(url: Column | str) -> Column:
    """Host part as written: port, user and case are kept."""
    return F.regexp_extract(_col(url), _NETLOC, 1)


def path(url: Column | str) -> Column:
    """Path without the parameters of its last segment."""
    return F.regexp_replace(F.regexp_extract(_col(url), _PATH, 1), r";[^/]*$", "")


def without_www(host: Column) -> Column:
    return F.replace(host, F.lit("www."), F.lit(""))


def robots_url(url: Column | str) -> Column:
    return F.concat(scheme(url), F.lit("://"), netloc(url), F.lit("/robots.txt"))


def is_useful(url: Column | str) -> Column:
    """True unless the lower-cased url ends like an asset or holds a utility, ad or video term."""
    low = F.lower(_col(url))
    asset = _any(low.endswith(s) for s in V.ASSET_SUFFIXES)
    utility = _any(low.contains(t) for t in V.UTILITY_TERMS)
    return ~(asset | utility)


def is_internal(url: Column | str, base: Column | str) -> Column:
    return without_www(netloc(url)) == without_www(netloc(base))


def classify_link(url_path: Column | str) -> Column:
    """``article``, ``index`` or ``unknown``; dates and trailing ids win over index keywords."""
    low = F.lower(_col(url_path))
    index = _any(low.contains("/" + k) for k in V.INDEX_KEYWORDS)
    return (
        F.when(low.rlike(V.YEAR_IN_PATH), "article")
        .when(low.rlike(V.MONTH_IN_PATH), "article")
        .when(low.rlike(V.ID_AT_END), "article")
        .when(index, "index")
        .otherwise("unknown")
    )


def score_sitemap(url: Column | str) -> Column:
    low = F.lower(_col(url))
    news = _any(low.contains(t) for t in V.NEWS_SITEMAP_TERMS).cast("int") * V.NEWS_SCORE
    priority = sum((low.contains(t).cast("int") for t in V.PRIORITY_TERMS), F.lit(0)) * V.PRIORITY_SCORE
    skip = sum((low.contains(t).cast("int") for t in V.SKIP_TERMS), F.lit(0)) * V.SKIP_SCORE
    return news + priority + skip


def detect_source_type(url: Column | str) -> Column:
    """``struct(job_type, interval_seconds, label)`` guessed from the url."""
    low = F.trim(F.lower(_col(url)))

    def kind(name: str) -> Column:
        interval, label = V.SOURCE_TYPES[name]
        return F.struct(
            F.lit(name).alias("job_type"),
            F.lit(interval).alias("interval_seconds"),
            F.lit(label).alias("label"),
        )

    feed = _any(low.contains(m) for m in V.FEED_MARKERS)
    single = low.rlike(V.DATE_IN_URL) | low.rlike(V.ID_IN_URL)
    return F.when(feed, kind("rss")).when(single, kind("single")).otherwise(kind("discovery"))


def job_name(name: Column, label: Column, url: Column) -> Column:
    """The given name, or ``label: host`` when it is missing or empty."""
    return F.when(F.coalesce(name, F.lit("")) == "", F.concat(label, F.lit(": "), netloc(url))).otherwise(name)


def with_scheme(url: Column | str) -> Column:
    u = _col(url)
    return F.when(u.startswith("http"), u).otherwise(F.concat(F.lit("https://"), u))


def strip_trailing_slashes(url: Column | str) -> Column:
    return F.regexp_replace(_col(url), r"/+$", "")


def _fold_dots(segments: Column) -> Column:
    """Resolve ``.`` and ``..`` in an array of path segments."""
    none = F.array().cast("array<string>")

    def fold(segs: Column) -> Column:
        folded = F.aggregate(
            segs,
            none,
            lambda acc, seg: F.when(seg == ".", acc)
            .when(seg == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
            .otherwise(F.concat(acc, F.array(seg))),
        )
        tail = F.when(F.element_at(segs, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(none)
        return F.array_join(F.concat(folded, tail), "/")

    def rooted(joined: Column) -> Column:
        return F.when(joined.startswith("/"), joined).otherwise(F.concat(F.lit("/"), joined))

    return bound(bound(segments, fold), rooted)


_PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
_PART_NAMES = ("scheme", "host", "path", "query", "fragment")


def _parts(url: Column) -> dict[str, Column]:
    found = {name: F.regexp_extract(url, _PARTS, i) for i, name in enumerate(_PART_NAMES, 1)}
    return {**found, "scheme": F.lower(found["scheme"])}


def _trimmed(href: Column) -> Column:
    return F.regexp_replace(href, r"^[\x00-\x20]+|[\t\r\n]", "")


def _joined(base: Column, href: Column, b: dict[str, Column], h: dict[str, Column]) -> Column:
    """Join out of the parts of both urls."""
    root = F.concat(b["scheme"], F.lit("://"), b["host"])
    host_root = F.concat(b["scheme"], F.lit("://"), h["host"])
    fragment = F.when(h["fragment"] != "", F.concat(F.lit("#"), h["fragment"])).otherwise("")

    def query(text: Column) -> Column:
        return F.when(text != "", F.concat(F.lit("?"), text)).otherwise("")

    base_parts = F.split(b["path"], "/")
    base_dir = F.when(b["path"].endswith("/") | (b["path"] == ""), base_parts).otherwise(
        F.slice(base_parts, 1, F.size(base_parts) - 1)
    )
    merged = F.concat(base_dir, F.split(h["path"], "/"))

    def filled(m: Column) -> Column:
        inner = F.filter(F.slice(m, 2, F.greatest(F.size(m) - 2, F.lit(0))), lambda s: s != "")
        return F.concat(F.slice(m, 1, 1), inner, F.slice(m, -1, 1))

    relative = bound(merged, filled)
    rooted = h["path"].startswith("/")
    plain = rooted & ~h["path"].contains("/.")
    path = (
        F.when((h["host"] != "") | plain, h["path"])
        .when(h["path"] == "", b["path"])
        .otherwise(_fold_dots(F.when(rooted, F.split(h["path"], "/")).otherwise(relative)))
    )
    kept_query = F.when((h["host"] == "") & (h["path"] == "") & (h["query"] == ""), b["query"]).otherwise(h["query"])
    return (
        F.when(base == "", href)
        .when(href == "", base)
        .when((h["scheme"] != "") & (h["scheme"] != b["scheme"]), href)
        .otherwise(F.concat(F.when(h["host"] != "", host_root).otherwise(root), path, query(kept_query), fragment))
    )


def url_join(base: Column | str, href: Column | str) -> Column:
    """Absolute url of ``href`` on the page ``base`` (absolute, ``//``, ``/``, ``?``, ``#``, relative)."""
    b = _col(base)

    def join(p: Column) -> Column:
        return _joined(p["base"], p["href"], {n: p[f"b_{n}"] for n in _PART_NAMES}, {n: p[f"h_{n}"] for n in _PART_NAMES})

    def parts(h: Column) -> Column:
        return F.struct(
            b.alias("base"), h.alias("href"),
            *[c.alias(f"b_{n}") for n, c in _parts(b).items()], *[c.alias(f"h_{n}") for n, c in _parts(h).items()],
        )

    return bound(bound(_trimmed(_col(href)), parts), join)


def with_joined_url(df: DataFrame, base: str, href: str, out: str) -> DataFrame:
    """Add ``url_join(base, href)``, taking both urls apart once per row.

    The result comes out of a generator, so that filters on it are evaluated on the finished url
    instead of repeating the expression for each of their terms.
    """
    names = df.columns
    split = df.withColumn("_href", _trimmed(F.col(href))).select(
        *names, "_href",
        *[c.alias(f"_b_{n}") for n, c in _parts(F.col(base)).items()],
        *[c.alias(f"_h_{n}") for n, c in _parts(F.col("_href")).items()],
    )
    b = {n: F.col(f"_b_{n}") for n in _PART_NAMES}
    h = {n: F.col(f"_h_{n}") for n in _PART_NAMES}
    return split.select(*names, F.explode(F.array(_joined(F.col(base), F.col("_href"), b, h))).alias(out))
