"""Robots files, one file per host: (host, status, robots_txt).

``status`` is the answer to the request for the file; null status and text mean no answer at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pageloom.functions import fixed_values as V
from pageloom.functions.text import strip

_LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def decoded(text: Column) -> Column:
    """Percent-decoded text; text that is not validly encoded stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def robots_sitemaps(files: DataFrame) -> DataFrame:
    """Declared sitemaps, once per host."""
    found = F.regexp_extract_all(F.col("robots_txt"), F.lit(r"(?im)^Sitemap:\s*(.+)$"), 1)
    return (
        files.select("host", F.explode(found).alias("sitemap_url"))
        .select("host", strip(F.col("sitemap_url")).alias("sitemap_url"))
        .distinct()
    )


def guess_sitemaps(hosts: DataFrame, fetches: DataFrame) -> DataFrame:
    """Usual sitemap places of hosts, kept when the fetch log (url, status) has them with status 200."""
    places = F.explode(F.array(*[F.lit(p) for p in V.COMMON_SITEMAP_PATHS]))
    guesses = hosts.select("host", places.alias("place")).select(
        "host", F.concat(F.lit("https://"), F.col("host"), F.col("place")).alias("sitemap_url")
    )
    found = fetches.filter("status = 200").select(F.col("url").alias("sitemap_url"))
    return guesses.join(found, "sitemap_url", "left_semi").select("host", "sitemap_url")


def robots_rules(files: DataFrame) -> DataFrame:
    """Rule rows: host, group number, agents of the group, sequence in the file, allow, prefix.

    A group starts at the first agent line after a rule or an empty line and takes the rules up to
    the next empty line. Lines that only set a delay or rate give a row without a prefix: they make
    the group count without restricting anything. An empty prefix always allows.
    """
    lines = files.filter(F.col("robots_txt").isNotNull()).select(
        "host", F.posexplode(F.split("robots_txt", _LINE_END)).alias("seq", "line")
    )
    body = strip(F.regexp_replace("line", "#.*$", ""))
    key = F.lower(strip(F.regexp_extract(body, r"(?s)^([^:]*):", 1)))
    value = decoded(strip(F.regexp_extract(body, r"(?s)^[^:]*:(.*)$", 1)))
    kind = (
        F.when(F.col("line") == "", "blank")
        .when(key == "user-agent", "agent")
        .when(key.isin("allow", "disallow"), key)
        .when(key.isin("crawl-delay", "request-rate"), "pace")
    )
    # One robots file is one window partition: its size is that of a single input row.
    in_file = W.partitionBy("host").orderBy("seq")
    marked = (
        lines.select("host", "seq", kind.alias("kind"), value.alias("value"))
        .filter("kind is not null")
        .withColumn("before", F.lag("kind").over(in_file))
        .withColumn(
            "starts",
            (F.col("kind") == "blank")
            | ((F.col("kind") == "agent") & (F.coalesce("before", F.lit("blank")) != "agent")),
        )
        .withColumn("grp", F.sum(F.col("starts").cast("int")).over(in_file))
    )
    group = W.partitionBy("host", "grp").orderBy("seq").rowsBetween(
        W.unboundedPreceding, W.unboundedFollowing
    )
    agents = F.collect_list(F.when(F.col("kind") == "agent", F.lower("value"))).over(group)
    prefix = F.when(F.col("kind") != "pace", F.col("value"))
    allow = (F.col("kind") != "disallow") | (F.col("value") == "")
    return (
        marked.withColumn("agents", agents)
        .filter(F.col("kind").isin("allow", "disallow", "pace") & (F.size("agents") > 0))
        .select("host", F.col("grp").cast("int").alias("grp"), "agents", "seq",
                allow.alias("allow"), prefix.alias("prefix"))
    )


def robots_policy(files: DataFrame, agent: str = V.BOT_AGENT) -> DataFrame:
    """One row per host: the verdict its status implies, and the ordered rules that bind ``agent``."""
    short = agent.split("/")[0].lower()
    general = F.array_contains("agents", "*")
    named = ~general & F.exists("agents", lambda a: F.lit(short).contains(a))
    by_group = robots_rules(files).groupBy("host", "grp").agg(
        F.bool_or(named).alias("named"),
        F.bool_or(general).alias("general"),
        F.sort_array(F.collect_list(F.when(F.col("prefix").isNotNull(), F.struct("seq", "allow", "prefix")))).alias(
            "rules"
        ),
    )
    rules = by_group.groupBy("host").agg(
        F.coalesce(
            F.min_by("rules", F.when(F.col("named"), F.col("grp"))),
            F.min_by("rules", F.when(F.col("general"), F.col("grp"))),
        ).alias("rules")
    )
    status = F.col("status")
    verdict = (
        F.when(status.isin(401, 403), F.lit(False))
        .when((status >= 400) & (status < 500), F.lit(True))
        .when(status >= 500, F.lit(False))
    )
    return files.select("host", verdict.alias("verdict")).join(rules, "host", "left")
