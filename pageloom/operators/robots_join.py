"""Robots decision for a table of urls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.functions import fixed_values as V
from pageloom.functions.urls import netloc
from pageloom.sources.robots import decoded, robots_policy

_TARGET = r"(?s)^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?(.*)$"


def robots_join(urls: DataFrame, files: DataFrame, agent: str = V.BOT_AGENT) -> DataFrame:
    """Add ``allowed``: may ``agent`` read the url, given the robots file of its host?

    The first rule in file order whose prefix starts the url's path decides; no rule, no file and no
    answer allow; status 401, 403 and 5xx deny; other 4xx allow. A host's rules travel as one
    array, so urls meet one row per host instead of one per rule.
    """
    policy = robots_policy(files, agent)
    target = decoded(F.regexp_extract("url", _TARGET, 1))
    target = F.when(target == "", "/").otherwise(target)
    joined = urls.withColumn("host", netloc("url")).join(policy, "host", "left")
    hit = F.get(F.filter("rules", lambda r: F.col("_target").startswith(r["prefix"])), F.lit(0))
    return (
        joined.withColumn("_target", target)
        .withColumn("allowed", F.coalesce("verdict", hit["allow"], F.lit(True)))
        .drop("host", "verdict", "rules", "_target")
    )


def allowed_urls(urls: DataFrame, files: DataFrame, agent: str = V.BOT_AGENT) -> DataFrame:
    return robots_join(urls, files, agent).filter("allowed").drop("allowed")
