"""Where addresses lead: chains of redirects, of any length, and loops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.functions.urls import strip_trailing_slashes, with_scheme
from pageloom.session import discard, materialize


def resolve_redirects(redirects: DataFrame) -> DataFrame:
    """The end of every chain: ``redirects`` (url, final_url), one hop a row, to (url, final_url, looped).

    Pointer doubling: each round replaces a row's target by its target's target, so a chain of n hops takes log2(n) rounds of
    one join. A round that ends no chain proves that all open rows lead into loops, for of the rows of a longer chain some would have
    ended in it; those keep their own url. Of several targets of a url the least counts; rows without url or target are left out.
    Rounds are written to the checkpoint folder, the last one only stays.
    """
    hops = redirects.filter("url is not null and final_url is not null").groupBy("url").agg(F.min("final_url").alias("to"))
    hops = materialize(hops)
    onward = hops.select(F.col("url").alias("to"), F.lit(True).alias("_on"))
    state = materialize(hops.join(onward, "to", "left").select("url", "to", F.col("_on").isNotNull().alias("open")))
    discard(hops)
    left = state.filter("open").count()
    while left:
        known = state.select(F.col("url").alias("to"), F.col("to").alias("_next"), F.col("open").alias("_open"))
        stepped = state.filter("open").join(known, "to").select("url", F.col("_next").alias("to"), F.col("_open").alias("open"))
        after = materialize(state.filter("not open").unionByName(stepped))
        discard(state)
        state, before = after, left
        left = state.filter("open").count()
        if left == before:
            break
    return state.select("url", F.when(F.col("open"), F.col("url")).otherwise(F.col("to")).alias("final_url"), F.col("open").alias("looped"))


def normalized_sources(given: DataFrame, redirects: DataFrame, url: str = "url", out: str = "base") -> DataFrame:
    """``given`` with the address each url leads to, without slashes at its end; one that leads into a loop stays as asked."""
    asked = given.withColumn("_asked", with_scheme(F.col(url)))
    ends = resolve_redirects(redirects).select(F.col("url").alias("_asked"), "final_url", "looped")
    end = F.when(F.col("looped"), F.col("_asked")).otherwise(strip_trailing_slashes(F.coalesce("final_url", "_asked")))
    return asked.join(ends, "_asked", "left").withColumn(out, end).drop("_asked", "final_url", "looped")
