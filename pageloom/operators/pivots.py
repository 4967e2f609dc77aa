"""Exact nearest neighbours with slices of articles ruled out by pivots.

Vectors are scaled to unit length, where the straight distance is a metric and grows with the cosine distance. Every article belongs to the
nearest of some pivots, and a slice holds articles of one pivot at about the same distance from it, between ``low`` and ``high``. By
the triangle inequality no member of a slice is nearer to a question than ``max(to_pivot - high, low - to_pivot)``. A question first
meets its most promising slices, as many as hold ``k`` articles; the k-th distance found there is proof for all slices that
begin farther away: they are skipped. The others are met in a second step. The result is exact, equal distances included; what pruning saves
depends on how the vectors lie.

Articles travel once, to their slice; a question travels to the slices it meets. Slices hold about ``slice_`` articles, and what is
broadcast to plan the visits is a row per slice.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.operators.articles import filter_embedded
from pageloom.operators.memory import _HITS, _matrix, _nearest, undefined_last, with_rank
from pageloom.operators.skew import per_key_limit
from pageloom.session import materialize

PIVOTS, SLICE = 64, 16_384
#: Distance from the pivot is cut into rings of this width; a ring with more articles than a slice holds is dealt to several.
RING = 1 / 16
#: Bounds computed at a time: questions times slices.
CELLS = 1 << 21
#: What rounding may add to a computed distance; slices are skipped only beyond it.
SLACK = 1e-6


class Pruned(NamedTuple):
    """The hits (query_id, id, distance, rank); meetings of questions with slices, and how many there could have been."""

    hits: DataFrame
    visits: DataFrame
    possible: int


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows of unit length; zero vectors stay zero."""
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norm == 0, 1.0, norm)


def _from_pivots(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((rows * rows).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2.0 * rows @ pivots.T, 0.0))


def _placed(base: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Articles with their nearest pivot and the distance to it. Zero vectors, near to nothing, are apart: pivot -1."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _unit(_matrix(batch.column("embedding")))
            far = _from_pivots(rows, pivots)
            best = far.argmin(axis=1)
            near = far[np.arange(len(rows)), best]
            zero = ~rows.any(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("embedding"), pa.array(np.where(zero, -1, best), pa.int32()), pa.array(np.where(zero, 0.0, near))],
                names=["id", "embedding", "pivot", "far"])

    return base.mapInArrow(place, "id bigint, embedding array<float>, pivot int, far double")


def _plan(questions: DataFrame, pivots: np.ndarray, slices: pd.DataFrame, k: int, second: bool) -> DataFrame:
    """(query_id, embedding, slice): first the slices that may be nearest and hold k articles, then those that ``limit`` leaves."""
    pivot, low, high, held, number = (slices[c].to_numpy() for c in ("pivot", "low", "high", "held", "slice"))
    known = pivot >= 0
    at = np.maximum(pivot, 0)

    step = max(1, CELLS // max(1, len(number)))

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, step) for whole in batches for i in range(0, whole.num_rows, step)):
            rows = _unit(_matrix(batch.column("embedding")))
            to = _from_pivots(rows, pivots)[:, at]
            bound = np.where(known, np.maximum(np.maximum(to - high, low - to), 0.0), np.inf)
            order = np.argsort(bound, axis=1, kind="stable")
            filled = np.cumsum(held[order], axis=1)
            # In order of their bounds, up to the slice with the k-th article; zero vectors count as holding none.
            early = np.zeros_like(bound, dtype=bool)
            np.put_along_axis(early, order, filled - held[order] < k, axis=1)
            if second:
                limit = batch.column("limit").to_numpy(zero_copy_only=False)
                wanted = ~early & ~(bound > limit[:, None] + SLACK)
            else:
                wanted = early
            q, s = np.nonzero(wanted)
            yield pa.RecordBatch.from_arrays(
                [batch.column("query_id").take(pa.array(q)), batch.column("embedding").take(pa.array(q)), pa.array(number[s], pa.int32())], names=["query_id", "embedding", "slice"])

    return questions.mapInArrow(plan, "query_id bigint, embedding array<float>, slice int")


def _meet(visits: DataFrame, articles: DataFrame, k: int) -> DataFrame:
    """The best k of each slice for each question that visits it."""

    def cell(q: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        if q.empty or a.empty:
            return pd.DataFrame({"query_id": [], "id": [], "distance": []})
        rows, matrix = (np.stack(x["embedding"].to_numpy()).astype(np.float64) for x in (a, q))
        found = _nearest(q["query_id"].to_numpy(), matrix, [(a["id"].to_numpy(), rows)], k)
        return pd.DataFrame(dict(zip(("query_id", "id", "distance"), found, strict=True)))

    held = articles.select("id", "embedding", F.col("slice").alias("_slice"))
    return undefined_last(visits.groupBy("slice").cogroup(held.groupBy("_slice")).applyInPandas(cell, _HITS))


def pruned_knn(articles: DataFrame, queries: DataFrame, k: int, pivots: int = PIVOTS, slice_: int = SLICE) -> Pruned:
    """Nearest ``k`` articles for a table of queries (``query_id``, ``embedding``), as ``memory.knn_join`` finds them.

    Equal distances go by id. A question of length zero, or one with fewer than ``k`` articles to be near to, visits every slice.
    Articles, with their slice, and hits of both steps are written to the checkpoint folder.
    """
    base = filter_embedded(articles).select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("embedding"))
    asked = materialize(filter_embedded(queries).select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<float>").alias("embedding")))
    some = base.orderBy(F.xxhash64("id"), "id").limit(pivots).toPandas()["embedding"]
    empty = articles.sparkSession.createDataFrame([], f"{_HITS}, rank int")
    if not len(some):
        return Pruned(empty, empty.select("query_id", F.lit(0).alias("slice")), 0)
    centres = _unit(np.stack(some.to_numpy()).astype(np.float64))

    placed = materialize(_placed(base, centres).withColumn("ring", F.floor(F.col("far") / RING).cast("int")))
    rings = placed.groupBy("pivot", "ring").agg(F.count(F.lit(1)).alias("n"))
    rings = rings.select("pivot", "ring", F.ceil(F.col("n") / slice_).cast("int").alias("parts"))
    dealt = placed.join(rings, ["pivot", "ring"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    # A row per slice, some thousands of articles each.
    slices = dealt.groupBy("pivot", "ring", "part").agg(F.min("far").alias("low"), F.max("far").alias("high"), F.count(F.lit(1)).alias("held")).toPandas()
    slices["slice"] = np.arange(len(slices), dtype=np.int32)
    slices["held"] = np.where(slices["pivot"] >= 0, slices["held"], 0)
    numbers = articles.sparkSession.createDataFrame(slices[["pivot", "ring", "part", "slice"]], "pivot int, ring int, part int, slice int")
    held = dealt.join(numbers, ["pivot", "ring", "part"]).select("id", "embedding", "slice")

    first = materialize(_plan(asked, centres, slices, k, False))
    near = materialize(_meet(first, held, k))
    # The k-th straight distance found, of vectors of unit length; not a number, or too few, limits nothing.
    kth = near.groupBy("query_id").agg(F.sort_array(F.collect_list("distance")).alias("d"))
    last = F.get("d", F.lit(k - 1))
    limits = kth.select("query_id", F.when(last.isNotNull() & ~F.isnan(last), F.sqrt(F.greatest(2 * last, F.lit(0.0)))).alias("limit"))
    open_ = asked.join(limits, "query_id", "left").select("query_id", "embedding", F.coalesce("limit", F.lit(float("inf"))).alias("limit"))
    second = materialize(_plan(open_, centres, slices, k, True))
    hits = near.unionByName(_meet(second, held, k))
    best = with_rank(per_key_limit(hits, "query_id", ["distance", "id"], k, spread="id"), "query_id")
    visits = first.select("query_id", "slice").unionByName(second.select("query_id", "slice"))
    return Pruned(best, visits, asked.count() * len(slices))
