"""Exact nearest-neighbour search over article vectors.

The vectors of a record batch form one matrix, so a partition is scanned by matrix products and only
its best k rows leave the Python worker; Spark merges those. No pair outside a best-k list is emitted.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.functions import fixed_values as V
from pageloom.operators.articles import filter_embedded
from pageloom.operators.enrich import Embedder, embedding
from pageloom.operators.skew import per_key_limit

# Queries and articles that meet in one task.
BLOCK_QUERIES, BLOCK_ARTICLES = 16_384, 32_768
_QUERIES_AT_ONCE = 512
# Queries that every task gets whole (25 MB of 768 dimensions), and articles that it compares with them at once.
FEW_QUERIES, _ARTICLES_AT_ONCE = 4_096, 2_048


def _matrix(vectors: pa.Array) -> np.ndarray:
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


def _distances(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Cosine distances, one row per article and one column per query; NaN for a zero vector."""
    norms = np.linalg.norm(rows, axis=1)[:, None] * np.linalg.norm(queries, axis=1)[None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(norms == 0, np.nan, 1.0 - (rows @ queries.T) / norms)


def memory_search(
    articles: DataFrame,
    vector: Sequence[float],
    k: int = V.AUDIT_HITS,
    cols: Sequence[str] = ("id", "title", "ai_category"),
) -> DataFrame:
    """The ``k`` articles nearest to one vector, with their distance; equal distances by id."""
    base = filter_embedded(articles).select(*cols, "embedding")
    schema = T.StructType([base.schema[c] for c in cols] + [T.StructField("distance", T.DoubleType())])
    query = np.asarray(vector, dtype=np.float64)[None, :]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            table = pa.Table.from_batches([batch])
            distance = _distances(_matrix(table.column("embedding")), query)[:, 0]
            table = table.drop_columns(["embedding"]).append_column("distance", pa.array(distance, from_pandas=False))
            table = table if kept is None else pa.concat_tables([kept, table])
            order = np.lexsort((table.column("id").to_numpy(), table.column("distance").to_numpy()))
            kept = table.take(order[:k])
        if kept is not None:
            yield from kept.combine_chunks().to_batches()

    return base.mapInArrow(best, schema).orderBy("distance", "id").limit(k)


def _nearest(
    query_ids: np.ndarray, queries: np.ndarray, batches: Iterable[tuple[np.ndarray, np.ndarray]], k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best ``k`` (query id, article id, distance) per query over batches of (ids, matrix)."""
    q = np.empty(0, dtype=np.int64)
    ids, dist = np.empty(0, dtype=np.int64), np.empty(0)
    for batch_ids, rows in batches:
        by_id = np.argsort(batch_ids, kind="stable")
        batch_ids, rows = batch_ids[by_id], rows[by_id]
        new_q, new_row, new_d = [q], [ids], [dist]
        for at in range(0, len(queries), _QUERIES_AT_ONCE):
            d = _distances(rows, queries[at : at + _QUERIES_AT_ONCE])
            d = np.where(np.isnan(d), np.inf, d)
            if len(rows) > k:
                # k rows per query: all below the k-th distance, then of those at it the least ids.
                kth = np.partition(d, k - 1, axis=0)[k - 1]
                below, at_it = d < kth, d == kth
                near = below | (at_it & (np.cumsum(at_it, axis=0) <= k - below.sum(axis=0)))
            else:
                near = np.ones_like(d, dtype=bool)
            row, col = np.nonzero(near)
            new_q.append(col + at)
            new_row.append(batch_ids[row])
            new_d.append(d[row, col])
        q, ids, dist = np.concatenate(new_q), np.concatenate(new_row), np.concatenate(new_d)
        order = np.lexsort((ids, dist, q))
        q, ids, dist = q[order], ids[order], dist[order]
        first = np.searchsorted(q, q, side="left")
        keep = np.arange(len(q)) - first < k
        q, ids, dist = q[keep], ids[keep], dist[keep]
    return query_ids[q], ids, np.where(np.isinf(dist), np.nan, dist)


_HITS = "query_id long, id long, distance double"


def _knn_blocks(base: DataFrame, queries: DataFrame, n_queries: int, k: int, block: int, slice_: int) -> DataFrame:
    """Every block of queries meets every slice of articles in one task; both are of bounded size."""
    blocks, slices = ceil(n_queries / block), max(1, ceil(base.count() / slice_))
    left = queries.select(
        F.col("query_id").alias("key"), "embedding",
        F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("b"),
        F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("s"),
    )
    right = base.select(
        F.col("id").alias("key"), "embedding",
        F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int").alias("s"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"),
    )

    def cell(q: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        if q.empty or a.empty:
            return pd.DataFrame({"query_id": [], "id": [], "distance": []})
        rows = np.stack(a["embedding"].to_numpy()).astype(np.float64)
        steps = range(0, len(rows), 10_000)
        parts = ((a["key"].to_numpy()[i : i + 10_000], rows[i : i + 10_000]) for i in steps)
        matrix = np.stack(q["embedding"].to_numpy()).astype(np.float64)
        found = _nearest(q["key"].to_numpy(), matrix, parts, k)
        return pd.DataFrame(dict(zip(("query_id", "id", "distance"), found)))

    return undefined_last(left.groupBy("b", "s").cogroup(right.groupBy("b", "s")).applyInPandas(cell, _HITS))


def _knn_few(articles: DataFrame, asked: pa.Table, k: int) -> DataFrame:
    """Few queries go to every task: articles are read once and stay where they are, each task hands on its best ``k`` per query."""
    sent = articles.sparkSession.sparkContext.broadcast((asked.column("query_id").to_pandas().to_numpy(), _matrix(asked.column("embedding"))))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for batch in batches:
                for at in range(0, batch.num_rows, _ARTICLES_AT_ONCE):
                    some = batch.slice(at, _ARTICLES_AT_ONCE)
                    some = some.filter(some.column("embedding").is_valid())
                    if some.num_rows:
                        yield some.column("id").to_pandas().to_numpy(), _matrix(some.column("embedding"))

        found = pd.DataFrame(dict(zip(("query_id", "id", "distance"), _nearest(*sent.value, parts(), k))))
        schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("distance", pa.float64())])
        yield from pa.Table.from_pandas(found, schema=schema, preserve_index=False).to_batches()

    # Without a filter before it the vector is computed once where it is an expression.
    return undefined_last(articles.select(F.col("id").cast("long").alias("id"), "embedding").mapInArrow(best, _HITS))


def undefined_last(hits: DataFrame) -> DataFrame:
    """Distances that are no number, of zero vectors, come back from pandas as nulls; as numbers they sort after all others."""
    return hits.withColumn("distance", F.coalesce("distance", F.lit(float("nan"))))


def knn_join(
    articles: DataFrame, queries: DataFrame, k: int, block: int = BLOCK_QUERIES, slice_: int = BLOCK_ARTICLES
) -> DataFrame:
    """Nearest ``k`` articles for a table of queries (``query_id``, ``embedding``).

    Returns query_id, id, distance and rank; equal distances by id. Up to ``FEW_QUERIES`` queries (and no more than ``block``) go to
    every task. Of more, blocks of queries meet slices of articles, of ``block`` and ``slice_`` rows at most on average.
    """
    asked = filter_embedded(queries).select(F.col("query_id").cast("long").alias("query_id"), "embedding")
    few = min(block, FEW_QUERIES)
    first = asked.limit(few + 1).toArrow()
    if not first.num_rows:
        hits = queries.sparkSession.createDataFrame([], _HITS)
    elif first.num_rows <= few:
        hits = _knn_few(articles, first, k)
    else:
        base = filter_embedded(articles).select(F.col("id").cast("long").alias("id"), "embedding")
        hits = _knn_blocks(base, asked, asked.count(), k, block, slice_)
    best = per_key_limit(hits, "query_id", ["distance", "id"], k, spread="id")
    return with_rank(best, "query_id")


def search_by_text(
    articles: DataFrame, questions: DataFrame, k: int = V.AUDIT_HITS, model: Embedder | None = None, dim: int = V.EMBEDDING_DIM
) -> DataFrame:
    """Nearest articles for a table of questions (``query_id``, ``text``), each turned into a vector by ``model`` first.

    The model must be the one that the article vectors come from. A question without words has no hits.
    """
    asked = questions.select("query_id", embedding(F.col("text"), model, dim).alias("embedding"))
    return knn_join(articles, asked, k)


def with_rank(hits: DataFrame, key: str) -> DataFrame:
    """Number the hits of each query from 1; the input holds at most k per query."""
    return hits.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy("distance", "id")))
