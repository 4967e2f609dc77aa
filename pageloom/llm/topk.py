"""Exact top-k search by integer inner product over impact-ordered blocks.

A vector becomes integers floor(scale * x). Rows are dealt to blocks; a block's index holds its components as postings grouped
into segments by quantised impact (the magnitude, in powers of two), largest first. Queries go through the segments in that
order, score at a time: after each segment every row has a partial score and a bound on the rest, the product of the
query's norm and the norm of the row's components not yet seen. A row whose partial score plus bound falls below the k-th
largest partial score minus bound can not be a member any more. Processing stops only when at most ``RESCORED`` rows a query
are possible (that is the proof) or no segment is left; possible members are rescored exactly with 64-bit integers.

Queries meet all blocks in groups of bounded size, and each group returns k rows a query.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block, queries of a group, and queries scored at once.
BLOCK_ROWS, GROUP_QUERIES, AT_ONCE = 16384, 8192, 256
RESCORED = 64
#: Pairs rescored at once: equal vectors leave every row possible, and their copies side by side would fill the memory.
PAIRS = 1 << 16


def integer_vectors(table: DataFrame, scale: int, key: str, vector: str) -> DataFrame:
    """(id, v array<bigint>) of the rows whose vector and all its components are there and finite."""
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = table.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("x"))
    return rows.filter(F.col("x").isNotNull() & finite).select("id", F.transform("x", lambda c: F.floor(c * F.lit(float(scale)))).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows, shorter ones filled up with zeros, which add nothing to a product."""
    n = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy()
    out = np.zeros((len(column), width), dtype=np.int64)
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(n) - n, n)] = values
    return out


class Block:
    """Impact-ordered segments of some rows."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        size = np.abs(vectors.astype(np.float64))
        level = np.where(size > 0, np.floor(np.log2(np.maximum(size, 1))), -1).astype(int)
        self.segments = []
        square = size**2
        rest = square.sum(axis=1)
        for impact in sorted(set(np.unique(level).tolist()) - {-1}, reverse=True):
            row, dim = np.nonzero(level == impact)
            rest = np.maximum(rest - np.bincount(row, weights=square[row, dim], minlength=len(ids)), 0)
            self.segments.append((row, dim, vectors[row, dim].astype(np.float64), np.sqrt(rest) * (1 + 1e-9)))
        self.segments = self._joined()

    def _joined(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Segments of few postings go with the next one; the order of impacts stays."""
        out, least, held = [], self.vectors.size // 5, []
        for i, s in enumerate(self.segments):
            held.append(s)
            if sum(len(h[0]) for h in held) >= least or i == len(self.segments) - 1:
                out.append((*(np.concatenate([h[j] for h in held]) for j in range(3)), s[3]))
                held = []
        return out

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query place, row place, exact score) of a superset of each query's k best rows of this block."""
        n = len(self.ids)
        q = queries.astype(np.float64)
        norm = np.sqrt((q**2).sum(axis=1)) * (1 + 1e-9)
        score = np.zeros((len(q), n))
        own = query_ids[:, None] == self.ids[None, :]
        possible = ~own
        top = np.abs(self.vectors).max(initial=0).item() * np.abs(queries).max(initial=0).item() * max(1, queries.shape[1])
        slack = 0.0 if top < 1 << 53 else top * 1e-12
        for row, dim, value, rest in self.segments:
            dense = np.zeros((q.shape[1], n))
            dense[dim, row] = value
            score += q @ dense
            bound = norm[:, None] * rest[None, :] + slack
            if n > k:
                low = np.where(own, -np.inf, score - bound)
                least = np.partition(low, n - k, axis=1)[:, n - k]
                possible = ~own & (score + bound >= least[:, None])
                if possible.sum(axis=1).max(initial=0) <= max(RESCORED, 2 * k):
                    break
        at, row = np.nonzero(possible)
        exact = np.empty(len(at), dtype=np.int64)
        for low in range(0, len(at), PAIRS):
            i, j = at[low : low + PAIRS], row[low : low + PAIRS]
            if top < 1 << 62:
                exact[low : low + PAIRS] = np.einsum("ij,ij->i", queries[i], self.vectors[j])
            else:
                exact[low : low + PAIRS] = [sum(a * b for a, b in zip(queries[x].tolist(), self.vectors[y].tolist(), strict=True)) for x, y in zip(i, j, strict=True)]
        return at, row, exact


def _best(at: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best, by score from the top, then id."""
    order = np.lexsort((ids, -score, at))
    a = at[order]
    begin = np.searchsorted(a, a)
    return order[np.arange(len(a)) - begin < k]


def _search(queries: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    out = []
    if queries.num_rows and rows.num_rows:
        qs, rs = queries.combine_chunks(), rows.combine_chunks()
        qv, rv = qs.column("v").chunk(0), rs.column("v").chunk(0)
        width = int(max(np.diff(qv.offsets.to_numpy()).max(), np.diff(rv.offsets.to_numpy()).max(), 1))
        block = Block(rs.column("id").to_numpy(), _matrix(rv, width))
        ids, matrix = qs.column("id").to_numpy(), _matrix(qv, width)
        for low in range(0, len(ids), AT_ONCE):
            some = ids[low : low + AT_ONCE]
            at, row, score = block.search(some, matrix[low : low + AT_ONCE], k)
            best = _best(at, block.ids[row], score, k)
            out.append(pa.table({"query_id": some[at[best]], "vec_id": block.ids[row[best]], "score": score[best]}))
    return pa.concat_tables(out) if out else pa.table({c: pa.array([], pa.int64()) for c in ("query_id", "vec_id", "score")})


def top_k(table: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k rows of largest integer inner product, ties to the smaller id.

    All rows are candidates but those of the query's own id; fewer than k give all. Null vectors, and vectors with a null or
    non-finite component, take no part on either side; of vectors of unequal length the shorter counts as filled up with
    zeros. Rows without id take no part. A repeated row is as many candidates; a repeated query id is one query by its first
    vector (the least by order). Empty tables give no rows.
    """
    rows = integer_vectors(table, scale, key, vector).filter("id is not null")
    asked = integer_vectors(queries, scale, key, vector).filter("id is not null").groupBy("id").agg(F.min("v").alias("v"))
    blocks = max(1, math.ceil(rows.count() / BLOCK_ROWS))
    groups = max(1, math.ceil(asked.count() / GROUP_QUERIES))
    lot = F.pmod(F.xxhash64("id"), F.lit(groups).cast("bigint"))
    copies = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    by_block = asked.select("id", "v", lot.alias("g"), copies(blocks).alias("b"))
    by_group = rows.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(blocks).cast("bigint")).alias("b"), copies(groups).alias("g"))
    found = by_block.groupBy("g", "b").cogroup(by_group.groupBy("g", "b")).applyInArrow(lambda q, r: _search(q, r, k), "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
