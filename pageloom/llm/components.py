"""Connected components of a link table, without any node's neighbours in one task.

Union-find runs first inside each record batch of the links, which leaves a forest of stars per batch. Rounds of two joins
follow until the table itself is a forest of stars: the large-star step ties a node's larger neighbours to its least one, the
small-star step its smaller ones. Both need a node's least neighbour only, which Spark combines before the shuffle, and a
join on the node, whose skewed partitions Spark splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import materialize

MAX_ROUNDS = 64


class UnionFind:
    """Sets over integers 0..n-1; the least member stands for its set."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def union(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.parent[max(x, y)] = min(x, y)
        return True


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its set) for all nodes of the links a-b but the least ones themselves."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    sets = UnionFind(len(nodes))
    for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True):
        sets.union(x, y)
    root = np.fromiter((sets.find(i) for i in range(len(nodes))), np.int64, len(nodes))
    child = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[child], nodes[root[child]]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        child, root = stars(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(child, pa.int64()), pa.array(root, pa.int64())], ["node", "component"])


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("node").agg(F.min("component").alias("least"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("component").alias("node"), F.col("node").alias("component")))
    least = _least(both).select("node", F.least("node", "least").alias("least"))
    return both.filter("component > node").join(least, "node").select(F.col("component").alias("node"), F.col("least").alias("component")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = _least(edges)
    moved = edges.join(least, "node").filter("component <> least").select(F.col("component").alias("node"), F.col("least").alias("component"))
    return least.select("node", F.col("least").alias("component")).unionByName(moved).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component): every node of the two-column link table and the least node it is connected with.

    Links to oneself, repeated links and links with a null end add nothing; an empty table gives no rows.
    """
    a, b = links.columns[:2]
    links = links.select(F.col(a).cast("bigint").alias("a"), F.col(b).cast("bigint").alias("b")).filter("a <> b")
    edges = materialize(links.mapInArrow(_local, "node bigint, component bigint").distinct())
    for _ in range(MAX_ROUNDS):
        marks = edges.select("node", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
            edges.select(F.col("component").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
        )
        unsettled = marks.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or (up = 1 and down = 1)")
        if unsettled.isEmpty():
            break
        edges = materialize(_small_star(_large_star(edges)))
    else:
        raise RuntimeError("components did not settle")
    return edges.unionByName(edges.select(F.col("component").alias("node"), "component").distinct())
