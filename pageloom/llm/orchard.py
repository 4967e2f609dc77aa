"""Centroid clustering of whole-number vectors with Orchard's nearest-centroid search.

Each centroid has a list of the others sorted by distance. A vector's search walks the list of the nearest centroid known so
far; a closer one (or an equally close one of smaller number) makes it jump to that one's list; a centroid seen before is
skipped by a mark; the walk ends at the first entry strictly farther than twice the current distance, since by the triangle
inequality nothing from there on can be as close. All vectors of a batch walk together, one list entry a step.

A round is one pass: tasks return sums and counts per cluster, Spark adds them up, and the driver holds the ``k`` centroids
only. All arithmetic is on whole numbers. Batches whose squared distances fit 64 bits are worked in such integers, others in
Python's. Only vectors of exactly ``dim`` components, none null or non-finite, take part; rows without an id take part, but
start no centroid. Repeated rows count as often as they stand. Fewer than ``k`` vectors make fewer centroids, an empty table
gives no rows. Distances beyond 64 bits are returned as null.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import bounded_batches, materialize

_LONG = (1 << 63) - 1
#: Sums travel in parts of this many bits, so that no size of component passes what Spark adds up exactly.
PART_BITS = 48


def small(dim: int) -> int:
    """Components below this make squared distances that fit 64 bits."""
    return math.isqrt(_LONG // (4 * max(dim, 1)))


def parts_of(x: int) -> list[int]:
    """A number as signed parts of ``PART_BITS`` bits, lowest first."""
    sign, x, out = (-1 if x < 0 else 1), abs(x), []
    while x:
        out.append(sign * (x & (1 << PART_BITS) - 1))
        x >>= PART_BITS
    return out or [0]


def whole_vectors(column: pa.Array, dim: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that take part, and floor(scale * x) of their components (int64, or Python ints where a value is large)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sizes == dim)
    flat = column.take(pa.array(rows)).flatten()
    good = flat.is_valid().to_numpy(zero_copy_only=False)
    x = flat.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
    fine = (good & np.isfinite(x)).reshape(-1, dim).all(axis=1)
    with np.errstate(over="ignore"):
        scaled = np.floor(scale * x.reshape(-1, dim)[fine])
    if not len(scaled) or np.abs(scaled).max() < small(dim):
        return rows[fine], scaled.astype(np.int64)
    exact = np.empty(scaled.shape, dtype=object)
    for at, value in np.ndenumerate(x.reshape(-1, dim)[fine]):
        top, bottom = float(value).as_integer_ratio()
        exact[at] = scale * top // bottom
    return rows[fine], exact


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distance of each row of ``a`` to the same row of ``b``."""
    d = a - b
    return (d * d).sum(axis=1)


class Orchard:
    """Centroids (rows of whole numbers) with each one's neighbours in order of distance, nearest first."""

    def __init__(self, centroids: list[list[int]]) -> None:
        exact = np.array(centroids, dtype=object).reshape(len(centroids), -1)
        fits = all(abs(x) < small(len(row)) for row in centroids for x in row)
        self.points = exact.astype(np.int64) if fits else exact
        k = len(centroids)
        self.apart = np.array([[sum((x - y) ** 2 for x, y in zip(a, b, strict=True)) for b in centroids] for a in centroids], dtype=object)
        self.order = np.array([sorted((j for j in range(k) if j != i), key=lambda j, i=i: (self.apart[i][j], j)) for i in range(k)], dtype=np.int64).reshape(k, k - 1)
        if fits:
            self.apart = self.apart.astype(np.int64)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of each vector's nearest centroid, the smaller number among equals."""
        n, k = len(vectors), len(self.points)
        wide = vectors.dtype == object or self.points.dtype == object
        points, apart = (self.points.astype(object), self.apart.astype(object)) if wide else (self.points, self.apart)
        best = np.zeros(n, dtype=np.int64)
        far = squared(vectors.astype(object) if wide else vectors, points[best]) if n else np.zeros(0, np.int64)
        seen = np.zeros((n, k), dtype=bool)
        seen[:, 0] = True
        place = np.zeros(n, dtype=np.int64)
        walking = np.arange(n) if k > 1 else np.arange(0)
        while len(walking):
            at = best[walking]
            other = self.order[at, place[walking]]
            # Halving rather than doubling keeps the test inside 64 bits: apart > 4 * far.
            go = ((apart[at, other] + 3) // 4 <= far[walking]).astype(bool)
            walking, other = walking[go], other[go]
            place[walking] += 1
            new = ~seen[walking, other]
            tried, met = walking[new], other[new]
            seen[tried, met] = True
            found = squared(vectors[tried], points[met]) if len(tried) else far[:0]
            closer = ((found < far[tried]) | ((found == far[tried]) & (met < best[tried]))).astype(bool)
            moved = tried[closer]
            best[moved], far[moved], place[moved] = met[closer], found[closer], 0
            walking = walking[place[walking] < k - 1]
        return best, far


def _first_centroids(vectors: DataFrame, k: int, dim: int, scale: int, id_col: str, vec_col: str) -> list[list[int]]:
    """The ``k`` vectors whose id has the smallest hash; each batch hands over ``k`` candidates at most."""
    text = lambda c: F.concat(F.lit("1:"), F.col(c).cast("string"))
    hashed = vectors.filter(F.col(id_col).isNotNull()).select(F.sha2(text(id_col), 256).alias("h"), F.col(vec_col).alias("v"))

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, whole = whole_vectors(batch.column("v"), dim, scale)
            keys = batch.column("h").take(pa.array(rows)).to_pylist()
            # Among rows of one id the text of the vector decides, so that any order of rows gives one result.
            made = sorted((h, [str(x) for x in v]) for h, v in zip(keys, whole.tolist(), strict=True))[:k]
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in made], pa.string()), pa.array([v for _, v in made], pa.list_(pa.string()))], names=["h", "v"])

    found = hashed.mapInArrow(least, "h string, v array<string>").orderBy("h", "v").limit(k).collect()
    return [[int(x) for x in r.v] for r in found]


def _moved(vectors: DataFrame, centroids: list[list[int]], dim: int, scale: int, vec_col: str) -> list[list[int]]:
    """Means of the clusters, rounded down; a cluster without vectors keeps its centroid."""
    k = len(centroids)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Orchard(centroids)
        count, total = [0] * k, [[0] * dim for _ in range(k)]
        for batch in batches:
            _, whole = whole_vectors(batch.column(0), dim, scale)
            best, _ = search.nearest(whole)
            for c in np.unique(best).tolist():
                mine = whole[best == c]
                count[c] += len(mine)
                total[c] = [a + int(b) for a, b in zip(total[c], mine.sum(axis=0), strict=True)]
        used = [c for c in range(k) if count[c]]
        yield pa.RecordBatch.from_pydict(
            {"c": pa.array(used, pa.int32()), "n": pa.array([count[c] for c in used], pa.int64()),
             "v": pa.array([[parts_of(x) for x in total[c]] for c in used], pa.list_(pa.list_(pa.int64())))})

    made = vectors.select(vec_col).mapInArrow(sums, "c int, n bigint, v array<array<bigint>>")
    added = (
        made.select("c", "n", F.posexplode("v").alias("at", "parts")).select("c", "n", "at", F.posexplode("parts").alias("part", "x"))
        .groupBy("c", "at", "part").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    ).collect()
    total: dict[tuple[int, int], int] = {}
    count = [0] * k
    for r in added:
        total[r.c, r["at"]] = total.get((r.c, r["at"]), 0) + (int(r.x) << PART_BITS * r.part)
        count[r.c] = max(count[r.c], r.n)
    return [[total[c, i] // count[c] for i in range(dim)] if count[c] else list(centroids[c]) for c in range(k)]


def orchard_clusters(
    vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """One row per vector that takes part: ``vec_id``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia``, ``centroid_sha256``.

    ``vectors`` is read once for the start, once per round and once for the result, which is written to the checkpoint
    folder (20 bytes a row) before the sums over clusters are joined to it: ``k`` rows, so their broadcast is bounded.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    vectors = vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("vec_id"), F.col(f"`{vec_col}`").alias("vector"))
    schema = "vec_id bigint, cluster int, distance bigint"
    out = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    centroids = _first_centroids(vectors, k, dim, scale, "vec_id", "vector")
    if not centroids:
        return spark.createDataFrame([], out)
    for _ in range(rounds):
        centroids = _moved(vectors, centroids, dim, scale, "vector")
    final = centroids

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Orchard(final)
        for batch in batches:
            rows, whole = whole_vectors(batch.column("vector"), dim, scale)
            best, far = search.nearest(whole)
            yield pa.RecordBatch.from_pydict(
                {"vec_id": batch.column("vec_id").take(pa.array(rows)), "cluster": pa.array(best, pa.int32()),
                 "distance": pa.array([None if d > _LONG else d for d in far.tolist()], pa.int64())})

    assigned = materialize(vectors.mapInArrow(assign, schema))
    # A distance that is null is beyond 64 bits, and so is every sum with it.
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"), F.count_if(F.col("distance").isNull()).alias("lost")).collect()
    each = {r.cluster: None if r.lost else int(r.s) for r in sums}
    whole = None if None in each.values() else sum(each.values())
    long = lambda x: x if x is not None and x <= _LONG else None
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in final]
    told = spark.createDataFrame(
        [(c, long(s), long(whole), digest[c]) for c, s in each.items()],
        "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return assigned.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
