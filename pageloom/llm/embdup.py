"""Embedding near-duplicates over an inverted multi-index.

Vectors, scaled to length one, are cut into halves; each half has a codebook, and the two nearest centroids name a cell of the
product grid. A vector looks for partners in the cells that a multi-sequence traversal reaches first: pairs of centroids by
growing sum of their squared distances to its halves, taken from a heap. How many cells that takes is measured on a
sample: as many as find ``RECALL`` of partners placed exactly at the threshold from sampled vectors. Partners met are
verified in double precision. Cells belong to a label, since only equal labels are compared.

Equal vectors form a class first and go on as one. Cells that hold many vectors are cut into blocks, and pairs are only
ever counted inside a pair of blocks: what leaves a task is each vector's number of links and a spanning forest of them.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import by_rows, materialize
from pageloom.llm.components import components, stars

#: Rows that codebooks and the number of cells are fitted on, at most (taken by a hash of the id).
SAMPLE = 8192
#: Share of partners at the threshold that the index must find; they are the hardest ones.
RECALL = 0.995
#: Vectors of a grid column, about: codebooks grow with the square root of the table.
PER_ENTRY = 2048
#: Vectors of one block of a cell, and rows multiplied at once.
BLOCK, AT_ONCE = 4096, 512


class MultiIndex:
    """Two codebooks and the number of cells a search visits."""

    def __init__(self, sample: np.ndarray, size: int, threshold: float, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.width = sample.shape[1]
        self.cut = self.width // 2
        self.size = size
        self.books = [_centroids(h, size, rng) for h in (sample[:, : self.cut], sample[:, self.cut :])]
        self.visits = self._calibrated(sample, threshold, rng)

    def distances(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        halves = (unit[:, : self.cut], unit[:, self.cut :])
        return tuple((h**2).sum(axis=1)[:, None] - 2 * h @ b.T + (b**2).sum(axis=1) for h, b in zip(halves, self.books, strict=True))

    def nearest(self, unit: np.ndarray, count: int) -> np.ndarray:
        """The first ``count`` cells of each vector's traversal; the first is its own."""
        d1, d2 = self.distances(unit)
        o1, o2 = np.argsort(d1, axis=1, kind="stable"), np.argsort(d2, axis=1, kind="stable")
        s1, s2 = np.take_along_axis(d1, o1, axis=1), np.take_along_axis(d2, o2, axis=1)
        count = min(count, self.size**2)
        out = np.empty((len(unit), count), dtype=np.int32)
        for r, (a, b, x, y) in enumerate(zip(s1.tolist(), s2.tolist(), o1.tolist(), o2.tolist(), strict=True)):
            heap, n = [(a[0] + b[0], 0, 0)], 0
            while n < count:
                _, i, j = heapq.heappop(heap)
                out[r, n] = x[i] * self.size + y[j]
                n += 1
                if j + 1 < self.size:
                    heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
                if j == 0 and i + 1 < self.size:
                    heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
        return out

    def _calibrated(self, sample: np.ndarray, threshold: float, rng: np.random.Generator) -> int:
        """Cells after which ``RECALL`` of the partners at the threshold are found from one side or the other."""
        some = sample[:1024]
        noise = rng.standard_normal(some.shape)
        noise -= (noise * some).sum(axis=1)[:, None] * some
        length = np.sqrt((noise**2).sum(axis=1))[:, None]
        other = threshold * some + math.sqrt(max(0.0, 1 - threshold**2)) * noise / np.where(length > 0, length, 1)
        if not len(some):
            return 1
        # The traversals go on, four times as far each time, until enough partners are met; the rest need not be followed.
        every, wanted = self.size**2, max(1, math.ceil(RECALL * len(some)))
        count = min(64, every)
        while True:
            a, b = self.nearest(some, count), self.nearest(other, count)
            places = [np.where((x == y[:, :1]).any(axis=1), np.argmax(x == y[:, :1], axis=1), every) for x, y in ((a, b), (b, a))]
            met = np.sort(np.minimum(*places))
            if met[wanted - 1] < every or count == every:
                return int(min(met[wanted - 1], every - 1)) + 1
            count = min(4 * count, every)


def _centroids(x: np.ndarray, size: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """k-means from random rows; a centroid that loses all its rows stays where it is."""
    at = x[rng.choice(len(x), min(size, len(x)), replace=False)] if len(x) else np.zeros((1, x.shape[1]))
    at = np.concatenate([at, np.repeat(at[:1], size - len(at), axis=0)]) if len(at) < size else at
    for _ in range(rounds if len(x) else 0):
        near = np.argmin((at**2).sum(axis=1) - 2 * x @ at.T, axis=1)
        n = np.bincount(near, minlength=size)
        total = np.zeros_like(at)
        np.add.at(total, near, x)
        at = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], at)
    return at


def _rows(column: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows (cut or filled up with zeros to ``width``), and their true lengths."""
    n = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    wide = int(n.max(initial=1))
    out = np.zeros((len(n), wide))
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(n) - n, n)] = values
    if width is not None:
        out = out[:, :width] if wide >= width else np.pad(out, ((0, 0), (0, width - wide)))
    return out, n


def _unit(x: np.ndarray) -> np.ndarray:
    """Scaled to length one, by the largest component first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, initial=1e-300)[:, None]
    return x / np.maximum(np.sqrt((x**2).sum(axis=1)), 1e-300)[:, None]


def _linked(seekers: pa.Table, held: pa.Table, threshold: float) -> pa.Table:
    """Per vector with links in this pair of blocks: id, links found here (copies counted), least id it is tied to."""
    a, b = seekers.combine_chunks(), held.combine_chunks()
    av, an = _rows(a.column("v").chunk(0))
    bv, bn = _rows(b.column("v").chunk(0))
    width = max(av.shape[1], bv.shape[1])
    au, bu = (_unit(np.pad(x, ((0, 0), (0, width - x.shape[1])))) for x in (av, bv))
    ai, bi, ac, bc = (t.column(c).to_numpy() for t, c in ((a, "id"), (b, "id"), (a, "copies"), (b, "copies")))
    b_probes = np.stack(b.column("probes").to_numpy())
    a_cell = a.column("own").to_numpy()
    left, right = [], []
    for low in range(0, len(ai), AT_ONCE):
        close = au[low : low + AT_ONCE] @ bu.T >= threshold
        close &= (an[low : low + AT_ONCE, None] == bn[None, :]) & (ai[low : low + AT_ONCE, None] != bi[None, :])
        x, y = np.nonzero(close)
        x += low
        # a pair that is met from both sides counts where the smaller id seeks
        once = (ai[x] < bi[y]) | ~(b_probes[y] == a_cell[x][:, None]).any(axis=1)
        left.append(x[once])
        right.append(y[once])
    x, y = np.concatenate(left), np.concatenate(right)
    ids = np.concatenate([ai[x], bi[y]])
    if not len(ids):
        return pa.table({"id": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "tied": pa.array([], pa.int64())})
    found, at = np.unique(ids, return_inverse=True)
    links = np.bincount(at, weights=np.concatenate([bc[y], ac[x]])).astype(np.int64)
    child, root = stars(ai[x], bi[y])
    tied = found.copy()
    tied[np.searchsorted(found, child)] = root
    return pa.table({"id": found, "links": links, "tied": tied})


def embedding_duplicates(table: DataFrame, threshold: float = 0.93, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """Per row: id (named as ``key``), n_links, component_id, kept.

    Vectors of one label, not null, are linked if their cosine is ``threshold`` or more; ``n_links`` counts the other rows
    linked directly, ``component_id`` is the least id reachable, itself included, ``kept`` tells whether it is the row's own.
    Null, empty and zero vectors, those with null or non-finite components, and rows without label link with nothing.
    Vectors of unequal length are not compared. A repeated row is another row with an equal vector. A row without id takes
    no part, has a null component and is kept. Empty tables give no rows.
    """
    x = F.col("v")
    usable = F.col("label").isNotNull() & F.col("id").isNotNull() & x.isNotNull() & F.exists("v", lambda c: c != 0)
    usable &= F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = table.select(F.col(key).cast("bigint").alias("id"), F.col(label).alias("label"), F.col(vector).alias("v"))
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    classes = materialize(rows.filter("usable").groupBy("label", "v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")))

    total = classes.count()
    sample = classes.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow().combine_chunks()
    points, lengths = _rows(sample.column("v").chunk(0)) if total else (np.ones((1, 2)), np.array([2]))
    usual = int(np.bincount(lengths).argmax())
    points = _unit(np.pad(points, ((0, 0), (0, max(0, usual - points.shape[1]))))[:, :usual])
    size = max(1, round(math.sqrt(total / PER_ENTRY)))
    index = MultiIndex(points, size, threshold)

    def cells(batch: pa.RecordBatch) -> dict:
        values, _ = _rows(batch.column("v"), usual)
        probes = index.nearest(_unit(values), index.visits)
        ends = np.arange(len(probes) + 1, dtype=np.int32) * probes.shape[1]
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(probes.reshape(-1)))
        return {"id": batch.column("id"), "probes": lists, "own": probes[:, 0].astype(np.int32)}

    probed = materialize(by_rows(classes.select("id", "v"), cells, "id bigint, probes array<int>, own int").join(classes, "id"))
    seek = probed.select("label", F.explode("probes").alias("cell"), "id", "own", "copies", "v")
    hold = probed.select("label", F.col("own").alias("cell"), "id", "copies", "v", "probes")
    blocks = lambda df, name: df.groupBy("label", "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("bigint").alias(name))
    grid = blocks(seek, "rows_of").join(blocks(hold, "columns_of"), ["label", "cell"])
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    lot = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    seek = seek.join(grid, ["label", "cell"]).withColumn("i", lot("rows_of")).withColumn("k", F.explode(F.sequence(zero, F.col("columns_of") - one)))
    hold = hold.join(grid, ["label", "cell"]).withColumn("k", lot("columns_of")).withColumn("i", F.explode(F.sequence(zero, F.col("rows_of") - one)))
    by = ["label", "cell", "i", "k"]
    # new names for what both sides have in common, so that the two can be told apart
    seek = seek.select(*by, "id", "own", "copies", "v")
    hold = hold.select(*[F.col(c).alias(f"{c}_held") for c in (*by, "id", "copies", "v")], "probes")

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        b = b.rename_columns([c.removesuffix("_held") for c in b.column_names])
        return _linked(a, b, threshold) if a.num_rows and b.num_rows else _NONE

    found = materialize(seek.groupBy(*by).cogroup(hold.groupBy(*[f"{c}_held" for c in by])).applyInArrow(meet, "id bigint, links bigint, tied bigint"))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    groups = components(found.select("id", "tied")).withColumnRenamed("node", "id")
    known = classes.join(links, "id", "left").join(groups, "id", "left").select(
        "label", "v", F.lit(True).alias("usable"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
    )
    out = rows.join(known, ["label", "v", "usable"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )


_NONE = pa.table({c: pa.array([], pa.int64()) for c in ("id", "links", "tied")})
