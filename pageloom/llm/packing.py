"""Mixture-controlled packing of documents into sequences of fixed length.

Every source is a queue of its documents' ids, served in quanta of ``QUANTUM`` tokens. A window is a run of ``WINDOW_SEQUENCES``
sequences; deficit round-robin gives each queue in turn its target share of a window's quanta, and what is less than a quantum stays as
the queue's deficit for the next window. Since documents may be cut anywhere, the state of that round-robin after w windows of W
quanta has a closed form: with running target shares P(s), queue s has been served floor(w W P(s)) - floor(w W P(s-1)) quanta. So
nothing has to run through one place: a document's tokens have fixed places as soon as the tokens before it in its queue are
counted, and deficits carry over windows and partitions alike. When a queue runs dry, one window is filled by what is left of
it, the rest of the queues share the remainder, and a new phase begins with the queues that remain. All sequences but the
very last are full.

What a source has beyond its last whole quantum, and sources of less than a quantum altogether, follow each other in one more
queue, document by document, which is cut into quanta as well; the few tokens beyond its last whole quantum end the stream.

A source with less than a quantum per window saves its deficit up over several. All of them share one queue, in which their quanta are
interleaved by a binary tree over these sources: of the first j quanta of a tree node floor(j L/N) are of its left half, where L of
its N quanta are. So quantum t of a source has a fixed place in that queue too, found from the leaf up, and any stretch of the queue
has each source's share to within a quantum per level. Only sources with a quantum per window or more are known to the driver, no more
than a window has quanta; the tree is a table.

With the default targets, the sources' own shares, every window holds the corpus mixture to within a quantum or two per queue. Other
``weights`` hold as long as the queues last.

Ids are kept with 2 bytes each in an intermediate table between counting and placing, so texts are encoded once.
"""

from __future__ import annotations

import uuid
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.bpe import pieces
from pageloom.llm.common import by_rows, give_back, materialize
from pageloom.llm.words import chunks
from pageloom.operators.skew import assign_ids
from pageloom.session import ensure_checkpoint_dir

LENGTH = 1024
WINDOW_SEQUENCES = 64
#: Tokens served to a queue at a time.
QUANTUM = 512
#: Parts in which the remainders of all sources are summed up.
PARTS = 4096
#: Pieces kept with their ids by a Python worker before those not met since are let go; twice as many at most.
REMEMBERED = 250_000


class Pieces(dict):
    """Piece of text -> ids as little-endian bytes; pieces not met before are merged by the library's model.

    The vocabulary is byte-level: a piece enters the model with each byte as one character (printable ones as themselves).

    A worker keeps the table from task to task. When it is full it becomes the older half, and pieces met again move on from
    there: frequent pieces stay, rare ones go.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.model = self.library.model
        self.kind = "<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4"
        self.end = np.zeros(1, self.kind).tobytes()
        self.older: dict[str, bytes] = {}
        shown = [b for b in range(256) if 33 <= b <= 126 or b >= 161 and b != 173]
        hidden = [b for b in range(256) if b not in shown]
        self.letters = {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}

    def merged(self, piece: str) -> bytes:
        found = self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))
        return array("H" if self.kind == "<u2" else "I", [t.id for t in found]).tobytes()

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.merged(piece)
        self[piece] = ids
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, each with id 0 behind."""
        if len(self) > REMEMBERED:
            self.older = dict(self)
            self.clear()
        return [b"".join(map(self.__getitem__, pieces(t))) + self.end for t in texts]


@lru_cache(maxsize=2)
def piece_table(path: str) -> Pieces:
    return Pieces(path)


def _encoded(docs: DataFrame, path: str, keep_pieces: bool) -> DataFrame:
    """Ids of every text, with the tokens of its source that precede it in the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, part = piece_table(path), TaskContext.get().partitionId()
        width = np.dtype(table.kind).itemsize
        before: dict[str, int] = {}
        for batch in batches:
            for some in chunks(batch, "text"):
                ids = table.encode([t or "" for t in some.column("text").to_pylist()])
                start = []
                for s, x in zip(some.column("source").to_pylist(), ids, strict=True):
                    start.append(before.get(s, 0))
                    before[s] = start[-1] + len(x) // width
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id"), some.column("source"), pa.array(np.full(len(ids), part)), pa.array(start, pa.int64()),
                     pa.array([len(x) // width for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                    ["doc_id", "source", "part", "start", "n", "ids"],
                )
        if not keep_pieces:
            table.clear()
            table.older.clear()
        give_back()

    return docs.mapInArrow(run, "doc_id bigint, source string, part bigint, start bigint, n bigint, ids binary")


class Schedule:
    """Places of queues' units (quanta): phases of windows with fixed shares, and single windows in which a queue ends."""

    def __init__(self, totals: list[int], window: int, weights: list[int] | None = None):
        self.window = window
        left = list(totals)
        weights = list(weights or totals)
        self.first: list[int] = []  # first window of each phase
        self.served: list[list[int]] = [[] for _ in totals]  # by queue: units served before each phase
        self.shares: list[tuple[list[int], int] | None] = []  # running weights and their sum
        self.quotas: list[list[int] | None] = []  # of a single window
        self.total = sum(totals)
        w = 0
        while any(left):
            floor = -(-sum(x for x, n in zip(weights, left, strict=True) if n) // window)
            now = [max(x, floor) if n else 0 for x, n in zip(weights, left, strict=True)]
            running = [0]
            for x in now:
                running.append(running[-1] + x)
            every = running[-1]
            windows = min((n - 1) * every // (window * x) for x, n in zip(now, left, strict=True) if n)
            self.first.append(w)
            for s, n in enumerate(left):
                self.served[s].append(totals[s] - n)
            if windows > 0:
                self.shares.append((running, every))
                self.quotas.append(None)
                used = [self._by_share(running, every, s, windows) for s in range(len(left))]
            else:
                windows = 1
                used = [min(n, self._by_share(running, every, s, 1)) for s, n in enumerate(left)]
                room = min(window, sum(left)) - sum(used)
                for s, n in enumerate(left):
                    more = min(room, n - used[s])
                    used[s] += more
                    room -= more
                before = [0]
                for n in used:
                    before.append(before[-1] + n)
                self.shares.append(None)
                self.quotas.append(before)
            left = [n - u for n, u in zip(left, used, strict=True)]
            w += windows

    def _by_share(self, running: list[int], every: int, s: int, windows: int) -> int:
        """Units of queue s in the first windows of a phase."""
        n = windows * self.window
        return n * running[s + 1] // every - n * running[s] // every

    def place(self, s: int, t: int) -> tuple[int, int]:
        """Place of unit t of queue s, and how many of its units follow without a break."""
        k = bisect_right(self.served[s], t) - 1
        t -= self.served[s][k]
        base = self.first[k] * self.window
        if self.quotas[k] is not None:
            before = self.quotas[k]
            return base + before[s] + t, before[s + 1] - before[s] - t
        running, every = self.shares[k]
        w = t * every // ((running[s + 1] - running[s]) * self.window)
        while self._by_share(running, every, s, w) > t:
            w -= 1
        while (stop := self._by_share(running, every, s, w + 1)) <= t:
            w += 1
        ahead = (w + 1) * self.window * running[s] // every - w * self.window * running[s] // every
        return base + w * self.window + ahead + t - self._by_share(running, every, s, w), stop - t


def climb(leaf: int, totals: list[int], t: int) -> int:
    """Place of unit t of a leaf among the units of the root; ``totals`` has the units of each node on the way up."""
    for level, (n, every) in enumerate(zip(totals, totals[1:])):  # noqa: B905
        if n != every:
            t = t * every // n if leaf >> level & 1 else -(-(t + 1) * every // n) - 1
    return t


def _tree(small: DataFrame, sources: int) -> DataFrame:
    """(s, leaf, path): the sources' leaves, and the units of the nodes from leaf to root, of (source, n)."""
    key = F.concat(F.when(F.col("source").isNull(), "-").otherwise("+"), F.coalesce("source", F.lit("")))
    leaves = materialize(assign_ids(small.withColumn("k", key), "k").select(F.col("source").alias("s"), "n", (F.col("id") - 1).cast("bigint").alias("leaf")))
    steps = leaves.select("leaf", "n", F.explode(F.sequence(F.lit(0), F.lit((sources - 1).bit_length()))).alias("level")).withColumn(
        "node", F.expr("shiftright(leaf, level)"))
    nodes = steps.groupBy("level", "node").agg(F.sum("n").alias("every"))
    paths = steps.join(nodes, ["level", "node"]).groupBy("leaf").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("level", "every"))), lambda x: x["every"]).alias("path"))
    return leaves.join(paths, "leaf").select("s", "leaf", "path")


def _with_rest_start(sources: DataFrame) -> DataFrame:
    """Sources with the sum of ``rest`` over the sources before them, in an order of their hash."""
    dealt = sources.withColumn("deal", F.pmod(F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull()), F.lit(PARTS)))
    inside = Window.partitionBy("deal").orderBy("source")
    deals = dealt.groupBy("deal").agg(F.sum("rest").alias("all"))
    # One row per part.
    before = deals.withColumn("before", F.sum("all").over(Window.orderBy("deal")) - F.col("all")).drop("all")
    summed = dealt.withColumn("rest_start", F.sum("rest").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("rest"))
    return summed.join(before, "deal").withColumn("rest_start", F.col("rest_start") + F.col("before")).drop("deal", "before")


_PIECES = "doc_id bigint, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, path: str, weights: dict[str, int] | None = None, key: str = "doc_id", text: str = "text", source: str = "source", keep_pieces: bool = True) -> DataFrame:
    """One row per piece: doc_id, source, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and id 0; pieces of a document cover it without overlap, and pieces of a sequence fill it from
    offset 0 without a gap. A null text is empty (one token); rows without id or source are packed too, those without
    source as a source of their own; repeated rows are packed as often as they occur; other columns are ignored. Without ``keep_pieces``
    Python workers forget the pieces they know at the end of a partition, which leaves their memory to what runs next.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"), F.col(source).cast("string").alias("source"))
    at = f"{ensure_checkpoint_dir(spark)}/pageloom-{uuid.uuid4().hex}"
    _encoded(rows, path, keep_pieces).write.option("compression", "zstd").parquet(at)
    ids = spark.read.parquet(at)
    kind = piece_table(path).kind

    window = LENGTH * WINDOW_SEQUENCES // QUANTUM
    by_part = ids.groupBy("part", "source").agg(F.sum("n").alias("n"))
    whole = F.floor(F.col("n") / QUANTUM)
    sources = _with_rest_start(by_part.groupBy("source").agg(F.sum("n").alias("n")).withColumn("whole", whole).withColumn("rest", F.col("n") % QUANTUM))
    sources = materialize(sources)
    every, rest, some, count = sources.agg(F.sum("whole"), F.sum("rest"), F.count_if(F.col("whole") > 0), F.count("*")).head()
    every, rest = every or 0, rest or 0
    rest_quanta = rest // QUANTUM
    quanta = every + rest_quanta
    # Sources of a quantum per window or more: no more than a window has quanta.
    enough = F.col("whole") >= max(1, -(-quanta // window))
    if weights:
        enough |= F.coalesce(F.col("source").isin(list(weights)), F.lit(False))
    named = [(r.source, r.whole) for r in sources.filter(enough & (F.col("whole") > 0)).orderBy(F.desc("whole"), "source").collect()]
    few, pool = some - len(named), every - sum(n for _, n in named)
    sizes = [n for _, n in named]
    shares = [int(weights.get(s, 1)) for s, _ in named] if weights else None
    rest_queue = len(sizes)
    if rest_quanta:
        sizes.append(rest_quanta)
        if weights:
            shares.append(max(1, count - some))
    mixed = 0  # quanta of the first queue, if the tree's are interleaved with them
    pooled = 0
    if pool and (pool >= -(-quanta // window) or not sizes):
        pooled = len(sizes)
        sizes.append(pool)
        if weights:
            shares.append(few)
    elif pool:  # too little for a queue of its own
        mixed = sizes[0]
        sizes[0] += pool
    schedule = Schedule(sizes, window, shares)

    queues = spark.createDataFrame([(s, i) for i, (s, _) in enumerate(named)], "s string, queue bigint")
    own = queues.select("s", "queue", F.lit(None).cast("array<bigint>").alias("path"))
    if few:
        small = sources.filter("whole > 0").join(queues, F.col("source").eqNullSafe(F.col("s")), "left_anti").select("source", F.col("whole").alias("n"))
        own = own.unionByName(_tree(small, few).select("s", (-1 - F.col("leaf")).alias("queue"), "path"))
    own = own.withColumnRenamed("s", "_s")
    known = sources.join(own, F.col("source").eqNullSafe(F.col("_s")), "left").select(F.col("source").alias("s"), "whole", "rest_start", "queue", "path")
    earlier = Window.partitionBy("source").orderBy("part")
    bases = by_part.withColumn("base", F.sum("n").over(earlier) - F.col("n")).drop("n")
    offsets = bases.join(known, F.col("source").eqNullSafe(F.col("s"))).select(F.col("part").alias("p"), "s", "base", "whole", "rest_start", "queue", "path")
    # Written, so that Spark knows its size and need not shuffle the ids to join it while it is small.
    offsets = materialize(offsets)

    def place(queue: int, path: list[int] | None, t: int) -> int:
        """Place of a quantum among all."""
        if path is not None:
            at = climb(-1 - queue, path, t)
            if mixed:
                at = climb(1, [pool, mixed + pool], at)
            return schedule.place(pooled, at)[0]
        if queue == 0 and mixed:
            t = climb(0, [mixed, mixed + pool], t)
        return schedule.place(queue, t)[0]

    def stretches(queue: int | None, path: list[int] | None, whole: int, rest_start: int, at: int, n: int) -> Iterator[list[int]]:
        """[place, length] of the stretches in which n tokens of a source lie, from its token ``at`` on."""
        end = at + n
        while at < end:
            if at < whole * QUANTUM:
                where, inside = place(queue, path, at // QUANTUM), at % QUANTUM
                room = QUANTUM - inside
            else:
                t = rest_start + at - whole * QUANTUM
                if t < rest_quanta * QUANTUM:
                    where, inside = place(rest_queue, None, t // QUANTUM), t % QUANTUM
                    room = min(QUANTUM - inside, end - at)
                else:
                    where, inside, room = quanta, t - rest_quanta * QUANTUM, end - at
            length = min(room, end - at)
            yield [where * QUANTUM + inside, length]
            at += length

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {c.split()[0]: [] for c in _PIECES.split(", ")}
        columns = (batch.column(c).to_pylist() for c in ("doc_id", "source", "queue", "path", "whole", "rest_start", "at", "n", "ids"))
        for doc, src, queue, path, whole, rest_start, at, n, raw in zip(*columns, strict=True):
            wide = memoryview(np.frombuffer(raw, kind).astype("<u4").tobytes())
            joined: list[list[int]] = []
            for to, length in stretches(queue, path, whole, rest_start, at, n):
                if joined and sum(joined[-1]) == to:
                    joined[-1][1] += length
                else:
                    joined.append([to, length])
            t = 0
            for to, length in joined:
                while length:
                    now = min(length, LENGTH - to % LENGTH)
                    made = (doc, src, t, now, zlib.crc32(wide[4 * t : 4 * (t + now)]), n, to // LENGTH, to % LENGTH)
                    for c, v in zip(out, made, strict=True):
                        out[c].append(v)
                    t, to, length = t + now, to + now, length - now
        kinds = {"source": pa.string()}
        return {c: pa.array(v, kinds.get(c, pa.int64())) for c, v in out.items()}

    joined = ids.join(offsets, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s"))).select(
        "doc_id", "source", "queue", "path", "whole", "rest_start", (F.col("start") + F.col("base")).alias("at"), "n", "ids"
    )
    return by_rows(joined, run, _PIECES)
