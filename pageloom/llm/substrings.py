"""Substring dedup: documents parsed into factors of what stands earlier in the corpus (relative Lempel-Ziv).

The reference of a document is all text that starts earlier: documents of smaller id, and its own beginning. It is held as an
index of reference blocks: a block (see ``blocks``) lists its windows of ``WINDOW`` consecutive words by a 96-bit hash with
their earliest places. A document is parsed greedily from the left: where the window at hand has an earlier start anywhere, a
factor begins and grows as long as the next window has one too; other words are literals. A factor is at least a window long,
and its last words are checked by the window that ends there. The words of factors are the duplicate spans.

Only windows that can occur twice are looked up. Of the ``WINDOW - GRAM + 1`` word grams in a window the one of least hash is
its anchor; equal windows have equal anchors, so a window whose anchor occurs once in the corpus is unique. Anchors, about one
in five words, are counted first, and windows around repeated ones are compared across blocks after that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.blocks import blocked, one_batch
from pageloom.llm.words import Words, chunks, runs, words

WINDOW, GRAM = 20, 12


def _starts(w: Words, length: int) -> np.ndarray:
    """Word places at which ``length`` words of one row begin."""
    n = np.diff(w.first)
    left = np.repeat(w.first[1:], n) - np.arange(len(w.start))
    return np.flatnonzero(left >= length)


def anchors(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the anchors of all windows, and their places; each place once."""
    at = _starts(w, WINDOW)
    if not len(at):
        return np.zeros(0, np.uint64), at
    grams = runs(w.hash, GRAM)
    best, place = grams[at], np.zeros(len(at), dtype=np.int64)
    for i in range(1, WINDOW - GRAM + 1):
        other = grams[at + i]
        less = other < best
        best = np.where(less, other, best)
        place[less] = i
    place = np.unique(at + place)
    return grams[place], place


def _sorted_chunks(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, Words]]:
    for part in chunks(batch, "text"):
        yield part, words(part.column("text"), lower=False)


def _anchor_rows(table: pa.Table) -> pa.Table:
    """A block's distinct anchors with their number of occurrences."""
    found = [anchors(w)[0] for _, w in _sorted_chunks(one_batch(table))]
    hashes, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
    block = table.column("_block")[0].as_py() if table.num_rows else 0
    return pa.table({"_block": pa.array(np.full(len(hashes), block)), "h": pa.array(hashes.view(np.int64)), "n": pa.array(n.astype(np.int32))})


def _member(sorted_set: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(values), dtype=bool)
    at = np.searchsorted(sorted_set, values)
    at[at == len(sorted_set)] = 0
    return sorted_set[at] == values


def _check(w: Words, at: np.ndarray) -> np.ndarray:
    return (runs(w.hash, WINDOW, 5)[at] >> np.uint64(32)).astype(np.uint32) if len(at) else np.zeros(0, np.uint32)


def _places(part: pa.RecordBatch, w: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document id and place in the document of each word place; a row without id comes before all others."""
    ids = part.column("doc_id").fill_null(-(2**63)).to_numpy(zero_copy_only=False)
    row = np.searchsorted(w.first, at, "right") - 1
    return ids[row], (at - w.first[row]).astype(np.int32)


def _windows(batch: pa.RecordBatch, shared: np.ndarray | None) -> dict[str, np.ndarray]:
    """Windows of a block (only those around a shared anchor, if any are given): hash, check, document, place."""
    out: dict[str, list[np.ndarray]] = {"h": [], "c": [], "d": [], "p": []}
    for part, w in _sorted_chunks(batch):
        at = _starts(w, WINDOW)
        if shared is not None and len(at):
            hashes, place = anchors(w)
            count = np.zeros(len(w.start) + 1, dtype=np.int64)
            count[place[_member(shared, hashes)] + 1] = 1
            np.cumsum(count, out=count)
            at = at[count[at + WINDOW - GRAM + 1] > count[at]]
        d, p = _places(part, w, at)
        for k, v in (("h", runs(w.hash, WINDOW)[at] if len(at) else np.zeros(0, np.uint64)), ("c", _check(w, at)), ("d", d), ("p", p)):
            out[k].append(v)
    kinds = {"h": np.uint64, "c": np.uint32, "d": np.int64, "p": np.int32}
    return {k: np.concatenate(v) if v else np.zeros(0, kinds[k]) for k, v in out.items()}


def _in_order(table: pa.Table) -> pa.RecordBatch:
    """A block's rows by document id, none first; rows of one id as they come."""
    batch = one_batch(table)
    ids = batch.column("doc_id").fill_null(-(2**63)).to_numpy(zero_copy_only=False)
    return batch.take(pa.array(np.argsort(ids, kind="stable")))


def _earliest(x: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order of the windows (given in order of the texts) by hash and check, and where in it each different window begins."""
    order = np.argsort(x["h"], kind="stable")
    h, c = x["h"][order], x["c"][order]
    same = h[1:] == h[:-1]
    if (c[1:] != c[:-1])[same].any():  # equal hashes of different windows
        order = np.lexsort((x["c"], x["h"]))
        h, c = x["h"][order], x["c"][order]
        same = h[1:] == h[:-1]
    new = np.ones(len(order), dtype=bool)
    new[1:] = ~same | (c[1:] != c[:-1])
    return order, np.flatnonzero(new)


def _window_rows(docs: pa.Table, shared: pa.Table) -> pa.Table:
    """A block's index: the earliest place of each window around an anchor that occurs more than once in the corpus."""
    known = np.sort(shared.column("h").to_numpy().view(np.uint64))
    x = _windows(_in_order(docs), known)
    order, new = _earliest(x)
    first = np.sort(order[new])  # in order of the texts: neighbouring rows are alike and shrink when they are shuffled
    check_and_place = (x["c"][first].astype(np.uint64) << np.uint64(32)) | x["p"][first].astype(np.uint64)
    return pa.table({"h": pa.array(x["h"][first].view(np.int64)), "cp": pa.array(check_and_place.view(np.int64)), "d": pa.array(x["d"][first])})


def _duplicate(batch: pa.RecordBatch, known: pa.Table) -> np.ndarray:
    """For the windows of a block in order: whether the same words start earlier."""
    x = _windows(batch, None)
    order, new = _earliest(x)
    group = np.cumsum(np.bincount(new, minlength=len(order))[: len(order)]) - 1
    d, p = x["d"][order], x["p"][order]
    lead = new[group] if len(order) else order
    later = (d != d[lead]) | (p != p[lead])
    # windows whose earliest place is in another block
    known_h, known_c = known.column("h").to_numpy().view(np.uint64), known.column("c").to_numpy().view(np.uint32)
    if len(known_h) and len(order):
        by = np.argsort(known_h)
        known_h, known_c = known_h[by], known_c[by]
        h, c = x["h"][order[new]], x["c"][order[new]]
        low, high = np.searchsorted(known_h, h, "left"), np.searchsorted(known_h, h, "right")
        hit = (low < high) & (known_c[np.minimum(low, len(known_h) - 1)] == c)
        for i in np.flatnonzero((high - low > 1) & ~hit):  # equal hashes of different windows
            hit[i] = c[i] in known_c[low[i] : high[i]]
        later |= hit[group]
    out = np.zeros(len(order), dtype=bool)
    out[order] = later
    return out


def factors(duplicate: np.ndarray) -> list[tuple[int, int]]:
    """Greedy parse of one document: (first word, word behind the last) of each factor; ``duplicate`` has its windows."""
    covered = np.zeros(len(duplicate) + WINDOW, dtype=np.int64)
    at = np.flatnonzero(duplicate)
    covered[at] += 1
    ends = np.zeros_like(covered)
    ends[at + WINDOW - 1] += 1
    inside = np.cumsum(covered) - np.concatenate([[0], np.cumsum(ends)[:-1]]) > 0
    edge = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


def _parse(docs: pa.Table, known: pa.Table, schema: pa.Schema, layout: bool) -> pa.Table:
    batch = _in_order(docs)
    duplicate = _duplicate(batch, known)
    out, used = [], 0
    for part, w in _sorted_chunks(batch):
        texts, n_words, n_removed, spans = [], [], [], []
        raw = memoryview(np.ascontiguousarray(w.buffer))
        for i in range(part.num_rows):
            a, b = int(w.first[i]), int(w.first[i + 1])
            n = max(0, b - a - WINDOW + 1)
            found = factors(duplicate[used : used + n]) if n and duplicate[used : used + n].any() else []
            used += n
            keep = np.ones(b - a, dtype=bool)
            for s, e in found:
                keep[s:e] = False
            if layout:
                edges = [0, *(x for span in found for x in span), b - a]
                runs_left = [(s + a, e + a - 1) for s, e in zip(edges[::2], edges[1::2], strict=True) if s < e]
                whole = (int(w.offsets[i]), int(w.offsets[i + 1]))
                parts = [(w.start[s], w.end[e]) for s, e in runs_left] if found else [whole]
            else:
                at = np.flatnonzero(keep) + a
                parts = zip(w.start[at].tolist(), w.end[at].tolist(), strict=True)
            texts.append(b" ".join(raw[s:e] for s, e in parts))
            n_words.append(b - a)
            n_removed.append(b - a - int(keep.sum()))
            spans.append([{"start": s, "stop": e} for s, e in found])
        made = {
            "text": pa.array(texts, pa.binary()).cast(pa.string()), "n_words": pa.array(n_words, pa.int64()),
            "n_removed": pa.array(n_removed, pa.int64()), "factors": pa.array(spans, schema.field("factors").type),
        }
        out.append(pa.RecordBatch.from_arrays(
            [made[f.name] if f.name in made else part.column(f.name).cast(f.type) for f in schema], schema=schema
        ))
    return pa.Table.from_batches(out, schema=schema)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", layout: bool = False) -> DataFrame:
    """The rows of ``docs`` with repeated passages taken out, and n_words, n_removed, factors (start, stop; in words).

    A word (run of bytes other than blank and 9..13) goes if it lies in ``WINDOW`` consecutive words of its document that
    also start earlier: in a document of smaller id, or earlier in the same one. What is left is joined by one blank, word
    by word, or with ``layout`` run by run as it stood, so that a text without repeats stays as it is. A null text comes back empty; fewer words than a window stay. A null id counts as smaller than any; rows of one
    id stand in the order they come, and equal places of them are one place, so a repeated row keeps its words. Other columns come along unchanged, under any name but those added.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    extra = [c for c in docs.columns if c not in (key, text, "n_words", "n_removed", "factors")]
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"), *[F.col(f"`{c}`").alias(f"x{i}") for i, c in enumerate(extra)])
    rows, count = blocked(rows, "doc_id", "text")
    by_block = rows.groupBy("_block")

    found = by_block.applyInArrow(_anchor_rows, "_block bigint, h bigint, n int")
    shared = found.withColumn("all", F.sum("n").over(Window.partitionBy("h"))).filter("`all` > 1").select("_block", "h")
    index = by_block.cogroup(shared.groupBy("_block")).applyInArrow(_window_rows, "h bigint, cp bigint, d bigint")
    # check and place travel as one number, and the block, which follows from the document, not at all
    index = index.repartition("h").select(
        "h", F.shiftright("cp", 32).cast("int").alias("c"), F.col("cp").bitwiseAND(0xFFFFFFFF).cast("int").alias("p"), "d",
        F.pmod(F.xxhash64(F.when(F.col("d") != -(2**63), F.col("d"))), F.lit(count).cast("bigint")).alias("_block"),
    )
    earliest = F.min(F.struct("d", "p")).over(Window.partitionBy("h", "c"))
    earlier = index.withColumn("e", earliest).filter(F.struct("d", "p") != F.col("e")).select("_block", "h", "c")

    added = StructType.fromDDL("n_words bigint, n_removed bigint, factors array<struct<start: bigint, stop: bigint>>")
    schema = StructType([f for f in rows.schema.fields if f.name != "_block"] + added.fields)
    arrow = to_arrow_schema(schema)
    out = by_block.cogroup(earlier.groupBy("_block")).applyInArrow(lambda a, b: _parse(a, b, arrow, layout), schema)
    names = dict(zip([f"x{i}" for i in range(len(extra))], extra, strict=True)) | {"doc_id": key, "text": text}
    order = {c: i for i, c in enumerate([c for c in docs.columns if c in (key, text, *extra)])}
    cols = sorted(names, key=lambda c: order[names[c]])
    return out.select(*[F.col(c).alias(names[c]) for c in cols], "n_words", "n_removed", "factors")
