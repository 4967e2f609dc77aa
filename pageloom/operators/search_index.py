"""Keyword search that opens only the files of a stored article table which can hold the term.

The index is a table of (piece, file): every run of three characters of a file's lower-cased titles and summaries, sorted by
piece, so a look-up reads few row groups. A file that lacks one of the term's pieces holds no hit; the others are searched as usual.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.operators.articles import keyword_search

PIECE = 3
#: Characters whose pieces are made at once, pieces that a task holds, and rows that it hands on at once.
CHARS, HELD, BATCH = 1 << 20, 1 << 22, 1 << 16
_SEARCHED = ("title", "summary")


def _pieces(texts: list[str]) -> np.ndarray:
    """The distinct runs of ``PIECE`` characters of some texts, 21 bits a character, sorted."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    end = np.cumsum(lengths)
    chars = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.uint64)
    if len(chars) < PIECE:
        return np.zeros(0, np.uint64)
    whole = np.ones(len(chars), dtype=bool)
    for short in range(1, PIECE):
        whole[end[lengths >= short] - short] = False
    last = len(chars) - PIECE + 1
    run = np.zeros(last, np.uint64)
    for i in range(PIECE):
        run = run << np.uint64(21) | chars[i : i + last]
    return np.unique(run[whole[:last]])


def _text_of(pieces: np.ndarray) -> list[str]:
    """Pieces as texts."""
    chars = np.stack([pieces >> np.uint64(21 * i) & np.uint64((1 << 21) - 1) for i in range(PIECE - 1, -1, -1)], axis=1)
    text = chars.astype("<u4").tobytes().decode("utf-32-le")
    return [text[i : i + PIECE] for i in range(0, len(text), PIECE)]


def _of_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(piece, file) of (file, texts ...) rows, each once as long as no more than ``HELD`` pieces are held."""
    held: dict[str, np.ndarray] = {}

    def told() -> Iterator[pa.RecordBatch]:
        for file, pieces in held.items():
            for at in range(0, len(pieces), BATCH):
                some = _text_of(pieces[at : at + BATCH])
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([file] * len(some), pa.string())], ["piece", "file"])
        held.clear()

    def some_texts(batch: pa.RecordBatch) -> Iterator[tuple[str, list[str]]]:
        """Texts of one file, some ``CHARS`` characters at a time."""
        files = batch.column(0).to_pylist()
        texts, size = [], 0
        for i, file in enumerate(files):
            for column in batch.columns[1:]:
                raw = column[i].as_buffer()
                if raw is not None:
                    texts.append(raw.to_pybytes().decode("utf-8", "replace"))
                    size += len(texts[-1])
            if size >= CHARS or i + 1 == len(files) or files[i + 1] != file:
                yield file, texts
                texts, size = [], 0

    for batch in batches:
        for file, texts in some_texts(batch):
            new = _pieces(texts)
            held[file] = np.union1d(held[file], new) if file in held else new
            if sum(map(len, held.values())) > HELD:
                yield from told()
    yield from told()


def index_files(spark: SparkSession, path: str, out: str) -> None:
    """Write the index of the article table stored at ``path`` to ``out``."""
    rows = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("file"), *[F.lower(c).cast("binary").alias(c) for c in _SEARCHED])
    found = rows.mapInArrow(_of_files, "piece string, file string").distinct()
    found.repartitionByRange("piece", "file").sortWithinPartitions("piece", "file").write.mode("overwrite").parquet(out)


def candidate_files(spark: SparkSession, index: str, term: str) -> list[str] | None:
    """Files that hold all pieces of the term, or None where it has none. The driver knows a table's files in any case.

    Wildcards (``%`` and ``_``) end a run of plain text.
    """
    runs = [r for r in re.split("[%_]", term) if r]
    if not runs:
        return None
    low = spark.range(1).select(F.array(*[F.lower(F.lit(r)) for r in runs])).head()[0]
    wanted = _text_of(_pieces(low))
    if not wanted:
        return None
    held = spark.read.parquet(index).filter(F.col("piece").isin(wanted))
    full = held.groupBy("file").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(wanted))
    return sorted(r["file"] for r in full.collect())


def indexed_search(spark: SparkSession, path: str, index: str, term: str | None) -> DataFrame:
    """The rows that ``keyword_search`` finds in the article table stored at ``path``."""
    whole = spark.read.parquet(path)
    files = candidate_files(spark, index, term) if term else None
    if files is None:
        return keyword_search(whole, term)
    if not files:
        return spark.createDataFrame([], whole.schema)
    return keyword_search(spark.read.schema(whole.schema).option("basePath", path).parquet(*files), term)
