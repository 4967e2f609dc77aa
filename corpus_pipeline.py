"""A corpus from raw documents: language ID, near-duplicates, repeated passages, packing.

Every stage takes what its predecessor kept, as Parquet written and read again, and all but the last return the columns of
``documents``. Stages accept empty tables, null texts, repeated rows and further columns, which they carry along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm.common import bounded_batches, materialize, table
from pageloom.llm.langid import identify_documents
from pageloom.llm.neardup import keep_one
from pageloom.llm.packing import pack
from pageloom.llm.queries import tokenizer_file
from pageloom.llm.substrings import remove_repeats
from pageloom.session import ship_package


#: Rows of a record batch: four stages share the executors' memory, and a batch of long texts is held several times over.
BATCH_ROWS = 512


def _ready(spark: SparkSession) -> None:
    ship_package(spark)
    bounded_batches(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, min(int(spark.conf.get(name)), BATCH_ROWS))


def _apart(docs: DataFrame, *used: str) -> DataFrame:
    """The table with columns that a stage doesn't use under names of their own, so that none can clash."""
    return docs.withColumnsRenamed({c: f"carried_{i}" for i, c in enumerate(docs.columns) if c not in used})


def _back(kept: DataFrame, docs: DataFrame, *used: str) -> DataFrame:
    """The columns of ``docs`` again."""
    return kept.select(*[F.col(f"`{c}`") if c in used else F.col(f"carried_{i}").alias(c) for i, c in enumerate(docs.columns)])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages of the corpus; texts without letters or in no known language go."""
    _ready(spark)
    used = ("doc_id", "text", "lang", "source")
    return _back(identify_documents(_apart(docs, *used)).filter("kept"), docs, *used)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles have a similarity of 0.8 or more, the one of least id."""
    _ready(spark)
    used = ("doc_id", "text")
    return _back(keep_one(_apart(docs, *used), k=5, percent=80, rows=4), docs, *used)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of passages of twenty words or more that start earlier; documents left without any go."""
    _ready(spark)
    used = ("doc_id", "text", "n_chars")
    found = remove_repeats(_apart(docs, *used), layout=True).filter("n_words > n_removed or n_words = 0")
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return _back(found, docs, *used)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens that hold the sources in proportion."""
    _ready(spark)
    return pack(docs, tokenizer_file(), keep_pieces=False)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("packing", packing)]

#: SQL has neither the language model nor the tokenizer; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
