"""Documents dealt to blocks of bounded text size by a hash of their id.

An operator that must ask a corpus-wide table about every word or window of a document does so once per block: a block's
distinct keys go out, the answers come back to the block and meet its documents again. That is far less to shuffle than one
row per document and key, and a key that occurs everywhere has one row per block, not one per occurrence. All uses in one
plan share one shuffle of the texts.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import give_back

BLOCK_BYTES = 6 << 20


def blocked(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, int]:
    """The rows with a column ``_block`` (bigint), and the number of blocks, which follows the size of all texts."""
    total = docs.agg(F.sum(F.octet_length(text))).head()[0] or 0
    count = max(1, math.ceil(total / BLOCK_BYTES))
    return docs.withColumn("_block", F.pmod(F.xxhash64(F.col(key)), F.lit(count).cast("bigint"))), count


def one_batch(table: pa.Table) -> pa.RecordBatch:
    """A table's rows in one record batch, with offsets wide enough for any text; what earlier blocks left is freed."""
    give_back()
    schema = pa.schema([f.with_type(pa.large_string()) if pa.types.is_string(f.type) else f for f in table.schema])
    return table.cast(schema).combine_chunks().to_batches()[0] if table.num_rows else pa.RecordBatch.from_pylist([], schema=schema)
