"""What the language model's scores leave on disk."""

import re

import numpy as np

from pageloom.llm import blocks, ctw
from pageloom.session import shuffles_forgotten


def test_texts_do_not_travel(spark, monkeypatch):
    """Only the buckets' answers are shuffled by block; a block's texts stay where they were written."""
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 100)
    rows = [(d, f"text {d % 5} of some words" * (d % 4)) for d in range(30)] + [(None, None), (3, "twice"), (3, "twice")]
    got = ctw.score_texts(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(_block", plan)) == 1
    assert len(got.collect()) == len(rows)


def test_keys_and_words_come_back_from_their_cells():
    rng = np.random.default_rng(5)
    keys = np.unique(np.concatenate([rng.integers(0, 1 << 64, 50, np.uint64), rng.integers(0, 1 << 20, 300, np.uint64), np.array([0, (1 << 64) - 1], np.uint64)]))
    n = rng.integers(0, 3, len(keys))
    n[[0, 7, -1]] = 254, 255, 1 << 40
    cuts = np.array([0, 1, 40, len(keys)])
    for cells, back in ((ctw._key_cells(keys, n, cuts), ctw._cell_keys), (ctw._word_cells(keys, n, cuts), None)):
        got = back(cells) if back else [np.concatenate(x) for x in zip(*map(ctw._cell_words, cells), strict=True)]
        assert (got[0] == keys).all() and (got[1] == n).all()
    near = np.array([1 << 63, (1 << 63) + 256], np.uint64)  # they share six bytes
    assert len(ctw._unpacked(ctw._key_cells(near, np.ones(2, int), np.array([0, 2]))[0])[2]) == 8 + 2


def test_shuffle_files_go_with_their_query(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    with shuffles_forgotten(spark):
        assert spark.conf.get(name) == "true"
    assert spark.conf.get(name) == before
