"""What the language model's scores cost: keys and words are not gathered a second time."""

import numpy as np
import pyarrow as pa
import pytest

from pageloom.llm import ctw


def _block(texts, held):
    part = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string()), "held_out": pa.array(held)})
    rows = list(ctw._block_rows(7, [part.slice(0, 3), part.slice(3)]))
    return part, pa.Table.from_batches(rows)


TEXTS = ["the cat sat", None, "", "A cat, the CAT", "é", "the cat sat on the mat " * 40]
HELD = [False, False, True, True, False, False]


def _by_definition(part):
    """Keys of all texts, one by one."""
    out = []
    for text in part.column("text").to_pylist():
        data = b"\xff" * 7 + (text or "").lower().encode() + b"\xff"
        out.append([int.from_bytes(data[i - 7 : i][::-1] + data[i : i + 1]) for i in range(7, len(data))])
    return out


def test_keys_are_those_of_the_definition():
    part, _ = _block(TEXTS, HELD)
    keys, begin = ctw.context_keys(part.column("text"))
    assert [keys[a:b].tolist() for a, b in zip(begin, begin[1:])] == _by_definition(part)  # noqa: B905


@pytest.mark.parametrize("limits", [{}, {"SORTED_KEYS": 1, "SLICE_KEYS": 5, "CELLS": 2}, {"SORTED_ROWS": 1}])
def test_scores_come_from_the_keys_and_words_a_block_has_asked_for(monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(ctw, name, value)
    part, asked = _block(TEXTS, HELD)
    rows = [tuple(r[c] for c in ("_block", "kind", "bucket", "m", "raw")) for r in asked.to_pylist()]
    assert all(np.diff([r[2] for r in rows if r[1] == kind]).min() > 0 for kind in (ctw.KEYS, ctw.WORDS))
    value = lambda key: -float(np.float32(key % 1009 + 1))
    told = []
    for row in rows:
        if row[1] == ctw.KEYS:
            keys, _ = ctw._cell_keys([row[4]])
            told.append((*row[:4], ctw._packed(ctw._planes(np.array([value(k) for k in keys.tolist()], "<f4")))))
        elif row[1] == ctw.WORDS:
            h, n = ctw._cell_words(row[4])
            told.append((*row[:4], ctw._packed(*ctw._small(n))))

    def gathered_again(*_):
        raise AssertionError("the block's keys or words are gathered again")

    for name in ("_distinct", "_block_keys", "_block_words"):
        monkeypatch.setattr(ctw, name, gathered_again)
    answers = ctw._answer_rows(told, [r[4] for r in told])
    got = ctw._scored(asked, pa.Table.from_batches([answers]), (100, 10, 4))
    assert got.column("score").to_pylist() == pytest.approx([sum(map(value, keys)) for keys in _by_definition(part)])
    # words in training: the, cat, sat, on, mat, é; "a" and "cat," are in a held-out text only
    assert got.column("n_known").to_pylist() == [4, 1, 1, 3, 2, 241]


def test_keys_that_differ_in_their_lowest_bits_stay_apart():
    """Where keys multiplied by one number differ in the bits only that rows take, another number is found."""
    near = np.array([5, 5 + pow(ctw._SPREAD, -1, 1 << 64)], np.uint64)
    by, cut, value = ctw._spread(near, np.array([1, 2], np.float32), np.uint64(14))
    assert int(by) != ctw._SPREAD and cut[0] < cut[1]
    assert (value == np.array([1, 2])[np.argsort(near * by)]).all()


def test_a_block_writes_few_rows_of_words():
    """A row of a few words costs more to pack and unpack, three times, than its words."""
    h = np.sort(np.random.default_rng(3).integers(0, 1 << 64, 40000, np.uint64))
    bucket = ctw._word_bucket(h)
    assert len(ctw._cuts(bucket)) <= 1025 and (np.diff(bucket.astype(int)) >= 0).all() and bucket.max() < 1 << ctw.BUCKET_BITS
