"""The corpus pipeline against a brute-force version, on odd rows, and on nothing."""

import zlib

import numpy as np
import pytest
from test_llm_tables import check_pieces, library  # noqa: F401
from llm_rows import messy, nothing  # noqa: F401
from test_llm_texts import brute_groups, brute_repeats

import corpus_pipeline


def staged(spark, docs):
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], "unused"))
    return out


def test_stage_columns(spark, messy, nothing):
    for docs in (messy, nothing):
        *kept, packed = staged(spark, docs)
        assert all(d.columns == docs.columns for d in kept)
        assert set(packed.columns) >= {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}
    assert packed.count() == 0
    assert {tuple(r) for r in kept[-1].select("key", "label", "language", "n_words").distinct().collect()} == set()


def test_stages_against_brute_force(spark, data, messy, library):  # noqa: F811
    for docs in (messy, spark.read.parquet(f"{data}/documents.parquet")):
        _, spoken, unique, cut, packed = staged(spark, docs)
        pairs = lambda df: [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        before, one, two, three = pairs(docs), pairs(spoken), pairs(unique), pairs(cut)
        assert {d for d, t in before if t and any(c.isalpha() and c.isascii() for c in t)} >= {d for d, _ in one}
        want = sorted({(d, t) for (d, t), g in zip(one, brute_groups(one, 5, 80), strict=True) if g[3] or d is None}, key=repr)
        assert sorted(two, key=repr) == want
        left = {}
        for d, words, gone in brute_repeats(two):
            rest = [w for w, g in zip(words, gone, strict=True) if not g]
            if rest:
                left.setdefault(d, []).append(rest)
        assert sorted(((d, (t or "").encode().split()) for d, t in three), key=repr) == sorted(((d, x) for d, xs in left.items() for x in xs), key=repr)
        untouched = dict(two)
        assert all(t == untouched[d] for d, t in three if d is not None and (t or "").split() == (untouched[d] or "").split())
        check_pieces(three, packed.collect(), library)


def test_carried_columns_stay(spark, messy):
    *_, cut, _ = staged(spark, messy)
    assert {tuple(r) for r in cut.select("key", "label", "language", "n_words", "_block").distinct().collect()} == {
        ("own key", "own label", "own language", "own n_words", "own _block")
    }


def test_run(spark, data, library):  # noqa: F811
    got = corpus_pipeline.run(spark, data).collect()
    docs = {r.doc_id for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id").collect()}
    assert {p.doc_id for p in got} <= docs and len({p.doc_id for p in got}) > 0.8 * len(docs)
    assert all(0 < p.length <= 1024 and 0 <= p.ids_crc32 < 1 << 32 for p in got)


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "repeated_passages", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None
    assert zlib.crc32(np.zeros(1, "<u4").tobytes()) > 0


pytestmark = pytest.mark.filterwarnings("ignore::DeprecationWarning")
