"""Searches that leave out what cannot hold a hit: same rows as the plain ones."""

import numpy as np
import pytest
from conftest import values

from pageloom.operators import articles as A
from pageloom.operators import search_index as SI
from pageloom.operators.memory import knn_join
from pageloom.operators.pivots import pruned_knn

ROWS = [(i, f"Title {i} zebra{i:03d}" if i % 2 else None, f"summary about {['cats', 'Dogs', 'x%y', 'a_b'][i % 4]} {i // 10}") for i in range(200)]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    place = tmp_path_factory.mktemp("search")
    spark.createDataFrame(ROWS, "id bigint, title string, summary string").repartitionByRange(10, "id").sortWithinPartitions("id").write.parquet(f"{place}/articles")
    SI.index_files(spark, f"{place}/articles", f"{place}/index")
    return str(place)


@pytest.mark.parametrize("term", ["zebra", "ZEBRA017", "dogs", "t%17", "x%y", "a_b", "Title 5 z", "absent", "ab", "%", "_", "", None, "\\", "about c"])
def test_indexed_search_finds_the_same_rows(spark, stored, term):
    got = SI.indexed_search(spark, f"{stored}/articles", f"{stored}/index", term)
    want = A.keyword_search(spark.read.parquet(f"{stored}/articles"), term)
    assert values(got, "id", "title") == values(want, "id", "title")


def test_a_rare_term_opens_few_files(spark, stored):
    assert len(spark.read.parquet(f"{stored}/articles").inputFiles()) == 10
    assert len(SI.candidate_files(spark, f"{stored}/index", "zebra017")) == 1
    assert SI.candidate_files(spark, f"{stored}/index", "nowhere") == []
    assert SI.candidate_files(spark, f"{stored}/index", "ab%c") is None
    assert len(SI.indexed_search(spark, f"{stored}/articles", f"{stored}/index", "Zebra017").inputFiles()) == 1


def frames(spark, rows, asked):
    made = lambda xs, key: spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in xs], f"{key} bigint, embedding array<float>").repartition(3)
    return made(rows, "id"), made(asked, "query_id")


@pytest.mark.parametrize("kind", ["clusters", "spread", "equal", "zeros", "few"])
def test_pruned_search_equals_the_plain_one(spark, kind):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8)) * 5
    if kind == "clusters":
        rows = [(i, centres[i % 12] + rng.normal(size=8) * 0.05) for i in range(1500)]
        asked = [(i, centres[i] + rng.normal(size=8) * 0.05) for i in range(12)]
    elif kind == "spread":
        rows, asked = list(enumerate(rng.normal(size=(600, 8)))), list(enumerate(rng.normal(size=(20, 8))))
    elif kind == "equal":
        rows, asked = [(i, np.ones(4)) for i in range(300)], [(0, np.ones(4)), (1, -np.ones(4))]
    elif kind == "zeros":
        rows = [(i, np.zeros(4) if i % 3 else np.eye(4)[i % 4]) for i in range(60)] + [(100, None)]
        asked = [(0, np.zeros(4)), (1, np.eye(4)[0]), (2, None)]
    else:
        rows, asked = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0])], [(0, [1.0, 1.0]), (1, [0.0, 0.0])]
    articles, queries = frames(spark, rows, asked)
    for k in (1, 5, 30):
        got = pruned_knn(articles, queries, k, pivots=16, slice_=40)
        want = knn_join(articles, queries, k)
        near = lambda df: sorted(((r.query_id, r["rank"], r.id, None if r.distance is None or r.distance != r.distance else round(r.distance, 6)) for r in df.collect()), key=repr)
        assert near(got.hits) == near(want)
    if kind == "clusters":
        got = pruned_knn(articles, queries, 5, pivots=16, slice_=40)
        met = got.visits.count()
        assert got.visits.distinct().count() == met and met < 0.4 * got.possible, (met, got.possible)


def test_nothing_to_search(spark):
    articles, queries = frames(spark, [(1, [1.0])], [(1, [1.0])])
    assert pruned_knn(articles.filter("id < 0"), queries, 3).hits.count() == 0
    assert pruned_knn(articles, queries.filter("query_id < 0"), 3).hits.count() == 0
