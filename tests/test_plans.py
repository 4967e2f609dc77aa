"""The shape of the physical plans: what reaches the scan, what is not shuffled, what never appears."""

import re

import pytest

import __spark_entry__ as entry

QUERIES = entry.queries()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def read_columns(text: str) -> list[str]:
    return re.findall(r"ReadSchema: struct<([^>]*)>", text)


@pytest.mark.parametrize("name", ["latest_page", "latest_200", "top_priority"])
def test_newest_rows_are_a_top_k(spark, data, name):
    assert "TakeOrderedAndProject" in plan(QUERIES[name](spark, data))


def test_detail_is_pushed_to_the_scan(spark, data):
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(doc_id,42\)", plan(QUERIES["article_detail"](spark, data)))


def test_unused_columns_and_tables_are_not_read(spark, data):
    text = plan(QUERIES["useful_links"](spark, data))
    assert "html" not in "".join(read_columns(text))
    assert text.count("FileScan") == 1
    assert plan(QUERIES["filter_category"](spark, data)).count("FileScan") == 1


@pytest.mark.parametrize("name", ["useful_links", "classify_link", "extract_links", "analyze_documents", "keyword_search", "stream_cards"])
def test_row_work_needs_no_extra_shuffle(spark, data, name):
    exchanges = [x for x in re.findall(r"Exchange (\w+)", plan(QUERIES[name](spark, data))) if x != "RoundRobinPartitioning"]
    assert all("hashpartitioning" not in x for x in exchanges)


def test_nearest_neighbours_move_no_vectors(spark, data):
    text = plan(QUERIES["memory_search"](spark, data))
    assert "TakeOrderedAndProject" in text and "MapInArrow" in text


NEVER = ("CartesianProduct", "BroadcastNestedLoopJoin")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_joins(spark, data, name):
    text = plan(QUERIES[name](spark, data))
    assert not any(n in text for n in NEVER), text
