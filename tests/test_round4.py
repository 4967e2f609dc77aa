"""Streams over tables of several files, pieces of long lines, and searches of few questions."""

import pytest
from conftest import values
from pyspark.sql import functions as F

from pageloom.operators import memory as M
from pageloom.operators import search_index as SI
from pageloom.plans import catalog_streams as CS


@pytest.mark.parametrize("files", [1, 3])
def test_streams_read_tables_of_one_file_and_of_many(spark, tmp_path, files):
    rows = [(i, f"https://h.example.com/{i}", f"<p>{i}</p>") for i in range(9)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    pages.repartition(files).write.parquet(f"{tmp_path}/t/pages.parquet")
    folder = f"{tmp_path}/t"
    if files == 1:
        (part,) = (tmp_path / "t" / "pages.parquet").glob("part-*.parquet")
        folder = f"{tmp_path}/one"
        (tmp_path / "one").mkdir()
        (tmp_path / "one" / "pages.parquet").write_bytes(part.read_bytes())
    got = CS.run_to_table(CS._stream(spark, folder, "pages"), "append")
    assert values(got, "page_id", "url", "html") == sorted(rows, key=repr)


def test_few_questions_move_no_vectors_and_compute_them_once(spark):
    rows = [(i, [float(i % 7), 1.0, float(i % 3)] if i % 5 else None) for i in range(200)] + [(None, [1.0, 1.0, 1.0]), (300, [0.0, 0.0, 0.0])]
    articles = spark.createDataFrame(rows, "id bigint, embedding array<float>").repartition(3)
    computed = spark.sparkContext.accumulator(0)

    @F.udf("array<float>")
    def again(v):
        computed.add(1)
        return v

    asked = spark.createDataFrame([(1, [1.0, 2.0, 0.0]), (2, [0.0, 0.0, 0.0]), (3, None), (4, [3.0, 1.0, 1.0])], "query_id bigint, embedding array<float>")
    got = M.knn_join(articles.withColumn("embedding", again("embedding")), asked, 4)
    found = values(got.withColumn("distance", F.round("distance", 9)), "query_id", "rank", "id", "distance")
    assert computed.value == len(rows)
    plain = M.knn_join(articles, asked, 4, block=1)
    assert repr(found) == repr(values(plain.withColumn("distance", F.round("distance", 9)), "query_id", "rank", "id", "distance"))
    assert "FlatMapCoGroups" not in got._jdf.queryExecution().toString()
    assert M.knn_join(articles, asked.filter("query_id = 3"), 4).count() == 0


def test_pieces_of_a_long_line_take_linear_work():
    line = "".join(chr(97 + (i * i) % 23) for i in range(1 << 20))
    texts = ["ab", "", "abc", "\U0001f600b\u00e9\u00e9", line]
    want = sorted({t[i : i + 3] for t in texts for i in range(len(t) - 2)})
    assert SI._text_of(SI._pieces(texts)) == want
    assert SI._text_of(SI._pieces([])) == SI._text_of(SI._pieces(["", "xy"])) == []


def test_an_index_names_every_file_and_piece_once(spark, tmp_path):
    rows = [(i, None if i == 3 else f"Title {i} \n" + "x" * (i % 4), f"sum{i}" if i % 2 else None) for i in range(40)]
    spark.createDataFrame(rows, "id bigint, title string, summary string").repartition(4).write.parquet(f"{tmp_path}/a")
    SI.index_files(spark, f"{tmp_path}/a", f"{tmp_path}/i")
    read = spark.read.parquet(f"{tmp_path}/a").select("title", "summary", F.col("_metadata.file_path").alias("file")).collect()
    want = {(t[i : i + 3].lower(), r.file) for r in read for t in (r.title, r.summary) if t for i in range(len(t) - 2)}
    assert values(spark.read.parquet(f"{tmp_path}/i"), "piece", "file") == sorted(want, key=repr)
