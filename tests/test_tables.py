"""Knowledge-base algebra, table operations, files and streams."""

import json

import pytest
from pyspark.sql import functions as F

from loregrid.operators import tables as tb
from loregrid.sources import examples as ex
from loregrid.streaming import live

ROW = "idx long, input string"


def rows(df, *columns):
    return [tuple(r) for r in df.orderBy("idx").select(*columns).collect()]


def test_merge_keeps_order_and_copies(spark):
    a = spark.createDataFrame([(0, "a"), (1, "b")], ROW)
    b = spark.createDataFrame([(0, "c"), (1, "a")], ROW)
    assert rows(tb.merged(a, b), "idx", "input") == [(0, "a"), (1, "b"), (2, "c"), (3, "a")]
    assert rows(tb.merged(a.limit(0), b.limit(0)), "idx") == []


@pytest.mark.parametrize("partitions", [2, 4, 8, 200])
def test_numbers_are_dense_and_in_order(spark, partitions):
    n = 20_000
    # wide rows that lie in another order, more than a sort by range samples
    left = spark.range(n // 2).select(((F.col("id") * 7919) % (n // 2)).alias("idx"), F.concat(F.lit("row "), F.col("id").cast("string")).alias("input"), F.sha2(F.col("id").cast("string"), 256).alias("value"))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = tb.merged(left, left.withColumn("idx", -F.col("idx"))).toPandas().sort_values("idx")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    want = left.toPandas().sort_values("idx")
    assert got["idx"].tolist() == list(range(n))
    assert got["input"].tolist() == [*want["input"], *want["input"][::-1]]
    assert got["value"].tolist() == [*want["value"], *want["value"][::-1]]


def test_remove(spark):
    a = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], ROW)
    assert rows(tb.removed(a, 1), "idx", "input") == [(0, "a"), (1, "c")]
    with pytest.raises(IndexError):
        tb.removed(a, 5)


def test_upsert_and_ignore(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "key string, value int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "key string, value int")
    as_dict = lambda df: {r.key: r.value for r in df.collect()}
    assert as_dict(tb.upserted(old, new, "key")) == {"a": 1, "b": 3, "c": 4}
    assert as_dict(tb.inserted_or_ignored(old, new, "key")) == {"a": 1, "b": 2, "c": 4}


def test_dedup_first_wins_nulls_stay(spark):
    new = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, None), (5, None)], "id long, hash string")
    stored = spark.createDataFrame([("y",), (None,)], "hash string")
    assert sorted(r.id for r in tb.deduplicated(new, stored, "hash", "id").collect()) == [1, 4, 5]


def test_cascade(spark):
    parents = spark.createDataFrame([(1, "a"), (2, "b")], "id long, n string")
    children = spark.createDataFrame([(1, 1), (2, 2), (3, None), (4, 9)], "c long, p long")
    p, c = tb.deleted_with_children(parents, children, F.col("n") == "a", "id", "p")
    assert [r.id for r in p.collect()] == [2] and sorted(r.c for r in c.collect()) == [2, 3, 4]


def test_kb_files(spark, tmp_path):
    (tmp_path / "plain.json").write_text(json.dumps([{"input": "a", "output": "b"}, {"input": "c", "output": "d", "weight": 2.5, "metadata": {"x": 1}}]))
    (tmp_path / "tagged.json").write_text(json.dumps([{"input": "e", "output": {"Markdown": "# f"}}, {"input": "g", "output": {"Json": {"k": 1}}, "metadata": {"y": 2}}]))
    plain = ex.read_kb(spark, str(tmp_path / "plain.json")).orderBy("idx").collect()
    assert [(r.input, r.output.format, r.output.value, r.weight, r.metadata) for r in plain] == [("a", "Text", "b", 1.0, None), ("c", "Text", "d", 2.5, None)]
    tagged = ex.read_kb(spark, str(tmp_path / "tagged.json")).orderBy("idx").collect()
    assert [(r.output.format, r.output.value) for r in tagged] == [("Markdown", "# f"), ("Json", '{"k":1}')]
    (tmp_path / "mixed.json").write_text(json.dumps([{"input": "a", "output": "b"}, {"input": "e", "output": {"Text": "f"}}]))
    with pytest.raises(Exception, match="not a knowledge base"):
        ex.read_kb(spark, str(tmp_path / "mixed.json")).collect()
    assert ex.read_kb(spark, str(tmp_path), strict=False).count() == 4


def test_kb_round_trip(spark, tmp_path):
    schema = "idx long, input string, output struct<format:string,value:string>, weight float, metadata string"
    kb = spark.createDataFrame([(0, 'say "hi"\n', ("Text", "ünï\\"), 1.5, None), (1, "j", ("Json", '{"a": [1]}'), 1.0, '{"p": 1}'), (2, "", ("Markdown", ""), 0.0, None)], schema)
    ex.write_kb(kb, str(tmp_path / "kb"))
    back = {r.input: (r.output.format, r.output.value, r.weight) for r in ex.read_kb_lines(spark, str(tmp_path / "kb")).collect()}
    assert back['say "hi"\n'] == ("Text", "ünï\\", 1.5) and back[""] == ("Markdown", "", 0.0)
    assert json.loads(back["j"][1]) == {"a": [1]}


def test_tsv(spark):
    lines = ["# comment", "", "ab\tcd", "one field", "a\tlong enough", "\tab\tcd", "ab\tcd\tthird", "é\tüb"]
    got = [(r.input, r.output, r.ok) for r in ex.tsv_pairs(spark.createDataFrame([(x,) for x in lines], "value string")).collect()]
    assert got == [("ab", "cd", True), ("one field", "", False), ("a", "long enough", False), ("ab", "cd", True), ("ab", "cd", True), ("é", "üb", True)]


def test_document_pages(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"first page of text\fsecond page\f   ")
    pages = ex.read_document_pages(spark, str(tmp_path), lambda b: b.decode().split("\f")).orderBy("page_number").collect()
    assert [(r.page_number, r.text) for r in pages] == [(1, "first page of text"), (2, "second page")]


def test_streams(spark, folder):
    rows_ = live.stream_of(spark, folder, "raw_data").select("content_hash")
    once = live.drained(live.fresh_rows(rows_, "content_hash"), "test-dedup")
    want = spark.read.parquet(f"{folder}/raw_data.parquet").select("content_hash").distinct().count()
    assert once.count() == want
    ev = live.windowed_counts(live.stream_of(spark, folder, "events"))
    assert ev.isStreaming and set(ev.columns) == {"window", "event_type", "n"}
