"""Crawls, processing runs, imports, and agents that learn from a stream."""

import random
import time

import pytest
from pyspark.sql import functions as F

from loregrid.functions import arrow as ax
from loregrid.operators import context as cx
from loregrid.operators import pipeline as pl
from loregrid.operators import retrieval as rt
from loregrid.operators.crawl import reached
from loregrid.sources import examples as ex
from loregrid.streaming import live

RAW = "id long, title string, content string, content_hash string, status string"
KB = "idx long, input string, output struct<format:string,value:string>, weight float"


def test_crawl_against_brute_force(spark):
    random.seed(3)
    edges = [(f"u{random.randint(0, 40)}", f"u{random.randint(0, 40)}") for _ in range(60)] + [("hub", f"u{i}") for i in range(20)] + [(None, "u1"), ("u1", None)]
    links = spark.createDataFrame(edges, "src string, dst string")
    seeds = spark.createDataFrame([("hub",), ("u33",), ("hub",), (None,), ("alone",)], "url string")
    for depth in (0, 1, 3):
        want, now = {"hub": 0, "u33": 0, "alone": 0}, ["hub", "u33"]
        for d in range(1, depth + 1):
            now = [b for a in now for x, b in edges if x == a and b and b not in want and not want.setdefault(b, d) is None]
        assert {r.url: r.depth for r in reached(links, seeds, depth).collect()} == want
    assert reached(links, seeds.limit(0), 3).count() == 0 and reached(links.limit(0), seeds, 3).count() == 3


def test_process_pending(spark):
    text = "The old mill grinds the grain of the valley. It stands beside the river since long ago. Boats carry the flour to the town. People cross the bridge every day."
    rows = [
        (1, "The mill", text, "h1", "pending"), (2, "The mill", text, "h2", "pending"), (3, None, "�" * 50, "h3", "pending"), (4, "x", None, None, "pending"),
        (5, "Done", text + " And more of it is said here.", "h5", "approved"), (6, "", " \n ", "h6", "pending"), (7, "No", text, "h7", "rejected"),
    ]
    raw = spark.createDataFrame(rows, RAW)
    run = pl.process_pending(raw, "sentence")
    found = sorted((r.raw_id, r["at"], r.input, r.added) for r in run.pairs.collect())
    assert [(i, added) for i, _, _, added in found] == [(1, True)] * 4 + [(2, False)] * 4
    assert found[2][2:] == ("Was ist The mill?", True) and found[3][2] == "The mill?"
    assert tuple(run.counts.first()) == (8, 4)
    assert {r.id: r.status for r in run.raw.collect()} == {1: "approved", 2: "approved", 3: "approved", 4: "approved", 5: "approved", 6: "approved", 7: "rejected"}
    # what a run stored is not added by the next
    stored = run.pairs.filter("added").select((F.col("at") + 100).alias("id"), F.lit("t").alias("title"), F.lit("").alias("content"), F.col("hash").alias("content_hash"), F.lit("approved").alias("status"))
    assert tuple(pl.process_pending(raw.unionByName(stored), "sentence").counts.first()) == (8, 0)
    assert tuple(pl.process_pending(raw.limit(0)).counts.first()) == (0, 0)


def test_added_to_kb(spark):
    kb = spark.createDataFrame([(0, "a", ("Text", "b"), 1.0)], KB)
    approved = spark.createDataFrame([(9, "c", "d", 2.0, False), (3, "e", None, 1.0, None), (5, "f", "g", 1.0, True)], "id long, input string, output string, weight double, added_to_kb boolean")
    out, marked = pl.added_to_kb(kb, approved)
    assert [(r.idx, r.input, r.output.value) for r in out.orderBy("idx").collect()] == [(0, "a", "b"), (1, "e", None), (2, "c", "d")]
    assert [r.added_to_kb for r in marked.collect()] == [True] * 3
    assert pl.added_to_kb(out, marked)[0].count() == 3


def test_training_items(spark):
    lines = ['{"input": "a", "output": "b"}', '{"input": "c", "output": "# d", "format": "markdown", "weight": 0.5, "category_id": 7}', '{"input": "e", "output": "{}", "format": "json"}']
    items = ex.training_items(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert [tuple(r) for r in items.orderBy("input").collect()] == [(None, "a", "b", "text", 1.0), (7, "c", "# d", "markdown", 0.5), (None, "e", "{}", "json", 1.0)]
    assert [(r.output.format, r.weight) for r in ex.as_examples(items).orderBy("input").collect()] == [("Text", 1.0), ("Markdown", 0.5), ("Text", 1.0)]
    with pytest.raises(Exception, match="no training item"):
        ex.training_items(spark.createDataFrame([('{"input": "a"}',)], "value string")).collect()


def test_document_text(spark):
    pages = spark.createDataFrame([("f", 2, "second  page"), ("f", 1, "eﬃcient\n7\n"), ("f", 3, " "), ("g", 1, None)], "file string, page_number int, text string")
    assert [tuple(r) for r in ex.document_text(pages).collect()] == [("f", "efficient\n\nsecond page")]


def test_context_agent(spark):
    kb = spark.createDataFrame([(0, "deep lake", ("Text", "nine metres"), 1.0), (1, "wide mill", ("Text", "ten metres"), 1.0)], KB)
    turns = spark.createDataFrame([(1, 1, "deep lake", "nine"), (1, 2, "and how wide", "?"), (1, 3, "unknown words", "?"), (2, 1, "unknown words", None), (3, 1, None, None)], "conv_id long, turn long, question string, answer string")
    got = {(r.conv_id, r.turn): r.response for r in cx.ContextAgent(rt.Bm25Agent.train(kb), 1).predict(turns).collect()}
    # the third turn finds something only through the question before it
    assert got == {(1, 1): "nine metres", (1, 2): "nine metres", (1, 3): "ten metres", (2, 1): rt.NO_MATCH, (3, 1): rt.NO_MATCH}
    sure = cx.ContextAgent(rt.ExactAgent(kb), 0).confidence(turns)
    assert {(r.conv_id, r.turn): r.confidence for r in sure.collect()}[1, 1] == 1.0


def test_can_answer(spark):
    sure = spark.createDataFrame([(1, 0.5), (2, 0.51)], "query_id long, confidence double")
    assert {r.query_id: r.can_answer for r in rt.can_answer(sure).collect()} == {1: False, 2: True}


def test_append_is_training_on_all(spark):
    random.seed(4)
    rows = [(i, " ".join(random.choice("red green blue black".split()) for _ in range(4)), ("Text", str(i)), 1.0) for i in range(40)]
    kb = spark.createDataFrame(rows, KB)
    asks = spark.createDataFrame([(0, "red green"), (1, "black")], "query_id long, text string")
    one = rt.Bm25Agent.train(kb)
    two = rt.Bm25Agent.train(kb.filter("idx < 15")).append(kb.filter("idx >= 15"))
    scores = lambda a: sorted(map(tuple, a.scores(asks).collect()))
    assert scores(one) == scores(two) and scores(one)


def test_agent_learns_from_a_stream(spark, tmp_path):
    rows = [(i, f"word{chr(97 + i)} common", ("Text", str(i)), 1.0) for i in range(6)]
    for k in range(3):
        spark.createDataFrame(rows[2 * k : 2 * k + 2], KB).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(KB).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    sizes = []
    agent = live.retrained(stream, rt.Bm25Agent.train(spark.createDataFrame([], KB)), lambda a: sizes.append(a.kb.count()))
    assert sizes == [2, 4, 6]
    asks = spark.createDataFrame([(0, "wordd"), (1, "common")], "query_id long, text string")
    assert {r.query_id: r.response for r in agent.predict(asks).collect()}[0] == "3"


def test_open_brackets_take_linear_time():
    text = "It is (so and never closed. " * 30_000
    began = time.perf_counter()
    assert ax.split_sentences(text) == [text.strip()]
    assert time.perf_counter() - began < 5
    assert ax.split_sentences("A (b. C) done. Then (E. F. G") == ["A (b. C) done. ", "Then (E. F. G"]


def test_entry_without_the_subpackage():
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; sys.modules['loregrid.llm'] = None\nimport __spark_entry__ as e\nassert not any(n[0] == 'p' and n[1].isdigit() for n in e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], capture_output=True).returncode == 0
