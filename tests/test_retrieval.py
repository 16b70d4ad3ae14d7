"""Retrievers on small knowledge bases, BM25 and fuzzy lookup against naive versions."""

import math
import random

import numpy as np
import pytest

from loregrid.operators import context as cx
from loregrid.operators import retrieval as rt
from loregrid.operators import vectors as vx
from loregrid.plans import retrieval as plans
from loregrid.session import table

KB = "idx long, input string, output struct<format:string,value:string>, weight float"


def kb(spark, *rows):
    return spark.createDataFrame([(i, a, ("Text", b), float(w)) for i, (a, b, w) in enumerate(rows)], KB)


def asks(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")


def answers(df):
    return {r.query_id: r.response for r in df.collect()}


def test_exact(spark):
    agent = rt.ExactAgent(kb(spark, ("hello", "first", 1), ("Hello", "second", 1), ("CAFÉ", "shop", 1), (None, "x", 1)))
    got = answers(agent.predict(asks(spark, "HELLO", " hello", "café", None)))
    assert got == {0: "first", 1: rt.NO_MATCH, 2: "shop", 3: rt.NO_MATCH}
    assert [r.idx for r in agent.predict_top_n(asks(spark, "hello"), 2).orderBy("rank").collect()] == [0, 1]


def test_empty_knowledge_base(spark):
    agent = rt.ExactAgent(kb(spark, ("a", "b", 1)).limit(0))
    assert answers(agent.predict(asks(spark, "a"))) == {0: rt.NO_DATA}


def test_fuzzy(spark):
    agent = rt.FuzzyAgent(kb(spark, ("hello", "Hi there!", 1), ("goodbye", "See you", 1), ("how are you", "fine", 1)))
    assert answers(agent.predict(asks(spark, "helo", "xxxxxxxxx"))) == {0: "Hi there!", 1: rt.NO_MATCH}
    assert {r.query_id: r.confidence for r in agent.confidence(asks(spark, "helo")).collect()} == {0: 0.75}


@pytest.mark.parametrize("kw", [{}, {"factor": 0.1}, {"max_distance": 1, "factor": None}, {"max_distance": 5, "factor": 0.5}, {"max_distance": None, "factor": None}])
def test_fuzzy_against_all_pairs(spark, kw):
    random.seed(1)
    words = ["".join(random.choice("abc") for _ in range(random.randint(0, 9))) for _ in range(40)]
    base = spark.createDataFrame([(i, w, ("Text", w), 1.0) for i, w in enumerate(words)], KB)
    agent = rt.FuzzyAgent(base, **kw)
    queries = [w[:3] + w[4:] for w in words[:15]]
    got = {(r.query_id, r.idx, r.distance) for r in agent.hits(asks(spark, *queries)).collect()}

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    factor, most = kw.get("factor", 0.3), kw.get("max_distance")
    bound = lambda q: min(int(len(q) * factor) if factor is not None else 10**9, most if most is not None else 10**9)
    want = {(i, j, lev(q, w)) for i, q in enumerate(queries) for j, w in enumerate(words) if lev(q, w) <= bound(q)}
    assert got == want


def test_bm25_weights_and_sentinels(spark):
    agent = rt.Bm25Agent.train(kb(spark, ("programming language", "low", 0.1), ("programming language", "high", 10.0), ("rust systems", "suppressed", 0.0)))
    assert answers(agent.predict(asks(spark, "programming", "rust", "quantum", ""))) == {0: "high", 1: rt.NO_MATCH, 2: rt.NO_MATCH, 3: rt.NO_MATCH}
    assert agent.predict_top_n(asks(spark, "programming"), 0).isEmpty()
    top = agent.predict_top_n(asks(spark, "programming language"), 5).orderBy("rank").collect()
    assert [r.idx for r in top] == [1, 0] and top[0].confidence >= top[1].confidence


def test_bm25_against_naive(spark):
    random.seed(2)
    docs = [" ".join(random.choice("red green blue black white pink".split()) for _ in range(random.randint(0, 8))) for _ in range(25)]
    agent = rt.Bm25Agent.train(kb(spark, *[(d, "x", 1 + i % 3) for i, d in enumerate(docs)]))
    queries = ["red red green", "pink", "blue black none"]
    got = {(r.query_id, r.idx): r.score for r in agent.scores(asks(spark, *queries)).collect()}
    toks = [d.split() for d in docs]
    avg = sum(map(len, toks)) / len(docs)
    want = {}
    for qi, q in enumerate(queries):
        for i, t in enumerate(toks):
            s = 0.0
            for term in q.split():
                df, tf = sum(term in x for x in toks), t.count(term)
                if tf:
                    s += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / avg))
            if s * (1 + i % 3) > 0:
                want[qi, i] = round(s * (1 + i % 3), 6)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_context(spark):
    turns = spark.createDataFrame([(1, i, f"q{i}", f"a{i}") for i in (1, 2, 3)], "conv_id long, turn long, question string, answer string")
    rows = cx.window(turns, 2)
    text = lambda style: rows.filter("turn = 3").select(cx.rendered(rows.history, style).alias("t")).first().t
    assert text("qa_pairs") == "Q: q1 A: a1 Q: q2 A: a2 "
    assert text("list") == "[q1 -> a1, q2 -> a2]"
    assert text("sentence") == "Previous questions and answers: q1 - a1; q2 - a2"
    assert cx.window(turns, 0).selectExpr("max(size(history)) AS n").first().n == 0
    with pytest.raises(ValueError):
        cx.rendered(rows.history, "verse")


def test_ensemble_takes_first_that_answers(spark):
    q = asks(spark, "a")
    hit = spark.createDataFrame([(0, "yes")], "query_id long, response string")
    miss = spark.createDataFrame([(0, rt.NO_MATCH)], "query_id long, response string")
    assert rt.ensemble([("one", miss), ("two", hit), ("three", hit)]).first().agent == "two"
    assert rt.ensemble([("one", miss), ("two", miss)]).first()[:] == (0, "one", rt.NO_MATCH, 0.0)
    assert q.count() == 1


def brute_nearest(rows, queries, k):
    """rows, queries: (id, vector or None)."""

    def cosine(a, b):
        if a is None or b is None or len(a) != len(b):
            return 0.0
        size = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return sum(x * y for x, y in zip(a, b)) / size if size > 0 else 0.0

    out = {}
    for q, a in queries:
        scored = sorted((-round(cosine(a, b), 5), v) for v, b in rows if v != q)[:k]
        out.update({(q, i): (v, -s) for i, (s, v) in enumerate(scored, 1)})
    return out


def near(got, want):
    found = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in got.collect()}
    assert found.keys() == want.keys()
    assert all(found[k][0] == v and abs(found[k][1] - s) < 1.1e-5 for k, (v, s) in want.items())


def test_cosine_topk_searches_every_label(spark, folder):
    rows = [(r.vec_id, np.array(r.embedding, np.float64)) for r in table(spark, folder, "embeddings").collect()]
    near(plans.cosine_topk(spark, folder), brute_nearest(rows, [r for r in rows if r[0] % 50 == 0], 5))


def test_nearest_odd_vectors_ties_and_blocks(spark, monkeypatch):
    rows = [(i, [float(i % 7), float(i % 3), 1.0]) for i in range(60)] + [(60, None), (61, []), (62, [0.0, 0.0, 0.0]), (63, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    asked = df.filter("vec_id % 5 = 0 OR vec_id > 60").selectExpr("vec_id AS query_id", "embedding AS qv")
    want = brute_nearest(rows, [r for r in rows if r[0] % 5 == 0 or r[0] > 60], 4)
    near(vx.nearest(df, asked, 4), want)
    monkeypatch.setattr(vx, "QUERY_BLOCK", 4)
    monkeypatch.setattr(vx, "TILE", 3)
    near(vx.nearest(df, asked, 4), want)
    assert vx.nearest(df, asked.limit(0), 4).count() == 0
