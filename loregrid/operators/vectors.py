"""TF-IDF weights, cosine search in a collection, and the sparse inverted index."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loregrid.functions.text import index_tokens, tokenize
from loregrid.operators.retrieval import top
from loregrid.session import written

#: Dense queries sent to the tasks at once, and vectors and queries of one matrix of scores; they bound memory, not results.
QUERY_BLOCK, TILE = 16384, 1024


def _tf(df: DataFrame, key: str, text: str, split=tokenize) -> DataFrame:
    words = df.select(key, F.explode(split(F.col(text))).alias("term"))
    return words.groupBy(key, "term").agg(F.count("*").alias("tf"))


def weights(entries: DataFrame, key: str, text: str, index: DataFrame | None = None, split=tokenize) -> DataFrame:
    """(key, term, w): tf / length * (ln(N / df) + 1), with N and df of `index` (entries themselves if None)."""
    tf = _tf(entries, key, text, split)
    base = entries if index is None else index
    df = (tf if index is None else _tf(index, key, text, split)).groupBy("term").agg(F.count("*").alias("df"))
    n = base.select(F.count("*").alias("n")).scalar()
    lengths = tf.groupBy(key).agg(F.sum("tf").alias("len"))
    idf = F.coalesce(F.ln(n / F.col("df")) + 1, F.lit(1.0))
    return tf.join(df, "term", "left").join(lengths, key).select(key, "term", (F.col("tf") / F.col("len") * idf).alias("w"))


def collection_search(entries: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, entry_id, score): cosine of TF-IDF vectors; zeros go, ties to the larger id."""
    index = entries.select(F.col("entry_id").alias("id"), "content")
    w = weights(index, "id", "content")
    asked = queries.select(F.col("query_id").alias("id"), F.col("text").alias("content"))
    q = weights(asked, "id", "content", index).select(F.col("id").alias("query_id"), "term", F.col("w").alias("qw"))
    # terms outside the vocabulary of the collection have no place in the vectors
    q = q.join(w.select("term").distinct(), "term", "left_semi")
    norms = w.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    qnorms = q.groupBy("query_id").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qnorm"))
    dots = w.join(q, "term").groupBy("query_id", "id").agg(F.sum(F.col("w") * F.col("qw")).alias("dot"))
    score = F.round(F.col("dot") / (F.col("norm") * F.col("qnorm")), 6)
    scored = dots.join(norms, "id").join(qnorms, "query_id").select("query_id", F.col("id").alias("entry_id"), score.alias("score"))
    return top(scored.filter("score > 0"), k, F.desc("score"), F.desc("entry_id")).select("query_id", "rank", "entry_id", "score")


def cosine(a: str, b: str) -> F.Column:
    """Of two dense vectors; 0 if lengths differ or one has no magnitude."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    dot = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    norm = lambda c: F.sqrt(total(F.transform(c, lambda x: x.cast("double") * x.cast("double"))))
    return F.when((F.size(a) == F.size(b)) & (norm(a) * norm(b) > 0), dot / (norm(a) * norm(b))).otherwise(0.0)


def _units(vectors: pd.Series) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: places of the vectors and the vectors at length one; those without a magnitude are zeros."""
    sizes = np.array([-1 if v is None else len(v) for v in vectors])
    out = {}
    for size in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == size)
        m = np.stack(list(vectors.iloc[at])).astype(np.float64)
        norm = np.sqrt((m * m).sum(axis=1))
        sound = np.isfinite(norm) & (norm > 0)
        out[int(size)] = at, np.where(sound[:, None], m, 0.0) / np.where(sound, norm, 1.0)[:, None]
    return out


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row by score, ties to the smaller id; ids are a row for all or one for each."""
    ids = np.broadcast_to(ids, scores.shape)
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def _scan(block: pd.DataFrame, k: int):
    """The best k vectors of a task for each query of a block, the task's vectors read tile by tile."""
    query_ids, n = block["query_id"].to_numpy(np.int64), len(block)
    units = _units(block["qv"])

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # scores in units of the fifth decimal; a place that nothing fills stays at the lowest
        none = np.iinfo(np.int32).min
        score, vec = np.full((n, k), none, np.int64), np.zeros((n, k), np.int64)
        for pdf in batches:
            for a in range(0, len(pdf), TILE):
                tile = pdf.iloc[a : a + TILE].sort_values("vec_id")
                ids, own = tile["vec_id"].to_numpy(np.int64), _units(tile["embedding"])
                place = np.arange(len(ids))
                for b in range(0, n, TILE):
                    rows = slice(b, min(n, b + TILE))
                    cosines = np.zeros((rows.stop - b, len(ids)))
                    for size in own.keys() & units.keys():
                        q_at, q = units[size]
                        inside = slice(*np.searchsorted(q_at, [b, rows.stop]))
                        cosines[np.ix_(q_at[inside] - b, own[size][0])] = q[inside] @ own[size][1].T
                    whole = (np.sign(cosines) * np.floor(np.abs(cosines) * 1e5 + 0.5)).astype(np.int64)
                    # one number for score and place, so that ties go to the smaller id
                    whole = np.where(query_ids[rows, None] == ids, none, whole) * len(ids) - place
                    if len(ids) > k:
                        whole = -np.partition(-whole, k - 1, axis=1)[:, :k]
                    s = -(-whole // len(ids))
                    near = ids[s * len(ids) - whole]
                    score[rows], vec[rows] = _best(np.hstack([score[rows], s]), np.hstack([vec[rows], near]), k)
        at, rank = np.nonzero(score > none)
        yield pd.DataFrame({"query_id": query_ids[at], "vec_id": vec[at, rank], "score": score[at, rank] / 1e5})

    return scan


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): for queries (query_id, qv) the k vectors (vec_id, embedding) of best cosine, of all there are.

    Scores have five decimals; ties go to the smaller id, a vector is no neighbour of itself. Queries go to the tasks
    in blocks of bounded size, each block in one pass over the vectors; tasks keep k vectors for each query, which are
    merged by query. No group holds more than k rows for each task.
    """
    known = vectors.filter("vec_id IS NOT NULL").select("vec_id", "embedding")
    asked = written(queries.filter("query_id IS NOT NULL").select("query_id", "qv"), "dense-queries")
    blocks = -(-asked.count() // QUERY_BLOCK)
    if blocks > 1:
        asked = asked.withColumn("block", F.monotonically_increasing_id() % blocks)
        asked = written(asked.repartition(blocks, "block").sortWithinPartitions("block"), "query-blocks")
    parts = []
    for i in range(max(1, blocks)):
        block = (asked.filter(F.col("block") == i) if blocks > 1 else asked).select("query_id", "qv").toPandas()
        near = known.mapInPandas(_scan(block, k), "query_id bigint, vec_id bigint, score double")
        best = top(near, k, F.desc("score"), F.col("vec_id")).select("query_id", "rank", "vec_id", "score")
        parts.append(written(best, "nearest") if blocks > 1 else best)
    return reduce(DataFrame.unionByName, parts)


def inverted_index(pairs: DataFrame) -> DataFrame:
    """(source_id, term, tfidf_score) over input and output of pairs (source_id, input, output)."""
    text = F.concat_ws(" ", F.coalesce("input", F.lit("")), F.coalesce("output", F.lit("")))
    docs = pairs.select("source_id", text.alias("text"))
    return weights(docs, "source_id", "text", split=index_tokens).withColumnRenamed("w", "tfidf_score")


def index_search(index: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, source_id, score): sums of scores over the distinct terms of a query."""
    q = queries.select("query_id", F.explode(F.array_distinct(index_tokens(F.col("text")))).alias("term"))
    scored = index.join(q, "term").groupBy("query_id", "source_id").agg(F.round(F.sum("tfidf_score"), 6).alias("score"))
    return top(scored, k, F.desc("score"), F.col("source_id")).select("query_id", "rank", "source_id", "score")
