"""Exact, fuzzy and BM25 retrieval over a table of weighted (input, output) examples, batch first.

A knowledge base is a DataFrame (idx, input, output struct(format, value), weight); a batch of queries is a
DataFrame (query_id, text). Every answer is (query_id, rank, idx, confidence and the like); ties go to the
smallest idx. Rows with a null input or text match nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loregrid.functions.text import tokenize
from loregrid.session import written

NO_MATCH = "No matching answer found."
NO_DATA = "No training data available."


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows of each query, with their rank."""
    w = Window.partitionBy("query_id").orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def with_sentinel(queries: DataFrame, best: DataFrame, kb: DataFrame) -> DataFrame:
    """One row for each query: the answer of its best example, or the sentence that says there is none."""
    answers = best.join(kb.select("idx", "output"), "idx", "left").select("query_id", "idx", F.col("output.value").alias("response"))
    none = F.when(kb.select(F.count("*").alias("n")).scalar() == 0, F.lit(NO_DATA)).otherwise(F.lit(NO_MATCH))
    out = queries.select("query_id").join(answers, "query_id", "left")
    return out.select("query_id", "idx", F.when(F.col("idx").isNull(), none).otherwise(F.col("response")).alias("response"))


@dataclass(frozen=True)
class ExactAgent:
    """Inputs equal but for case; every hit has confidence 1."""

    kb: DataFrame

    def append(self, more: DataFrame) -> ExactAgent:
        return replace(self, kb=self.kb.unionByName(more))

    def hits(self, queries: DataFrame) -> DataFrame:
        q = queries.select("query_id", F.lower("text").alias("low"))
        return self.kb.select("idx", F.lower("input").alias("low")).join(q, "low").select("query_id", "idx")

    def predict_top_n(self, queries: DataFrame, n: int) -> DataFrame:
        return top(self.hits(queries), n, F.col("idx")).select("query_id", "rank", "idx", F.lit(1.0).alias("confidence"))

    def predict(self, queries: DataFrame) -> DataFrame:
        return with_sentinel(queries, self.hits(queries).groupBy("query_id").agg(F.min("idx").alias("idx")), self.kb)

    def confidence(self, queries: DataFrame) -> DataFrame:
        hit = self.hits(queries).select("query_id").distinct().withColumn("confidence", F.lit(1.0))
        return queries.select("query_id").join(hit, "query_id", "left").fillna(0.0, ["confidence"])


@dataclass(frozen=True)
class FuzzyAgent:
    """Inputs within a Levenshtein distance: `max_distance`, and `factor` times the bytes of the lower-case query.

    Candidates come from an equi-join, not from all pairs. A query that may differ in t places is cut into t + 1
    pieces, of which one must stand unchanged in every match, moved by at most t; pieces are compared by their
    first characters (up to PROBE). A query shorter than t + 1 is joined by length instead. Both lose nothing.
    """

    kb: DataFrame
    max_distance: int | None = None
    factor: float | None = 0.3

    PROBE = 4

    def append(self, more: DataFrame) -> FuzzyAgent:
        return replace(self, kb=self.kb.unionByName(more))

    def _bound(self, low: Column) -> Column:
        limits = []
        if self.factor is not None:
            limits.append((F.octet_length(low).cast("float") * F.lit(self.factor).cast("float")).cast("int"))
        if self.max_distance is not None:
            limits.append(F.lit(self.max_distance))
        if not limits:
            return F.lit(2**31 - 2)
        return limits[0] if len(limits) == 1 else F.least(*limits)

    def hits(self, queries: DataFrame) -> DataFrame:
        """(query_id, idx, distance) of every match."""
        q = queries.select("query_id", F.lower("text").alias("q")).filter("q IS NOT NULL")
        q = q.withColumns({"t": self._bound(F.col("q")), "n": F.char_length("q")}).groupBy("q", "t", "n").agg(F.collect_set("query_id").alias("ids"))
        kb = self.kb.select("idx", F.lower("input").alias("k")).filter("k IS NOT NULL")
        # a text travels under its hash; texts that share one are told apart when distances are taken
        texts = kb.select("k").distinct().withColumns({"kid": F.xxhash64("k"), "m": F.char_length("k")})
        # where piece i of t + 1 begins, and its first characters
        begins = F.transform(F.sequence(F.lit(0), F.least("t", "n")), lambda i: F.floor(i * F.col("n") / (F.col("t") + 1)).cast("int"))
        ends = lambda i: F.floor((i + 1) * F.col("n") / (F.col("t") + 1)).cast("int")
        piece = F.transform(begins, lambda b, i: F.struct(b.alias("at"), F.substring("q", b + 1, F.least(F.lit(self.PROBE), ends(i) - b)).alias("key")))
        by_piece = q.filter("t < n").select("q", "t", "n", F.inline(piece))
        # only grams as long as a piece of some query: at most PROBE lengths
        sizes = by_piece.agg(F.coalesce(F.collect_set(F.char_length("key")), F.array().cast("array<int>"))).scalar()
        grams = texts.select("k", "kid", "m", F.explode(sizes).alias("g")).filter("g <= m")
        grams = grams.select("kid", "m", F.posexplode(F.transform(F.sequence(F.lit(1), F.col("m") - F.col("g") + 1), lambda i: F.substring("k", i, F.col("g")))).alias("p", "key"))
        near = (F.abs(F.col("p") - F.col("at")) <= F.col("t")) & (F.abs(F.col("m") - F.col("n")) <= F.col("t"))
        pairs = by_piece.join(grams, "key").filter(near).select("q", "t", "kid").distinct()
        pairs = pairs.join(texts.select("kid", "k"), "kid").select("q", "t", "k")
        # queries that may change altogether: all lengths within the bound
        longest = texts.agg(F.coalesce(F.max("m"), F.lit(0)).alias("m")).scalar()
        reach = F.least(F.col("n").cast("bigint") + F.col("t"), longest).cast("int")
        lengths = q.filter("t >= n").select("q", "t", F.explode(F.sequence(F.lit(0), reach)).alias("m"))
        pairs = pairs.unionByName(lengths.join(texts, "m").select("q", "t", "k")).withColumn("distance", F.expr("levenshtein(q, k, t)"))
        good = pairs.filter("distance >= 0")
        ids = q.select("q", "t", F.explode("ids").alias("query_id"))
        return good.join(ids, ["q", "t"]).join(kb, "k").select("query_id", "idx", "distance")

    def _scored(self, queries: DataFrame) -> DataFrame:
        size = queries.select("query_id", F.greatest(F.lit(1), F.octet_length(F.lower("text"))).alias("size"))
        sure = F.greatest(F.lit(0.0), 1 - F.col("distance") / F.col("size"))
        return self.hits(queries).join(size, "query_id").select("query_id", "idx", "distance", sure.alias("confidence"))

    def predict_top_n(self, queries: DataFrame, n: int) -> DataFrame:
        return top(self._scored(queries), n, F.col("distance"), F.col("idx")).select("query_id", "rank", "idx", "distance", "confidence")

    def predict(self, queries: DataFrame) -> DataFrame:
        best = self.hits(queries).groupBy("query_id").agg(F.min(F.struct("distance", "idx")).alias("b")).select("query_id", "b.idx")
        return with_sentinel(queries, best, self.kb)

    def confidence(self, queries: DataFrame) -> DataFrame:
        best = self._scored(queries).groupBy("query_id").agg(F.max("confidence").alias("confidence"))
        return queries.select("query_id").join(best, "query_id", "left").fillna(0.0, ["confidence"])


def term_freq(kb: DataFrame, key: str = "idx", text: str = "input") -> DataFrame:
    return kb.select(key, F.explode(tokenize(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def doc_freq(tf: DataFrame) -> DataFrame:
    return tf.groupBy("term").agg(F.count("*").alias("df"))


def postings(kb: DataFrame) -> DataFrame:
    """(term, idx, tf, dl, weight): each term of each example with the words and the weight of the example."""
    rows = kb.select("idx", "weight", tokenize(F.col("input")).alias("words"))
    words = rows.select("idx", "weight", F.size("words").cast("bigint").alias("dl"), F.explode("words").alias("term"))
    return words.groupBy("term", "idx", "dl", "weight").agg(F.count("*").alias("tf")).select("term", "idx", "tf", "dl", "weight")


@dataclass(frozen=True)
class Bm25Agent:
    """BM25 times weight. The index is one table of postings, written once; what is appended is a further part of it.

    Only postings of query terms are ever joined, and they carry all a score needs. A term said twice in a query
    counts twice. Examples without a word count in N and in the average length.
    """

    kb: DataFrame
    index: DataFrame
    k1: float = 1.2
    b: float = 0.75

    @classmethod
    def train(cls, kb: DataFrame, k1: float = 1.2, b: float = 0.75) -> Bm25Agent:
        return cls(kb, written(postings(kb), "postings"), k1, b)

    def append(self, more: DataFrame) -> Bm25Agent:
        """The agent with more examples; the index that is there is not read."""
        part = written(postings(more), "postings")
        return replace(self, kb=self.kb.unionByName(more), index=self.index.unionByName(part))

    @property
    def stats(self) -> DataFrame:
        """(n, words, avgdl): examples, words of all, words of one on average."""
        n = self.kb.select(F.count("*").alias("n")).scalar()
        words = self.index.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("words"))
        return words.select(n.alias("n"), "words", (F.col("words") / n).alias("avgdl"))

    def terms(self, queries: DataFrame) -> DataFrame:
        return queries.select("query_id", F.explode(tokenize(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))

    def scores(self, queries: DataFrame) -> DataFrame:
        """(query_id, idx, score) of every example with a score over 0, rounded to six places."""
        stats = self.stats
        n, avgdl = stats.select("n").scalar(), stats.select("avgdl").scalar()
        q = self.terms(queries)
        hits = self.index.join(q.select("term").distinct(), "term", "left_semi")
        idf = F.ln(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
        q = q.join(doc_freq(hits), "term").select("query_id", "term", (F.col("times") * idf).alias("w"))
        norm = F.col("tf") + self.k1 * (1 - self.b + self.b * F.col("dl") / avgdl)
        part = F.col("w") * F.col("tf") * (self.k1 + 1) / norm
        summed = hits.join(q, "term").groupBy("query_id", "idx").agg(F.sum(part).alias("s"), F.max("weight").alias("weight"))
        score = F.round(F.col("s") * F.col("weight").cast("double"), 6)
        return summed.select("query_id", "idx", score.alias("score")).filter("score > 0")

    def predict_top_n(self, queries: DataFrame, n: int) -> DataFrame:
        sizes = self.terms(queries).groupBy("query_id").agg(F.sum("times").alias("terms"))
        best = top(self.scores(queries), n, F.desc("score"), F.col("idx")).join(sizes, "query_id")
        sure = F.least(F.lit(1.0), F.col("score") / F.greatest(F.lit(1), F.col("terms")))
        return best.select("query_id", "rank", "idx", "score", F.round(sure, 6).alias("confidence"))

    def predict(self, queries: DataFrame) -> DataFrame:
        return with_sentinel(queries, self.predict_top_n(queries, 1).select("query_id", "idx"), self.kb)

    def confidence(self, queries: DataFrame) -> DataFrame:
        best = self.predict_top_n(queries, 1).select("query_id", "confidence")
        return queries.select("query_id").join(best, "query_id", "left").fillna(0.0, ["confidence"])


def can_answer(confidences: DataFrame) -> DataFrame:
    """(query_id, can_answer) of what `confidence` of an agent gave: more sure than not."""
    return confidences.select("query_id", (F.col("confidence") > 0.5).alias("can_answer"))


def ensemble(answers: list[tuple[str, DataFrame]]) -> DataFrame:
    """(query_id, agent, response, confidence): the first agent in order whose answer is not a sentinel, else the first."""
    parts = [df.select("query_id", F.lit(i).alias("place"), F.lit(name).alias("agent"), "response") for i, (name, df) in enumerate(answers)]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    sure = F.when(F.col("response").isin(NO_MATCH, NO_DATA), 0.0).otherwise(1.0)
    union = union.withColumn("confidence", sure)
    best = F.min_by(F.struct("agent", "response", "confidence"), F.struct(-F.col("confidence"), F.col("place")))
    return union.groupBy("query_id").agg(best.alias("b")).select("query_id", "b.*")
