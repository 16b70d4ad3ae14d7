"""Keyword-stuffed and link-list pages.

Bagged decision trees on content and link features, trained on weak labels: rules with a wide margin label the pages
they are sure of, on both sides, and leave the others open; the trees learn from those and judge all. Page predictions
are then smoothed with the spam rate of their host: the odds of a page move by the odds of the other pages of its host.
Features come from one pass over the texts; only they travel on, one short row for each page.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loregrid.llm.pair_defects import FUNCTION_WORDS
from loregrid.session import written

#: Labelled pages of each class the trees are trained on, at most; the judgement covers every page.
TRAIN_ROWS = 10_000
TREES, DEPTH = 25, 6
#: The power of the host's odds in those of a page, and so many pages of average rate that every host is given.
HOST_WEIGHT, HOST_PRIOR = 0.3, 10
#: One labelled page in so many is held back from training.
HELD_BACK = 5
#: Pages of fewer words are no lists of anything.
LEAST_WORDS = 5
#: The share of a sentence's words that its keyword makes up where it is made of it.
ECHO = 0.1

FEATURES = ["ended", "function", "loose_function", "bare", "linked", "sourced", "stamped", "coded", "distinct", "top", "separators", "tags", "digits", "line_words", "size", "echo", "again"]

_WORD = re.compile(r"[^\W_]+")
_PIECES = re.compile(r"(?<=[.!?…])[\"'»”)]*\s+")
_ENDED = re.compile(r"[.!?…][\"'»”)*_`]*\s*$")
_LINK = re.compile(r"https?://|\bwww\.|href=|\]\(", re.I)
_SOURCE = re.compile(r"^\s*\[?\d+[\].)]\s")
_STAMP = re.compile(r"^\s*[\[(]?(?:\d{4}-\d\d-\d\d[T ])?\d{1,2}:\d\d(?::\d\d)?\b")
_CODE = re.compile(r"[;{}]\s*(?://.*|#.*)?$|^\s*(?:let|var|const|def|fn|if|for|while|return|import|from|SELECT|INSERT|UPDATE|\$|>>>)\b.*[=(:$]|\w\([^)]*\)\s*[;{:]?$|^\s*(?://|/\*)")
_COMMON = frozenset(w for words in FUNCTION_WORDS.values() for w in words.split()) | frozenset("in en de la que von wer über per to an il sa son se".split())


def page_features(text: str) -> list[float]:
    """The features of one text, in the order of FEATURES; shares are of its words.

    ended: words in closed sentences, loose_function: function words among the others, bare: words in rows without
    any, linked: in lines with links, sourced, stamped, coded: in lines of sources, logs, code. top: uses of the
    commonest content word, echo: words of sentences that are made of it, again: words that a sentence says twice.
    """
    n = ended = common = loose = loose_common = bare = linked = sourced = stamped = coded = seps = digits = lines = again = 0
    seen: Counter[str] = Counter()
    told: list[list[str]] = []
    for line in text.split("\n"):
        low = line.lower()
        pieces = [_WORD.findall(x) for x in _PIECES.split(low)]
        k = sum(map(len, pieces))
        if not k:
            continue
        n += k
        lines += 1
        c = 0
        for words in pieces:
            seen.update(words)
            told.append(words)
            again += len(words) - len(set(words))
            c += sum(w in _COMMON for w in words)
        seps += line.count(",") + line.count(";") + line.count("|") + line.count("/") + line.count(">") + line.count(" - ")
        common += c
        closed = bool(_ENDED.search(line))
        if not closed and _LINK.search(line):
            if _SOURCE.match(line):
                sourced += k
            else:
                linked += k
            continue
        if _STAMP.match(line):
            stamped += k
        elif _CODE.search(line):
            coded += k
        if closed:
            ended += k
        else:
            tail = pieces[-1]
            ended += k - len(tail)
            loose += len(tail)
            t = sum(w in _COMMON for w in tail)
            loose_common += t
            if not t:
                bare += len(tail)
    if not n:
        return [0.0] * len(FEATURES)
    top, word = max(((v, w) for w, v in seen.items() if w not in _COMMON and len(w) > 1), default=(0, ""))
    digits = sum(v for w, v in seen.items() if w.isdigit())
    echo = 0
    # a word said three times in all is no keyword
    for words in told if top > 3 else ():
        uses = words.count(word)
        if uses > 1 and uses >= ECHO * len(words):
            echo += len(words)
    return [
        ended / n, common / n, loose_common / loose if loose else 0.3, bare / n, linked / n, sourced / n, stamped / n, coded / n,
        len(seen) / n, top / n, seps / n, text.count("#") / n, digits / n, n / lines, float(n), echo / n, again / n,
    ]


def features(pages: DataFrame, id_column: str = "doc_id", host_column: str = "source", text_column: str = "text") -> DataFrame:
    """(page, host, the features, words) of every page; a null text is an empty one, a null host is none."""
    schema = pa.schema([("page", pa.int64()), ("host", pa.string()), *[(f, pa.float32()) for f in FEATURES]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [page_features(t or "") for t in b.column("text").to_pylist()]
            columns = [pa.array(c, pa.float32()) for c in zip(*rows)] or [pa.array([], pa.float32())] * len(FEATURES)
            yield pa.RecordBatch.from_arrays([b.column("page"), b.column("host"), *columns], schema=schema)

    source = pages.select(F.col(id_column).cast("bigint").alias("page"), F.col(host_column).alias("host"), F.col(text_column).alias("text"))
    return source.mapInArrow(run, "page bigint, host string, " + ", ".join(f"{f} float" for f in FEATURES))


def weak_label() -> Column:
    """1 or 0 where a rule is sure, else null."""
    c = F.col
    ordered = c("stamped") + c("coded") + c("sourced")
    rows = (c("ended") < 0.2) & (c("digits") < 0.2)
    lists = (c("bare") > 0.7) | (c("linked") > 0.7) | (c("bare") + c("linked") > 0.75)
    stuffed = rows & (c("top") > 0.15)
    places = rows & (c("loose_function") < 0.25) & (c("distinct") < 0.5)
    preached = (c("echo") > 0.8) & (c("top") > 0.15) & (c("distinct") < 0.4)
    spam = (ordered < 0.1) & (c("size") >= 20) & (lists | stuffed | places | preached)
    calm = ((c("top") < 0.1) | (c("top") * c("size") < 3.5)) & (c("echo") < 0.3) & (c("bare") + c("linked") < 0.2)
    ham = (c("size") < LEAST_WORDS) | ((ordered > 0.6) & (c("top") < 0.1)) | (calm & ((c("ended") > 0.8) | (c("loose_function") > 0.35)))
    return F.when(spam & ~ham, 1.0).when(ham & ~spam, 0.0)


def _assembled(found: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(found)


def _held_back() -> Column:
    return F.pmod(F.xxhash64("page", F.lit("held back")), F.lit(HELD_BACK)) == 0


def train(found: DataFrame) -> RandomForestClassificationModel | None:
    """Trees from a bounded sample of the labelled pages, None where a class has no page."""
    labelled = found.withColumn("label", weak_label()).filter(F.col("label").isNotNull() & ~_held_back())
    sizes = {r.label: r.n for r in labelled.groupBy("label").agg(F.count("*").alias("n")).toLocalIterator()}
    if len(sizes) < 2:
        return None
    # a page is taken by the hash of its id, so that the sample is the same however the data lies
    share = F.coalesce(*[F.when(F.col("label") == k, F.lit(min(1.0, TRAIN_ROWS / n))) for k, n in sizes.items()])
    picked = labelled.filter(F.pmod(F.xxhash64("page"), F.lit(1_000_000)) < share * 1_000_000)
    weight = F.coalesce(*[F.when(F.col("label") == k, F.lit(1.0 / min(n, TRAIN_ROWS))) for k, n in sizes.items()])
    trees = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, subsamplingRate=0.7, featureSubsetStrategy="0.5", weightCol="weight", seed=7, cacheNodeIds=False)
    return trees.fit(_assembled(picked.withColumn("weight", weight * min(TRAIN_ROWS, sum(sizes.values())))))


def scored(found: DataFrame, model: RandomForestClassificationModel | None) -> DataFrame:
    """The features of `found` with `own`, what the trees say of each page; without trees the weak label, else 0."""
    if model is None:
        return found.withColumn("own", F.coalesce(weak_label(), F.lit(0.0)))
    return model.transform(_assembled(found)).withColumn("own", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def held_out(found: DataFrame) -> DataFrame:
    """(label, said, n): labels of the pages held back from training against what trees trained on the others say."""
    labelled = scored(found, train(found)).withColumn("label", weak_label()).filter(F.col("label").isNotNull() & _held_back())
    return labelled.groupBy("label", (F.col("own") > 0.5).cast("double").alias("said")).agg(F.count("*").alias("n"))


def judged(pages: DataFrame, id_column: str = "doc_id", host_column: str = "source", text_column: str = "text") -> DataFrame:
    """(page, own, rate, score, spam) of every page: its own prediction, its host's rate, both together, the verdict.

    A null or empty text and one of under LEAST_WORDS words is no spam; a null host has the average rate. Rows are
    judged one by one, copies included; an empty table gives no rows.
    """
    found = written(features(pages, id_column, host_column, text_column), "page-features")
    own = written(scored(found, train(found)).select("page", "host", "size", "own"), "page-scores")
    rates = own.filter("host IS NOT NULL").groupBy("host").agg(F.sum("own").alias("sum"), F.count("*").alias("n"))
    out = own.join(rates, "host", "left")
    base = own.agg(F.avg("own").alias("a")).select(F.greatest(F.coalesce("a", F.lit(0.0)), F.lit(1e-6))).scalar()
    rate = (F.coalesce("sum", "own") - F.col("own") + HOST_PRIOR * base) / (F.coalesce("n", F.lit(1)) - 1 + HOST_PRIOR)
    out = out.withColumn("rate", F.least(rate, F.lit(1 - 1e-6)))
    odds = lambda p: p / (1 - p)
    p = F.least(F.col("own"), F.lit(1 - 1e-6))
    joint = odds(p) * F.pow(odds(F.col("rate")) / odds(F.least(base, F.lit(1 - 1e-6))), F.lit(HOST_WEIGHT))
    out = out.withColumn("score", joint / (1 + joint))
    return out.select("page", "own", "rate", "score", ((F.col("score") > 0.5) & (F.col("size") >= LEAST_WORDS)).alias("spam"))
