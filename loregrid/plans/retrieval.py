"""Queries of the retrievers: the knowledge base is `examples`, the batch of queries the questions of `eval_items`."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loregrid.operators import context as cx
from loregrid.operators import retrieval as rt
from loregrid.operators import vectors as vx
from loregrid.plans.texts import TOKENS
from loregrid.session import table


def kb(s, d):
    return table(s, d, "examples")


def asked(s, d):
    return table(s, d, "eval_items").select(F.col("item_id").alias("query_id"), F.col("question").alias("text"))


def agent(s, d):
    return rt.Bm25Agent.train(kb(s, d).select("idx", "input", "output", "weight"))


def term_freq(s, d):
    return rt.term_freq(kb(s, d))


def doc_freq(s, d):
    return rt.doc_freq(rt.term_freq(kb(s, d)))


def bm25_stats(s, d):
    return agent(s, d).stats.select("n", "words", F.round("avgdl", 6).alias("avgdl"))


def bm25_scores(s, d):
    return agent(s, d).scores(asked(s, d))


def bm25_topn(s, d):
    return agent(s, d).predict_top_n(asked(s, d), 3)


def bm25_predict(s, d):
    return agent(s, d).predict(asked(s, d)).select("query_id", "idx", "response")


def bm25_confidence(s, d):
    return agent(s, d).confidence(asked(s, d))


def bm25_append(s, d):
    """The knowledge base with approved pairs appended; b = 0 and another k1."""
    more = table(s, d, "approved_data").select((F.col("id") + F.lit(10**12)).alias("idx"), "input", F.struct(F.lit("Text").alias("format"), F.col("output").alias("value")).alias("output"), F.col("weight").cast("float").alias("weight"))
    base = rt.Bm25Agent.train(kb(s, d).select("idx", "input", "output", "weight"), 1.5, 0.0)
    return base.append(more).predict_top_n(asked(s, d), 2)


def can_answer(s, d):
    return rt.can_answer(agent(s, d).confidence(asked(s, d)))


def context_bm25(s, d):
    """The items of each suite and language as a conversation, asked with the last two of them behind the question."""
    items = table(s, d, "eval_items")
    turns = items.select(F.concat_ws("/", "suite", "lang").alias("conv_id"), F.col("item_id").alias("turn"), "question", "answer")
    return cx.ContextAgent(agent(s, d), 2).predict(turns).select("conv_id", "turn", "idx", "response")


def exact_topn(s, d):
    """Inputs asked in capitals."""
    q = kb(s, d).select(F.col("idx").alias("query_id"), F.upper("input").alias("text")).unionByName(asked(s, d).select((-F.col("query_id")).alias("query_id"), "text"))
    return rt.ExactAgent(kb(s, d)).predict_top_n(q, 2)


def exact_match(s, d):
    q = table(s, d, "approved_data").select(F.col("id").alias("query_id"), F.col("input").alias("text"))
    return rt.ExactAgent(kb(s, d)).predict(q).select("query_id", "idx")


def fuzzy_agent(s, d, **kw):
    names = table(s, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("idx"))
    return rt.FuzzyAgent(names.select("idx", F.col("p_name").alias("input"), F.struct(F.lit("Text").alias("format"), F.col("p_name").alias("value")).alias("output")), **kw)


def misspelled(s, d):
    """Names of parts without their third character."""
    names = table(s, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("query_id"))
    return names.select("query_id", F.concat(F.substring("p_name", 1, 2), F.substring("p_name", 4, 200)).alias("text"))


def fuzzy_topn(s, d):
    return fuzzy_agent(s, d).predict_top_n(misspelled(s, d), 2).withColumn("confidence", F.round("confidence", 6))


def fuzzy_bounded(s, d):
    """At most three edits whatever the length."""
    return fuzzy_agent(s, d, max_distance=3, factor=None).predict(misspelled(s, d)).select("query_id", "idx", "response")


def fuzzy_confidence(s, d):
    return fuzzy_agent(s, d).confidence(misspelled(s, d)).withColumn("confidence", F.round("confidence", 6))


def _pairs(s, d):
    """(conv_id, turn, question, answer): each user message and the next message of its chat, if that is an answer."""
    role = F.lower(F.trim("role"))
    who = F.when(role.isin("user", "human"), "q").when(role.isin("bot", "assistant", "ai"), "a")
    m = table(s, d, "messages").select("id", "chat_id", who.alias("who"), "content").distinct().filter("who IS NOT NULL")
    w = Window.partitionBy("chat_id").orderBy("id")
    m = m.withColumns({"next": F.lead("who").over(w), "answer": F.lead("content").over(w)})
    return m.filter("who = 'q' AND next = 'a'").select(F.col("chat_id").alias("conv_id"), F.col("id").alias("turn"), F.coalesce("content", F.lit("")).alias("question"), F.coalesce("answer", F.lit("")).alias("answer"))


def context_window(s, d):
    rows = cx.window(_pairs(s, d), 5)
    return rows.select("conv_id", "turn", F.size("history").alias("turns"), F.sha2(cx.rendered(F.col("history"), "qa_pairs"), 256).alias("hash"))


def context_format(s, d):
    h = cx.window(_pairs(s, d), 2)
    custom = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["question"], F.lit("="), x["answer"])), "|")
    kinds = {"list": "list", "sentence": "sentence", "custom": custom}
    return h.select("conv_id", "turn", *[F.sha2(cx.rendered(F.col("history"), v), 256).alias(k) for k, v in kinds.items()])


def context_query(s, d):
    h = cx.window(_pairs(s, d), 3)
    return h.select("conv_id", "turn", F.sha2(cx.enhanced(F.col("question"), cx.rendered(F.col("history"), "qa_pairs")), 256).alias("hash"))


def ensemble_best(s, d):
    q = asked(s, d)
    known = kb(s, d).select("idx", "input", F.struct(F.col("output.format").alias("format"), F.coalesce("output.value", F.lit("")).alias("value")).alias("output"), "weight")
    bm25, exact = rt.Bm25Agent.train(known), rt.ExactAgent(known)
    return rt.ensemble([("tfidf", bm25.predict(q)), ("exact", exact.predict(q))])


def _entries(s, d):
    return table(s, d, "approved_data").select(F.col("id").alias("entry_id"), F.coalesce("output", F.lit("")).alias("content"))


def vocabulary(s, d):
    return rt.term_freq(_entries(s, d), "entry_id", "content").select("term").distinct().orderBy("term")


def tfidf_weights(s, d):
    return vx.weights(_entries(s, d), "entry_id", "content").withColumn("w", F.round("w", 6))


def embed_new(s, d):
    """Weights of new entries over a collection they are not part of."""
    new = asked(s, d).select(F.col("query_id").alias("entry_id"), F.col("text").alias("content"))
    return vx.weights(new, "entry_id", "content", _entries(s, d)).withColumn("w", F.round("w", 6))


def collection_search(s, d):
    return vx.collection_search(_entries(s, d), asked(s, d), 5)


def cosine_topk(s, d):
    """Every vector whose id is divisible by 50 against all."""
    v = table(s, d, "embeddings")
    q = v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
    return vx.nearest(v, q, 5)


def _sources(s, d):
    return table(s, d, "approved_data").select(F.col("id").alias("source_id"), "input", "output")


def inverted_index(s, d):
    return vx.inverted_index(_sources(s, d)).withColumn("tfidf_score", F.round("tfidf_score", 6))


def index_stats(s, d):
    return vx.inverted_index(_sources(s, d)).agg(F.count("*").alias("postings"), F.countDistinct("term").alias("terms"), F.countDistinct("source_id").alias("sources"))


def index_search(s, d):
    hits = vx.index_search(vx.inverted_index(_sources(s, d)), asked(s, d), 5)
    rows = table(s, d, "approved_data").select(F.col("id").alias("source_id"), "input", "source_url")
    return hits.join(rows, "source_id").select("query_id", "rank", "source_id", "score", "input", "source_url")


T = TOKENS.format
BM25 = f"""WITH kb AS (SELECT idx, input, output.value AS response, weight FROM examples),
tf AS (SELECT idx, term, count(*) AS tf FROM (SELECT idx, unnest({T('input')}) AS term FROM kb) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
dl AS (SELECT idx, sum(tf) AS dl FROM tf GROUP BY 1),
st AS (SELECT (SELECT count(*) FROM kb) AS n, coalesce((SELECT sum(tf) FROM tf), 0) AS words),
q AS (SELECT item_id AS query_id, term, count(*) AS times FROM (SELECT item_id, unnest({T('question')}) AS term FROM eval_items) GROUP BY 1, 2),
sc AS (SELECT query_id, idx, sum(times * ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / (words / n)))) AS s
  FROM q JOIN df USING (term) JOIN tf USING (term) JOIN dl USING (idx), st GROUP BY 1, 2),
scored AS (SELECT query_id, idx, round(s * CAST(weight AS DOUBLE), 6) AS score FROM sc JOIN kb USING (idx) WHERE round(s * CAST(weight AS DOUBLE), 6) > 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, idx) AS rank FROM scored),
terms AS (SELECT query_id, sum(times) AS terms FROM q GROUP BY 1)
"""
PARTS = "names AS (SELECT p_name, min(p_partkey) AS idx FROM part GROUP BY 1), q AS (SELECT idx AS query_id, substring(p_name, 1, 2) || substring(p_name, 4) AS text FROM names)"
FUZZY = f"""WITH {PARTS},
m AS (SELECT query_id, names.idx, levenshtein(lower(p_name), lower(text)) AS distance, greatest(1, strlen(lower(text))) AS size, lower(text) AS l FROM q, names),
g AS (SELECT * FROM m WHERE distance <= CAST(floor(strlen(l)::FLOAT * 0.3::FLOAT) AS INTEGER)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, idx) AS rank FROM g)
"""
CHATS = """WITH m AS (SELECT DISTINCT id, chat_id, content, CASE WHEN lower(trim(role)) IN ('user', 'human') THEN 'q' WHEN lower(trim(role)) IN ('bot', 'assistant', 'ai') THEN 'a' END AS who FROM messages),
n AS (SELECT *, lead(who) OVER w AS nxt, lead(content) OVER w AS answer FROM m WHERE who IS NOT NULL WINDOW w AS (PARTITION BY chat_id ORDER BY id)),
p AS (SELECT chat_id AS conv_id, id AS turn, coalesce(content, '') AS question, coalesce(answer, '') AS answer FROM n WHERE who = 'q' AND nxt = 'a'),
"""
HIST = "h AS (SELECT *, coalesce(list({{'q': question, 'a': answer}}) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN {0} PRECEDING AND 1 PRECEDING), []) AS history FROM p)\n"
QA = "array_to_string(list_transform(history, lambda h: 'Q: ' || h.q || ' A: ' || h.a || ' '), '')"
COLL = f"""WITH tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({T("coalesce(output, '')")}) AS term FROM approved_data) GROUP BY 1, 2),
n AS (SELECT count(*) AS n FROM approved_data), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), len AS (SELECT id, sum(tf) AS len FROM tf GROUP BY 1),
w AS (SELECT id, term, tf / len * (ln(n / df) + 1) AS w FROM tf JOIN df USING (term) JOIN len USING (id), n),
qt AS (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest({T('question')}) AS term FROM eval_items) GROUP BY 1, 2),
qlen AS (SELECT item_id, sum(tf) AS len FROM qt GROUP BY 1),
qw AS (SELECT item_id, term, tf / len * coalesce(ln(n / df) + 1, 1) AS w, df FROM qt LEFT JOIN df USING (term) JOIN qlen USING (item_id), n)
"""
_TOK2 = r"list_filter(regexp_split_to_array(lower(coalesce(input, '') || ' ' || coalesce(output, '')), '[^\p{L}\p{Nl}\p{N}]+'), lambda x: strlen(x) > 1)"
INDEX = f"""WITH tf AS (SELECT id AS source_id, term, count(*) AS tf FROM (SELECT id, unnest({_TOK2}) AS term FROM approved_data) GROUP BY 1, 2),
n AS (SELECT count(*) AS n FROM approved_data), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), len AS (SELECT source_id, sum(tf) AS len FROM tf GROUP BY 1),
ix AS (SELECT source_id, term, tf / len * (ln(n / df) + 1) AS s FROM tf JOIN df USING (term) JOIN len USING (source_id), n)
"""
_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"

QUERIES = {
    "term_freq": (term_freq, BM25 + "SELECT idx, term, tf FROM tf"),
    "doc_freq": (doc_freq, BM25 + "SELECT term, df FROM df"),
    "bm25_stats": (bm25_stats, BM25 + "SELECT n, CAST(words AS BIGINT) AS words, round(words / n, 6) AS avgdl FROM st"),
    "bm25_scores": (bm25_scores, BM25 + "SELECT query_id, idx, score FROM scored"),
    "bm25_topn": (bm25_topn, BM25 + "SELECT query_id, CAST(rank AS INTEGER) AS rank, idx, score, round(least(1, score / greatest(1, terms)), 6) AS confidence FROM ranked JOIN terms USING (query_id) WHERE rank <= 3"),
    "bm25_predict": (bm25_predict, BM25 + f"SELECT item_id AS query_id, r.idx, CASE WHEN r.idx IS NULL THEN '{rt.NO_MATCH}' ELSE response END AS response FROM eval_items e LEFT JOIN (SELECT * FROM ranked WHERE rank = 1) r ON r.query_id = item_id LEFT JOIN kb ON kb.idx = r.idx"),
    "bm25_confidence": (bm25_confidence, BM25 + "SELECT item_id AS query_id, coalesce(round(least(1, score / greatest(1, terms)), 6), 0) AS confidence FROM eval_items e LEFT JOIN (SELECT * FROM ranked WHERE rank = 1) r ON r.query_id = item_id LEFT JOIN terms t ON t.query_id = item_id"),
    "can_answer": (can_answer, BM25 + "SELECT item_id AS query_id, coalesce(round(least(1, score / greatest(1, terms)), 6), 0) > 0.5 AS can_answer FROM eval_items e LEFT JOIN (SELECT * FROM ranked WHERE rank = 1) r ON r.query_id = item_id LEFT JOIN terms t ON t.query_id = item_id"),
    "context_bm25": (context_bm25, BM25.replace("FROM (SELECT item_id, unnest(" + T('question') + ") AS term FROM eval_items)", "FROM (SELECT item_id, unnest(" + T('asked') + ") AS term FROM asked)").replace("WITH kb AS", f"""WITH items AS (SELECT item_id, concat_ws('/', suite, lang) AS conv_id, coalesce(question, '') AS question, coalesce(answer, '') AS answer FROM eval_items),
hist AS (SELECT *, coalesce(list({{'q': question, 'a': answer}}) OVER (PARTITION BY conv_id ORDER BY item_id ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), []) AS history FROM items),
asked AS (SELECT item_id, conv_id, CASE WHEN {QA} = '' THEN question ELSE question || ' [Context: ' || {QA} || ']' END AS asked FROM hist),
kb AS""") + f"SELECT conv_id, item_id AS turn, r.idx, CASE WHEN r.idx IS NULL THEN '{rt.NO_MATCH}' ELSE response END AS response FROM asked LEFT JOIN (SELECT * FROM ranked WHERE rank = 1) r ON r.query_id = item_id LEFT JOIN kb ON kb.idx = r.idx"),
    "bm25_append": (bm25_append, BM25.replace("SELECT idx, input, output.value AS response, weight FROM examples", "SELECT idx, input, weight FROM examples UNION ALL SELECT id + 1000000000000, input, CAST(weight AS FLOAT) FROM approved_data").replace("tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / (words / n)))", "tf * 2.5e0 / (tf + 1.5e0)")
        + "SELECT query_id, CAST(rank AS INTEGER) AS rank, idx, score, round(least(1, score / greatest(1, terms)), 6) AS confidence FROM ranked JOIN terms USING (query_id) WHERE rank <= 2"),
    "exact_topn": (exact_topn, """WITH q AS (SELECT idx AS query_id, upper(input) AS text FROM examples UNION ALL SELECT -item_id, question FROM eval_items),
r AS (SELECT query_id, idx, row_number() OVER (PARTITION BY query_id ORDER BY idx) AS rank FROM q JOIN examples ON lower(text) = lower(input))
SELECT query_id, CAST(rank AS INTEGER) AS rank, idx, 1e0 AS confidence FROM r WHERE rank <= 2"""),
    "exact_match": (exact_match, "SELECT a.id AS query_id, min(e.idx) AS idx FROM approved_data a LEFT JOIN examples e ON lower(a.input) = lower(e.input) GROUP BY 1"),
    "fuzzy_topn": (fuzzy_topn, FUZZY + "SELECT query_id, CAST(rank AS INTEGER) AS rank, idx, CAST(distance AS INTEGER) AS distance, round(greatest(0, 1 - distance / size), 6) AS confidence FROM ranked WHERE rank <= 2"),
    "fuzzy_bounded": (fuzzy_bounded, FUZZY.replace("CAST(floor(strlen(l)::FLOAT * 0.3::FLOAT) AS INTEGER)", "3") + f"SELECT q.query_id, r.idx, coalesce(p_name, '{rt.NO_MATCH}') AS response FROM q LEFT JOIN (SELECT * FROM ranked WHERE rank = 1) r USING (query_id) LEFT JOIN names ON names.idx = r.idx"),
    "fuzzy_confidence": (fuzzy_confidence, FUZZY + "SELECT q.query_id, coalesce(max(round(greatest(0, 1 - distance / size), 6)), 0) AS confidence FROM q LEFT JOIN g USING (query_id) GROUP BY 1"),
    "context_window": (context_window, CHATS + HIST.format(5) + f"SELECT conv_id, turn, CAST(len(history) AS INTEGER) AS turns, sha256({QA}) AS hash FROM h"),
    "context_format": (context_format, CHATS + HIST.format(2) + """SELECT conv_id, turn, sha256('[' || array_to_string(list_transform(history, lambda h: h.q || ' -> ' || h.a), ', ') || ']') AS list,
 sha256('Previous questions and answers: ' || array_to_string(list_transform(history, lambda h: h.q || ' - ' || h.a), '; ')) AS sentence,
 sha256(array_to_string(list_transform(history, lambda h: h.q || '=' || h.a), '|')) AS custom FROM h"""),
    "context_query": (context_query, CHATS + HIST.format(3) + f"SELECT conv_id, turn, sha256(CASE WHEN {QA} = '' THEN question ELSE question || ' [Context: ' || {QA} || ']' END) AS hash FROM h"),
    "ensemble_best": (ensemble_best, BM25 + f""", b AS (SELECT query_id, coalesce(response, '') AS response FROM ranked JOIN kb USING (idx) WHERE rank = 1),
x AS (SELECT item_id AS query_id, arg_min(coalesce(response, ''), idx) AS response FROM eval_items JOIN kb ON lower(question) = lower(input) GROUP BY 1)
SELECT item_id AS query_id, CASE WHEN b.response IS NOT NULL OR x.response IS NULL THEN 'tfidf' ELSE 'exact' END AS agent,
 coalesce(b.response, x.response, '{rt.NO_MATCH}') AS response, CASE WHEN b.response IS NULL AND x.response IS NULL THEN 0e0 ELSE 1e0 END AS confidence
FROM eval_items LEFT JOIN b ON b.query_id = item_id LEFT JOIN x ON x.query_id = item_id"""),
    "vocabulary": (vocabulary, COLL + "SELECT term FROM df ORDER BY term"),
    "tfidf_weights": (tfidf_weights, COLL + "SELECT id AS entry_id, term, round(w, 6) AS w FROM w"),
    "embed_new": (embed_new, COLL + "SELECT item_id AS entry_id, term, round(w, 6) AS w FROM qw"),
    "collection_search": (collection_search, COLL + """, norms AS (SELECT id, sqrt(sum(w * w)) AS norm FROM w GROUP BY 1), qn AS (SELECT item_id, sqrt(sum(w * w)) AS qnorm FROM qw WHERE df IS NOT NULL GROUP BY 1),
dots AS (SELECT item_id, id, sum(w.w * qw.w) AS dot FROM w JOIN qw USING (term) GROUP BY 1, 2),
sc AS (SELECT item_id AS query_id, id AS entry_id, round(dot / (norm * qnorm), 6) AS score FROM dots JOIN norms USING (id) JOIN qn USING (item_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry_id DESC) AS rank FROM sc WHERE score > 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, entry_id, score FROM r WHERE rank <= 5"""),
    "cosine_topk": (cosine_topk, f"""WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, round({_DOT.format('q.embedding', 'v.embedding')} / (sqrt({_DOT.format('q.embedding', 'q.embedding')}) * sqrt({_DOT.format('v.embedding', 'v.embedding')})), 5) AS score
 FROM embeddings q JOIN embeddings v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5"""),
    "inverted_index": (inverted_index, INDEX + "SELECT source_id, term, round(s, 6) AS tfidf_score FROM ix"),
    "index_stats": (index_stats, INDEX + "SELECT count(*) AS postings, count(DISTINCT term) AS terms, count(DISTINCT source_id) AS sources FROM ix"),
    "index_search": (index_search, INDEX + r""", q AS (SELECT DISTINCT item_id AS query_id, unnest(list_filter(regexp_split_to_array(lower(question), '[^\p{L}\p{Nl}\p{N}]+'), lambda x: strlen(x) > 1)) AS term FROM eval_items),
sc AS (SELECT query_id, source_id, round(sum(s), 6) AS score FROM ix JOIN q USING (term) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source_id) AS rank FROM sc)
SELECT query_id, CAST(rank AS INTEGER) AS rank, source_id, score, input, source_url FROM r JOIN approved_data a ON a.id = source_id WHERE rank <= 5"""),
}
