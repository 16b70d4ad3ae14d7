"""Queries of text functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loregrid.functions import arrow as ax
from loregrid.functions import text as tx
from loregrid.session import table

#: The tokenizer in SQL; what every oracle with words uses.
_SPACE = r"\s\x{{0b}}\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}"
TOKENS = rf"list_filter(regexp_split_to_array(regexp_replace(lower({{0}}), '[^\p{{{{L}}}}\p{{{{Nl}}}}{_SPACE}]', '', 'g'), '[{_SPACE}]+'), lambda x: x <> '')"
STOP_EN = "['" + "','".join(tx.STOPWORDS["en"]) + "']"
STOP_DE = "['" + "','".join(tx.STOPWORDS["de"]) + "']"


def _sql_first(low: str, choices: list[tuple[str, list[str]]]) -> str:
    whens = " ".join(f"WHEN {' OR '.join(f'''contains({low}, '{w}')''' for w in words)} THEN '{v}'" for v, words in choices)
    return f"CASE {whens} END"


def _has(low: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({low}, '{w}')" for w in words) + ")"


def tokenize(s, d):
    return table(s, d, "documents").select("doc_id", F.array_join(tx.tokenize(F.col("text")), " ").alias("tokens"))


def unique_terms(s, d):
    return table(s, d, "documents").select("doc_id", F.array_join(tx.unique_terms(F.col("text")), " ").alias("terms"))


def stopwords(s, d):
    kept = tx.remove_stopwords(tx.tokenize(F.col("text")), F.col("lang"))
    return table(s, d, "documents").select("doc_id", F.size(kept).alias("kept"), F.sha2(F.array_join(kept, " "), 256).alias("hash"))


def levenshtein(s, d):
    return table(s, d, "customer").select("c_custkey", F.levenshtein("c_name", "c_mktsegment").alias("distance"))


def jaccard(s, d):
    return table(s, d, "approved_data").select("id", F.round(tx.jaccard(F.coalesce("input", F.lit("")), F.coalesce("output", F.lit(""))), 6).alias("similarity"))


def char_ngrams(s, d):
    return table(s, d, "customer").select("c_custkey", F.array_join(tx.char_ngrams(F.col("c_name"), 3), "|").alias("grams"))


def normalize(s, d):
    return table(s, d, "documents").select("doc_id", ax.normalize(F.col("title")).alias("title"))


def clean_text(s, d):
    return table(s, d, "pdf_pages").select("page_id", F.sha2(ax.clean_text(F.col("text")), 256).alias("hash"))


def sentences(s, d):
    return table(s, d, "documents").select("doc_id", F.posexplode(ax.sentences(F.col("text"))).alias("at", "sentence"))


def chunks(s, d):
    cut = ax.chunks(ax.clean_text(F.col("text")))
    return table(s, d, "documents").select("doc_id", cut.alias("c")).select("doc_id", F.posexplode("c").alias("chunk_index", "chunk"), F.size("c").alias("total_chunks"))


def chunk_examples(s, d):
    docs = table(s, d, "documents").select("doc_id", "source", ax.chunks(ax.clean_text(F.col("text"))).alias("c"))
    rows = docs.select("doc_id", "source", F.posexplode("c").alias("chunk_index", "chunk"), F.size("c").alias("total_chunks"))
    meta = F.to_json(F.struct("chunk_index", "total_chunks", F.col("source").alias("source_file")))
    return rows.select("doc_id", F.col("chunk").alias("input"), F.col("chunk").alias("output"), F.lit(1.0).cast("float").alias("weight"), meta.alias("metadata"))


def garbage_filter(s, d):
    return table(s, d, "pdf_pages").select("page_id", tx.is_garbage(F.col("text")).alias("garbage"))


def binary_filter(s, d):
    return table(s, d, "raw_data").select("id", tx.is_binary(F.col("content")).alias("is_binary"))


def html_clean(s, d):
    clean = tx.clean_page(F.col("content"))
    return table(s, d, "crawled_pages").select("page_id", F.sha2(clean, 256).alias("hash"), F.char_length(clean).alias("size"))


def content_clean(s, d):
    return table(s, d, "raw_data").select("id", F.sha2(tx.clean_content(F.col("content")), 256).alias("hash"))


def format_map(s, d):
    fmt, value = F.lower("output.format"), F.col("output.value")
    parsed = F.when(F.try_parse_json(value).isNotNull(), "object").otherwise("string")
    return table(s, d, "examples").select("idx", F.when(fmt == "markdown", "Markdown").when(fmt == "json", "Json").otherwise("Text").alias("format"), F.when(fmt == "json", parsed).alias("json_kind"))


def heading_question(s, d):
    return table(s, d, "documents").filter("title IS NOT NULL").select("doc_id", tx.heading_question(F.col("title")).alias("question"))


def sentence_question(s, d):
    return table(s, d, "examples").filter("input IS NOT NULL").select("idx", tx.sentence_question(F.col("input")).alias("question"))


def intent(s, d):
    return table(s, d, "messages").select("id", tx.settings_intent(F.col("content")).alias("i")).filter("i IS NOT NULL").select("id", "i.*").distinct()


# The commands of the console, in the order they are looked through.
COMMANDS = ["help", "clear", "status", "restart", "reset"]


def did_you_mean(s, d):
    """For each word said in messages the first command it is near to but not equal to."""
    names = F.array(*[F.lit(x) for x in COMMANDS])
    words = table(s, d, "messages").select(F.explode(tx.tokenize(F.col("content"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    near = words.select("word", "n", F.posexplode(names).alias("at", "command")).withColumn("similarity", ax.jaro_winkler(F.col("word"), F.col("command")))
    first = near.filter("similarity > 0.85 AND word <> command").groupBy("word", "n").agg(F.min(F.struct("at", "command", "similarity")).alias("c"))
    return first.select("word", "n", "c.command", F.round("c.similarity", 6).alias("similarity"))


def json_props(s, d):
    ev = table(s, d, "events")
    return ev.select("event_id", F.json_object_keys("props").alias("k")).select("event_id", F.array_join(F.array_sort("k"), ",").alias("keys"))


def dates(s, d):
    return table(s, d, "events").select("event_id", F.date_format("ts", "HH:mm:ss").alias("clock"), F.date_format("ts", "yyyy-MM-dd HH:mm").alias("minute"))


def sha256(s, d):
    return table(s, d, "raw_data").select("id", F.sha2("content", 256).alias("hash"), (F.lower(F.trim("content_hash")) == F.sha2("content", 256)).alias("as_written"))


def html_text(s, d):
    """Pages as HTML, so that the parser has markup to take apart: each line is a paragraph under a link to the page."""
    body = F.transform(F.split("content", "\n"), lambda x: F.concat(F.lit("<p>"), F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</p>")))
    title = F.replace(F.replace(F.coalesce("title", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    page = F.concat(F.lit("<html><head><title>"), title, F.lit("</title></head><body><nav>menu</nav><a href='/next'></a>"), F.array_join(body, ""), F.lit("</body></html>"))
    parts = table(s, d, "crawled_pages").select("page_id", ax.html_parts(page, F.col("url")).alias("p"))
    return parts.select("page_id", F.trim("p.title").alias("title"), F.sha2("p.text", 256).alias("text_hash"), F.size("p.links").alias("links"))


EDGE = r"'^[\s\x{00a0}\x{2000}-\x{200a}\x{3000}]+|[\s\x{00a0}\x{2000}-\x{200a}\x{3000}]+$'"
_WS = r"[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_LINE = rf"list_transform(regexp_split_to_array(content, '\r?\n'), lambda x: regexp_replace(regexp_replace(x, '^{_WS}+|{_WS}+$', '', 'g'), '{_WS}+', ' ', 'g'))"
_ODD = rf"length(regexp_replace(content, '[\p{{L}}\p{{Nl}}\p{{N}}\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]|{_WS}', '', 'g')) / length(content) > 0.10 OR length(regexp_replace(content, '[^\x{{FFFD}}]', '', 'g')) / length(content) > 0.10"
# a stored content, cleaned; a sentence (column {0}) as a question
CLEAN = f"CASE WHEN length(content) = 0 OR ({_ODD}) THEN '' ELSE array_to_string(list_filter({_LINE}, lambda x: x <> ''), chr(10)) END"
_ASKED = "regexp_replace(rtrim(rtrim(regexp_replace({0}, " + EDGE + ", '', 'g'), '.'), '!'), " + EDGE + ", '', 'g')"
QUESTION = f"CASE WHEN ends_with({_ASKED}, '?') OR {_ASKED} = '' THEN {_ASKED} WHEN regexp_matches(lower({_ASKED}), '^(wir |unser|die |das |der )') THEN 'Was bedeutet: ' || {_ASKED} || '?' ELSE 'Was ist ' || {_ASKED} || '?' END"
_JUNK = "|".join(p.replace(".", r"\.") for p in tx.JUNK_PHRASES)

QUERIES = {
    "tokenize": (tokenize, f"SELECT doc_id, array_to_string({TOKENS.format('text')}, ' ') AS tokens FROM documents"),
    "unique_terms": (unique_terms, f"SELECT doc_id, array_to_string(list_sort(list_distinct({TOKENS.format('text')})), ' ') AS terms FROM documents"),
    "stopwords": (stopwords, f"""WITH t AS (SELECT doc_id, CASE WHEN lower(lang) IN ('de', 'deu', 'german') THEN {STOP_DE} ELSE {STOP_EN} END AS stop, {TOKENS.format('text')} AS w FROM documents),
k AS (SELECT doc_id, list_filter(w, lambda x: NOT list_contains(stop, x)) AS w FROM t)
SELECT doc_id, CAST(len(w) AS INTEGER) AS kept, sha256(array_to_string(w, ' ')) AS hash FROM k"""),
    "levenshtein": (levenshtein, "SELECT c_custkey, CAST(levenshtein(c_name, c_mktsegment) AS INTEGER) AS distance FROM customer"),
    "jaccard": (jaccard, f"""WITH t AS (SELECT id, list_distinct({TOKENS.format("coalesce(input, '')")}) AS a, list_distinct({TOKENS.format("coalesce(output, '')")}) AS b FROM approved_data)
SELECT id, round(CASE WHEN len(a) + len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) END, 6) AS similarity FROM t"""),
    "char_ngrams": (char_ngrams, """SELECT c_custkey, CASE WHEN length(c_name) < 3 THEN c_name ELSE array_to_string(list_transform(range(1, CAST(length(c_name) - 1 AS BIGINT)), lambda i: substring(c_name, i, 3)), '|') END AS grams FROM customer"""),
    "normalize": (normalize, None),
    "clean_text": (clean_text, r"""WITH a AS (SELECT page_id, regexp_replace(replace(replace(replace(replace(replace(nfc_normalize(text), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬀ', 'ff'), 'ﬃ', 'ffi'), 'ﬄ', 'ffl'), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]', '', 'g') AS t FROM pdf_pages),
b AS (SELECT page_id, replace(replace(regexp_replace(t, '([\p{L}\p{M}\p{N}_])-\s*\n\s*([\p{L}\p{M}\p{N}_])', '\1\2', 'g'), chr(9), ' '), chr(13) || chr(10), chr(10)) AS t FROM a),
c AS (SELECT page_id, regexp_replace(regexp_replace(t, ' {2,}', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS t FROM b),
d AS (SELECT page_id, array_to_string(list_filter(regexp_split_to_array(t, '\r?\n'), lambda x: NOT regexp_full_match(x, '\s*-?\s*\d{1,4}\s*-?\s*')), chr(10)) AS t FROM c)
SELECT page_id, sha256(regexp_replace(regexp_replace(t, '^\s+', ''), '\s+$', '')) AS hash FROM d"""),
    "sentences": (sentences, None),
    "chunks": (chunks, None),
    "chunk_examples": (chunk_examples, None),
    "garbage_filter": (garbage_filter, r"""WITH t AS (SELECT page_id, trim(text, ' ') AS t FROM pdf_pages)
SELECT page_id, CASE WHEN t IS NULL THEN NULL WHEN length(t) = 0 THEN false ELSE
 length(regexp_replace(t, '[^\x{FFFD}\x{E000}-\x{F8FF}\x{10000}-\x{10FFFF}\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]', '', 'g')) / length(t) > 0.15 OR
 length(regexp_replace(t, '[^\p{L}\p{Nl}\p{N}\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E \t\n\r\x0C]', '', 'g')) / length(t) < 0.30 END AS garbage FROM t"""),
    "binary_filter": (binary_filter, f"SELECT id, CASE WHEN content IS NULL THEN NULL WHEN length(content) = 0 THEN true ELSE {_ODD} END AS is_binary FROM raw_data"),
    "html_clean": (html_clean, f"""WITH t AS (SELECT page_id, CASE WHEN content IS NULL THEN NULL WHEN length(content) > 0 AND ({_ODD}) THEN '' ELSE
 array_to_string(list_filter({_LINE}, lambda x: strlen(x) >= 3 AND NOT regexp_matches(x, '{_JUNK}')), chr(10)) END AS c FROM crawled_pages)
SELECT page_id, sha256(c) AS hash, CAST(length(c) AS INTEGER) AS size FROM t"""),
    "content_clean": (content_clean, f"""SELECT id, sha256(CASE WHEN length(content) = 0 OR ({_ODD}) THEN '' ELSE array_to_string(list_filter({_LINE}, lambda x: x <> ''), chr(10)) END) AS hash FROM raw_data"""),
    "format_map": (format_map, """SELECT idx, CASE lower(output.format) WHEN 'markdown' THEN 'Markdown' WHEN 'json' THEN 'Json' ELSE 'Text' END AS format,
 CASE WHEN lower(output.format) = 'json' THEN CASE WHEN json_valid(output.value) THEN 'object' ELSE 'string' END END AS json_kind FROM examples"""),
    "heading_question": (heading_question, rf"""WITH t AS (SELECT doc_id, regexp_replace(title, {EDGE}, '', 'g') AS h FROM documents WHERE title IS NOT NULL),
u AS (SELECT doc_id, h, lower(h) AS l, rtrim(h, ':') AS b FROM t)
SELECT doc_id, CASE WHEN ends_with(h, '?') THEN h
 WHEN starts_with(l, 'über ') THEN 'Was kann man über ' || rtrim(substring(h, 5), ':') || ' erfahren?'
 WHEN starts_with(l, 'about ') THEN 'What is ' || rtrim(substring(h, 7), ':') || '?'
 WHEN starts_with(l, 'how to') OR starts_with(l, 'wie ') OR starts_with(l, 'warum') OR starts_with(l, 'why') THEN b || '?'
 WHEN starts_with(l, 'kontakt') OR starts_with(l, 'contact') THEN 'Wie erreicht man ' || b || '?'
 WHEN starts_with(l, 'faq') OR starts_with(l, 'häufige fragen') THEN 'Welche häufigen Fragen gibt es zu ' || b || '?'
 ELSE 'Was ist ' || b || '?' END AS question FROM u"""),
    "sentence_question": (sentence_question, rf"""WITH t AS (SELECT idx, regexp_replace(rtrim(rtrim(regexp_replace(input, {EDGE}, '', 'g'), '.'), '!'), {EDGE}, '', 'g') AS s FROM examples WHERE input IS NOT NULL)
SELECT idx, CASE WHEN ends_with(s, '?') OR s = '' THEN s WHEN regexp_matches(lower(s), '^(wir |unser|die |das |der )') THEN 'Was bedeutet: ' || s || '?' ELSE 'Was ist ' || s || '?' END AS question FROM t"""),
    "intent": (intent, f"""WITH t AS (SELECT DISTINCT id, lower(content) AS l FROM messages WHERE {_has('lower(content)', tx.ACTION_WORDS)}),
u AS (SELECT id, {_sql_first('l', tx.THEMES)} AS theme, {_sql_first('l', tx.COLOURS)} AS colour, {_has('l', tx.BACKGROUND_WORDS)} AS bg, {_sql_first('l', tx.LANGUAGES)} AS language FROM t)
SELECT id, theme, colour, CASE WHEN colour IS NOT NULL THEN CASE WHEN bg THEN 'bg_color' ELSE 'accent_color' END END AS target, language FROM u WHERE theme IS NOT NULL OR colour IS NOT NULL OR language IS NOT NULL"""),
    "did_you_mean": (did_you_mean, f"""WITH w AS (SELECT unnest({TOKENS.format('content')}) AS word FROM messages), c AS (SELECT word, count(*) AS n FROM w GROUP BY 1)
SELECT word, n, arg_min(command, place) AS command, round(arg_min(jaro_winkler_similarity(word, command), place), 6) AS similarity
 FROM c CROSS JOIN (VALUES (0, 'help'), (1, 'clear'), (2, 'status'), (3, 'restart'), (4, 'reset')) v(place, command) WHERE word <> command AND jaro_winkler_similarity(word, command) > 0.85 GROUP BY 1, 2"""),
    "json_props": (json_props, "SELECT event_id, array_to_string(list_sort(json_keys(props)), ',') AS keys FROM events"),
    "dates": (dates, "SELECT event_id, strftime(ts, '%H:%M:%S') AS clock, strftime(ts, '%Y-%m-%d %H:%M') AS minute FROM events"),
    "sha256": (sha256, "SELECT id, sha256(content) AS hash, lower(trim(content_hash)) = sha256(content) AS as_written FROM raw_data"),
    "html_text": (html_text, None),
}
