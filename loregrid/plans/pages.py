"""Queries of the page pipeline: hashes, pairs from pages, review tables, links, and the live forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from loregrid.functions import arrow as ax
from loregrid.functions import text as tx
from loregrid.operators import pipeline
from loregrid.operators import tables as tb
from loregrid.operators.crawl import reached
from loregrid.plans.retrieval import CHATS, HIST, QA
from loregrid.plans.texts import CLEAN, QUESTION
from loregrid.session import table
from loregrid.streaming import live


def hash_dedup(s, d):
    """Crawled pages against the pages stored as raw data, first by id."""
    new = table(s, d, "crawled_pages").select("page_id", F.sha2("content", 256).alias("hash"))
    stored = table(s, d, "raw_data").select(F.sha2("content", 256).alias("hash"))
    return tb.deduplicated(new, stored, "hash", "page_id")


def _pages(s, d):
    return table(s, d, "crawled_pages").select("page_id", "title", tx.clean_content(F.col("content")).alias("text"))


def _pairs(s, d, strategy):
    rows = _pages(s, d).select("page_id", F.posexplode(ax.page_pairs(F.col("text"), strategy)).alias("at", "p"))
    return rows.select("page_id", "at", "p.input", "p.output")


def qa_heading(s, d):
    return _pairs(s, d, "heading_content")


def qa_paragraph(s, d):
    return _pairs(s, d, "paragraph")


def qa_sentence(s, d):
    return _pairs(s, d, "sentence")


def truncate_sentence(s, d):
    return _pages(s, d).select("page_id", ax.truncated(F.col("text"), F.lit(500)).alias("text"))


def _summaries(s, d):
    rows = _pages(s, d).withColumn("title", F.trim("title")).filter("octet_length(title) >= 3")
    answer = ax.truncated(F.col("text"), F.lit(500))
    rows = rows.select("page_id", "title", answer.alias("output")).filter("octet_length(output) >= 20")
    asks = F.array(F.concat(F.lit("Was ist "), "title", F.lit("?")), F.when(~F.col("title").endswith("?"), F.concat("title", F.lit("?"))))
    return rows.select("page_id", F.explode(F.array_compact(asks)).alias("input"), "output")


def qa_summary(s, d):
    return _summaries(s, d)


def qa_pipeline(s, d):
    """Pairs of all pages by sentence and summary, the first of each hash of `input:output`."""
    pairs = _pairs(s, d, "sentence").select("page_id", "input", "output").unionByName(_summaries(s, d))
    pairs = pairs.withColumn("hash", F.sha2(F.concat_ws(":", "input", "output"), 256))
    return pairs.groupBy("hash").agg(F.min(F.struct("page_id", "input", "output")).alias("p")).select("hash", "p.*")


def run_stats(s, d):
    rows = table(s, d, "raw_data").groupBy("bot_run_id").agg(F.count("*").alias("found"), F.sum((F.col("status") == "approved").cast("bigint")).alias("added"))
    runs = table(s, d, "bot_runs").distinct().select(F.col("id").alias("bot_run_id"), "bot_id", "items_found", "items_added")
    return runs.join(rows, "bot_run_id", "left").fillna(0, ["found", "added"]).withColumn("off", F.coalesce(F.col("found") != F.col("items_found"), F.lit(True)))


def approve_pending(s, d):
    raw = table(s, d, "raw_data").select("id", "status")
    return tb.updated(raw, F.col("status") == "pending", status=F.lit("approved")).groupBy("status").agg(F.count("*").alias("n"))


def approved_to_kb(s, d):
    """Pairs not yet added, numbered behind the knowledge base in the order of their ids."""
    known = table(s, d, "examples").select("idx", "input", F.col("output.value").alias("value"), F.lit(0).alias("src"))
    new = table(s, d, "approved_data").filter("NOT added_to_kb").select(F.col("id").alias("idx"), "input", F.col("output").alias("value"), F.lit(1).alias("src"))
    return tb.merged(known, new)


def bad_refs(s, d):
    """Approved pairs whose raw row is gone or was rejected."""
    a = table(s, d, "approved_data").filter("raw_data_id IS NOT NULL").select("id", "raw_data_id")
    good = table(s, d, "raw_data").filter("status <> 'rejected'").select(F.col("id").alias("raw_data_id"))
    return a.join(good, "raw_data_id", "left_anti").select("id", "raw_data_id")


def page_hosts(s, d):
    host = F.lower(F.try_parse_url("url", F.lit("HOST")))
    return table(s, d, "crawled_pages").select(host.alias("host")).groupBy("host").agg(F.count("*").alias("pages"))


def _linked(s, d):
    """Pages as HTML that links to their section, their site, a place of their own and another site."""
    hrefs = ["./", "/", "#top", "https://elsewhere.invalid/", "mailto:desk@elsewhere.invalid"]
    page = F.concat(F.lit("<html><body><nav>" + "".join(f'<a href="{h}">' for h in hrefs) + "</nav><p>"), F.replace("title", F.lit("<"), F.lit("&lt;")), F.lit("</p></body></html>"))
    pages = table(s, d, "crawled_pages").filter("url IS NOT NULL").select("page_id", "url", F.coalesce(page, F.lit("".join(f'<a href="{h}">' for h in hrefs))).alias("html"))
    return pages.select("page_id", "url", F.explode(ax.html_parts(F.col("html"), F.col("url"))["links"]).alias("link"))


def page_links(s, d):
    """The links of each page, resolved against its own address, to the same host only."""
    return _linked(s, d).select("page_id", "link")


def crawl_reach(s, d):
    """What a crawl reaches in two steps from one page of each host, where sections list their pages."""
    links = _linked(s, d).select(F.col("url").alias("src"), F.col("link").alias("dst"))
    up = links.filter(F.col("dst").endswith("/"))
    both = up.unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    seeds = table(s, d, "crawled_pages").groupBy(F.lower(F.try_parse_url("url", F.lit("HOST"))).alias("host")).agg(F.min("url").alias("url"))
    return reached(both, seeds, 2)


def process_pending(s, d):
    """The pairs a processing run adds, sentence by sentence."""
    return pipeline.process_pending(table(s, d, "raw_data"), "sentence").pairs.filter("added").select("raw_id", "input", "output")


def process_counts(s, d):
    return pipeline.process_pending(table(s, d, "raw_data")).counts


def approved_marked(s, d):
    """What add-to-KB leaves: rows by their mark, before and after."""
    before = table(s, d, "approved_data")
    after = pipeline.added_to_kb(table(s, d, "examples"), before)[1]
    count = lambda df, at: df.groupBy(F.lit(at).alias("at"), "added_to_kb").agg(F.count("*").alias("n"))
    return count(before, "before").unionByName(count(after, "after"))


def stream_dedup(s, d):
    """The same hash set as a batch: the first row of each content hash as files come in."""
    rows = live.stream_of(s, d, "raw_data").select(F.sha2("content", 256).alias("hash"))
    return live.drained(live.fresh_rows(rows, "hash"), "stream-dedup")


def stream_context(s, d):
    """Context as state: the same turns and histories as the window over the whole table."""
    role = F.lower(F.trim("role"))
    who = F.when(role.isin("user", "human"), "q").when(role.isin("bot", "assistant", "ai"), "a")
    rows = live.stream_of(s, d, "messages").select(F.col("chat_id").alias("conv_id"), "id", who.alias("who"), "content").filter("who IS NOT NULL")
    return live.drained(live.running_context(rows, 2), "stream-context").select("conv_id", "turn", F.sha2("history", 256).alias("hash"))


_ABBREVIATED = "|".join(a.replace(".", r"\.") for a in ax.PAGE_ABBREVIATIONS)
# texts as pages are cleaned, cut at a sentence, and taken apart into sentences
SAID = rf"""WITH c AS (SELECT page_id, trim(title) AS title, {CLEAN} AS text FROM crawled_pages WHERE content IS NOT NULL),
h AS (SELECT *, CASE WHEN strlen(text) > 500 THEN substring(text, 1, list_max(list_filter(range(125, 501), lambda k: strlen(substring(text, 1, k)) <= 500))) END AS head FROM c),
t AS (SELECT page_id, title, text, CASE WHEN head IS NULL THEN text WHEN regexp_matches(head, '[.!?] ') THEN regexp_extract(head, '(?s)^(.*[.!?]) ', 1)
  WHEN contains(head, ' ') THEN regexp_extract(head, '(?s)^(.*) ', 1) || '...' ELSE head || '...' END AS cut FROM h),
p AS (SELECT page_id, unnest(string_split(regexp_replace(text, '([.!?])(\s)', '\1' || chr(1) || '\2', 'g'), chr(1))) AS piece, generate_subscripts(string_split(regexp_replace(text, '([.!?])(\s)', '\1' || chr(1) || '\2', 'g'), chr(1)), 1) AS i FROM t),
g AS (SELECT *, coalesce(sum(CASE WHEN regexp_matches(piece, '(?:{_ABBREVIATED})$') THEN 0 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM p),
s AS (SELECT page_id, g, regexp_replace(string_agg(piece, '' ORDER BY i), '^\s+|\s+$', '', 'g') AS said FROM g GROUP BY 1, 2),
n AS (SELECT page_id, said, row_number() OVER (PARTITION BY page_id ORDER BY g) AS n FROM s WHERE said <> '' AND strlen(said) >= 20),
two AS (SELECT a.page_id, CAST((a.n - 1) / 2 AS INTEGER) AS "at", a.said AS asked, b.said AS output FROM n a JOIN n b ON a.page_id = b.page_id AND a.n % 2 = 1 AND b.n = a.n + 1),
sentence AS (SELECT page_id, "at", {QUESTION.replace("{0}", "asked")} AS input, output FROM two),
summary AS (SELECT page_id, unnest(CASE WHEN ends_with(title, '?') THEN ['Was ist ' || title || '?'] ELSE ['Was ist ' || title || '?', title || '?'] END) AS input, cut AS output FROM t WHERE strlen(title) >= 3 AND strlen(cut) >= 20),
first AS (SELECT page_id, arg_min(said, g) AS said FROM s WHERE said <> '' GROUP BY 1)
"""

QUERIES = {
    "hash_dedup": (hash_dedup, "SELECT min(page_id) AS page_id, sha256(content) AS hash FROM crawled_pages WHERE content IS NOT NULL AND sha256(content) NOT IN (SELECT sha256(content) FROM raw_data WHERE content IS NOT NULL) GROUP BY 2 UNION ALL SELECT page_id, NULL FROM crawled_pages WHERE content IS NULL"),
    "qa_heading": (qa_heading, None),
    "qa_paragraph": (qa_paragraph, SAID + f"SELECT page_id, 0 AS at, {QUESTION.replace('{0}', 'said')} AS input, cut AS output FROM t JOIN first USING (page_id) WHERE strlen(text) >= 20 AND strlen(said) >= 20 AND length(said) < length(text)"),
    "qa_sentence": (qa_sentence, SAID + 'SELECT page_id, "at", input, output FROM sentence'),
    "truncate_sentence": (truncate_sentence, SAID + "SELECT page_id, cut AS text FROM t UNION ALL SELECT page_id, NULL FROM crawled_pages WHERE content IS NULL"),
    "qa_summary": (qa_summary, SAID + "SELECT page_id, input, output FROM summary"),
    "qa_pipeline": (qa_pipeline, SAID + ", b AS (SELECT page_id, input, output FROM sentence UNION ALL SELECT page_id, input, output FROM summary), u AS (SELECT sha256(concat_ws(':', input, output)) AS hash, min({'page_id': page_id, 'input': input, 'output': output}) AS p FROM b GROUP BY 1) SELECT hash, p.page_id AS page_id, p.input AS input, p.output AS output FROM u"),
    "run_stats": (run_stats, """WITH r AS (SELECT DISTINCT id, bot_id, items_found, items_added FROM bot_runs),
f AS (SELECT bot_run_id, count(*) AS found, sum(CASE WHEN status = 'approved' THEN 1 ELSE 0 END) AS added FROM raw_data GROUP BY 1)
SELECT id AS bot_run_id, bot_id, items_found, items_added, coalesce(found, 0) AS found, CAST(coalesce(added, 0) AS BIGINT) AS added, coalesce(coalesce(found, 0) <> items_found, true) AS "off" FROM r LEFT JOIN f ON f.bot_run_id = id"""),
    "approve_pending": (approve_pending, "SELECT CASE WHEN status = 'pending' THEN 'approved' ELSE status END AS status, count(*) AS n FROM raw_data GROUP BY 1"),
    "approved_to_kb": (approved_to_kb, """WITH a AS (SELECT 0 AS src, idx, input, output.value AS value FROM examples UNION ALL SELECT 1, id, input, output FROM approved_data WHERE NOT added_to_kb)
SELECT row_number() OVER (ORDER BY src, idx) - 1 AS idx, input, value, src FROM a"""),
    "bad_refs": (bad_refs, "SELECT id, raw_data_id FROM approved_data WHERE raw_data_id IS NOT NULL AND raw_data_id NOT IN (SELECT id FROM raw_data WHERE status <> 'rejected')"),
    "page_hosts": (page_hosts, r"SELECT nullif(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '') AS host, count(*) AS pages FROM crawled_pages GROUP BY 1"),
    "page_links": (page_links, r"WITH p AS (SELECT page_id, url FROM crawled_pages WHERE url IS NOT NULL) SELECT page_id, regexp_replace(url, '[^/]*$', '') AS link FROM p UNION ALL SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+/') FROM p UNION ALL SELECT page_id, url || '#top' FROM p"),
    "crawl_reach": (crawl_reach, r"""WITH RECURSIVE p AS (SELECT DISTINCT url FROM crawled_pages WHERE url IS NOT NULL),
up AS (SELECT url AS src, regexp_replace(url, '[^/]*$', '') AS dst FROM p UNION SELECT url, regexp_extract(url, '^[a-z]+://[^/]+/') FROM p),
l AS (SELECT src, dst FROM up UNION SELECT dst, src FROM up),
r AS (SELECT min(url) AS url, 0 AS depth FROM p GROUP BY lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1))
 UNION SELECT l.dst, r.depth + 1 FROM r JOIN l ON l.src = r.url WHERE r.depth < 2)
SELECT url, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY 1"""),
    "process_pending": (process_pending, None),
    "process_counts": (process_counts, None),
    "approved_marked": (approved_marked, "SELECT 'before' AS at, added_to_kb, count(*) AS n FROM approved_data GROUP BY 2 UNION ALL SELECT 'after', true, count(*) FROM approved_data"),
    "stream_dedup": (stream_dedup, "SELECT DISTINCT sha256(content) AS hash FROM raw_data"),
    "stream_context": (stream_context, CHATS + HIST.format(2) + f"SELECT conv_id, turn, sha256({QA}) AS hash FROM h"),
}
