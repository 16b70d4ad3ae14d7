"""Queries of knowledge-base algebra and of table operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from loregrid.operators import tables as tb
from loregrid.session import table


def _kb(s, d):
    return table(s, d, "examples").select("idx", "input", "output", "weight")


def _flat(kb):
    return kb.select("idx", "input", F.col("output.value").alias("value"), "weight")


def kb_search(s, d):
    return tb.searched(_kb(s, d), "Account").select("idx", "input")


def kb_page(s, d):
    return tb.page(_flat(_kb(s, d)), 20, 20, "idx")


def kb_merge(s, d):
    """The knowledge base behind itself in reverse: order is data."""
    second = _flat(_kb(s, d)).withColumn("idx", -F.col("idx"))
    return tb.merged(_flat(_kb(s, d)), second)


def kb_append(s, d):
    more = table(s, d, "approved_data").select(F.col("id").alias("idx"), "input", F.col("output").alias("value"), F.col("weight").cast("float").alias("weight"))
    return tb.merged(_flat(_kb(s, d)), more)


def kb_remove(s, d):
    return tb.removed(_flat(_kb(s, d)), 5)


def kb_rebuild(s, d):
    """Approved pairs newest first."""
    a = table(s, d, "approved_data").select((-F.col("id")).alias("key"), "id", "input")
    return tb.renumbered(a, "key").drop("key")


def kb_stats(s, d):
    kb = table(s, d, "examples")
    return kb.groupBy(F.col("output.format").alias("format")).agg(F.count("*").alias("n"), F.sum((F.col("weight") == 0).cast("bigint")).alias("silent"), F.round(F.sum(F.col("weight").cast("double")), 4).alias("weight"))


def list_chats(s, d):
    """The last state of each chat that is not archived."""
    rows = table(s, d, "chats")
    last = rows.groupBy("id").agg(F.max_by(F.struct("title", "archived", "updated_at"), F.struct("updated_at", "title")).alias("c")).select("id", "c.*")
    return last.filter(~F.coalesce("archived", F.lit(False))).select("id", "title", "updated_at").orderBy(F.desc("updated_at"), "id")


def list_messages(s, d):
    """Counts and the last confidence of each chat; the listing of one chat is its filter."""
    m = table(s, d, "messages").dropDuplicates(["id"])
    return m.groupBy("chat_id").agg(F.count("*").alias("n"), F.max("id").alias("last_id"), F.max_by("confidence", F.when(F.col("confidence").isNotNull(), F.col("id"))).alias("confidence"))


def last_runs(s, d):
    return tb.latest(table(s, d, "bot_runs").select("id", "bot_id", "status").distinct(), 20, F.desc("id"))


def ring_buffer(s, d):
    return tb.latest(table(s, d, "events").select("event_id", "ts", "event_type"), 500, F.desc("ts"), F.desc("event_id"))


def list_customers(s, d):
    return table(s, d, "customer").select("c_custkey", "c_name", "c_acctbal").orderBy("c_name")


def settings_upsert(s, d):
    old = table(s, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("value"))
    new = table(s, d, "supplier").groupBy(F.col("s_nationkey").alias("key")).agg(F.max("s_name").alias("value"))
    return tb.upserted(old, new.filter("key % 2 = 0"), "key")


def settings_ignore(s, d):
    old = table(s, d, "nation").filter("n_nationkey < 10").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("value"))
    new = table(s, d, "nation").select(F.col("n_nationkey").alias("key"), F.lower("n_name").alias("value"))
    return tb.inserted_or_ignored(old, new, "key")


def orders_update(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_orderstatus")
    return tb.updated(o, F.col("o_orderstatus") == "O", o_orderstatus=F.lit("X")).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def delete_cascade(s, d):
    """Raw data left once the runs of bot 1 are deleted."""
    runs = table(s, d, "bot_runs").distinct()
    raw = table(s, d, "raw_data").select("id", "bot_run_id")
    return tb.deleted_with_children(runs, raw, F.col("bot_id") == 1, "id", "bot_run_id")[1].select("id", "bot_run_id")


def delete_category(s, d):
    """Orders of a deleted segment lose their customer."""
    gone = table(s, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("gone"))
    o = table(s, d, "orders").select("o_orderkey", "o_custkey").join(gone, "o_custkey", "left")
    return o.select("o_orderkey", F.when(F.col("gone"), None).otherwise(F.col("o_custkey")).alias("o_custkey"))


def pending_raw(s, d):
    return table(s, d, "raw_data").filter("status = 'pending'").select("id", "bot_run_id", "title").orderBy(F.desc("id"))


def unadded(s, d):
    return table(s, d, "approved_data").filter("NOT added_to_kb").select("id", "input", "weight")


def browse_page(s, d):
    return tb.page(table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), 100, 100, "o_orderkey")


# Names of types as a table browser shows them.
TYPE_NAMES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "float": "FLOAT", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP"}


def browse_schema(s, d):
    """Columns and types as the table browser lists them, with the number of rows."""
    df = table(s, d, "lineitem")
    columns = F.array(*[F.struct(F.lit(c).alias("name"), F.lit(TYPE_NAMES.get(t, t.upper())).alias("type")) for c, t in df.dtypes])
    return df.agg(F.count("*").alias("n")).select(F.posexplode(columns).alias("cid", "c"), F.col("n").alias("total")).select("cid", "c.name", "c.type", "total")


def chat_messages(s, d):
    """The messages of every chat in their order of storing; one chat is its filter."""
    return table(s, d, "messages").select("chat_id", "id", "role", "content", "timestamp").distinct().orderBy("chat_id", "id")


def training_import(s, d):
    """Training items as JSON that leaves out what is the default, read back by the rules of the import."""
    from loregrid.sources.examples import as_examples, training_items

    rows = table(s, d, "examples").filter("input IS NOT NULL AND output.value IS NOT NULL")
    item = F.struct("input", F.col("output.value").alias("output"), F.when(F.col("output.format") == "Markdown", "markdown").alias("format"), F.when(F.col("weight") != 1, F.col("weight").cast("double")).alias("weight"))
    out = as_examples(training_items(rows.select(F.to_json(item).alias("value"))))
    return out.select("input", "output.format", "output.value", F.round(F.col("weight").cast("double"), 4).alias("weight"))


def collection_sizes(s, d):
    """Collections with the number of their entries, empty ones included: runs and the pairs approved from them."""
    entries = table(s, d, "approved_data").join(table(s, d, "raw_data").select(F.col("id").alias("raw_data_id"), "bot_run_id"), "raw_data_id")
    runs = table(s, d, "bot_runs").select(F.col("id").alias("bot_run_id"), "bot_id").distinct()
    sizes = entries.groupBy("bot_run_id").agg(F.count("*").alias("entries"))
    return runs.join(sizes, "bot_run_id", "left").fillna(0, ["entries"])


def reject_raw(s, d):
    """Pending rows whose hash is missing or not that of their content are rejected."""
    raw = table(s, d, "raw_data").select("id", "status", "content", "content_hash")
    off = ~F.coalesce(F.lower(F.trim("content_hash")) == F.sha2("content", 256), F.lit(False))
    return tb.updated(raw, (F.col("status") == "pending") & off, status=F.lit("rejected")).select("id", "status")


def chat_archive(s, d):
    """Untitled chats are archived, blank titles take the name of a new chat."""
    last = table(s, d, "chats").groupBy("id").agg(F.max_by(F.struct("title", "archived"), F.struct("updated_at", "title")).alias("c")).select("id", "c.*")
    blank = F.coalesce(F.trim("title") == "", F.lit(True))
    return tb.updated(last, blank, archived=F.lit(True), title=F.lit("New Chat"))


def tsv_import(s, d):
    """Pairs of the knowledge base written as tab-separated lines and read back by the rules of the import."""
    from loregrid.sources.examples import tsv_pairs

    lines = table(s, d, "approved_data").select(F.concat_ws("\t", "input", F.regexp_replace("output", r"[\t\n\r]", " "), F.lit("x")).alias("value"))
    return tsv_pairs(lines).groupBy("ok").agg(F.count("*").alias("n"), F.sum(F.char_length("output")).alias("chars"))


def export_json(s, d):
    """Each pair as the JSON object of the tagged form, newest first."""
    from loregrid.sources.examples import tagged_json

    kb = table(s, d, "examples").select("idx", "input", "output", "weight", "metadata")
    field = lambda name: F.get_json_object("value", f"$.{name}")
    rows = tagged_json(kb).select("idx", field("input").alias("input"), F.coalesce(field("output.Text"), field("output.Markdown")).alias("text"), field("weight").cast("float").alias("weight"), field("metadata").isNotNull().alias("described"))
    return rows.orderBy(F.desc("idx"))


QUERIES = {
    "kb_search": (kb_search, "SELECT idx, input FROM examples WHERE contains(lower(input), 'account') OR contains(lower(output.value), 'account')"),
    "kb_page": (kb_page, "SELECT idx, input, output.value AS value, weight FROM examples ORDER BY idx LIMIT 20 OFFSET 20"),
    "kb_merge": (kb_merge, "SELECT row_number() OVER (ORDER BY src, k) - 1 AS idx, input, value, weight FROM (SELECT 0 AS src, idx AS k, input, output.value AS value, weight FROM examples UNION ALL SELECT 1, -idx, input, output.value, weight FROM examples)"),
    "kb_append": (kb_append, "SELECT row_number() OVER (ORDER BY src, k) - 1 AS idx, input, value, weight FROM (SELECT 0 AS src, idx AS k, input, output.value AS value, weight FROM examples UNION ALL SELECT 1, id, input, output, CAST(weight AS FLOAT) FROM approved_data)"),
    "kb_remove": (kb_remove, "SELECT CASE WHEN idx > 5 THEN idx - 1 ELSE idx END AS idx, input, output.value AS value, weight FROM examples WHERE idx <> 5"),
    "kb_rebuild": (kb_rebuild, "SELECT row_number() OVER (ORDER BY id DESC) - 1 AS idx, id, input FROM approved_data"),
    "kb_stats": (kb_stats, "SELECT output.format AS format, count(*) AS n, CAST(sum(CASE WHEN weight = 0 THEN 1 ELSE 0 END) AS BIGINT) AS silent, round(sum(CAST(weight AS DOUBLE)), 4) AS weight FROM examples GROUP BY 1"),
    "list_chats": (list_chats, "WITH l AS (SELECT id, arg_max({'t': title, 'a': archived, 'u': updated_at}, {'u': updated_at, 't': title}) AS c FROM chats GROUP BY 1) SELECT id, c.t AS title, c.u AS updated_at FROM l WHERE NOT coalesce(c.a, false)"),
    "list_messages": (list_messages, "WITH m AS (SELECT DISTINCT id, chat_id, confidence FROM messages) SELECT chat_id, count(*) AS n, max(id) AS last_id, arg_max(confidence, id) FILTER (confidence IS NOT NULL) AS confidence FROM m GROUP BY 1"),
    "last_runs": (last_runs, "SELECT DISTINCT id, bot_id, status FROM bot_runs ORDER BY id DESC LIMIT 20"),
    "ring_buffer": (ring_buffer, "SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 500"),
    "list_customers": (list_customers, "SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_name"),
    "settings_upsert": (settings_upsert, "WITH n AS (SELECT s_nationkey AS key, max(s_name) AS value FROM supplier WHERE s_nationkey % 2 = 0 GROUP BY 1) SELECT n_nationkey AS key, n_name AS value FROM nation WHERE n_nationkey NOT IN (SELECT key FROM n) UNION ALL SELECT key, value FROM n"),
    "settings_ignore": (settings_ignore, "SELECT n_nationkey AS key, CASE WHEN n_nationkey < 10 THEN n_name ELSE lower(n_name) END AS value FROM nation"),
    "orders_update": (orders_update, "SELECT CASE WHEN o_orderstatus = 'O' THEN 'X' ELSE o_orderstatus END AS o_orderstatus, count(*) AS n FROM orders GROUP BY 1"),
    "delete_cascade": (delete_cascade, "SELECT id, bot_run_id FROM raw_data WHERE bot_run_id NOT IN (SELECT id FROM bot_runs WHERE bot_id = 1)"),
    "delete_category": (delete_category, "SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') THEN NULL ELSE o_custkey END AS o_custkey FROM orders"),
    "pending_raw": (pending_raw, "SELECT id, bot_run_id, title FROM raw_data WHERE status = 'pending'"),
    "unadded": (unadded, "SELECT id, input, weight FROM approved_data WHERE NOT added_to_kb"),
    "browse_page": (browse_page, "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 100"),
    "browse_schema": (browse_schema, "SELECT CAST(ordinal_position - 1 AS INTEGER) AS cid, column_name AS name, data_type AS type, (SELECT count(*) FROM lineitem) AS total FROM information_schema.columns WHERE table_name = 'lineitem'"),
    "tsv_import": (tsv_import, r"WITH l AS (SELECT regexp_replace(concat_ws(chr(9), input, regexp_replace(output, '[\t\n\r]', ' ', 'g'), 'x'), '^\s+|\s+$', '', 'g') AS line FROM approved_data), f AS (SELECT trim(string_split(line, chr(9))[1]) AS input, trim(coalesce(string_split(line, chr(9))[2], '')) AS output FROM l WHERE line <> '' AND NOT starts_with(line, '#')) SELECT strlen(input) >= 2 AND strlen(output) >= 2 AS ok, count(*) AS n, CAST(sum(length(output)) AS BIGINT) AS chars FROM f GROUP BY 1"),
    "export_json": (export_json, "SELECT idx, coalesce(input, '') AS input, CASE WHEN output.format <> 'Json' THEN coalesce(output.value, '') END AS text, weight, metadata IS NOT NULL AS described FROM examples ORDER BY idx DESC"),
    "chat_messages": (chat_messages, "SELECT DISTINCT chat_id, id, role, content, timestamp FROM messages ORDER BY chat_id, id"),
    "training_import": (training_import, "SELECT input, CASE WHEN output.format = 'Markdown' THEN 'Markdown' ELSE 'Text' END AS format, output.value AS value, round(CAST(weight AS DOUBLE), 4) AS weight FROM examples WHERE input IS NOT NULL AND output.value IS NOT NULL"),
    "collection_sizes": (collection_sizes, "WITH e AS (SELECT bot_run_id, count(*) AS entries FROM approved_data a JOIN raw_data r ON r.id = a.raw_data_id GROUP BY 1) SELECT DISTINCT id AS bot_run_id, bot_id, coalesce(entries, 0) AS entries FROM bot_runs LEFT JOIN e ON e.bot_run_id = id"),
    "reject_raw": (reject_raw, "SELECT id, CASE WHEN status = 'pending' AND NOT coalesce(lower(trim(content_hash)) = sha256(content), false) THEN 'rejected' ELSE status END AS status FROM raw_data"),
    "chat_archive": (chat_archive, "WITH l AS (SELECT id, arg_max({'t': title, 'a': archived}, {'u': updated_at, 't': title}) AS c FROM chats GROUP BY 1) SELECT id, CASE WHEN coalesce(trim(c.t) = '', true) THEN 'New Chat' ELSE c.t END AS title, CASE WHEN coalesce(trim(c.t) = '', true) THEN true ELSE c.a END AS archived FROM l"),
}
