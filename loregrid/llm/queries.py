"""The queries of the training-data operators; `__spark_entry__` adds them when this subpackage can be imported."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loregrid.llm import boilerplate, conversations, history_dedup, leakage, packing, pair_defects, scan_repair, spam
from loregrid.session import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    found = conversations.conversations(table(spark, folder, "messages"))
    return found.select("chat_id", "turn_no", "message_id")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return history_dedup.repeated_pages(table(spark, folder, "raw_data"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return scan_repair.found(table(spark, folder, "pdf_pages"))


def p3_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    return scan_repair.paragraphs(table(spark, folder, "pdf_pages"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return pair_defects.defective(table(spark, folder, "examples"), table(spark, folder, "approved_data"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    found = leakage.leaked(table(spark, folder, "documents"), table(spark, folder, "eval_items"))
    return found.select("item_id", "doc_id").distinct()


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    pages = spam.judged(table(spark, folder, "documents"))
    return pages.filter("spam").select(F.col("page").alias("doc_id"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    pages = boilerplate.pages_of(table(spark, folder, "raw_data"), table(spark, folder, "crawled_pages"))
    return boilerplate.boilerplate_lines(pages)


def p6_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(table(spark, folder, "documents"), table(spark, folder, "pack_sizes"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p2_found": p2_found, "p3_found": p3_found, "p3_paragraphs": p3_paragraphs, "p4_found": p4_found, "p5_found": p5_found, "p6_packing": p6_packing, "p7_found": p7_found, "p8_found": p8_found}


P1_FOUND = r"""
WITH one AS (
  SELECT DISTINCT id, chat_id, role, content, timestamp AS ts FROM messages WHERE chat_id IS NOT NULL AND id IS NOT NULL),
filled AS (
  SELECT id, chat_id, lower(regexp_replace(role, '^\s+|\s+$', '', 'g')) AS r,
    regexp_replace(regexp_replace(coalesce(content, ''), '^[\s\x{00a0}\x{200b}]+', ''), '[\s\x{00a0}\x{200b}]+$', '') AS c,
    last_value(ts IGNORE NULLS) OVER (PARTITION BY chat_id ORDER BY id ROWS UNBOUNDED PRECEDING) AS ts FROM one),
said AS (
  SELECT *, CASE WHEN r IN ('user', 'human') THEN 'user' WHEN r IN ('bot', 'assistant', 'ai') THEN 'bot'
    WHEN r = 'system' THEN 'system' END AS who FROM filled),
marked AS (
  SELECT *, CASE WHEN lag(c) OVER w = c AND lag(coalesce(who, r, '')) OVER w = coalesce(who, r, '') THEN 0 ELSE 1 END AS fresh
  FROM said WINDOW w AS (PARTITION BY chat_id ORDER BY ts NULLS FIRST, id)),
numbered AS (
  SELECT *, sum(fresh) OVER (PARTITION BY chat_id ORDER BY ts NULLS FIRST, id ROWS UNBOUNDED PRECEDING) AS turn_no FROM marked),
turn AS (
  SELECT chat_id, turn_no, min(id) AS message_id, any_value(who) AS who, min(length(c)) AS shown FROM numbered GROUP BY 1, 2),
placed AS (
  SELECT *, max(turn_no) OVER c AS n, max(CASE WHEN turn_no = 1 AND who = 'system' THEN 1 ELSE 0 END) OVER c AS s
  FROM turn WINDOW c AS (PARTITION BY chat_id)),
good AS (
  SELECT chat_id FROM placed GROUP BY chat_id
  HAVING bool_and(shown > 0 AND who IS NOT NULL AND who = CASE WHEN turn_no <= s THEN 'system'
    WHEN (turn_no - s) % 2 = 1 THEN 'user' ELSE 'bot' END) AND max(n - s) >= 2 AND max(n - s) % 2 = 0)
SELECT chat_id, CAST(turn_no AS INTEGER) AS turn_no, message_id FROM turn WHERE chat_id IN (SELECT chat_id FROM good)
"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_FOUND}
