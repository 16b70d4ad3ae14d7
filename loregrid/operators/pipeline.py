"""From stored raw pages to training pairs: what a processing run finds, what of it is new, and what it leaves behind."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loregrid.functions import arrow as ax
from loregrid.functions import text as tx
from loregrid.operators import tables as tb
from loregrid.session import written


@dataclass(frozen=True)
class Processed:
    """pairs (raw_id, at, input, output, hash, added), raw (the table after the run), counts (found, added)."""

    pairs: DataFrame
    raw: DataFrame
    counts: DataFrame


def summary_pairs(title: Column, text: Column) -> Column:
    """array(struct(input, output)): what a page is about, by its title; none where title or text is too short."""
    title = F.trim(title)
    answer = ax.truncated(text, F.lit(500))
    pair = lambda q: F.struct(q.alias("input"), answer.alias("output"))
    asks = F.array(pair(F.concat(F.lit("Was ist "), title, F.lit("?"))), F.when(~title.endswith("?"), pair(F.concat(title, F.lit("?")))))
    return F.when(F.coalesce((F.octet_length(title) >= 3) & (F.octet_length(answer) >= 20), F.lit(False)), F.array_compact(asks))


def process_pending(raw: DataFrame, strategy: str = "heading_content", least: int = 20) -> Processed:
    """Pending rows of raw (id, title, content, content_hash, status) turned into pairs and approved.

    Contents that are binary or empty once cleaned are approved and bring nothing. A pair is added unless its hash is
    that of a stored row or of an earlier pair; earlier is by id of the row, then by place on its page. Null contents
    are empty ones. Rows are taken as they are, copies included.
    """
    waits = F.coalesce(F.col("status") == "pending", F.lit(False))
    pages = raw.filter(waits & ~F.coalesce(tx.is_binary(F.col("content")), F.lit(True)))
    pages = pages.select(F.col("id").alias("raw_id"), "title", tx.clean_content(F.col("content")).alias("text")).filter("text <> ''")
    none = F.array().cast("array<struct<input:string,output:string>>")
    both = F.concat(F.coalesce(ax.page_pairs(F.col("text"), strategy, least), none), F.coalesce(summary_pairs(F.col("title"), F.col("text")), none))
    pairs = pages.select("raw_id", F.posexplode(both).alias("at", "p")).select("raw_id", "at", "p.input", "p.output")
    pairs = written(pairs.withColumn("hash", F.sha2(F.concat_ws(":", "input", "output"), 256)), "found-pairs")
    stored = raw.select(F.col("content_hash").alias("hash")).filter("hash IS NOT NULL").distinct().withColumn("stored", F.lit(True))
    first = pairs.groupBy("hash").agg(F.min(F.struct("raw_id", "at")).alias("first")).join(stored, "hash", "left")
    added = F.col("stored").isNull() & (F.struct("raw_id", "at") == F.col("first"))
    pairs = written(pairs.join(first, "hash").select("raw_id", "at", "input", "output", "hash", added.alias("added")), "judged-pairs")
    counts = pairs.agg(F.count("*").alias("found"), F.count_if("added").alias("added"))
    return Processed(pairs, tb.updated(raw, waits, status=F.lit("approved")), counts)


def added_to_kb(kb: DataFrame, approved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The knowledge base (idx, input, output, weight) with the approved pairs not yet added behind it by id, and approved with all marked."""
    fresh = approved.filter("NOT coalesce(added_to_kb, false)").select(
        F.col("id").alias("idx"), "input", F.struct(F.lit("Text").alias("format"), F.col("output").alias("value")).alias("output"), F.col("weight").cast("float").alias("weight")
    )
    return tb.merged(kb.select("idx", "input", "output", "weight"), fresh), tb.updated(approved, F.lit(True), added_to_kb=F.lit(True))
