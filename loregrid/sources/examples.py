"""Reading and writing knowledge bases and training pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROW = "struct<input:string,output:string,weight:float,metadata:string>"
_TAGS = ("Text", "Markdown", "Json")


class MixedFormat(ValueError):
    """A file holds both plain and tagged outputs."""


def read_kb(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(file, idx, input, output, weight, metadata) of JSON array files; path may be a file, a folder or a pattern.

    Each file is either plain (output is a string, metadata is dropped) or tagged (output is an object such as
    {"Text": "..."}). A file that is neither is an error, or left out if not strict.
    """
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("body"))
    files = files.withColumn("rows", F.from_json("body", f"array<{_ROW}>"))
    tagged = lambda r: r["output"].startswith("{")
    files = files.withColumns({"some": F.exists("rows", tagged), "all": F.forall("rows", tagged), "bad": F.col("rows").isNull()})
    broken = F.col("bad") | (F.col("some") & ~F.col("all"))
    if strict:
        files = files.withColumn("rows", F.when(broken, F.raise_error(F.concat(F.lit("not a knowledge base: "), F.col("file")))).otherwise(F.col("rows")))
    else:
        files = files.filter(~F.coalesce(broken, F.lit(True)))
    rows = files.select("file", "some", F.posexplode("rows").alias("idx", "r"))
    value = F.coalesce(*[F.get_json_object("r.output", f"$.{t}") for t in _TAGS])
    fmt = F.coalesce(*[F.when(F.get_json_object("r.output", f"$.{t}").isNotNull(), F.lit(t)) for t in _TAGS])
    output = F.when(F.col("some"), F.struct(fmt.alias("format"), value.alias("value"))).otherwise(F.struct(F.lit("Text").alias("format"), F.col("r.output").alias("value")))
    weight, meta = F.coalesce("r.weight", F.lit(1.0).cast("float")), F.when(F.col("some"), F.col("r.metadata"))
    return rows.select("file", F.col("idx").cast("bigint").alias("idx"), "r.input", output.alias("output"), weight.alias("weight"), meta.alias("metadata"))


def tagged_json(kb: DataFrame) -> DataFrame:
    """(idx, value): each row as the JSON object of the tagged form."""
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(F.coalesce(c, F.lit("")).alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    sound = F.try_parse_json("output.value").isNotNull()
    body = F.when((F.col("output.format") == "Json") & sound, F.col("output.value")).otherwise(quoted("output.value"))
    value = F.concat(
        F.lit('{"input":'), quoted("input"),
        F.lit(',"output":{"'), F.coalesce("output.format", F.lit("Text")), F.lit('":'), body, F.lit('},"weight":'), F.coalesce("weight", F.lit(1.0)).cast("string"),
        F.when(F.col("metadata").isNotNull(), F.concat(F.lit(',"metadata":'), F.col("metadata"))).otherwise(""), F.lit("}"),
    )
    return kb.select("idx", value.alias("value"))


def write_kb(kb: DataFrame, path: str) -> None:
    """One object on each line, in the order of idx, in as many files as the data needs."""
    tagged_json(kb).repartitionByRange("idx").sortWithinPartitions("idx").select("value").write.text(path)


def read_kb_lines(spark: SparkSession, path: str) -> DataFrame:
    """What write_kb wrote; idx by the order of files and lines is given by the caller's own column, so none here."""
    rows = spark.read.text(path).select(F.from_json("value", _ROW).alias("r"))
    value = F.coalesce(*[F.get_json_object("r.output", f"$.{t}") for t in _TAGS])
    fmt = F.coalesce(*[F.when(F.get_json_object("r.output", f"$.{t}").isNotNull(), F.lit(t)) for t in _TAGS])
    return rows.select("r.input", F.struct(fmt.alias("format"), value.alias("value")).alias("output"), "r.weight", "r.metadata")


def training_items(lines: DataFrame) -> DataFrame:
    """(category_id, input, output, format, weight) of JSON objects (value): format is text and weight 1 where they are left out.

    An object without input or output is an error, as is what is no object.
    """
    item = F.from_json("value", "struct<input:string,output:string,format:string,weight:double,category_id:bigint>")
    rows = lines.select("value", item.alias("r"))
    sound = F.col("r.input").isNotNull() & F.col("r.output").isNotNull()
    rows = rows.withColumn("r", F.when(sound, F.col("r")).otherwise(F.raise_error(F.concat(F.lit("no training item: "), F.coalesce("value", F.lit("null"))))))
    return rows.select("r.category_id", "r.input", "r.output", F.coalesce("r.format", F.lit("text")).alias("format"), F.coalesce("r.weight", F.lit(1.0)).alias("weight"))


def as_examples(items: DataFrame) -> DataFrame:
    """(input, output, weight) of training items; only markdown keeps its format, all else is text."""
    fmt = F.when(F.col("format") == "markdown", "Markdown").otherwise("Text")
    return items.select("input", F.struct(fmt.alias("format"), F.col("output").alias("value")).alias("output"), F.col("weight").cast("float").alias("weight"))


def document_text(pages: DataFrame) -> DataFrame:
    """(file, text) of pages (file, page_number, text): each page cleaned, those of a file joined in order by blank lines."""
    from loregrid.functions.arrow import clean_text

    rows = pages.select("file", "page_number", clean_text(F.col("text")).alias("text")).filter("text <> ''")
    texts = rows.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("page_number", "text"))).alias("pages"))
    return texts.select("file", F.array_join("pages.text", "\n\n").alias("text"))


def tsv_pairs(lines: DataFrame) -> DataFrame:
    """(input, output, ok) of lines (value): trimmed, blank lines and comments gone; ok needs two fields of 2 bytes or more."""
    edge = r"^[\p{IsWhite_Space}]+|[\p{IsWhite_Space}]+$"
    rows = lines.select(F.regexp_replace("value", edge, "").alias("line")).filter((F.col("line") != "") & ~F.col("line").startswith("#"))
    field = lambda i: F.regexp_replace(F.coalesce(F.get(F.split("line", "\t"), F.lit(i)), F.lit("")), edge, "")
    rows = rows.select(field(0).alias("input"), field(1).alias("output"))
    return rows.withColumn("ok", (F.octet_length("input") >= 2) & (F.octet_length("output") >= 2))


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    return tsv_pairs(spark.read.text(path))


def read_document_pages(spark: SparkSession, path: str, extract: Callable[[bytes], list[str]]) -> DataFrame:
    """(file, page_number, text) of binary documents; `extract` turns the bytes of one file into the texts of its pages."""
    from loregrid.functions.text import is_garbage

    def pages(batches):
        import pandas as pd

        for b in batches:
            yield pd.DataFrame(
                [(p, i, t) for p, c in zip(b.path, b.content) for i, t in enumerate(extract(c), 1)], columns=["file", "page_number", "text"]
            )

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    found = files.mapInPandas(pages, "file string, page_number int, text string")
    return found.filter((F.trim("text") != "") & ~is_garbage(F.col("text")))
