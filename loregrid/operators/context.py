"""The last turns of a conversation as context of a query."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def window(turns: DataFrame, n: int) -> DataFrame:
    """turns (conv_id, turn, question, answer) with `history`, the n (question, answer) pairs before each; [] if n is 0."""
    if n <= 0:
        return turns.withColumn("history", F.array().cast("array<struct<question:string,answer:string>>"))
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-n, -1)
    return turns.withColumn("history", F.collect_list(F.struct("question", "answer")).over(w))


def rendered(history: Column, style: str | Callable[[Column], Column]) -> Column:
    """The history as text: qa_pairs, list or sentence, or a function of the column."""
    if callable(style):
        return style(history)
    join = lambda form, by: F.array_join(F.transform(history, form), by)
    if style == "qa_pairs":
        return join(lambda h: F.concat(F.lit("Q: "), h["question"], F.lit(" A: "), h["answer"], F.lit(" ")), "")
    if style == "list":
        return F.concat(F.lit("["), join(lambda h: F.concat(h["question"], F.lit(" -> "), h["answer"]), ", "), F.lit("]"))
    if style == "sentence":
        return F.concat(F.lit("Previous questions and answers: "), join(lambda h: F.concat(h["question"], F.lit(" - "), h["answer"]), "; "))
    raise ValueError(f"unknown style {style}")


def enhanced(query: Column, context: Column) -> Column:
    """The query with its context; without one it stands alone."""
    return F.when(context == "", query).otherwise(F.concat(query, F.lit(" [Context: "), context, F.lit("]")))


@dataclass(frozen=True)
class ContextAgent:
    """Any agent, asked with the last turns of the conversation behind the question.

    turns: conv_id, turn, question, answer; a null question or answer stands as an empty one. Each turn is a query of
    its own, numbered by a hash of (conv_id, turn), which must be unique.
    """

    base: Any
    size: int = 5
    style: str | Callable[[Column], Column] = "qa_pairs"

    def append(self, more: DataFrame) -> ContextAgent:
        return replace(self, base=self.base.append(more))

    def queries(self, turns: DataFrame) -> DataFrame:
        """(query_id, conv_id, turn, text): each question with its context."""
        plain = turns.select("conv_id", "turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("question", "answer")])
        text = enhanced(F.col("question"), rendered(F.col("history"), self.style))
        return window(plain, self.size).select(F.xxhash64("conv_id", "turn").alias("query_id"), "conv_id", "turn", text.alias("text"))

    def _asked(self, turns: DataFrame, ask: Callable[[DataFrame], DataFrame]) -> DataFrame:
        q = self.queries(turns)
        return ask(q.select("query_id", "text")).join(q.select("query_id", "conv_id", "turn"), "query_id").drop("query_id")

    def predict(self, turns: DataFrame) -> DataFrame:
        return self._asked(turns, self.base.predict)

    def confidence(self, turns: DataFrame) -> DataFrame:
        return self._asked(turns, self.base.confidence)
