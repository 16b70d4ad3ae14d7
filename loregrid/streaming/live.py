"""Structured Streaming: incremental ingest with hash dedup, and the last turns of a conversation as state."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loregrid.session import shared_folder, written


def stream_of(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the data folder as a stream of its files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parque[t]")


def fresh_rows(stream: DataFrame, hash_column: str, time_column: str | None = None, late: str = "7 days") -> DataFrame:
    """The first row of each hash; with a time column, state older than `late` is let go."""
    if time_column is None:
        return stream.dropDuplicates([hash_column])
    return stream.withColumn(time_column, F.col(time_column).cast("timestamp")).withWatermark(time_column, late).dropDuplicatesWithinWatermark([hash_column])


def running_context(messages: DataFrame, n: int) -> DataFrame:
    """(conv_id, turn, question, history) of a stream of messages (conv_id, id, who, content), history as text.

    who is q or a, any other row is passed over. A turn is a q and the a right after it, and comes out once the answer
    is there; its number is the id of the question. Rows of one batch are taken by id, a row whose id came before is a
    copy. The state of a conversation is its last n turns and the question that still waits. Null contents are empty.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, turn, question, asked, said = state.get if state.exists else (None, None, None, [], [])
        asked, said = list(asked), list(said)
        rows = []
        for r in pd.concat(list(batches)).sort_values("id").itertuples():
            if last is not None and r.id <= last or r.who not in ("q", "a"):
                continue
            last, text = r.id, r.content or ""
            if r.who == "q":
                turn, question = r.id, text
                continue
            if turn is not None:
                rows.append((key[0], turn, question, "".join(f"Q: {q} A: {a} " for q, a in zip(asked, said))))
                asked, said = [*asked, question][-n:] if n else [], [*said, text][-n:] if n else []
            turn = question = None
        state.update((last, turn, question, asked, said))
        yield pd.DataFrame(rows, columns=["conv_id", "turn", "question", "history"])

    return messages.groupBy("conv_id").applyInPandasWithState(
        step, "conv_id long, turn long, question string, history string", "last long, turn long, question string, asked array<string>, said array<string>", "append", GroupStateTimeout.NoTimeout
    )


def retrained(stream: DataFrame, agent: Any, seen: Callable[[Any], None]) -> Any:
    """Run a stream of examples over what is there now; each batch is appended to the agent, which `seen` is shown.

    Only the postings of a batch are computed when it comes; gives the agent after the last batch.
    """
    now = [agent]

    def learn(batch: DataFrame, _: int) -> None:
        now[0] = now[0].append(written(batch, "examples-batch"))
        seen(now[0])

    folder = f"{shared_folder(stream.sparkSession).rstrip('/')}/loregrid/retrained-{uuid.uuid4().hex}"
    stream.writeStream.foreachBatch(learn).option("checkpointLocation", folder).trigger(availableNow=True).start().awaitTermination()
    return now[0]


def drained(stream: DataFrame, label: str) -> DataFrame:
    """Run a stream over what is there now and give what it wrote."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark).rstrip('/')}/loregrid/{label}-{uuid.uuid4().hex}"
    run = stream.writeStream.format("parquet").option("checkpointLocation", f"{base}-state").outputMode("append").trigger(availableNow=True).start(base)
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(base)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events by type and window of time, late rows within the watermark included."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
