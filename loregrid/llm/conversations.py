"""Rebuilding conversations from message rows.

Rows are read as an event log. Each row is an event on a message id: a create, an edit, a delete or a retry.
The log is folded by version into the final messages, messages are ordered, retries said again right after
themselves are folded into one turn, and conversations are validated.

No chat is ever gathered into one task: ordering works on range-partitioned segments of (chat, time, id),
each segment hands its number of turns and its last turn to the next ones through one small row, and all
verdicts about a chat are plain aggregates with map-side combining.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loregrid.session import written

#: Spellings of the speakers after trimming and lower-casing.
SPEAKERS = {"user": "user", "human": "user", "bot": "bot", "assistant": "bot", "ai": "bot", "system": "system"}

#: White space, controls and characters of no width: what shows nothing.
_BLANK = r"[\s\p{Z}\p{C}]"

#: Ids of one block when times are filled in; bounds the rows of a window whatever the size of a chat.
FILL_BLOCK = 20_000


def speaker(role: Column) -> Column:
    """user, bot or system; null when the role names none of them."""
    spellings = F.create_map(*[F.lit(x) for pair in SPEAKERS.items() for x in pair])
    return spellings[F.lower(F.regexp_replace(role, f"^{_BLANK}+|{_BLANK}+$", ""))]


def visible(content: Column) -> Column:
    """Whether a content shows anything; null counts as showing nothing."""
    return F.coalesce(F.length(F.regexp_replace(content, _BLANK, "")) > 0, F.lit(False))


def fold_events(events: DataFrame, key: str, version: list[str], op: str | None = None) -> DataFrame:
    """The last version of each key; keys whose last event is a 'delete' go.

    Copies of an event fold into one. Ties in all version columns are broken by the whole row, so the result is
    the same on every run. Keys that are null are dropped. `op`, if given, names the column holding
    create, edit, delete or retry.
    """
    rest = [c for c in events.columns if c not in (key, *version)]
    order = F.struct(*[F.col(c) for c in version], *[F.col(c) for c in rest])
    folded = events.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(order).alias("_last"))
    out = folded.select(key, "_last.*").select(*events.columns)
    return out.filter(F.coalesce(F.lower(op) != "delete", F.lit(True))) if op else out


def _filled_times(messages: DataFrame) -> DataFrame:
    """A null ts takes that of the next smaller id of its chat (which may itself have taken it).

    Windows run over blocks of ids; a block that begins with nulls takes the last time of the earlier blocks.
    """
    m = messages.withColumn("_block", F.floor(F.col("id") / FILL_BLOCK))
    inside = Window.partitionBy("chat_id", "_block").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    m = m.withColumn("_ts", F.last("ts", ignorenulls=True).over(inside))
    blocks = m.groupBy("chat_id", "_block").agg(
        F.max_by("ts", F.when(F.col("ts").isNotNull(), F.col("id"))).alias("_end"), F.max(F.col("_ts").isNull()).alias("_open")
    )
    earlier = Window.partitionBy("chat_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_carry", F.last("_end", ignorenulls=True).over(earlier)).filter("_open AND _carry IS NOT NULL")
    return (
        m.join(blocks.select("chat_id", "_block", "_carry"), ["chat_id", "_block"], "left")
        .withColumn("ts", F.coalesce("_ts", "_carry"))
        .drop("_block", "_ts", "_carry")
    )


def turns(messages: DataFrame) -> DataFrame:
    """Turns (chat_id, turn_no, message_id, speaker, shows) of every chat, sound or not.

    messages: id, chat_id, role, content, timestamp; other columns are ignored. Rows whose id or chat_id is null
    belong to no conversation and are dropped. Messages without any time before them stand first.
    """
    m = messages.select("id", "chat_id", "role", "content", F.col("timestamp").alias("ts")).filter("chat_id IS NOT NULL")
    # contents are only ever compared with their neighbours: a hash and a length stand for them, not to move texts
    text = F.regexp_replace(F.coalesce("content", F.lit("")), f"^{_BLANK}+|{_BLANK}+$", "")
    said = F.struct(F.xxhash64(text).alias("hash"), F.length(text).alias("size"))
    m = m.select(
        "id",
        "chat_id",
        "ts",
        speaker(F.col("role")).alias("speaker"),
        visible(F.col("content")).alias("shows"),
        said.alias("said"),
        F.lower(F.trim("role")).alias("spelled"),
    )
    m = written(_filled_times(fold_events(m, "id", ["ts", "said"])), "messages")
    # Segments of the order: a range of (chat, time, id) each, so that a large chat lies in many of them.
    parts = max(4, int(m.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    m = m.repartitionByRange(parts, "chat_id", F.col("ts").asc_nulls_first(), "id").withColumn("seg", F.spark_partition_id())
    order = [F.col("ts").asc_nulls_first(), F.col("id")]
    inside = Window.partitionBy("chat_id", "seg").orderBy(*order)
    key = F.struct(F.coalesce("speaker", "spelled", F.lit("")).alias("who"), F.col("said"))
    m = m.withColumn("key", key).withColumn("before", F.lag("key").over(inside))
    m = written(m.drop("said", "spelled"), "ordered")
    # One row for each segment of a chat: its first and last message, and how many turns begin inside it.
    ends = F.struct(F.col("ts"), F.col("id"))
    segs = m.groupBy("chat_id", "seg").agg(
        F.min_by("key", ends).alias("first"),
        F.max_by("key", ends).alias("last"),
        F.sum(F.when(F.col("before").isNotNull() & (F.col("before") != F.col("key")), 1).otherwise(0)).alias("changes"),
    )
    by_seg = Window.partitionBy("chat_id").orderBy("seg")
    segs = segs.withColumn("prior", F.lag("last").over(by_seg))
    segs = segs.withColumn("opens", (F.col("prior").isNull() | (F.col("prior") != F.col("first"))).cast("int"))
    total = F.sum(F.col("changes") + F.col("opens")).over(by_seg.rowsBetween(Window.unboundedPreceding, 0))
    segs = segs.select("chat_id", "seg", "prior", (total - F.col("changes") - F.col("opens")).alias("offset"))
    m = m.join(segs, ["chat_id", "seg"]).withColumn("before", F.coalesce("before", "prior"))
    new = (F.col("before").isNull() | (F.col("before") != F.col("key"))).cast("int")
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    m = m.withColumn("turn_no", (F.col("offset") + F.sum(new).over(running)).cast("int"))
    return m.groupBy("chat_id", "turn_no").agg(
        F.min("id").alias("message_id"), F.first("speaker").alias("speaker"), F.min("shows").alias("shows")
    )


def sound_chats(found: DataFrame) -> DataFrame:
    """Chats of `turns` that hold at most a leading system message and then strict user/bot pairs.

    An empty chat, one of a system message only, one that begins with the bot or ends with the user is not sound.
    """
    even = F.col("turn_no") % 2 == 0
    is_ = lambda who: F.coalesce(F.col("speaker") == who, F.lit(False))
    chats = found.groupBy("chat_id").agg(
        F.max("turn_no").alias("n"),
        F.max(F.col("speaker").isNull() | ~F.col("shows")).alias("broken"),
        F.sum(is_("system").cast("int")).alias("systems"),
        F.max(is_("system") & (F.col("turn_no") == 1)).alias("led"),
        F.max((is_("user") & even) | (is_("bot") & ~even)).alias("off_plain"),
        F.max((is_("user") & ~even) | (is_("bot") & even)).alias("off_led"),
    )
    plain = (F.col("systems") == 0) & ~F.col("off_plain") & (F.col("n") % 2 == 0) & (F.col("n") >= 2)
    led = (F.col("systems") == 1) & F.col("led") & ~F.col("off_led") & (F.col("n") % 2 == 1) & (F.col("n") >= 3)
    return chats.filter(~F.col("broken") & (plain | led)).select("chat_id")


def conversations(messages: DataFrame) -> DataFrame:
    """(chat_id, turn_no, message_id, speaker): the turns of sound conversations, numbered from 1."""
    found = written(turns(messages), "turns")
    return found.join(sound_chats(found), "chat_id", "left_semi").select("chat_id", "turn_no", "message_id", "speaker")
