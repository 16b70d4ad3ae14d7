"""Knowledge-base algebra and functional updates of tables: every operation gives a new DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loregrid.session import written


def renumbered(kb: DataFrame, *order: str) -> DataFrame:
    """kb with idx 0, 1, ... in the given order, without a window over all rows in one task.

    Rows are sorted by range and written once with their partition and place in it, as a second run of the sort would
    draw other bounds; counts and rows are read from that table. One count per partition travels. Rows that tie in
    the order come in any order, each with a number of its own; an empty table gives no rows.
    """
    parts = max(1, int(kb.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = kb.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # the id holds the number of the partition above 33 bits of the place in it
    ranged = written(ranged.withColumn("_id", F.monotonically_increasing_id()), "renumbered")
    ranged = ranged.withColumns({"_part": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # at most as many rows as there are shuffle partitions
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return ranged.join(F.broadcast(offsets), "_part").withColumn("idx", (F.col("_offset") + F.col("_at")).cast("bigint")).drop("_part", "_at", "_id", "_offset")


def merged(first: DataFrame, *more: DataFrame) -> DataFrame:
    """UNION ALL in order, no row dropped, idx counted anew."""
    parts = [kb.withColumn("_src", F.lit(i)).withColumnRenamed("idx", "_idx") for i, kb in enumerate((first, *more))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return renumbered(out, "_src", "_idx").drop("_src", "_idx").select(*first.columns)


def removed(kb: DataFrame, idx: int) -> DataFrame:
    """kb without the row at idx, later rows moving up; an idx that does not exist is an error."""
    if kb.filter(F.col("idx") == idx).isEmpty():
        raise IndexError(f"no example at {idx}")
    return kb.filter(F.col("idx") != idx).withColumn("idx", F.when(F.col("idx") > idx, F.col("idx") - 1).otherwise(F.col("idx")))


def searched(kb: DataFrame, text: str) -> DataFrame:
    """Rows whose input or output holds text, case aside; an empty text keeps all rows."""
    low = F.lit(text.lower())
    return kb.filter(F.lower("input").contains(low) | F.coalesce(F.lower("output.value").contains(low), F.lit(False)))


def page(df: DataFrame, offset: int, limit: int, *order: str | Column) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def upserted(old: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """Rows of new replace rows of old with the same key."""
    return old.join(new.select(*key), list(key), "left_anti").unionByName(new)


def inserted_or_ignored(old: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """Rows of new whose key is not there yet."""
    return old.unionByName(new.join(old.select(*key), list(key), "left_anti"))


def updated(df: DataFrame, where: Column, **values: Column) -> DataFrame:
    hit = F.coalesce(where, F.lit(False))
    return df.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})


def deleted_with_children(parents: DataFrame, children: DataFrame, where: Column, key: str, parent_key: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without the matching parents and what belongs to them; orphans and null keys stay."""
    gone = parents.filter(where).select(F.col(key).alias(parent_key))
    return parents.filter(~F.coalesce(where, F.lit(False))), children.join(gone, parent_key, "left_anti")


def deduplicated(new: DataFrame, stored: DataFrame, hash_column: str, *order: str) -> DataFrame:
    """Rows of new whose hash is neither stored nor that of an earlier row of new; rows without a hash are all kept."""
    fresh = new.join(stored.select(hash_column).filter(F.col(hash_column).isNotNull()), hash_column, "left_anti").select(*new.columns)
    row = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in new.columns if c not in order])
    firsts = fresh.filter(F.col(hash_column).isNotNull()).groupBy(hash_column).agg(F.min(row).alias("_r"))
    return _flat(firsts, new).unionByName(fresh.filter(F.col(hash_column).isNull()))


def _flat(firsts: DataFrame, like: DataFrame) -> DataFrame:
    return firsts.select(*[F.col(f"_r.{c}").alias(c) for c in like.columns])


def latest(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The last n rows of a log."""
    return df.orderBy(*order).limit(n)
