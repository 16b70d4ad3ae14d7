"""Links between pages, and what a crawl reaches along them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loregrid.session import written


def reached(links: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """(url, depth): pages on a way of at most max_depth links (src, dst) from the seeds (url), with the shortest one.

    Every round joins the pages found last with the links, and what was seen before goes; both are written tables, so
    plans do not grow. Seeds count as visited, linked or not. Null urls and links are left out; an empty table of
    seeds reaches nothing.
    """
    last = written(seeds.select("url").filter("url IS NOT NULL").distinct().withColumn("depth", F.lit(0)), "crawl-seeds")
    known = links.filter("src IS NOT NULL AND dst IS NOT NULL").select(F.col("src").alias("url"), "dst")
    parts = [last]
    for depth in range(1, max_depth + 1):
        seen = reduce(DataFrame.unionByName, parts).select("url")
        found = last.select("url").join(known, "url").select(F.col("dst").alias("url")).distinct()
        last = written(found.join(seen, "url", "left_anti").withColumn("depth", F.lit(depth)), "crawl-frontier")
        if last.isEmpty():
            break
        parts.append(last)
    return reduce(DataFrame.unionByName, parts)
