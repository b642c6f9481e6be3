"""Line dedup by site-relative frequency.

A line is boilerplate of a host if it stands on more than ``max_ratio`` of the
host's pages (and on ``min_pages`` pages at least).  Both counts are grouped
sums with map-side combine.  The ratios of one page's lines sum up to its
number of lines, so a host has at most (mean lines per page) / ``max_ratio``
boilerplate lines, whatever its number of pages: each host's list is short
and goes back to the pages by one join on the host.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import maybe_broadcast, stored, unused

#: The hosts' lists are broadcast up to so many characters, and joined by a shuffle beyond.
BROADCAST_CHARS = 16_000_000


def _lines(col):
    return F.split(F.coalesce(col, F.lit("")), "\n", -1)


def _key(line):
    return F.trim(line)


def boilerplate(docs: DataFrame, max_ratio: float = 0.1, min_pages: int = 3, host_col: str = "source",
                text_col: str = "text") -> DataFrame:
    """``host, n_pages, lines``: the sorted boilerplate lines of each host that has any."""
    pages = docs.select(F.col(host_col).cast("string").alias("host"), F.col(text_col).cast("string").alias("_text"))
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("n_pages"))
    keys = pages.select("host", F.explode(F.array_distinct(F.transform(_lines(F.col("_text")), _key))).alias("line"))
    counts = (keys.where("line != ''").groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
                  .where(F.col("n") >= min_pages))
    totals = totals.withColumnRenamed("host", "_h")
    joined = counts.join(maybe_broadcast(totals), F.col("host").eqNullSafe(F.col("_h")))
    return (joined.where(F.col("n") > F.col("n_pages") * max_ratio).groupBy("host")
                  .agg(F.first("n_pages").alias("n_pages"), F.sort_array(F.collect_list("line")).alias("lines")))


def drop_boilerplate(docs: DataFrame, max_ratio: float = 0.1, min_pages: int = 3, host_col: str = "source",
                     text_col: str = "text", out_col: str | None = None) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text_col``; plus ``_n_lines`` and ``_n_dropped`` (long).

    Lines are cut at line feeds and compared without spaces at their ends.
    Blank lines are neither counted nor dropped.  A line that recurs on one
    page counts once there but is dropped each time.  A null text counts as a
    page without lines and stays null (0 lines); null hosts are one host.
    Repeated rows count as pages of their own.  An empty table stays empty;
    other columns pass through.
    """
    host, hot, every, kept, new = unused(docs.columns, "host", "hot", "all", "kept", "new")
    lines = stored(boilerplate(docs, max_ratio, min_pages, host_col, text_col), "boilerplate")
    lines = lines.select(F.col("host").alias(host), F.col("lines").alias(hot))
    size = lines.agg(F.sum(F.length(F.array_join(hot, "")) + 64)).first()[0] or 0
    joined = docs.join(F.broadcast(lines) if size <= BROADCAST_CHARS else lines,
                       F.col(host_col).cast("string").eqNullSafe(F.col(host)), "left")
    joined = joined.withColumn(every, _lines(F.col(text_col).cast("string"))).withColumn(
        kept, F.when(F.col(hot).isNull(), F.col(every)).otherwise(
            F.filter(every, lambda line: ~F.array_contains(F.col(hot), _key(line)))))
    has_text = F.col(text_col).isNotNull()
    joined = joined.withColumns({
        "_n_lines": F.when(has_text, F.size(every)).otherwise(0).cast("long"),
        "_n_dropped": F.when(has_text, F.size(every) - F.size(kept)).otherwise(0).cast("long"),
        new: F.when(has_text, F.array_join(kept, "\n"))})
    out = joined.withColumn(out_col or text_col, F.col(new))
    return out.drop(host, hot, every, kept, new)
