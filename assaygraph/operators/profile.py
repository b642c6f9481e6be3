"""Profiling (V8-V15).  Every per-column statistic of a table is one
aggregate with all expressions (one scan), unpivoted afterwards with
``stack`` - never one job per column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ranking import column_quantiles


def _q(c: str) -> str:
    return "`" + c.replace("`", "``") + "`"


def _unpivot(row_df: DataFrame, cols: list[str], value_type: str, value_name: str) -> DataFrame:
    pairs = ", ".join(f"'{c}', CAST(`v{i}` AS {value_type})" for i, c in enumerate(cols))
    return row_df.selectExpr(f"stack({len(cols)}, {pairs}) AS (column, {value_name})")


def null_counts(df: DataFrame, top: int | None = None) -> DataFrame:
    """V8: NULLs per column (``column, nulls``), largest first; ``top`` keeps
    the first rows of that report (the reference prints the top 10)."""
    cols = df.columns
    row = df.agg(*[F.count_if(F.col(_q(c)).isNull()).alias(f"v{i}") for i, c in enumerate(cols)])
    out = _unpivot(row, cols, "BIGINT", "nulls")
    if top:
        out = out.orderBy(F.desc("nulls"), "column").limit(top)
    return out


def column_info(df: DataFrame) -> DataFrame:
    """``column, dtype, non_null``."""
    cols = df.columns
    row = df.agg(*[F.count(F.col(_q(c))).alias(f"v{i}") for i, c in enumerate(cols)])
    counts = _unpivot(row, cols, "BIGINT", "non_null")
    types = df.sparkSession.createDataFrame([(c, t) for c, t in df.dtypes], "column string, dtype string")
    return counts.join(F.broadcast(types), "column")  # one row per column


def nunique(df: DataFrame, cols: list[str] | None = None, approx: bool = False) -> DataFrame:
    """Distinct non-null values per column."""
    cols = cols or df.columns
    fn = F.approx_count_distinct if approx else F.count_distinct
    row = df.agg(*[fn(F.col(_q(c))).alias(f"v{i}") for i, c in enumerate(cols)])
    return _unpivot(row, cols, "BIGINT", "nunique")


def describe(df: DataFrame, cols: list[str]) -> DataFrame:
    """Count, mean, sample std, min, 25/50/75 % (linear), max per column:
    ``column, stat, value``.  Quantiles are exact and skew-safe (ranking)."""
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(_q(c)).cast("double")
        aggs += [F.count(x).cast("double").alias(f"count{i}"), F.avg(x).alias(f"mean{i}"),
                 F.stddev_samp(x).alias(f"std{i}"), F.min(x).alias(f"min{i}"), F.max(x).alias(f"max{i}")]
    row = df.agg(*aggs)
    stats = ["count", "mean", "std", "min", "max"]
    pairs = ", ".join(f"'{c}', '{s}', `{s}{i}`" for i, c in enumerate(cols) for s in stats)
    simple = row.selectExpr(f"stack({len(cols) * len(stats)}, {pairs}) AS (column, stat, value)")
    qs = column_quantiles(df, cols, [0.25, 0.5, 0.75])
    qs = qs.select("column", F.concat((F.col("q") * 100).cast("int").cast("string"), F.lit("%")).alias("stat"),
                   "value")
    # a column without values keeps its quartile rows, as NULL
    grid = df.sparkSession.createDataFrame([(c, s) for c in cols for s in ("25%", "50%", "75%")], "column string, stat string")
    return simple.unionByName(grid.join(qs, ["column", "stat"], "left"))


def value_counts(df: DataFrame, col: str, sort_by_key: bool = False) -> DataFrame:
    """``value, count``, by count desc (or by key)."""
    g = df.groupBy(F.col(_q(col)).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    return g.orderBy("value") if sort_by_key else g.orderBy(F.desc("count"), "value")


def shape(df: DataFrame) -> DataFrame:
    """V14 (shape part): one row ``rows, columns``."""
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(df.columns)).cast("bigint"))


def head(df: DataFrame, id_col: str, n: int = 5) -> DataFrame:
    """V14 (head part): the first ``n`` rows by ``id_col`` (a top-n report)."""
    return df.orderBy(id_col).limit(n)


def histogram(df: DataFrame, col: str, bins: int = 20) -> DataFrame:
    """Fixed-width bins between min and max (max falls in the last bin):
    ``bin, lo, hi, count`` plus the mean line as ``mean``."""
    x = F.col(_q(col)).cast("double")
    mm = df.agg(F.min(x).alias("mn"), F.max(x).alias("mx"), F.avg(x).alias("mean"))
    width = (F.col("mx") - F.col("mn")) / F.lit(bins)
    b = F.when(F.col("mx") == F.col("mn"), F.lit(0)).otherwise(
        F.least(F.floor((x - F.col("mn")) / (F.col("mx") - F.col("mn")) * bins), F.lit(bins - 1))).cast("int")
    binned = df.where(x.isNotNull()).crossJoin(F.broadcast(mm)).select(b.alias("bin"))  # mm: one row
    counts = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).crossJoin(F.broadcast(mm))
    return (grid.join(counts, "bin", "left")
                .select("bin", (F.col("mn") + F.col("bin") * width).alias("lo"),
                        (F.col("mn") + (F.col("bin") + 1) * width).alias("hi"),
                        F.coalesce(F.col("count"), F.lit(0)).alias("count"), "mean"))
