"""Column and row cleaning.

Column-level steps only rename or drop (driver-side metadata, one aggregate
pass at most); row-level steps are projections and filters that Catalyst
fuses into one codegen stage next to the scan.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..plans.ranking import null_safe_join

# Descriptive and proxy columns the reference drops when present.
DESCRIPTIVE_COLUMNS = [
    "Method core size", "Method hydro size", "Method surface charge",
    "Method surface area", "Assay", "Cell name", "Cell species",
    "Cell origin", "Cell type",
]
PROXY_COLUMNS = ["Viability (%)"]


def clean_name(name: str) -> str:
    """P1 for one header: strip a leading BOM, trim, Unicode NFKC."""
    return unicodedata.normalize("NFKC", re.sub(r"^﻿", "", str(name)).strip())


def normalize_columns(df: DataFrame) -> DataFrame:
    """Rename every column (metadata only)."""
    return df.toDF(*[clean_name(c) for c in df.columns])


def all_null_columns(df: DataFrame) -> list[str]:
    row = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(df.columns)]).first()
    return [c for i, c in enumerate(df.columns) if row[f"n{i}"] == 0]


def drop_all_null_columns(df: DataFrame) -> DataFrame:
    """One aggregate pass counts non-nulls of every column, then drop."""
    return df.drop(*all_null_columns(df))


def drop_matching(df: DataFrame, pattern: str = S.UNNAMED_PATTERN) -> DataFrame:
    """Drop columns whose name matches ``pattern``."""
    rx = re.compile(pattern)
    return df.drop(*[c for c in df.columns if rx.search(c)])


def drop_present(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Drop the named columns that exist (missing ones are ignored)."""
    names = DESCRIPTIVE_COLUMNS + PROXY_COLUMNS if names is None else names
    return df.drop(*[c for c in names if c in df.columns])


def select_required(df: DataFrame, cols: list[str]) -> DataFrame:
    """P5: keep exactly ``cols``; the error names every missing column."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)} (needed: {', '.join(cols)})")
    return df.select(*[F.col(f"`{c}`") for c in cols])


def extract_number(df: DataFrame, col: str, fill: float | None = 0.0) -> DataFrame:
    """First unsigned number in the text as double; no match -> ``fill``."""
    return df.withColumn(col, S.extract_number(F.col(f"`{col}`"), fill))


def coerce_numeric(df: DataFrame, name_part: str = "Exposure dose", fill: float | None = 0.0) -> DataFrame:
    """Every column whose name contains ``name_part`` -> double, bad -> fill."""
    out = {}
    for c in df.columns:
        if name_part in c:
            v = F.col(f"`{c}`").cast("string").try_cast("double")
            out[c] = F.coalesce(v, F.lit(fill)) if fill is not None else v
    return df.withColumns(out) if out else df


def decimal_comma(df: DataFrame, cols: list[str]) -> DataFrame:
    """P8: ',' -> '.' then numeric; bad text -> NULL."""
    return df.withColumns({c: S.decimal_comma(F.col(f"`{c}`")) for c in cols if c in df.columns})


def map_labels(df: DataFrame, col: str) -> DataFrame:
    """Trim + lower + fixed map; unmapped rows are dropped."""
    return df.withColumn(col, S.label_class(F.col(f"`{col}`"))).where(F.col(f"`{col}`").isNotNull())


def drop_duplicates(df: DataFrame, id_col: str | None = None, subset: list[str] | None = None) -> DataFrame:
    """Whole-row distinct keeping the first row.

    With ``id_col`` the kept row is the one with the smallest id, found by a
    grouped ``min`` (map-side combined), so a value repeated by a third of all
    rows is just a hot aggregate key, not a window holding all its rows.
    """
    keys = subset or [c for c in df.columns if c != id_col]
    if id_col is None:
        return df.dropDuplicates(keys)
    rest = [c for c in df.columns if c not in keys and c != id_col]
    row = F.struct(F.col(f"`{id_col}`").alias("_id"), *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(rest)])
    # the smallest id decides; the columns that are not compared come from that row
    firsts = df.groupBy(*[F.col(f"`{c}`") for c in keys]).agg(F.min_by(row, F.col(f"`{id_col}`")).alias("_row"))
    back = {id_col: F.col("_row._id")} | {c: F.col(f"_row._c{i}") for i, c in enumerate(rest)}
    return firsts.select(*[back[c].alias(c) if c in back else F.col(f"`{c}`") for c in df.columns])


def duplicate_rows(df: DataFrame, id_col: str, subset: list[str] | None = None, first_col: str | None = None) -> DataFrame:
    """V9: rows equal (on ``subset``) to a row with a smaller id; with ``first_col`` also the smallest id of these."""
    keys = subset or [c for c in df.columns if c != id_col]
    firsts = df.groupBy(*keys).agg(F.min(id_col).alias("_first"))
    later = null_safe_join(df, firsts, keys).where(F.col(id_col) != F.col("_first"))
    return later.withColumnRenamed("_first", first_col) if first_col else later.drop("_first")


def duplicate_count(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """V9: ``n_duplicates``, the rows that repeat another one on ``subset`` (all columns) less one for each value."""
    sizes = df.groupBy(*(subset or df.columns)).agg(F.count(F.lit(1)).alias("_n"))
    return sizes.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("n_duplicates"))


def drop_null_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    """Drop rows with a NULL in any of ``cols``."""
    return df.na.drop(subset=cols)


def drop_null_rows_report(df: DataFrame, cols: list[str]) -> tuple[DataFrame, dict]:
    """P11 with the reference's report: the kept rows and ``{rows_in,
    rows_dropped}`` from one aggregate over just the checked columns.
    (``DataFrame.observe`` would avoid that pass, but a registered
    Observation makes later reliable checkpoints in the session fail to
    serialise on Spark 4.1, so it is not used.)"""
    bad = None
    for c in cols:
        cond = F.col(f"`{c}`").isNull()
        bad = cond if bad is None else bad | cond
    r = df.agg(F.count(F.lit(1)).alias("rows_in"), F.count_if(bad).alias("rows_dropped")).first()
    return df.where(~bad), {"rows_in": r["rows_in"], "rows_dropped": r["rows_dropped"]}


def split_valid(df: DataFrame, bounds: dict[str, float]) -> tuple[DataFrame, DataFrame]:
    """Rows passing ``col > bound`` for all bounds, and the rejects with
    the first failing rule as ``reason``."""
    reason = None
    for c, lo in bounds.items():
        bad = ~(F.col(f"`{c}`") > F.lit(lo)) | F.col(f"`{c}`").isNull()
        reason = F.when(bad, F.lit(f"{c} must be > {lo}")) if reason is None else reason.when(
            bad, F.lit(f"{c} must be > {lo}"))
    tagged = df.withColumn("reason", reason)
    return tagged.where(F.col("reason").isNull()).drop("reason"), tagged.where(F.col("reason").isNotNull())


def clean(df: DataFrame, mode: str = "train", id_col: str | None = None,
          time_col: str = "Exposure time", target: str = "Toxicity") -> DataFrame:
    """The whole cleaning chain (P1-P4, P6, P7, P9, P10) in the reference order.

    ``mode='score'`` keeps NULLs instead of filling (the batch scorer drops
    such rows afterwards), removing the train/serve skew of the reference.
    """
    fill = 0.0 if mode == "train" else None
    df = normalize_columns(df)
    df = drop_all_null_columns(df)
    df = drop_matching(df)
    df = drop_present(df)
    if time_col in df.columns:
        df = extract_number(df, time_col, fill)
    df = coerce_numeric(df, "Exposure dose", fill)
    if target in df.columns:
        df = map_labels(df, target)
    return drop_duplicates(df, id_col)
