"""Validation, drift and profiling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean as C
from ..operators import profile as P
from ..operators import validate as V
from ..sources.tables import table
from .fixtures import DIRTY_ASSAY_SQL, dirty_assay, dirty_assay_raw
from .registry import register

_MISSING = ", ".join(n for n, _, _ in V.DECLARED_COLUMNS if n not in (
    "Material type", "Exposure dose (ug/mL)", "Exposure time", "Toxicity", "Viability (%)", "Assay"))


@register("validate_assay", sql=f"""
WITH {DIRTY_ASSAY_SQL.strip()},
n AS (SELECT count(*) FILTER (WHERE dose_text IS NULL) AS nd, count(*) FILTER (WHERE time_text IS NULL) AS nt
      FROM dirty)
SELECT 1 AS step, 'column_count' AS "check", false AS ok, 'expected 20 columns, found 9' AS detail,
       true AS first_failure
UNION ALL SELECT 2, 'columns_exist', false, 'missing: {_MISSING}', false
UNION ALL SELECT 3, 'numeric_types', false, 'non-numeric: Exposure dose (ug/mL) (string)', false
UNION ALL SELECT 4, 'critical_nulls', false,
  'Exposure dose (ug/mL) has ' || nd || ' nulls; Exposure time has ' || nt || ' nulls', false FROM n""")
def validate_assay(spark, sf_dir):
    """V1-V5 on the raw assay layout; the report marks the first failure."""
    return V.validate(C.normalize_columns(dirty_assay_raw(spark, sf_dir)))


@register("check_critical_nulls", sql=f"""
WITH {DIRTY_ASSAY_SQL.strip()}
SELECT CAST(count(*) FILTER (WHERE dose_text IS NULL) AS BIGINT) AS dose_nulls,
       CAST(count(*) FILTER (WHERE material_text IS NULL) AS BIGINT) AS material_nulls,
       CAST(count(*) FILTER (WHERE time_text IS NULL) AS BIGINT) AS time_nulls,
       count(*) FILTER (WHERE dose_text IS NULL) + count(*) FILTER (WHERE time_text IS NULL) = 0 AS ok
FROM dirty""")
def check_critical_nulls(spark, sf_dir):
    """V4 as one aggregate over the whole table."""
    d = dirty_assay(spark, sf_dir)
    r = d.agg(F.count_if(F.col("dose_text").isNull()).alias("dose_nulls"),
              F.count_if(F.col("material_text").isNull()).alias("material_nulls"),
              F.count_if(F.col("time_text").isNull()).alias("time_nulls"))
    return r.withColumn("ok", (F.col("dose_nulls") + F.col("material_nulls") + F.col("time_nulls")) == 0)


_SPLIT_TS = "TIMESTAMP '2024-01-16 00:00:00'"
_DRIFT_COLS = ["value", "user_id", "hr", "sparse_value"]


def _drift_side(ev, side):
    cols = [F.col("value"), F.col("user_id").cast("double").alias("user_id"),
            F.hour("ts").cast("double").alias("hr")]
    if side == 2:
        cols.append(F.when(F.col("event_id") % 3 == 0, F.lit(None).cast("double")).otherwise(F.col("value"))
                    .alias("sparse_value"))
    else:
        cols.append(F.col("value").alias("sparse_value"))
    return ev.select(*cols)


def _long_sql(side: str, tbl: str) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS col, CAST({e} AS DOUBLE) AS v, {side} AS side FROM {tbl}" for c, e in (
        ("value", "value"), ("user_id", "user_id"), ("hr", "hour(ts)"),
        ("sparse_value", "value" if side == "1" else "CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END")))


@register("drift_report", sql=f"""
WITH b AS (SELECT * FROM events WHERE ts < {_SPLIT_TS}),
c AS (SELECT * FROM events WHERE ts >= {_SPLIT_TS}),
lng AS ({_long_sql('1', 'b')} UNION ALL {_long_sql('2', 'c')}),
st AS (SELECT col, count(v) FILTER (WHERE side = 1) AS n1, count(v) FILTER (WHERE side = 2) AS n2,
              CAST(count(*) FILTER (WHERE side = 2 AND v IS NULL) AS DOUBLE) / count(*) FILTER (WHERE side = 2) AS mr
       FROM lng GROUP BY col),
pv AS (SELECT col, v, count(*) FILTER (WHERE side = 1) AS c1, count(*) FILTER (WHERE side = 2) AS c2
       FROM lng WHERE v IS NOT NULL GROUP BY col, v),
cum AS (SELECT col, v, sum(c1) OVER (PARTITION BY col ORDER BY v) AS cc1,
               sum(c2) OVER (PARTITION BY col ORDER BY v) AS cc2 FROM pv),
d AS (SELECT cum.col, max(abs(cc1 / st.n1 - cc2 / st.n2)) AS d FROM cum JOIN st ON cum.col = st.col
      GROUP BY cum.col),
lam AS (SELECT st.*, d.d, d.d * sqrt(CAST(n1 AS DOUBLE) * n2 / (n1 + n2)) AS lam
        FROM st LEFT JOIN d ON st.col = d.col),
p AS (SELECT col, CASE WHEN lam < 0.2 THEN 1.0 ELSE
        least(1.0, greatest(0.0, sum(2.0 * CASE WHEN k % 2 = 1 THEN 1.0 ELSE -1.0 END * exp(-2.0 * k * k * lam * lam))))
        END AS p
      FROM lam, range(1, 101) t(k) GROUP BY col, lam)
SELECT lam.col AS "column", lam.n1 AS n_base, lam.n2 AS n_current, round(lam.mr, 6) AS missing_ratio,
  CASE WHEN lam.mr > 0.3 THEN NULL ELSE round(lam.d, 6) END AS d_stat,
  CASE WHEN lam.mr > 0.3 THEN 0.0 ELSE round(p.p, 6) END AS p_value,
  CASE WHEN lam.mr > 0.3 THEN true ELSE p.p < 0.05 END AS drift_status,
  CASE WHEN lam.mr > 0.3 THEN 'Too many missing values' END AS message
FROM lam JOIN p ON lam.col = p.col
WHERE lam.mr > 0.3 OR (lam.n1 > 0 AND lam.n2 > 0)""")
def drift_report(spark, sf_dir):
    """V6 + V7: first half of the month against the second half, p by the limiting series."""
    return _drift(spark, sf_dir, "asymptotic")


@register("drift_report_exact")
def drift_report_exact(spark, sf_dir):
    """V7 with the exact two-sample p (one sample of the effective size beyond 10,000 rows)."""
    return _drift(spark, sf_dir, "auto")


def _drift(spark, sf_dir, method):
    ev = table(spark, sf_dir, "events")
    cut = F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    base = _drift_side(ev.where(F.col("ts") < cut), 1)
    cur = _drift_side(ev.where(F.col("ts") >= cut), 2)
    r = V.drift_report(base, cur, _DRIFT_COLS, method=method)
    return r.select("column", "n_base", "n_current", F.round("missing_ratio", 6).alias("missing_ratio"),
                    F.round("d_stat", 6).alias("d_stat"), F.round("p_value", 6).alias("p_value"),
                    "drift_status", "message")


_DIRTY_COLS = ["row_id", "material_text", "dose_text", "time_text", "time_num_text", "label_text"]


@register("null_counts", sql=f"""
WITH {DIRTY_ASSAY_SQL.strip()}
""" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS nulls "
                         f"FROM dirty" for c in _DIRTY_COLS))
def null_counts(spark, sf_dir):
    """V8: NULLs per column in one aggregate."""
    return P.null_counts(dirty_assay(spark, sf_dir))


@register("null_counts_top", sql=f"""
WITH {DIRTY_ASSAY_SQL.strip()},
n AS (""" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) "
                               f"AS nulls FROM dirty" for c in _DIRTY_COLS) + """)
SELECT * FROM n ORDER BY nulls DESC, "column" LIMIT 3""")
def null_counts_top(spark, sf_dir):
    """V8 report form: the columns with most NULLs (a top-n report)."""
    return P.null_counts(dirty_assay(spark, sf_dir), top=3)


@register("total_nulls", sql=f"""
WITH {DIRTY_ASSAY_SQL.strip()}
SELECT CAST(""" + " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in _DIRTY_COLS) + """ AS BIGINT) AS total_nulls
FROM dirty""")
def total_nulls(spark, sf_dir):
    return P.null_counts(dirty_assay(spark, sf_dir)).agg(F.sum("nulls").cast("long").alias("total_nulls"))


@register("duplicate_count", sql="""
SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS n_duplicates
FROM (SELECT count(*) AS n FROM documents GROUP BY text)""")
def duplicate_count(spark, sf_dir):
    """V9 count: rows equal (on text) to an earlier row."""
    return C.duplicate_count(table(spark, sf_dir, "documents").select("doc_id", "text"), ["text"])


@register("duplicate_rows", sql="""
SELECT d.doc_id, f.first_id FROM documents d
JOIN (SELECT text, min(doc_id) AS first_id FROM documents GROUP BY text) f ON d.text = f.text
WHERE d.doc_id <> f.first_id""")
def duplicate_rows(spark, sf_dir):
    """V9 rows: each later copy with the id of its first occurrence."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return C.duplicate_rows(d, "doc_id", ["text"], "first_id").select("doc_id", "first_id")


_LI_TYPES = [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"),
             ("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"),
             ("l_returnflag", "string"), ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz")]


@register("column_info", sql=" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{t}' AS dtype, count({c}) AS non_null FROM lineitem" for c, t in _LI_TYPES))
def column_info(spark, sf_dir):
    return P.column_info(table(spark, sf_dir, "lineitem"))


@register("nunique", sql=" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS nunique FROM lineitem" for c, _ in _LI_TYPES))
def nunique(spark, sf_dir):
    return P.nunique(table(spark, sf_dir, "lineitem"))


_NUMS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("describe", sql=" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{s}' AS stat, round(CAST({e} AS DOUBLE), 6) AS value FROM lineitem"
    for c in _NUMS for s, e in (
        ("count", f"count({c})"), ("mean", f"avg({c})"), ("std", f"stddev_samp({c})"), ("min", f"min({c})"),
        ("max", f"max({c})"), ("25%", f"quantile_cont({c}, 0.25)"), ("50%", f"quantile_cont({c}, 0.5)"),
        ("75%", f"quantile_cont({c}, 0.75)"))))
def describe(spark, sf_dir):
    d = P.describe(table(spark, sf_dir, "lineitem"), _NUMS)
    return d.select("column", "stat", F.round("value", 6).alias("value"))


@register("value_counts", sql="SELECT event_type AS value, count(*) AS count FROM events GROUP BY event_type")
def value_counts(spark, sf_dir):
    return P.value_counts(table(spark, sf_dir, "events"), "event_type")


@register("shape", sql="SELECT count(*) AS rows, CAST(6 AS BIGINT) AS columns FROM orders")
def shape(spark, sf_dir):
    return P.shape(table(spark, sf_dir, "orders"))


@register("shape_head", sql="""
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 5""")
def shape_head(spark, sf_dir):
    """First rows by key (the head report is the feature)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return P.head(o, "o_orderkey", 5)


@register("histogram", sql="""
WITH mm AS (SELECT min(l_extendedprice) AS mn, max(l_extendedprice) AS mx, avg(l_extendedprice) AS mean
            FROM lineitem),
b AS (SELECT CAST(CASE WHEN mx = mn THEN 0 ELSE least(floor((l_extendedprice - mn) / (mx - mn) * 20), 19) END
             AS INTEGER) AS bin FROM lineitem, mm WHERE l_extendedprice IS NOT NULL),
c AS (SELECT bin, count(*) AS n FROM b GROUP BY bin)
SELECT g.bin, round(mn + g.bin * (mx - mn) / 20, 6) AS lo, round(mn + (g.bin + 1) * (mx - mn) / 20, 6) AS hi,
       coalesce(c.n, 0) AS count, round(mean, 6) AS mean
FROM (SELECT CAST(range AS INTEGER) AS bin FROM range(20)) g CROSS JOIN mm LEFT JOIN c ON g.bin = c.bin""")
def histogram(spark, sf_dir):
    h = P.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice", 20)
    return h.select("bin", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "count",
                    F.round("mean", 6).alias("mean"))
