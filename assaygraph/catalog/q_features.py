"""Feature engineering queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as FE
from ..sources.tables import assay_base, table
from .registry import register
from .sql_common import ASSAY_CTE, ASSAY_ENC_CTE

_NUMS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CATS = ["click", "error", "purchase", "signup", "view"]   # sorted event types of the fixture


def _mm_sql(c):
    return (f"round(CASE WHEN max({c}) OVER () = min({c}) OVER () THEN 0.0 ELSE ({c} - min({c}) OVER ()) / "
            f"(max({c}) OVER () - min({c}) OVER ()) END, 6) AS {c}")


@register("min_max_scale", sql=f"SELECT {', '.join(_mm_sql(c) for c in _NUMS)} FROM lineitem")
def min_max_scale(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(*_NUMS)
    s = FE.min_max_scale(li, _NUMS)
    return s.select(*[F.round(c, 6).alias(c) for c in _NUMS])


@register("min_max_fit_apply", sql="""
WITH f AS (SELECT min(o_totalprice) AS mn, max(o_totalprice) AS mx FROM orders
           WHERE o_orderdate < TIMESTAMP '1996-01-01 00:00:00')
SELECT o_orderkey, round((o_totalprice - mn) / (mx - mn), 6) AS price_scaled FROM orders, f""")
def min_max_fit_apply(spark, sf_dir):
    """F1 fitted on early orders, applied to all (values may leave [0, 1])."""
    o = table(spark, sf_dir, "orders")
    fit = o.where(F.col("o_orderdate") < F.lit("1996-01-01 00:00:00").cast("timestamp_ntz"))
    s = FE.min_max_scale(o, ["o_totalprice"], fit_on=fit)
    return s.select("o_orderkey", F.round("o_totalprice", 6).alias("price_scaled"))


@register("standard_scale", sql="SELECT " + ", ".join(
    f"round(CASE WHEN stddev_pop({c}) OVER () = 0 THEN 0.0 ELSE ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () END,"
    f" 6) AS {c}" for c in _NUMS) + " FROM lineitem")
def standard_scale(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(*_NUMS)
    s = FE.standard_scale(li, _NUMS)
    return s.select(*[F.round(c, 6).alias(c) for c in _NUMS])


@register("one_hot", sql="SELECT event_id, " + ", ".join(
    f"CAST(coalesce(event_type = '{v}', false) AS DOUBLE) AS event_type_{v}" for v in CATS) + " FROM events")
def one_hot(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    cats = FE.fit_categories(ev, "event_type")
    return ev.select("event_id", *[e.alias(f"event_type_{v}") for e, v in zip(FE.one_hot_exprs("event_type", cats), cats)])


@register("one_hot_unseen", sql="SELECT p_partkey, " + ", ".join(
    f"CAST(coalesce(p_type = '{v}', false) AS DOUBLE) AS is_{v.lower()}" for v in
    ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL"]) + " FROM part")
def one_hot_unseen(spark, sf_dir):
    """F2 fitted on a category list without 'STANDARD': unseen -> all zeros."""
    p = table(spark, sf_dir, "part")
    fit = p.where(F.col("p_type") != "STANDARD")
    cats = FE.fit_categories(fit, "p_type")
    return p.select("p_partkey", *[e.alias(f"is_{v.lower()}") for e, v in zip(FE.one_hot_exprs("p_type", cats), cats)])


@register("column_transformer", sql=f"""
WITH {ASSAY_ENC_CTE.strip()}
SELECT row_id, 0 AS pos, round(xd, 6) AS value FROM enc
UNION ALL SELECT row_id, 1, round(xh, 6) FROM enc
""" + "".join(f"UNION ALL SELECT row_id, {i + 2}, CAST(material = '{v}' AS DOUBLE) FROM enc\n"
              for i, v in enumerate(CATS)))
def column_transformer(spark, sf_dir):
    """[min-max dose, min-max hour, one-hot material] as one array, shown
    exploded to (row_id, pos, value)."""
    a = assay_base(spark, sf_dir)
    params = FE.fit_encoder(a, ["dose", "hr"], ["material"])
    x = FE.encode(a, params)
    return x.select("row_id", F.posexplode("x").alias("pos", "value")).select(
        "row_id", F.col("pos").cast("int").alias("pos"), F.round("value", 6).alias("value"))


@register("final_dataset", sql=f"""
WITH {ASSAY_ENC_CTE.strip()}
SELECT row_id, round(xd, 6) AS dose, round(xh, 6) AS time, """ + ", ".join(
    f"CAST(material = '{v}' AS DOUBLE) AS \"Material type_{v}\"" for v in CATS) + ", toxic AS toxicity FROM enc")
def final_dataset(spark, sf_dir):
    """chosen continuous columns min-max scaled + one-hot + target."""
    a = assay_base(spark, sf_dir)
    params = FE.fit_encoder(a, ["dose", "hr"], ["material"])
    exprs = FE.encode_exprs(params)
    names = ["dose", "time"] + [f"Material type_{v}" for v in params.categories["material"]]
    return a.select("row_id", *[F.round(e, 6).alias(n) if i < 2 else e.alias(n) for i, (e, n) in
                                enumerate(zip(exprs, names))], F.col("toxic").alias("toxicity"))


_CORR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "q2t"]
_CORR_SQL_EXPR = {"l_quantity": "l_quantity", "l_extendedprice": "l_extendedprice", "l_discount": "l_discount",
                  "l_tax": "l_tax", "q2t": "(l_quantity * 2 + l_tax)"}


@register("correlation_matrix", sql=" UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(abs(corr({_CORR_SQL_EXPR[a]}, {_CORR_SQL_EXPR[b]})), 6) AS r "
    f"FROM lineitem" for i, a in enumerate(_CORR_COLS) for b in _CORR_COLS[i + 1:]))
def correlation_matrix(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("q2t", F.col("l_quantity") * 2 + F.col("l_tax"))
    return FE.correlation_matrix(li, _CORR_COLS).select("col_a", "col_b", F.round("r", 6).alias("r"))


_HC = [("a", "l_quantity"), ("b", "l_quantity + l_discount * 150"), ("c", "l_quantity + l_discount * 300"),
       ("d", "l_extendedprice"), ("e", "l_tax"), ("f", "CAST(l_returnflag = 'R' AS DOUBLE) + l_tax")]
_HC_PROT = [("Material type_A", "CAST(l_returnflag = 'A' AS DOUBLE)"),
            ("Material type_N", "CAST(l_returnflag = 'N' AS DOUBLE)"),
            ("Material type_R", "CAST(l_returnflag = 'R' AS DOUBLE)")]


def _hc_sql() -> str:
    cols = ", ".join(f"{e} AS {n}" for n, e in _HC) + ", " + ", ".join(f"{e} AS \"{n}\"" for n, e in _HC_PROT)
    names = [n for n, _ in _HC]
    s1 = []
    for j, c in enumerate(names):
        cond = " OR ".join(f"abs(corr({names[i]}, {c})) > 0.9" for i in range(j)) or "false"
        s1.append(f"SELECT '{c}' AS col, {j} AS k, ({cond}) AS s1, "
                  f"({' OR '.join(f'abs(corr({c}, \"{p}\")) > 0.9' for p, _ in _HC_PROT)}) AS s2 FROM t")
    return (f"WITH t AS (SELECT {cols} FROM lineitem), s AS ({' UNION ALL '.join(s1)}) "
            "SELECT col AS \"column\", coalesce(s1, false) OR coalesce(s2, false) AS dropped, "
            "CASE WHEN coalesce(s1, false) THEN 1 WHEN coalesce(s2, false) THEN 2 ELSE 0 END AS step FROM s")


@register("drop_high_correlation", sql=_hc_sql())
def drop_high_correlation(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    d = li.select(*[F.expr(e).alias(n) for n, e in _HC], *[F.expr(e).alias(n) for n, e in _HC_PROT])
    return FE.high_correlation(d, [n for n, _ in _HC], 0.9, "Material type_")


@register("drop_zero_variance", sql="""
SELECT 'l_quantity' AS "column", count(DISTINCT l_quantity) AS nunique, count(DISTINCT l_quantity) <= 1 AS dropped
FROM lineitem
UNION ALL SELECT 'l_linestatus', count(DISTINCT l_linestatus), count(DISTINCT l_linestatus) <= 1 FROM lineitem
UNION ALL SELECT 'constant', count(DISTINCT 1), true FROM lineitem
UNION ALL SELECT 'empty', CAST(0 AS BIGINT), true FROM lineitem GROUP BY ()""")
def drop_zero_variance(spark, sf_dir):
    """F7 with the distinct counts behind each decision."""
    li = table(spark, sf_dir, "lineitem").select("l_quantity", "l_linestatus", F.lit(1).alias("constant"),
                                                 F.lit(None).cast("double").alias("empty"))
    cols = li.columns
    row = li.agg(*[F.count_distinct(c).alias(c) for c in cols]).first()
    zero = set(FE.zero_variance(li, cols))
    return spark.createDataFrame([(c, int(row[c]), c in zero) for c in cols],
                                 "column string, nunique long, dropped boolean")


def _vif_sql() -> str:
    return """
WITH g AS (SELECT sum(l_quantity * l_quantity) AS a, sum(l_discount * l_discount) AS b, sum(l_tax * l_tax) AS c,
                  sum(l_quantity * l_discount) AS d, sum(l_quantity * l_tax) AS e, sum(l_discount * l_tax) AS f
           FROM lineitem),
dt AS (SELECT *, a * (b * c - f * f) - d * (d * c - f * e) + e * (d * f - b * e) AS det FROM g)
SELECT 'l_quantity' AS "column", round(a * (b * c - f * f) / det, 6) AS vif FROM dt
UNION ALL SELECT 'l_discount', round(b * (a * c - e * e) / det, 6) FROM dt
UNION ALL SELECT 'l_tax', round(c * (a * b - d * d) / det, 6) FROM dt"""


@register("vif", sql=_vif_sql())
def vif(spark, sf_dir):
    """F8: uncentred VIF (no intercept) of three columns from one Gram pass."""
    li = table(spark, sf_dir, "lineitem")
    return FE.vif(li, ["l_quantity", "l_discount", "l_tax"]).select("column", F.round("vif", 6).alias("vif"))


@register("drop_high_vif")
def drop_high_vif(spark, sf_dir):
    """F8 loop on five columns, two of them collinear."""
    li = table(spark, sf_dir, "lineitem").withColumn("q2t", F.col("l_quantity") * 2 + F.col("l_tax"))
    return FE.high_vif(li, ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "q2t"], 10.0)


@register("multicollinearity_filter")
def multicollinearity_filter(spark, sf_dir):
    """correlation -> zero variance -> VIF; one row per surviving column."""
    li = table(spark, sf_dir, "lineitem")
    d = li.select(*[F.expr(e).alias(n) for n, e in _HC], *[F.expr(e).alias(n) for n, e in _HC_PROT],
                  F.lit(3.0).alias("g"))
    keep = FE.multicollinearity(d, [n for n, _ in _HC] + ["g"], 0.9, 10.0)
    return spark.createDataFrame([(c,) for c in keep], "column string")
