"""One small query per column function (C1-C25), each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..sources.tables import table
from .registry import register

NUM = r"(\d+\.?\d*)"


def _q(name, tbl, sql_cols, spark_cols):
    """Register a projection query: ``SELECT <sql_cols> FROM tbl``."""
    sql = f"SELECT {', '.join(f'{e} AS {a}' for a, e in sql_cols)} FROM {tbl}"

    def fn(spark, sf_dir):
        df = table(spark, sf_dir, tbl)
        return df.select(*[c(df).alias(a) for a, c in spark_cols])

    fn.__doc__ = f"{name}: column function over {tbl}"
    register(name, sql=sql)(fn)


_q("fn_strip", "part", [("p_partkey", "p_partkey"), ("v", "trim('  ' || p_type || ' ')")],
   [("p_partkey", lambda d: F.col("p_partkey")),
    ("v", lambda d: S.strip(F.concat(F.lit("  "), F.col("p_type"), F.lit(" "))))])
_q("fn_lower", "customer", [("c_custkey", "c_custkey"), ("v", "lower(c_mktsegment)")],
   [("c_custkey", lambda d: F.col("c_custkey")), ("v", lambda d: S.lower("c_mktsegment"))])
_q("fn_replace_regex", "documents", [("doc_id", "doc_id"), ("v", "md5(regexp_replace(text, '[0-9]+', '#', 'g'))")],
   [("doc_id", lambda d: F.col("doc_id")), ("v", lambda d: F.md5(S.replace_regex("text", "[0-9]+", "#")))])
_q("fn_extract_first", "part",
   [("p_partkey", "p_partkey"), ("v", f"NULLIF(regexp_extract(p_brand, '{NUM}', 1), '')")],
   [("p_partkey", lambda d: F.col("p_partkey")), ("v", lambda d: S.extract_first("p_brand"))])
_q("fn_contains_regex", "pages", [("page_id", "page_id"), ("v", "regexp_matches(html, '(?i)<script')")],
   [("page_id", lambda d: F.col("page_id")), ("v", lambda d: S.contains_regex("html", "<script", ignore_case=True))])
_q("fn_contains_literal", "documents", [("doc_id", "doc_id"), ("v", "contains(text, 'the')")],
   [("doc_id", lambda d: F.col("doc_id")), ("v", lambda d: S.contains_literal("text", "the"))])
_q("fn_replace_literal", "orders", [("o_orderkey", "o_orderkey"), ("v", "replace(o_orderpriority, '-', ' ')")],
   [("o_orderkey", lambda d: F.col("o_orderkey")), ("v", lambda d: S.replace_literal("o_orderpriority", "-", " "))])
_q("fn_starts_ends_with", "part",
   [("p_partkey", "p_partkey"), ("starts", "starts_with(p_brand, 'Brand#1')"), ("ends", "suffix(p_name, 'bolt')")],
   [("p_partkey", lambda d: F.col("p_partkey")), ("starts", lambda d: S.starts_with("p_brand", "Brand#1")),
    ("ends", lambda d: S.ends_with("p_name", "bolt"))])
_q("fn_to_text", "lineitem", [("v", "CAST(l_linenumber AS VARCHAR)"), ("f", "l_returnflag || l_linestatus")],
   [("v", lambda d: S.to_text("l_linenumber")), ("f", lambda d: F.concat("l_returnflag", "l_linestatus"))])
_q("fn_to_number_or_null", "events",
   [("event_id", "event_id"), ("v", "TRY_CAST(regexp_extract(props, '[0-9]+', 0) AS DOUBLE)"),
    ("bad", "TRY_CAST(event_type AS DOUBLE)")],
   [("event_id", lambda d: F.col("event_id")),
    ("v", lambda d: S.try_double(F.regexp_extract("props", "[0-9]+", 0))),
    ("bad", lambda d: S.try_double("event_type"))])
_q("fn_to_int", "labels", [("doc_id", "doc_id"), ("v", "CAST(quality + toxic AS INTEGER)")],
   [("doc_id", lambda d: F.col("doc_id")), ("v", lambda d: S.to_int(F.col("quality") + F.col("toxic")))])
_q("fn_fill_null", "lineitem", [("v", "coalesce(CASE WHEN l_quantity > 25 THEN l_tax END, 0.0)")],
   [("v", lambda d: S.fill_null(F.when(F.col("l_quantity") > 25, F.col("l_tax")), 0.0))])
_q("fn_is_null", "orders",
   [("o_orderkey", "o_orderkey"), ("v", "(CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderstatus END) IS NULL")],
   [("o_orderkey", lambda d: F.col("o_orderkey")),
    ("v", lambda d: S.is_null(F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus"))))])
_q("fn_map_values", "orders",
   [("o_orderkey", "o_orderkey"), ("v", "CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END")],
   [("o_orderkey", lambda d: F.col("o_orderkey")), ("v", lambda d: S.map_values("o_orderstatus", {"F": 1, "O": 0}))])
_q("fn_abs", "customer", [("c_custkey", "c_custkey"), ("v", "abs(c_acctbal)")],
   [("c_custkey", lambda d: F.col("c_custkey")), ("v", lambda d: S.abs_("c_acctbal"))])
_q("fn_relu_tanh_sigmoid", "events",
   [("event_id", "event_id"), ("relu", "round(greatest(value - 50, 0.0), 6)"), ("tanh", "round(tanh(value / 100), 6)"),
    ("sigmoid", "round(1.0 / (1.0 + exp(-(value / 100 - 1))), 6)")],
   [("event_id", lambda d: F.col("event_id")), ("relu", lambda d: F.round(S.relu(F.col("value") - 50), 6)),
    ("tanh", lambda d: F.round(S.tanh(F.col("value") / 100), 6)),
    ("sigmoid", lambda d: F.round(S.sigmoid(F.col("value") / 100 - 1), 6))])
_q("fn_clamp_min", "labels", [("doc_id", "doc_id"), ("v", "greatest(quality + toxic, 1)")],
   [("doc_id", lambda d: F.col("doc_id")), ("v", lambda d: S.clamp_min(F.col("quality") + F.col("toxic"), 1))])
_q("fn_ordered_pair", "lineitem", [("a", "least(l_partkey, l_suppkey)"), ("b", "greatest(l_partkey, l_suppkey)")],
   [("a", lambda d: S.ordered_pair("l_partkey", "l_suppkey")[0]),
    ("b", lambda d: S.ordered_pair("l_partkey", "l_suppkey")[1])])
_q("fn_class_text_percent", "labels",
   [("doc_id", "doc_id"), ("prediction", "CASE quality WHEN 0 THEN 'Non-Toxic' WHEN 1 THEN 'Toxic' END"),
    ("confidence", "printf('%.2f%%', (0.5 + doc_id % 50 / 100.0) * 100.0)")],
   [("doc_id", lambda d: F.col("doc_id")), ("prediction", lambda d: S.class_text("quality")),
    ("confidence", lambda d: S.percent_text(F.lit(0.5) + (F.col("doc_id") % 50) / 100.0))])
_q("fn_run_stamp_digits", "events",
   [("event_id", "event_id"), ("stamp", "strftime(ts, '%Y%m%d%H%M%S')"),
    ("is_digits", "regexp_matches(strftime(ts, '%Y%m%d%H%M%S'), '^[0-9]+$')")],
   [("event_id", lambda d: F.col("event_id")), ("stamp", lambda d: S.run_stamp("ts")),
    ("is_digits", lambda d: S.is_digits(S.run_stamp("ts")))])
_q("fn_json", "events",
   [("event_id", "event_id"), ("k", "json_extract_string(props, '$.k')"),
    ("missing", "coalesce(json_extract_string(props, '$.absent'), 'none')"),
    ("doc", "CAST(json_object('id', event_id, 'type', event_type) AS VARCHAR)")],
   [("event_id", lambda d: F.col("event_id")), ("k", lambda d: S.json_get("props", "k")),
    ("missing", lambda d: S.json_get("props", "absent", "none")),
    ("doc", lambda d: F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"))))])
_q("fn_threshold", "labels", [("doc_id", "doc_id"), ("v", "CAST((doc_id % 100) / 100.0 >= 0.37 AS INTEGER)")],
   [("doc_id", lambda d: F.col("doc_id")), ("v", lambda d: S.threshold((F.col("doc_id") % 100) / 100.0, 0.37))])


@register("fn_softmax_argmax", sql="""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 10) AS a FROM embeddings),
m AS (SELECT vec_id, a, list_max(a) AS mx FROM v),
e AS (SELECT vec_id, a, list_transform(a, lambda x: exp(x - mx)) AS ex FROM m)
SELECT vec_id, round(ex[1] / list_sum(ex), 6) AS p0, round(list_max(ex) / list_sum(ex), 6) AS pmax,
       CAST(list_position(a, list_max(a)) - 1 AS INTEGER) AS argmax FROM e""")
def fn_softmax_argmax(spark, sf_dir):
    """C17: softmax and first argmax over all entries of each vector."""
    e = table(spark, sf_dir, "embeddings")
    a = F.transform(F.col("embedding"), lambda x: x.cast("double") * 10)
    d = e.select("vec_id", a.alias("a")).select("vec_id", "a", S.softmax("a").alias("p"))
    return d.select("vec_id", F.round(F.col("p")[0], 6).alias("p0"), F.round(F.array_max("p"), 6).alias("pmax"),
                    S.argmax("a").alias("argmax"))


@register("fn_linspace", sql="""
WITH g AS (SELECT range AS i, round(0.01 + range * ((0.99 - 0.01) / 199), 9) AS t FROM range(200)),
s AS (SELECT vec_id, (CAST(embedding[1] AS DOUBLE) + 1) / 2 AS p FROM embeddings)
SELECT CAST(i AS INTEGER) AS i, t, count(*) FILTER (p >= t) AS n FROM g, s GROUP BY i, t""")
def fn_linspace(spark, sf_dir):
    """C20: the 200-point threshold grid, and how many rows reach each point."""
    grid = S.linspace(0.01, 0.99, 200)
    p = table(spark, sf_dir, "embeddings").select(((F.col("embedding")[0].cast("double") + 1) / 2).alias("p"))
    reached = F.transform(grid, lambda t: (F.col("p") >= F.round(t, 9)).cast("long"))
    each = p.select(F.posexplode(reached).alias("i", "hit")).groupBy("i").agg(F.sum("hit").alias("n"))
    return each.select(F.col("i").cast("int").alias("i"), F.round(grid[F.col("i")], 9).alias("t"), "n")


