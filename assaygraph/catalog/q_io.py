"""Source and sink queries (S1-S3, S5-S9, S11); files go to the scratch folder
below the session's checkpoint directory."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import features as FE
from ..operators import validate as V
from ..plans.session import scratch_path
from ..sources import io as IO
from ..sources.tables import assay_base, table, vectors
from .registry import register


def _tmp(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


@register("scan_csv", sql="""
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag FROM lineitem""")
def scan_csv(spark, sf_dir):
    """S5 then S1: write lineitem as header CSV, read it back with a schema."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice",
                                                 "l_returnflag")
    path = IO.write_table(li, _tmp(spark, "lineitem-csv"), fmt="csv")
    return IO.read_table(spark, path, schema="l_orderkey long, l_linenumber int, l_quantity double, "
                                             "l_extendedprice double, l_returnflag string")


@register("scan_csv_sniffed", sql="SELECT p_partkey, p_name, p_brand, p_size FROM part")
def scan_csv_sniffed(spark, sf_dir):
    """S2: ';'-separated file with a BOM and padded header names; separator
    detected from the header line, names cleaned."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    messy = p.toDF("﻿p_partkey", " p_name ", "p_brand", "p_size  ")
    path = _tmp(spark, "part-semicolon")
    messy.write.option("header", True).option("sep", ";").csv(path)
    d = IO.read_table(spark, path, sep=None)
    return d.select(F.col("p_partkey").cast("long"), "p_name", "p_brand", F.col("p_size").cast("int"))


@register("scan_all_string", sql="""
SELECT CAST(event_id AS VARCHAR) AS event_id, event_type, CAST(user_id AS VARCHAR) AS user_id FROM events""")
def scan_all_string(spark, sf_dir):
    """S3: every column read as text."""
    ev = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    path = IO.write_table(ev, _tmp(spark, "events-csv"), fmt="csv")
    return IO.read_table(spark, path, as_string=True)


@register("save_load_transformer", sql="""
SELECT 'dose' AS "column", 'min' AS kind, min(value) AS num, CAST(NULL AS VARCHAR) AS text, 0 AS pos FROM events
UNION ALL SELECT 'dose', 'max', max(value), NULL, 0 FROM events
UNION ALL SELECT 'hr', 'min', CAST(min(hour(ts)) AS DOUBLE), NULL, 1 FROM events
UNION ALL SELECT 'hr', 'max', CAST(max(hour(ts)) AS DOUBLE), NULL, 1 FROM events
UNION ALL SELECT 'material', 'category', NULL, event_type,
  CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INTEGER) FROM (SELECT DISTINCT event_type FROM events)""")
def save_load_transformer(spark, sf_dir):
    """Fitted encoder saved as a table and loaded back."""
    a = assay_base(spark, sf_dir)
    params = FE.fit_encoder(a, ["dose", "hr"], ["material"])
    path = IO.save_encoder(params.to_frame(spark), _tmp(spark, "encoder"))
    back = IO.load_encoder(spark, path, ["dose", "hr"], ["material"])
    return back.to_frame(spark)


from .q_graph import D_ALL, G4_SQL  # noqa: E402
from .sql_common import VEC_CTE  # noqa: E402


@register("sink_features_graph", sql=f"""
WITH {VEC_CTE.strip()}, {D_ALL}, {G4_SQL.strip()},
sym AS (SELECT src AS n FROM g4 UNION ALL SELECT dst FROM g4),
deg AS (SELECT v.id, count(s.n) AS d FROM vec v LEFT JOIN sym s ON v.id = s.n GROUP BY v.id)
SELECT count(*) AS n_nodes, CAST(sum(d) / 2 AS BIGINT) AS n_edges, count(*) FILTER (WHERE d = 0) AS n_isolated,
       CAST(max(d) AS BIGINT) AS max_degree, round(sum(d) / count(*), 6) AS mean_degree FROM deg""")
def sink_features_graph(spark, sf_dir):
    """A k-NN graph written as nodes + edges tables and read back."""
    from ..operators import graph as GR

    v = vectors(spark, sf_dir)
    e = GR.intra_cluster_knn(v.withColumnRenamed("label", "cluster"), 5, "id", "x", "cluster")
    path = IO.write_graph(v.withColumnRenamed("id", "node_id"), e, _tmp(spark, "graph"))
    nodes, edges = IO.read_graph(spark, path)
    g = GR.graph_stats(nodes, edges)
    return g.select("n_nodes", "n_edges", "n_isolated", "max_degree", F.round("mean_degree", 6).alias("mean_degree"))


@register("sink_report", sql="""
WITH n AS (SELECT count(*) FILTER (WHERE event_type IS NULL) AS nt, count(*) FILTER (WHERE value IS NULL) AS nv FROM events)
SELECT CAST(1 AS BIGINT) AS step, 'column_count' AS "check", false AS ok, 'expected 3 columns, found 6' AS detail,
       true AS first_failure
UNION ALL SELECT 2, 'columns_exist', true, 'all present', false
UNION ALL SELECT 3, 'numeric_types', true, 'ok', false
UNION ALL SELECT 4, 'critical_nulls', nt + nv = 0,
  CASE WHEN nt + nv = 0 THEN 'ok' ELSE 'event_type has ' || nt || ' nulls; value has ' || nv || ' nulls' END, false FROM n""")
def sink_report(spark, sf_dir):
    """Validation report written as JSON and read back."""
    ev = table(spark, sf_dir, "events")
    rep = V.validate(ev, declared=[("event_id", "int", False), ("value", "float", False), ("event_type", "object", False)],
                     critical=["event_type", "value"])
    path = IO.write_report(rep, _tmp(spark, "report"))
    return spark.read.json(path)


@register("latest_valid_run", sql="""
WITH runs AS (SELECT CASE WHEN user_id % 4 = 0 THEN 'batch_' || CAST(user_id AS VARCHAR)
                          ELSE CAST(user_id AS VARCHAR) END AS run_id,
                     max(ts) AS mtime, count(*) % 2 = 0 AS has_model FROM events GROUP BY user_id)
SELECT run_id, CAST(mtime AS VARCHAR) AS mtime, has_model FROM runs
WHERE regexp_matches(run_id, '^[0-9]+$') AND has_model ORDER BY runs.mtime DESC, run_id LIMIT 1""")
def latest_valid_run(spark, sf_dir):
    """Newest run folder holding a model (numeric names preferred); the
    registry is derived from events (one run per user)."""
    ev = table(spark, sf_dir, "events")
    runs = ev.groupBy("user_id").agg(F.max("ts").alias("mtime"), ((F.count(F.lit(1)) % 2) == 0).alias("has_model"))
    runs = runs.select(F.when(F.col("user_id") % 4 == 0, F.concat(F.lit("batch_"), F.col("user_id").cast("string")))
                        .otherwise(F.col("user_id").cast("string")).alias("run_id"), "mtime", "has_model")
    best = IO.latest_valid_run(runs)
    return best.select("run_id", F.col("mtime").cast("string").alias("mtime"), "has_model")


@register("log_run_metrics", sql="""
WITH sc AS (SELECT l.quality AS y,
         round(1 - least(1.0, 10.0 * CASE WHEN length(d.text) = 0 THEN 0.0 ELSE
           CAST(length(d.text) - length(regexp_replace(d.text, '[#*%0-9]', '', 'g')) AS DOUBLE) / length(d.text) END),
           6) AS score
       FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
sp AS (SELECT y, CAST(score >= 0.5 AS INTEGER) AS pred FROM sc),
c AS (SELECT count(*) FILTER (WHERE y = 1 AND pred = 1) AS tp, count(*) FILTER (WHERE y = 0 AND pred = 1) AS fp,
             count(*) FILTER (WHERE y = 0 AND pred = 0) AS tn, count(*) FILTER (WHERE y = 1 AND pred = 0) AS fn FROM sp),
m AS (SELECT round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END, 6) AS f1_score,
             round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy,
             round(((CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END)
                    + (CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0.0 END))
                   / ((CASE WHEN tp + fn > 0 THEN 1 ELSE 0 END) + (CASE WHEN tn + fp > 0 THEN 1 ELSE 0 END)), 6)
               AS balanced_accuracy FROM c)
SELECT r.run_id, '{"threshold": 0.5}' AS params, m.* FROM m, (VALUES ('r1'), ('r2')) r(run_id)""")
def log_run_metrics(spark, sf_dir):
    """Append a metric record to a runs table and read the table."""
    from ..catalog.q_eval import scored
    from ..operators import evaluate as E

    rec = E.metrics(scored(spark, sf_dir))
    rec = rec.select(*[F.round(c, 6).alias(c) for c in rec.columns])
    path = _tmp(spark, "runs")
    IO.append_run(rec, path, {"threshold": 0.5}, run_id="r1")
    IO.append_run(rec, path, {"threshold": 0.5}, run_id="r2")
    return spark.read.parquet(path).drop("logged_at")
