"""Flagship: encode assay rows, 5 nearest labelled rows, vote (F4 + J4 + J1 + R3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features, similarity, split
from ..sources.tables import assay_base
from .registry import register
from .sql_common import ASSAY_CTE

K = 5


def assay_train_test(spark, sf_dir):
    a = split.positional_split(assay_base(spark, sf_dir), "row_id", 0.8)
    train = a.where(F.col("split") == "train")
    test = a.where(F.col("split") == "test")
    params = features.fit_encoder(train, ["dose", "hr"], ["material"])
    return features.encode(train, params), features.encode(test, params), params


@register("score_knn_vote", sql=f"""
WITH {ASSAY_CTE},
ord AS (SELECT *, row_number() OVER (ORDER BY row_id) - 1 AS idx, count(*) OVER () AS n FROM assay),
tr AS (SELECT * FROM ord WHERE idx < floor(n * 0.8)),
te AS (SELECT * FROM ord WHERE idx >= floor(n * 0.8)),
mm AS (SELECT min(dose) AS dmin, max(dose) AS dmax, min(hr) AS hmin, max(hr) AS hmax FROM tr),
cats AS (SELECT DISTINCT material FROM tr),
enc AS (
  SELECT t.row_id, t.material, t.toxic, t.is_train,
    CASE WHEN mm.dmax = mm.dmin THEN 0.0 ELSE (t.dose - mm.dmin) / (mm.dmax - mm.dmin) END AS xd,
    CASE WHEN mm.hmax = mm.hmin THEN 0.0 ELSE CAST(t.hr - mm.hmin AS DOUBLE) / (mm.hmax - mm.hmin) END AS xh,
    CASE WHEN t.material IN (SELECT material FROM cats) THEN 1 ELSE 0 END AS known
  FROM (SELECT *, true AS is_train FROM tr UNION ALL SELECT *, false AS is_train FROM te) t, mm),
pairs AS (
  SELECT q.row_id AS qid, r.row_id AS rid, r.toxic,
    round(CASE WHEN (q.xd * q.xd + q.xh * q.xh + q.known) = 0 THEN 1.0
      WHEN 1 - (q.xd * r.xd + q.xh * r.xh + CASE WHEN q.material = r.material AND q.known = 1 THEN 1 ELSE 0 END)
             / (sqrt(q.xd * q.xd + q.xh * q.xh + q.known) * sqrt(r.xd * r.xd + r.xh * r.xh + 1)) <= 0 THEN 0.0
      ELSE 1 - (q.xd * r.xd + q.xh * r.xh + CASE WHEN q.material = r.material AND q.known = 1 THEN 1 ELSE 0 END)
             / (sqrt(q.xd * q.xd + q.xh * q.xh + q.known) * sqrt(r.xd * r.xd + r.xh * r.xh + 1)) END, 9) AS dist
  FROM enc q, enc r WHERE NOT q.is_train AND r.is_train),
top AS (SELECT qid, toxic FROM pairs QUALIFY row_number() OVER (PARTITION BY qid ORDER BY dist, rid) <= {K})
SELECT qid AS row_id, CAST(sum(toxic) AS BIGINT) AS n_pos, CAST(count(*) AS BIGINT) AS n_nbrs,
       CAST(2 * sum(toxic) > count(*) AS INTEGER) AS prediction,
       CASE WHEN 2 * sum(toxic) > count(*) THEN 'Toxic' ELSE 'Non-Toxic' END AS prediction_text,
       round(CASE WHEN 2 * sum(toxic) > count(*) THEN sum(toxic) / count(*) ELSE 1 - sum(toxic) / count(*) END, 6)
         AS confidence
FROM top GROUP BY qid
""")
def score_knn_vote(spark, sf_dir):
    train, test, _ = assay_train_test(spark, sf_dir)
    nbrs = similarity.knn(test, train, k=K, q_id="row_id", r_id="row_id")
    vote = similarity.knn_vote(nbrs, train.select(F.col("row_id").alias("id"), F.col("toxic").alias("y")))
    return vote.select(F.col("query_id").alias("row_id"), "n_pos", "n_nbrs", "prediction",
                       F.when(F.col("prediction") == 1, F.lit("Toxic")).otherwise(F.lit("Non-Toxic"))
                        .alias("prediction_text"),
                       F.round("confidence", 6).alias("confidence"))
