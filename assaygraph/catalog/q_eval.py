"""Split, class-weight and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators import split as X
from ..plans.ranking import exact_quantiles
from ..sources.tables import table
from .registry import register

SEED = 43


@register("positional_split", sql="""
SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY o_orderkey) - 1 < floor(count(*) OVER () * 0.8)
                        THEN 'train' ELSE 'test' END AS split FROM orders""")
def positional_split(spark, sf_dir):
    """First 80 % of rows by key (global rank without a one-task window)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    return X.positional_split(o, "o_orderkey", 0.8)


@register("hash_split", sql=f"""
SELECT doc_id, CASE WHEN {X.mix_sql('doc_id', 42)} % 10000 < 8000 THEN 'train' ELSE 'test' END AS split
FROM documents""")
def hash_split(spark, sf_dir):
    """Seeded 80/20 split, a pure function of the id."""
    return X.hash_split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.8, 42)


_STRAT = f"""
s AS (SELECT doc_id, quality, toxic,
        row_number() OVER (PARTITION BY quality ORDER BY {X.mix_sql('doc_id', SEED)}, doc_id) - 1 AS pos,
        count(*) OVER (PARTITION BY quality) AS cn FROM labels)"""


@register("stratified_split", sql=f"""
WITH {_STRAT.strip()}
SELECT doc_id, quality, CASE WHEN pos < (CASE WHEN cn <= 1 THEN 0 ELSE ceil(cn * 0.2) END) THEN 'test' ELSE 'train' END
  AS split FROM s""")
def stratified_split(spark, sf_dir):
    """Exact per-class test share in hashed order."""
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return X.stratified_split(lab, "doc_id", "quality", 0.2, SEED)


_FOLDS = f"""
f AS (SELECT doc_id, toxic,
        CAST((row_number() OVER (PARTITION BY toxic ORDER BY {X.mix_sql('doc_id', SEED)}, doc_id) - 1) % 5 AS INTEGER)
          AS fold FROM labels)"""


@register("stratified_kfold", sql=f"WITH {_FOLDS.strip()} SELECT doc_id, toxic, fold FROM f")
def stratified_kfold(spark, sf_dir):
    """Five folds per class."""
    lab = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return X.stratified_folds(lab, "doc_id", "toxic", 5, SEED)


@register("class_weights", sql=f"""
WITH {_STRAT.strip()},
tr AS (SELECT l.toxic FROM labels l JOIN s USING (doc_id)
       WHERE NOT (s.pos < (CASE WHEN s.cn <= 1 THEN 0 ELSE ceil(s.cn * 0.2) END))),
c AS (SELECT toxic, count(*) AS n FROM tr GROUP BY toxic),
k AS (SELECT max(toxic) + 1 AS nc FROM labels),
g AS (SELECT CAST(range AS INTEGER) AS toxic FROM range((SELECT nc FROM k)))
SELECT g.toxic, CAST(coalesce(c.n, 0) AS BIGINT) AS count,
  round((SELECT count(*) FROM tr) / ((SELECT nc FROM k) * greatest(coalesce(c.n, 0), 1)), 6) AS weight
FROM g LEFT JOIN c ON g.toxic = c.toxic""")
def class_weights(spark, sf_dir):
    """N / (C * max(count, 1)) on the train side of the quality split."""
    lab = table(spark, sf_dir, "labels")
    sp = X.stratified_split(lab, "doc_id", "quality", 0.2, SEED).withColumn("is_train", F.col("split") == "train")
    w = X.class_weights(sp, "toxic", "is_train")
    return w.select("toxic", "count", F.round("weight", 6).alias("weight"))


# --- scored fixture: quality label vs a text-derived score -------------------
SCORE_SQL = """
sc AS (SELECT l.doc_id, l.quality AS y,
         round(1 - least(1.0, 10.0 * CASE WHEN length(d.text) = 0 THEN 0.0 ELSE
           CAST(length(d.text) - length(regexp_replace(d.text, '[#*%0-9]', '', 'g')) AS DOUBLE) / length(d.text) END),
           6) AS score
       FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
sp AS (SELECT *, CAST(score >= 0.5 AS INTEGER) AS pred FROM sc)"""


def scored(spark, sf_dir):
    """labels join documents: y = quality, score from the share of #*%0-9."""
    lab = table(spark, sf_dir, "labels")
    doc = table(spark, sf_dir, "documents").select("doc_id", "text")
    t = F.col("text")
    share = F.when(F.length(t) == 0, F.lit(0.0)).otherwise(
        (F.length(t) - F.length(F.regexp_replace(t, "[#*%0-9]", ""))).cast("double") / F.length(t))
    s = lab.join(doc, "doc_id").select("doc_id", F.col("quality").alias("y"),
                                       F.round(1 - F.least(F.lit(1.0), 10.0 * share), 6).alias("score"))
    return s.withColumn("pred", (F.col("score") >= 0.5).cast("int"))


@register("confusion_matrix", sql=f"""
WITH {SCORE_SQL.strip()},
g AS (SELECT a.y, b.pred FROM (VALUES (0), (1)) a(y), (VALUES (0), (1)) b(pred))
SELECT g.y, g.pred, count(sp.doc_id) AS n FROM g LEFT JOIN sp ON g.y = sp.y AND g.pred = sp.pred
GROUP BY g.y, g.pred""")
def confusion_matrix(spark, sf_dir):
    return E.confusion(scored(spark, sf_dir))


_METRIC_SQL = """
round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy,
round((CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END + CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0.0 END)
  / ((CASE WHEN tp + fn > 0 THEN 1 ELSE 0 END) + (CASE WHEN tn + fp > 0 THEN 1 ELSE 0 END)), 6) AS balanced_accuracy,
round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END, 6) AS f1_score"""

_CELLS_SQL = """
count(*) FILTER (WHERE y = 1 AND pred = 1) AS tp, count(*) FILTER (WHERE y = 0 AND pred = 1) AS fp,
count(*) FILTER (WHERE y = 0 AND pred = 0) AS tn, count(*) FILTER (WHERE y = 1 AND pred = 0) AS fn"""


def _round_all(df, cols):
    return df.select(*[F.round(c, 6).alias(c) for c in cols])


@register("classification_metrics", sql=f"""
WITH {SCORE_SQL.strip()}, c AS (SELECT {_CELLS_SQL} FROM sp)
SELECT {_METRIC_SQL} FROM c""")
def classification_metrics(spark, sf_dir):
    """Accuracy, balanced accuracy, F1 (the metric record)."""
    return _round_all(E.metrics(scored(spark, sf_dir)), ["accuracy", "balanced_accuracy", "f1_score"])


@register("balanced_accuracy_absent_class", sql=f"""
WITH {SCORE_SQL.strip()}, c AS (SELECT {_CELLS_SQL} FROM sp WHERE y = 1)
SELECT {_METRIC_SQL} FROM c""")
def balanced_accuracy_absent_class(spark, sf_dir):
    """E3 edge: class 0 absent from y -> mean over the present class only."""
    return _round_all(E.metrics(scored(spark, sf_dir).where(F.col("y") == 1)),
                      ["accuracy", "balanced_accuracy", "f1_score"])


@register("classification_report", sql=f"""
WITH {SCORE_SQL.strip()},
c AS (SELECT count(*) FILTER (WHERE y = 0 AND pred = 0) AS tp0, count(*) FILTER (WHERE pred = 0) AS pp0,
             count(*) FILTER (WHERE y = 0) AS s0, count(*) FILTER (WHERE y = 1 AND pred = 1) AS tp1,
             count(*) FILTER (WHERE pred = 1) AS pp1, count(*) FILTER (WHERE y = 1) AS s1 FROM sp),
m AS (SELECT *, CASE WHEN pp0 > 0 THEN tp0 / pp0 ELSE 0.0 END AS p0, CASE WHEN s0 > 0 THEN tp0 / s0 ELSE 0.0 END AS r0,
             CASE WHEN pp1 > 0 THEN tp1 / pp1 ELSE 0.0 END AS p1, CASE WHEN s1 > 0 THEN tp1 / s1 ELSE 0.0 END AS r1
      FROM c),
f AS (SELECT *, CASE WHEN p0 + r0 > 0 THEN 2 * p0 * r0 / (p0 + r0) ELSE 0.0 END AS f0,
                CASE WHEN p1 + r1 > 0 THEN 2 * p1 * r1 / (p1 + r1) ELSE 0.0 END AS f1 FROM m)
SELECT '0' AS label, round(p0, 6) AS precision, round(r0, 6) AS recall, round(f0, 6) AS f1,
       CAST(s0 AS DOUBLE) AS support FROM f
UNION ALL SELECT '1', round(p1, 6), round(r1, 6), round(f1, 6), CAST(s1 AS DOUBLE) FROM f
UNION ALL SELECT 'accuracy', NULL, NULL, round((tp0 + tp1) / (s0 + s1), 6), CAST(s0 + s1 AS DOUBLE) FROM f
UNION ALL SELECT 'macro avg', round(0.5 * p0 + 0.5 * p1, 6), round(0.5 * r0 + 0.5 * r1, 6), round(0.5 * f0 + 0.5 * f1, 6),
  CAST(s0 + s1 AS DOUBLE) FROM f
UNION ALL SELECT 'weighted avg', round(s0 / (s0 + s1) * p0 + s1 / (s0 + s1) * p1, 6),
  round(s0 / (s0 + s1) * r0 + s1 / (s0 + s1) * r1, 6), round(s0 / (s0 + s1) * f0 + s1 / (s0 + s1) * f1, 6),
  CAST(s0 + s1 AS DOUBLE) FROM f""")
def classification_report(spark, sf_dir):
    r = E.classification_report(scored(spark, sf_dir))
    return r.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@register("roc_auc", sql=f"""
WITH {SCORE_SQL.strip()},
r AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM sp)
SELECT round((sum(rk) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0)
  / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0)), 6) AS auc FROM r""")
def roc_auc(spark, sf_dir):
    """Tie-aware AUC (average ranks)."""
    return E.roc_auc(scored(spark, sf_dir)).select(F.round("auc", 6).alias("auc"))


_CURVE_SQL = """
g AS (SELECT score, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg FROM sp GROUP BY score),
cu AS (SELECT score, sum(pos) OVER (ORDER BY score DESC) AS tps, sum(neg) OVER (ORDER BY score DESC) AS fps,
              sum(pos) OVER () AS P, sum(neg) OVER () AS N FROM g)"""


@register("roc_curve", sql=f"""
WITH {SCORE_SQL.strip()}, {_CURVE_SQL.strip()}
SELECT score AS threshold, CAST(tps AS BIGINT) AS tps, CAST(fps AS BIGINT) AS fps, round(tps / P, 6) AS tpr,
       round(fps / N, 6) AS fpr FROM cu
UNION ALL SELECT CAST('inf' AS DOUBLE), 0, 0, 0.0, 0.0""")
def roc_curve(spark, sf_dir):
    """E6 curve / W2: cumulative TP/FP over descending distinct scores."""
    r = E.roc_curve(scored(spark, sf_dir))
    return r.select("threshold", F.col("tps").cast("long").alias("tps"), F.col("fps").cast("long").alias("fps"),
                    F.round("tpr", 6).alias("tpr"), F.round("fpr", 6).alias("fpr"))


@register("pr_curve", sql=f"""
WITH {SCORE_SQL.strip()}, {_CURVE_SQL.strip()}
SELECT score AS threshold, round(tps / (tps + fps), 6) AS precision, round(tps / P, 6) AS recall FROM cu
UNION ALL SELECT NULL, 1.0, 0.0""")
def pr_curve(spark, sf_dir):
    """Precision and recall at each distinct score."""
    r = E.pr_curve(scored(spark, sf_dir))
    return r.select("threshold", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


def _sweep_sql(grid_sql: str, metric_sql: str, by: str = "") -> str:
    byc = f"{by}, " if by else ""
    return f"""
gr AS ({grid_sql}),
cells AS (SELECT {byc}gr.i, gr.t,
    count(*) FILTER (WHERE y = 1 AND score >= t) AS tp, count(*) FILTER (WHERE y = 0 AND score >= t) AS fp,
    count(*) FILTER (WHERE y = 0 AND score < t) AS tn, count(*) FILTER (WHERE y = 1 AND score < t) AS fn
  FROM gr, data GROUP BY {byc}gr.i, gr.t),
met AS (SELECT {byc}t, {metric_sql} AS m FROM cells)"""


_BAL = """((CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END) + (CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0.0 END))
  / ((CASE WHEN tp + fn > 0 THEN 1 ELSE 0 END) + (CASE WHEN tn + fp > 0 THEN 1 ELSE 0 END))"""
_F1 = "CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END"
_E7_GRID = "SELECT range AS i, 0.01::DOUBLE + range::DOUBLE * 0.98::DOUBLE / 199.0 AS t FROM range(200)"
_E8_GRID = "SELECT range AS i, 0.05::DOUBLE + range::DOUBLE * 0.9::DOUBLE / 180.0 AS t FROM range(181)"


@register("threshold_balanced_acc", sql=f"""
WITH {SCORE_SQL.strip()}, data AS (SELECT * FROM sp), {_sweep_sql(_E7_GRID, _BAL).strip()}
SELECT round(t, 6) AS threshold, round(m, 6) AS balanced_accuracy FROM met ORDER BY m DESC, t LIMIT 1""")
def threshold_balanced_acc(spark, sf_dir):
    """200-point grid, lowest threshold with the best balanced accuracy."""
    b = E.best_threshold(scored(spark, sf_dir), E.grid_e7(), "balanced_accuracy")
    return b.select(F.round("threshold", 6).alias("threshold"), F.round("balanced_accuracy", 6).alias("balanced_accuracy"))


@register("threshold_f1_cv", sql=f"""
WITH {SCORE_SQL.strip()}, {_FOLDS.strip()},
data AS (SELECT sp.*, f.fold FROM sp JOIN f ON sp.doc_id = f.doc_id), {_sweep_sql(_E8_GRID, _F1, 'fold').strip()},
best AS (SELECT fold, t FROM met QUALIFY row_number() OVER (PARTITION BY fold ORDER BY m DESC, t) = 1)
SELECT round(quantile_cont(t, 0.5), 6) AS threshold, CAST(count(*) AS BIGINT) AS n_folds FROM best""")
def threshold_f1_cv(spark, sf_dir):
    """Best-F1 threshold (181-point grid) per stratified fold, median."""
    s = scored(spark, sf_dir)
    folds = X.stratified_folds(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "toxic", 5, SEED)
    d = s.join(folds.select("doc_id", "fold"), "doc_id")
    best = E.best_threshold(d, E.grid_e8(), "f1_score", by=["fold"])
    med = exact_quantiles(best, "threshold", [0.5])
    n = best.agg(F.count(F.lit(1)).alias("n_folds"))
    return med.crossJoin(n).select(F.round("value", 6).alias("threshold"), "n_folds")


@register("threshold_pr_candidates", sql=f"""
WITH {SCORE_SQL.strip()},
mp AS (SELECT min(score) AS mp FROM sp WHERE y = 1),
cand AS (SELECT DISTINCT score AS t FROM sp, mp WHERE score >= mp.mp UNION SELECT 0.5 UNION SELECT 1.0),
cells AS (SELECT t, count(*) FILTER (WHERE y = 1 AND score >= t) AS tp, count(*) FILTER (WHERE y = 0 AND score >= t) AS fp,
   count(*) FILTER (WHERE y = 0 AND score < t) AS tn, count(*) FILTER (WHERE y = 1 AND score < t) AS fn
   FROM cand, sp GROUP BY t),
met AS (SELECT t, {_BAL} AS m FROM cells),
best AS (SELECT t, m FROM met WHERE m > 0 UNION ALL SELECT 0.5, 0.0)
SELECT round(t, 6) AS threshold, round(m, 6) AS balanced_accuracy FROM best ORDER BY m DESC, t LIMIT 1""")
def threshold_pr_candidates(spark, sf_dir):
    """candidates = PR-curve thresholds plus 0.5 and 1.0."""
    b = E.best_threshold_distinct(scored(spark, sf_dir))
    return b.select(F.round("threshold", 6).alias("threshold"), F.round("balanced_accuracy", 6).alias("balanced_accuracy"))


@register("train_val_gap", sql=f"""
WITH {SCORE_SQL.strip()}, {_STRAT.strip()},
j AS (SELECT sp.*, CASE WHEN s.pos < (CASE WHEN s.cn <= 1 THEN 0 ELSE ceil(s.cn * 0.2) END) THEN 'test' ELSE 'train' END
        AS split FROM sp JOIN s ON sp.doc_id = s.doc_id),
c AS (SELECT split, {_CELLS_SQL} FROM j GROUP BY split),
m AS (SELECT split, {_BAL} AS bal FROM c)
SELECT round(a.bal, 6) AS train_metric, round(b.bal, 6) AS test_metric, b.bal >= 0.95 AS meets_floor,
       abs(a.bal - b.bal) <= 0.05 AS within_gap
FROM m a, m b WHERE a.split = 'train' AND b.split = 'test'""")
def train_val_gap(spark, sf_dir):
    """The declared gates (floor 0.95, gap 0.05) on train vs test."""
    s = scored(spark, sf_dir)
    sp = X.stratified_split(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "quality", 0.2, SEED)
    j = s.join(sp.select("doc_id", "split"), "doc_id")
    tr = E.metrics(j.where(F.col("split") == "train"))
    te = E.metrics(j.where(F.col("split") == "test"))
    g = E.gap_check(tr, te)
    return g.select(F.round("train_metric", 6).alias("train_metric"), F.round("test_metric", 6).alias("test_metric"),
                    "meets_floor", "within_gap")


@register("fold_mean_std", sql=f"""
WITH {SCORE_SQL.strip()}, {_FOLDS.strip()},
c AS (SELECT f.fold, avg(CAST(sp.y = sp.pred AS INTEGER)) AS acc FROM sp JOIN f ON sp.doc_id = f.doc_id GROUP BY f.fold)
SELECT round(avg(acc), 6) AS mean, round(stddev_pop(acc), 6) AS std, CAST(count(*) AS BIGINT) AS n_folds FROM c""")
def fold_mean_std(spark, sf_dir):
    """Mean and population std of per-fold accuracy."""
    s = scored(spark, sf_dir)
    folds = X.stratified_folds(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "toxic", 5, SEED)
    per = s.join(folds.select("doc_id", "fold"), "doc_id").groupBy("fold").agg(
        F.avg((F.col("y") == F.col("pred")).cast("int")).alias("acc"))
    r = E.fold_summary(per, "acc")
    return r.select(F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n_folds")
