"""Classification metrics and threshold sweeps.

Inputs are DataFrames with a label ``y``, a ``score`` and/or a ``pred``.
Every metric is a grouped aggregate; curves group rows by distinct score
first and use skew-safe running sums; threshold sweeps pre-aggregate scores
into the grid's buckets (no rows x thresholds explode).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ranking import null_safe_join, running_sum
from ..plans.session import cut_lineage


def _cell_counts(df: DataFrame, y: str, pred: str) -> DataFrame:
    """``y, pred, n`` of the pairs that occur: classes squared rows at most, frozen for the several uses."""
    return cut_lineage(df.groupBy(F.col(y).alias("y"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n")))


def _classes(counts: DataFrame) -> DataFrame:
    return counts.select(F.col("y").alias("c")).unionByName(counts.select(F.col("pred").alias("c"))).distinct()


def confusion(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """``y, pred, n`` for every cell of the class grid (zeros included).

    Classes are all values of either side; a null label or prediction is a
    class of its own, so the counts add up to the rows.
    """
    counts = _cell_counts(df, y, pred)
    c = _classes(counts)
    grid = c.select(F.col("c").alias("y")).crossJoin(c.select(F.col("c").alias("pred")))        # classes squared
    out = null_safe_join(grid, counts, ["y", "pred"], "left")
    return out.select(F.col("y").alias(y), F.col("pred").alias(pred), F.coalesce("n", F.lit(0)).alias("n"))


def _cells(df: DataFrame, y: str, pred: str) -> list[Column]:
    return [F.count_if((F.col(y) == 1) & (F.col(pred) == 1)).alias("tp"),
            F.count_if((F.col(y) == 0) & (F.col(pred) == 1)).alias("fp"),
            F.count_if((F.col(y) == 0) & (F.col(pred) == 0)).alias("tn"),
            F.count_if((F.col(y) == 1) & (F.col(pred) == 0)).alias("fn")]


def _metric_cols(tp, fp, tn, fn) -> dict[str, Column]:
    n = tp + fp + tn + fn
    pos, neg = tp + fn, tn + fp
    rec1 = F.when(pos > 0, tp / pos)
    rec0 = F.when(neg > 0, tn / neg)
    # balanced accuracy: mean recall over classes present in y
    bal = (F.coalesce(rec1, F.lit(0.0)) + F.coalesce(rec0, F.lit(0.0))) / (
        F.when(pos > 0, 1).otherwise(0) + F.when(neg > 0, 1).otherwise(0))
    f1 = F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(F.lit(0.0))
    return {"accuracy": (tp + tn) / n, "balanced_accuracy": bal, "f1_score": f1}


def metrics(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """E2-E4 metric record: one row ``accuracy, balanced_accuracy, f1_score``.

    Any number of classes: a row counts as right if its prediction is its
    label (a null prediction never is); balanced accuracy is the mean recall
    of the classes in ``y``; F1 is that of class 1.  Rows without a label are
    left out.
    """
    c = df.where(F.col(y).isNotNull()).groupBy(F.col(y).alias("y"), F.col(pred).alias("pred")).agg(
        F.count(F.lit(1)).alias("n"))
    right = F.col("y").eqNullSafe(F.col("pred"))
    per = c.groupBy("y").agg(F.sum("n").alias("sup"), F.sum(F.when(right, F.col("n")).otherwise(0)).alias("tp"),
                             F.sum(F.when((F.col("y") != 1) & (F.col("pred") == 1), F.col("n")).otherwise(0)).alias("fp"))
    one = F.col("y") == 1
    tp = F.coalesce(F.sum(F.when(one, F.col("tp"))), F.lit(0))
    wrong = F.coalesce(F.sum("fp"), F.lit(0)) + F.coalesce(F.sum(F.when(one, F.col("sup") - F.col("tp"))), F.lit(0))
    return per.agg(F.try_divide(F.sum("tp"), F.sum("sup")).alias("accuracy"),
                   F.avg(F.col("tp") / F.col("sup")).alias("balanced_accuracy"),
                   F.coalesce(F.try_divide(2 * tp, 2 * tp + wrong), F.lit(0.0)).alias("f1_score"))


def classification_report(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """E5: per class precision, recall, f1, support; then accuracy, macro avg
    and weighted avg rows (zero_division = 0).  Any number of classes; rows
    without a label are left out, a null prediction is no class."""
    counts = _cell_counts(df.where(F.col(y).isNotNull()), y, pred)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    of_y = counts.groupBy(F.col("y").alias("c")).agg(
        F.sum("n").alias("sup"), F.sum(F.when(F.col("y") == F.col("pred"), F.col("n"))).alias("tp"))
    of_pred = counts.groupBy(F.col("pred").alias("c")).agg(F.sum("n").alias("pp"))
    per = _classes(counts).where("c is not null").join(of_y, "c", "left").join(of_pred, "c", "left")
    per = per.select("c", F.coalesce("sup", F.lit(0)).alias("sup"), zero(F.try_divide("tp", "pp")).alias("precision"),
                     zero(F.try_divide("tp", "sup")).alias("recall"), F.coalesce("tp", F.lit(0)).alias("tp"))
    per = per.withColumn("f1", zero(F.try_divide(2 * F.col("precision") * F.col("recall"),
                                                 F.col("precision") + F.col("recall"))))
    measures = ["precision", "recall", "f1"]
    support = F.sum("sup").cast("double").alias("support")
    none = F.lit(None).cast("double")
    rows = per.select(F.col("c").cast("string").alias("label"), *measures, F.col("sup").cast("double").alias("support"))
    acc = per.agg(F.lit("accuracy").alias("label"), F.max(none).alias("precision"), F.max(none).alias("recall"),
                  F.try_divide(F.sum("tp"), F.sum("sup")).alias("f1"), support)
    macro = per.agg(F.lit("macro avg").alias("label"), *[F.avg(m).alias(m) for m in measures], support)
    weighted = per.agg(F.lit("weighted avg").alias("label"),
                       *[F.try_divide(F.sum(F.col(m) * F.col("sup")), F.sum("sup")).alias(m) for m in measures], support)
    return rows.unionByName(acc).unionByName(macro).unionByName(weighted)


def score_counts(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """Rows grouped by distinct score: ``score, pos, neg`` (map-side combined)."""
    return df.groupBy(F.col(score).alias("score")).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg"))


def roc_curve(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """E6 curve / W2: ``threshold, tps, fps, tpr, fpr`` at every distinct score
    (descending scores; running sums are skew-safe), and the start point where
    no row is taken (infinite threshold)."""
    sc = score_counts(df, y, score)
    cum = running_sum(sc, [F.col("score").desc()], ["pos", "neg"])
    totals = sc.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))            # one row
    start = totals.select(F.lit(float("inf")).alias("score"), F.lit(0).cast("long").alias("cum_pos"),
                          F.lit(0).cast("long").alias("cum_neg"))
    cum = cum.select(F.col("score").cast("double").alias("score"), "cum_pos", "cum_neg").unionByName(start)
    return cum.crossJoin(F.broadcast(totals)).select(
        F.col("score").alias("threshold"), F.col("cum_pos").alias("tps"), F.col("cum_neg").alias("fps"),
        F.when(F.col("P") > 0, F.col("cum_pos") / F.col("P")).alias("tpr"),
        F.when(F.col("N") > 0, F.col("cum_neg") / F.col("N")).alias("fpr"))


def roc_auc(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """Tie-aware AUC by average ranks (Mann-Whitney): one row ``auc``."""
    sc = score_counts(df, y, score)
    cum = running_sum(sc, ["score"], ["pos", "neg"])
    # negatives strictly below + half of the tied negatives, per positive
    below = cum.select((F.col("pos") * (F.col("cum_neg") - F.col("neg") + F.col("neg") / 2.0)).alias("u"),
                       "pos", "neg")
    return below.agg((F.sum("u") / (F.sum("pos") * F.sum("neg"))).alias("auc"))


def pr_curve(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """``threshold, precision, recall`` at each distinct score, and the end point precision 1, recall 0 (no
    threshold)."""
    roc = roc_curve(df, y, score)
    start = F.col("threshold") == float("inf")
    return roc.select(F.when(~start, F.col("threshold")).alias("threshold"),
                      F.when(start, 1.0).otherwise(F.try_divide("tps", F.col("tps") + F.col("fps"))).alias("precision"),
                      F.col("tpr").alias("recall"))


def grid_bucket(x: Column, grid: list[float]) -> Column:
    """Number of grid values <= x for a sorted grid, O(1) per row.

    An evenly spaced grid gives a first guess by arithmetic that is then
    corrected against the exact neighbouring grid values (ties with a grid
    value count as reached, as ``score >= t`` does).
    """
    n = len(grid)
    arr = F.array(*[F.lit(float(t)) for t in grid])
    step = (grid[-1] - grid[0]) / (n - 1) if n > 1 else 1.0
    guess = F.least(F.greatest(F.floor((x - F.lit(grid[0])) / F.lit(step)).cast("int") + 1, F.lit(0)), F.lit(n))
    g1 = F.when((guess < n) & (F.element_at(arr, guess + 1) <= x), guess + 1).otherwise(guess)
    g2 = F.when((g1 > 0) & (F.element_at(arr, F.greatest(g1, F.lit(1))) > x), g1 - 1).otherwise(g1)
    return F.when(x.isNull(), F.lit(0)).otherwise(g2)


def _sweep(df: DataFrame, thresholds: list[float], y: str, score: str, by: list[str]) -> DataFrame:
    """Confusion cells at each threshold (pred = score >= t), per ``by`` group.

    Rows are first bucketed: bucket b = number of grid thresholds <= score
    (a literal sorted grid, binary search free because the grid is small);
    then per bucket counts and suffix sums over at most len(grid)+1 rows
    per group give the cells of every threshold.
    """
    spark = df.sparkSession
    grid = sorted(thresholds)
    per_score = df.groupBy(*by, F.col(score).alias("_s")).agg(F.count_if(F.col(y) == 1).alias("_p"),
                                                              F.count_if(F.col(y) == 0).alias("_n"))
    counted = per_score.groupBy(*by, grid_bucket(F.col("_s"), grid).alias("b")).agg(
        F.sum("_p").alias("pos"), F.sum("_n").alias("neg"))
    tgrid = spark.createDataFrame([(i, float(t)) for i, t in enumerate(grid)], "ti int, t double")
    keys = counted.select(*by).distinct() if by else None
    tg = keys.crossJoin(tgrid) if by else tgrid   # groups x grid (grid is small)
    # threshold index ti predicts 1 for buckets b > ti
    j = tg.join(counted, on=by, how="left") if by else tg.crossJoin(counted)
    cells = j.groupBy(*by, "ti", "t").agg(
        F.sum(F.when(F.col("b") > F.col("ti"), F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("b") > F.col("ti"), F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(F.col("b") <= F.col("ti"), F.col("neg")).otherwise(0)).alias("tn"),
        F.sum(F.when(F.col("b") <= F.col("ti"), F.col("pos")).otherwise(0)).alias("fn"))
    m = _metric_cols(F.col("tp"), F.col("fp"), F.col("tn"), F.col("fn"))
    return cells.select(*by, "ti", "t", "tp", "fp", "tn", "fn", *[v.alias(k) for k, v in m.items()])


def best_threshold(df: DataFrame, thresholds: list[float], metric: str = "balanced_accuracy",
                   y: str = "y", score: str = "score", by: list[str] | None = None) -> DataFrame:
    """The lowest threshold reaching the best metric (strict
    improvement in ascending order): ``[by...], threshold, <metric>``."""
    by = by or []
    sw = _sweep(df, thresholds, y, score, by)
    w = Window.partitionBy(*by).orderBy(F.desc(metric), F.asc("t")) if by else Window.orderBy(F.desc(metric), "t")
    return (sw.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1)   # grid rows only
              .select(*by, F.col("t").alias("threshold"), F.col(metric)))


def grid_e7() -> list[float]:
    """200 thresholds 0.01 + i * 0.98 / 199 (linspace(0.01, 0.99, 200))."""
    return [0.01 + i * 0.98 / 199 for i in range(200)]


def grid_e8() -> list[float]:
    """181 thresholds linspace(0.05, 0.95, 181)."""
    return [0.05 + i * 0.9 / 180 for i in range(181)]


def best_threshold_distinct(df: DataFrame, y: str = "y", score: str = "score",
                            lo: float | None = None, hi: float | None = None) -> DataFrame:
    """candidates = distinct scores from the lowest positive score up
    (the PR-curve thresholds) plus 0.5 and 1.0; best balanced accuracy by
    strict improvement from 0.0 in ascending order, default 0.5.

    Distinct scores are unbounded, so cells come from running sums over the
    distinct-score table rather than a literal grid.
    """
    spark = df.sparkSession
    sc = score_counts(df, y, score)
    min_pos = df.where(F.col(y) == 1).agg(F.min(score).alias("mp"))
    extra = spark.createDataFrame([(0.5,), (1.0,)], "score double").select(
        "score", F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("neg"))
    cand = sc.unionByName(extra).groupBy("score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    cum = running_sum(cand, [F.col("score").desc()], ["pos", "neg"])   # predicted positive: score >= t
    tot = sc.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    c = cum.crossJoin(F.broadcast(tot)).crossJoin(F.broadcast(min_pos))  # one-row tables
    keep = (F.col("score") >= F.col("mp")) | F.col("score").isin(0.5, 1.0)
    if lo is not None:
        keep = keep & (F.col("score") >= lo)
    if hi is not None:
        keep = keep & (F.col("score") <= hi)
    m = _metric_cols(F.col("cum_pos"), F.col("cum_neg"), F.col("N") - F.col("cum_neg"), F.col("P") - F.col("cum_pos"))
    scored = c.where(keep).select(F.col("score").alias("threshold"), m["balanced_accuracy"].alias("balanced_accuracy"))
    best = scored.where(F.col("balanced_accuracy") > 0).orderBy(F.desc("balanced_accuracy"), "threshold").limit(1)
    default = spark.createDataFrame([(0.5, 0.0)], "threshold double, balanced_accuracy double")
    return best.unionByName(default).orderBy(F.desc("balanced_accuracy"), "threshold").limit(1)


def gap_check(train: DataFrame, test: DataFrame, floor: float = 0.95, gap: float = 0.05,
              metric: str = "balanced_accuracy") -> DataFrame:
    """Declared gates - test metric >= floor and |train - test| <= gap."""
    t = train.select(F.col(metric).alias("train_metric"))
    s = test.select(F.col(metric).alias("test_metric"))
    return t.crossJoin(s).select("train_metric", "test_metric",
                                 (F.col("test_metric") >= floor).alias("meets_floor"),
                                 (F.abs(F.col("train_metric") - F.col("test_metric")) <= gap).alias("within_gap"))


def fold_summary(scores: DataFrame, score_col: str = "score") -> DataFrame:
    """``mean, std, n_folds`` of one score a fold (population deviation); folds without a score are left out."""
    return scores.agg(F.avg(score_col).alias("mean"), F.stddev_pop(score_col).alias("std"), F.count(score_col).alias("n_folds"))
