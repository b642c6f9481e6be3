"""Model, scoring, streaming and I/O queries.

Seeded model fits and jobs with side effects have no SQL statement; the
driver checks them on rows only.  I/O round trips do have one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import clean as C
from ..operators import evaluate as E
from ..operators import features as FE
from ..operators import models as M
from ..operators import split as X
from ..operators import training as TR
from ..operators import validate as V
from ..plans.session import cut_lineage, scratch_path
from ..sources import io as IO
from ..sources.tables import DOSE, MATERIAL, TARGET, TIME, assay_base, assay_raw, table
from ..streaming.score_stream import score_batch_frame, score_stream
from .registry import register

SEED = 43
GROUPS = {"length": ["f_len"], "symbols": ["f_sym", "f_punct"], "words": ["f_distinct", "f_upper", "f_ws"]}
#: What a cleaned training table must look like.
TRAIN_COLUMNS = [(MATERIAL, "object", False), (DOSE, "float", False), (TIME, "float", False), (TARGET, "int", False)]
TEXT_FEATURES = [c for g in GROUPS.values() for c in g]


def text_features(spark, sf_dir, label: str = "quality"):
    """documents join labels -> six whole-text features, y, fold, split."""
    t = F.col("text")
    n = F.greatest(F.length(t), F.lit(1))
    words = F.split(t, r"\s+")

    def share(pattern):
        return (F.length(t) - F.length(F.regexp_replace(t, pattern, ""))) / n

    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    lab = table(spark, sf_dir, "labels").select("doc_id", F.col(label).alias("y"))
    df = lab.join(d, "doc_id").select(
        "doc_id", "y", F.log1p(F.length(t)).alias("f_len"), share("[#*%0-9]").alias("f_sym"),
        share(r"[!?.,;:]").alias("f_punct"),
        (F.size(F.array_distinct(words)) / F.greatest(F.size(words), F.lit(1))).alias("f_distinct"),
        share("[A-Z]").alias("f_upper"), share(r"\s").alias("f_ws"))
    df = X.stratified_folds(df, "doc_id", "y", 5, SEED)
    return X.stratified_split(df, "doc_id", "y", 0.2, SEED)


def _train_test(spark, sf_dir):
    d = cut_lineage(text_features(spark, sf_dir))      # six numbers a document, used by every fit
    return d.where(F.col("split") == "train"), d.where(F.col("split") == "test")


def _rf(cols):
    return M.random_forest(cols, "y", num_trees=50, max_depth=6, seed=SEED)


@register("random_forest")
def random_forest(spark, sf_dir):
    """M1: forest with balanced class weights; test-set metric record."""
    tr, te = _train_test(spark, sf_dir)
    w = X.class_weights(tr, "y", n_classes=2).select("y", "weight")
    m = M.random_forest(TEXT_FEATURES, "y", weight="weight", num_trees=60, max_depth=8, seed=SEED).fit(
        tr.join(w, "y"))
    return E.metrics(M.with_score(m.transform(te)))


@register("rf_importance")
def rf_importance(spark, sf_dir):
    """forest importances, largest first."""
    tr, _ = _train_test(spark, sf_dir)
    imp = M.importances(_rf(TEXT_FEATURES).fit(tr), TEXT_FEATURES)
    return spark.createDataFrame(imp, "feature string, importance double")


@register("select_by_mean_importance")
def select_by_mean_importance(spark, sf_dir):
    """features above the mean importance."""
    tr, _ = _train_test(spark, sf_dir)
    keep = M.above_mean(M.importances(_rf(TEXT_FEATURES).fit(tr), TEXT_FEATURES))
    return spark.createDataFrame([(f,) for f in keep], "feature string")


@register("best_n_features")
def best_n_features(spark, sf_dir):
    """F1 for the top-n features, n = 1..p."""
    tr, te = _train_test(spark, sf_dir)
    ranked = [f for f, _ in M.importances(_rf(TEXT_FEATURES).fit(tr), TEXT_FEATURES)]
    return M.best_n_features(tr, te, ranked, _rf)


@register("evaluate_group_combinations")
def evaluate_group_combinations(spark, sf_dir):
    """every 2- and 3-subset of the three feature groups."""
    tr, te = _train_test(spark, sf_dir)
    w = X.class_weights(tr, "y", n_classes=2).select("y", "weight")
    return M.evaluate_groups(cut_lineage(tr.join(w, "y")), te, GROUPS, lambda cols: M.random_forest(
        cols, "y", weight="weight", num_trees=100, max_depth=6, seed=SEED))


@register("svm_rbf")
def svm_rbf(spark, sf_dir):
    """M2: random Fourier features + LinearSVC + Platt probabilities."""
    tr, te = _train_test(spark, sf_dir)
    m = M.PlattSVM(TEXT_FEATURES, "y", "rbf", gamma=0.5, n_components=64, seed=SEED).fit(tr)
    return E.metrics(M.with_score(m.transform(te)))


@register("svm_poly")
def svm_poly(spark, sf_dir):
    """M3: degree-3 polynomial expansion + LinearSVC + Platt probabilities."""
    tr, te = _train_test(spark, sf_dir)
    m = M.PlattSVM(TEXT_FEATURES, "y", "poly", seed=SEED).fit(tr)
    return E.metrics(M.with_score(m.transform(te)))


@register("mlp")
def mlp(spark, sf_dir):
    """M4: multilayer perceptron (scaled inputs)."""
    tr, te = _train_test(spark, sf_dir)
    m = M.mlp(TEXT_FEATURES, "y", seed=SEED).fit(tr)
    return E.metrics(M.with_score(m.transform(te)))


@register("hyperparameter_search")
def hyperparameter_search(spark, sf_dir):
    """M6: seeded search of 100 trials, 5-fold CV balanced accuracy, median pruning in rungs of folds and trees."""
    tr, _ = _train_test(spark, sf_dir)
    space = {"num_trees": ("int", 50, 500), "max_depth": ("int", 3, 30), "min_instances": ("int", 1, 10),
             "subset": ("cat", ["sqrt", "log2", "all"])}
    return M.search(tr.select(*TEXT_FEATURES, "y", "fold"), space,
                    lambda **p: M.random_forest(TEXT_FEATURES, "y", seed=SEED, **p), resource="num_trees")


@register("cross_val_predict")
def cross_val_predict(spark, sf_dir):
    """M7 + M8: scaler fitted inside each fold, out-of-fold probabilities."""
    tr, _ = _train_test(spark, sf_dir)
    oof = M.out_of_fold(tr, lambda: M.logistic(TEXT_FEATURES, "y"), "fold")
    return oof.select("doc_id", "fold", "y", F.round("score", 6).alias("score"), "pred")


@register("graph_classifier")
def graph_classifier(spark, sf_dir):
    """M5: graph over the assay rows, propagated features, weighted logistic
    regression, validation threshold, test metrics (with a search: ``retrain``)."""
    _, rec = TR.fit_graph_classifier(assay_base(spark, sf_dir), seed=SEED)
    return rec


def retrain_from_csv(spark, csv_path: str, runs_dir: str, run_id: str):
    """M9: raw CSV -> cleaned -> validated (V5, the valid table is kept) -> graph classifier with its own encoder
    -> bundle saved under the run id -> one record in the run table.  Returns the record."""
    raw = IO.read_table(spark, csv_path, as_string=True)
    c = C.clean(raw, "train", id_col="row_id", time_col=TIME, target=TARGET)
    typed = c.select(F.col(f"`{MATERIAL}`").alias(MATERIAL), F.col(f"`{DOSE}`").alias(DOSE),
                     F.col(f"`{TIME}`").alias(TIME), F.col(TARGET), F.col("row_id").cast("long").alias("row_id"))
    typed = C.drop_null_rows(typed, [MATERIAL, DOSE, TIME, TARGET])
    path = f"{runs_dir}/{run_id}"
    report = V.validate(typed.drop("row_id"), declared=TRAIN_COLUMNS, critical=[DOSE, TIME, TARGET], raise_on_fail=True)
    IO.write_report(report, f"{path}/validation")
    IO.write_table(typed, f"{path}/valid")
    rows = spark.read.parquet(f"{path}/valid").select("row_id", F.trim(F.col(f"`{MATERIAL}`")).alias("material"),
                                                      F.col(f"`{DOSE}`").alias("dose"), F.col(f"`{TIME}`").alias("hr"),
                                                      F.col(TARGET).cast("int").alias("toxic"))
    gm, rec = TR.fit_graph_classifier(rows, seed=SEED, n_trials=6)
    TR.save_model(gm, f"{path}/final")
    rec = rec.crossJoin(F.broadcast(rows.agg(F.count_distinct("material").alias("materials"))))
    IO.append_run(rec, f"{runs_dir}/registry", {"seed": SEED}, run_id=run_id)
    return rec


@register("retrain")
def retrain(spark, sf_dir):
    """M9: the whole chain from a raw CSV; the model is loaded again and its threshold must agree."""
    runs = scratch_path(spark, f"runs-{uuid.uuid4().hex}")
    raw = f"{runs}/raw"
    IO.write_table(assay_raw(spark, sf_dir), raw, fmt="csv")
    rec = retrain_from_csv(spark, raw, runs, "1")
    loaded = TR.load_model(spark, f"{runs}/1/final")
    return rec.where(F.col("threshold") == loaded.threshold)


def _assay_rows_csv(spark, sf_dir, name):
    """The test-side assay rows as an all-text CSV in the scratch folder."""
    a = X.positional_split(assay_base(spark, sf_dir), "row_id", 0.8).where(F.col("split") == "test")
    txt = a.select(F.col("row_id").cast("string").alias("row_id"), F.col("material").alias(MATERIAL),
                   F.when(F.col("row_id") % 9 == 0, F.replace(F.col("dose").cast("string"), F.lit("."), F.lit(",")))
                    .otherwise(F.col("dose").cast("string")).alias(DOSE),
                   F.when(F.col("row_id") % 11 == 0, F.lit(None).cast("string"))
                    .otherwise(F.col("hr").cast("string")).alias(TIME))
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    IO.write_table(txt, path, fmt="csv")
    return path


def _saved_model(spark, sf_dir):
    """A model fitted on the first 80 % of the rows, saved as a run, and loaded by what the registry says."""
    a = X.positional_split(assay_base(spark, sf_dir), "row_id", 0.8).where(F.col("split") == "train").drop("split")
    gm, _ = TR.fit_graph_classifier(a, seed=SEED)
    runs = scratch_path(spark, f"runs-{uuid.uuid4().hex}")
    TR.save_model(gm, f"{runs}/1/final")
    registry = spark.createDataFrame([("1", 1, True), ("2", 2, False), ("batch-3", 3, True)],
                                     "run_id string, mtime int, has_model boolean")
    run = IO.latest_valid_run(registry).first()["run_id"]
    return TR.load_model(spark, f"{runs}/{run}/final")


@register("score_rows")
def score_rows(spark, sf_dir):
    """Score new assay rows (the last 20 %) with the loaded model, which never saw them."""
    new = X.positional_split(assay_base(spark, sf_dir), "row_id", 0.8).where(F.col("split") == "test")
    return TR.score_rows(_saved_model(spark, sf_dir), new)


_SCORED_SQL = """
WITH r AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS pos, count(*) OVER () AS n FROM events)
SELECT CAST(event_id AS VARCHAR) AS row_id, 'scored' AS status FROM r WHERE pos >= floor(n * 0.8) AND event_id % 11 <> 0
"""


def _status(df):
    ok = F.col("prediction").isin("Toxic", "Non-Toxic") & F.col("confidence").cast("double").between(0.5, 1.0)
    return df.select("row_id", F.when(ok, "scored").otherwise("error").alias("status"))


@register("score_batch", sql=_SCORED_SQL)
def score_batch(spark, sf_dir):
    """R2: all-text CSV -> P8, P5, P11 -> saved model -> CSV with prediction and confidence (here: each row's fate)."""
    raw = IO.read_table(spark, _assay_rows_csv(spark, sf_dir, "batch-in"), as_string=True)
    out = score_batch_frame(raw, _saved_model(spark, sf_dir))
    dest = scratch_path(spark, f"prediction_{uuid.uuid4().hex}")
    IO.write_table(out, dest, fmt="csv")
    return _status(IO.read_table(spark, dest, as_string=True))


@register("score_stream", sql=_SCORED_SQL)
def score_stream_query(spark, sf_dir):
    """The same scorer as a file-stream job (availableNow)."""
    path = _assay_rows_csv(spark, sf_dir, "stream-in")
    out, ck = scratch_path(spark, f"stream-out-{uuid.uuid4().hex}"), scratch_path(spark, f"stream-ck-{uuid.uuid4().hex}")
    q = score_stream(spark, path, out, ck, _saved_model(spark, sf_dir), available_now=True, extra_cols=("row_id",))
    q.awaitTermination()
    return _status(spark.read.parquet(out))


@register("processor_plus_model")
def processor_plus_model(spark, sf_dir):
    """Preprocessing and classifier saved and loaded as one PipelineModel."""
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import SQLTransformer

    a = assay_base(spark, sf_dir)
    params = FE.fit_encoder(a, ["dose", "hr"], ["material"])
    names = [f"feat_{i}" for i in range(len(params.feature_names()))]
    # the fitted encoder as a SQL stage (literals only), saved with the model
    stmt = FE.encoder_sql(params, names)
    pipe = Pipeline(stages=[SQLTransformer(statement=stmt), M.assembler(names),
                            LogisticRegression(featuresCol="features", labelCol="toxic")])
    tr = X.positional_split(a, "row_id", 0.8)
    model = pipe.fit(tr.where(F.col("split") == "train"))
    path = scratch_path(spark, f"model-{uuid.uuid4().hex}")
    model.write().overwrite().save(path)
    loaded = PipelineModel.load(path)
    scored = M.with_score(loaded.transform(tr.where(F.col("split") == "test")), "toxic")
    return scored.select("row_id", "pred", F.round("score", 6).alias("score"))


@register("scaler_plus_model")
def scaler_plus_model(spark, sf_dir):
    """M7: scaler + classifier fitted inside every fold (no leakage across
    folds); balanced accuracy per held-out fold."""
    tr, _ = _train_test(spark, sf_dir)
    oof = M.out_of_fold(tr, lambda: M.logistic(TEXT_FEATURES, "y"), "fold")
    return (oof.groupBy("fold").agg(*[c.alias(n) for n, c in E._metric_cols(
        F.count_if((F.col("y") == 1) & (F.col("pred") == 1)), F.count_if((F.col("y") == 0) & (F.col("pred") == 1)),
        F.count_if((F.col("y") == 0) & (F.col("pred") == 0)), F.count_if((F.col("y") == 1) & (F.col("pred") == 0))
    ).items()]))


@register("cross_val_rows", sql="""
SELECT doc_id, CAST((row_number() OVER (PARTITION BY quality ORDER BY """ + X.mix_sql("doc_id", SEED) + """, doc_id) - 1) % 5
  AS INTEGER) AS fold, quality AS y FROM labels JOIN documents USING (doc_id)""")
def cross_val_rows(spark, sf_dir):
    """M7 + M8: each row is held out exactly once, in its own fold (all labelled rows)."""
    d = cut_lineage(text_features(spark, sf_dir).drop("split"))
    oof = M.out_of_fold(d, lambda: M.logistic(TEXT_FEATURES, "y"), "fold")
    return oof.where(F.col("score").between(0, 1)).select("doc_id", "fold", F.col("y").cast("int").alias("y"))
