"""Classifiers, seeded search and cross-validation on Spark ML.

Model fitting runs on executors (Spark ML estimators); the driver only holds
parameters, per-trial scores and importances (bounded by the feature count).
"""

from __future__ import annotations

import itertools
import json
import math
import random
import statistics
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (LinearSVC, LogisticRegression, MultilayerPerceptronClassifier,
                                       RandomForestClassifier)
from pyspark.ml.feature import PolynomialExpansion, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.session import cut_lineage
from ..plans.session import parallelism as slots
from . import evaluate as E


def assembler(cols: list[str], out: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="keep")


def array_columns(df: DataFrame, arr: str, n: int, prefix: str = "f") -> tuple[DataFrame, list[str]]:
    names = [f"{prefix}{i}" for i in range(n)]
    return df.select("*", *[F.col(arr)[i].alias(nm) for i, nm in enumerate(names)]), names


def random_forest(features: list[str], label: str = "y", weight: str | None = None, seed: int = 43,
                  num_trees: int = 100, max_depth: int = 10, min_instances: int = 1,
                  subset: str = "sqrt", bootstrap: bool = True) -> Pipeline:
    """M1: assembler + RandomForestClassifier (balanced weights via ``weight``)."""
    rf = RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=num_trees,
                                maxDepth=max_depth, minInstancesPerNode=min_instances,
                                featureSubsetStrategy=subset, bootstrap=bootstrap, seed=seed)
    if weight:
        rf.setWeightCol(weight)
    return Pipeline(stages=[assembler(features), rf])


def rff_columns(x_cols: list[str], n_components: int = 64, gamma: float = 1.0, seed: int = 43) -> list[Column]:
    """M2 random Fourier features (Rahimi & Recht 2007) for an RBF kernel:
    z_k = sqrt(2/D) cos(w_k . x + b_k), w ~ N(0, 2 gamma), b ~ U(0, 2 pi).
    Plain column expressions, so they stay inside codegen."""
    rng = random.Random(seed)
    cols = []
    for _ in range(n_components):
        w = [rng.gauss(0.0, math.sqrt(2 * gamma)) for _ in x_cols]
        b = rng.uniform(0, 2 * math.pi)
        dot = sum((F.col(c) * F.lit(wk) for c, wk in zip(x_cols, w)), F.lit(b))
        cols.append(F.lit(math.sqrt(2.0 / n_components)) * F.cos(dot))
    return cols


class PlattSVM:
    """M2/M3: LinearSVC on (random Fourier | polynomial) features with a
    logistic calibration of held-out margins (Platt scaling) for probabilities."""

    def __init__(self, features: list[str], label: str = "y", kind: str = "rbf", gamma: float = 1.0,
                 degree: int = 3, reg: float = 0.01, n_components: int = 128, seed: int = 43, weight: str | None = None,
                 coef0: float = 1.0, parts: int = 3):
        self.features, self.label, self.kind = features, label, kind
        self.gamma, self.degree, self.reg, self.n_components, self.seed, self.weight = (
            gamma, degree, reg, n_components, seed, weight)
        self.coef0, self.parts = coef0, parts

    def _expand(self, df: DataFrame) -> DataFrame:
        if self.kind == "rbf":
            z = rff_columns(self.features, self.n_components, self.gamma, self.seed)
            return df.withColumn("_z", F.array(*z))
        return df

    def _svm(self):
        if self.kind == "rbf":
            stages = [assembler([f"_z{i}" for i in range(self.n_components)], "features")]
        else:
            # (gamma x.y + coef0) ** degree: coef0 is a further constant feature before the expansion
            stages = [assembler([*self.features, "_one"], "_raw"),
                      PolynomialExpansion(degree=self.degree, inputCol="_raw", outputCol="features")]
        svc = LinearSVC(featuresCol="features", labelCol=self.label, regParam=self.reg, maxIter=100)
        if self.weight:
            svc.setWeightCol(self.weight)
        return Pipeline(stages=stages + [svc])

    def fit(self, df: DataFrame) -> "PlattSVM":
        """The machine on all rows; its calibration on margins of rows that a machine of the other parts gave."""
        d = self._ready(df)
        part = F.pmod(F.xxhash64(*self.features, F.lit(self.seed)), F.lit(self.parts))
        margins = None
        for k in range(self.parts):
            held = self._svm().fit(d.where(part != k)).transform(d.where(part == k))
            held = held.select(self.label, vector_to_array("rawPrediction")[1].alias("m"))
            margins = held if margins is None else margins.unionByName(held)
        self.svm = self._svm().fit(d)
        self.platt = Pipeline(stages=[assembler(["m"], "mf"),
                                      LogisticRegression(featuresCol="mf", labelCol=self.label)]).fit(margins)
        return self

    def _ready(self, df: DataFrame) -> DataFrame:
        if self.kind == "rbf":
            return array_columns(self._expand(df), "_z", self.n_components, "_z")[0]
        return df.withColumn("_one", F.lit(math.sqrt(self.coef0)))

    def transform(self, df: DataFrame) -> DataFrame:
        scored = self.svm.transform(self._ready(df)).withColumn("m", vector_to_array("rawPrediction")[1])
        scored = scored.drop("rawPrediction", "prediction", "features", "_raw", "_one")
        return self.platt.transform(scored)


def mlp(features: list[str], label: str = "y", hidden: tuple[int, ...] = (64, 32), seed: int = 43,
        max_iter: int = 200) -> Pipeline:
    """M4: MultilayerPerceptronClassifier (sigmoid hidden units; Spark has no
    relu/tanh choice, L2 term or sample weights - documented difference)."""
    layers = [len(features), *hidden, 2]
    return Pipeline(stages=[assembler(features, "_raw"), StandardScaler(inputCol="_raw", outputCol="features"),
                            MultilayerPerceptronClassifier(featuresCol="features", labelCol=label, layers=layers,
                                                           seed=seed, maxIter=max_iter)])


def logistic(features: list[str], label: str = "y", weight: str | None = None, reg: float = 0.0,
             elastic: float = 0.0) -> Pipeline:
    lr = LogisticRegression(featuresCol="features", labelCol=label, regParam=reg, elasticNetParam=elastic, maxIter=100)
    if weight:
        lr.setWeightCol(weight)
    return Pipeline(stages=[assembler(features, "_raw"), StandardScaler(inputCol="_raw", outputCol="features"), lr])


def with_score(pred: DataFrame, label: str = "y") -> DataFrame:
    """Positive-class probability as ``score`` and the argmax as ``pred``."""
    return pred.withColumn("score", vector_to_array("probability")[1]).withColumn(
        "pred", F.col("prediction").cast("int")).withColumn("y", F.col(label).cast("int"))


def balanced_accuracy(scored: DataFrame) -> float:
    return float(E.metrics(scored).first()["balanced_accuracy"])


def importances(model: PipelineModel, features: list[str]) -> list[tuple[str, float]]:
    """(feature, importance) sorted descending (first on ties)."""
    imp = model.stages[-1].featureImportances.toArray()
    return sorted(zip(features, map(float, imp)), key=lambda t: (-t[1], features.index(t[0])))


def above_mean(imps: list[tuple[str, float]]) -> list[str]:
    """features whose importance exceeds the mean importance."""
    mean = sum(v for _, v in imps) / len(imps) if imps else 0.0
    return [f for f, v in imps if v > mean]


def out_of_fold(df: DataFrame, make, fold_col: str = "fold", label: str = "y") -> DataFrame:
    """M8: out-of-fold predictions (each fold scored by a model fitted on the
    others; the pipeline, scaler included, is fitted inside the fold = M7)."""
    folds = sorted(r[0] for r in df.select(fold_col).distinct().collect())
    parts = []
    for f in folds:
        model = make().fit(df.where(F.col(fold_col) != f))
        parts.append(with_score(model.transform(df.where(F.col(fold_col) == f)), label))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def draw(space: dict, n_trials: int, seed: int) -> list[dict]:
    """Seeded draws from ``space``: a name -> ('int', lo, hi) | ('float', lo, hi) | ('log', lo, hi) | ('cat', [..])."""
    rng = random.Random(seed)
    kinds = {"int": lambda lo, hi: rng.randint(lo, hi), "float": lambda lo, hi: rng.uniform(lo, hi),
             "log": lambda lo, hi: math.exp(rng.uniform(math.log(lo), math.log(hi))), "cat": lambda values: rng.choice(values)}
    return [{k: kinds[spec[0]](*spec[1:]) for k, spec in space.items()} for _ in range(n_trials)]


def sized(df: DataFrame, rows_per_task: int = 50_000) -> tuple[DataFrame, int]:
    """``df`` checkpointed in as many partitions as its rows need, in an order that does not depend on the last run."""
    parts = max(1, -(-df.count() // rows_per_task))
    order = [F.xxhash64(*df.columns), *df.columns]
    return cut_lineage(df.repartitionByRange(parts, *order).sortWithinPartitions(*order)), parts


def search(df: DataFrame, space: dict, make, n_trials: int = 100, fold_col: str = "fold", seed: int = 43,
           label: str = "y", resource: str | None = None, least: int = 16, parallelism: int | None = None) -> DataFrame:
    """M6: seeded random search for the best mean balanced accuracy over folds, in rungs.

    Rung r scores all live trials on fold r and then keeps the better half by
    the means so far (of equal ones the earlier trials).  ``resource`` names an integer parameter that
    costs time (number of trees): the first rungs take an eighth, a quarter and
    half of it (not below ``least``).  Trials that outlive all rungs are then scored on every
    fold with all of it; only these count as ``folds`` and only they can be the best.

    Trials of a rung run side by side: the training frame is laid out in
    partitions of its size, and as many fits start as task slots are left.  Returns ``trial,
    params, mean, std, folds, pruned, best``; the mean of a pruned trial is of its rungs.
    """
    trials = draw(space, n_trials, seed)
    frame, parts = sized(df)
    folds = sorted(r[0] for r in frame.select(fold_col).distinct().collect())
    workers = parallelism or max(1, slots(df.sparkSession) // parts)

    def fit(job: tuple[int, int, float]) -> float:
        trial, fold, share = job
        params = dict(trials[trial])
        if resource:
            params[resource] = min(params[resource], max(least, round(params[resource] * share)))
        model = make(**params).fit(frame.where(F.col(fold_col) != fold))
        return balanced_accuracy(with_score(model.transform(frame.where(F.col(fold_col) == fold)), label))

    shares = [1.0] * len(folds)
    if resource:
        shares[:3] = [0.125, 0.25, 0.5][:len(folds)]
    rungs: dict[int, list[float]] = {i: [] for i in range(n_trials)}
    full: dict[int, dict[int, float]] = {i: {} for i in range(n_trials)}
    live, mean = list(range(n_trials)), lambda xs: sum(xs) / len(xs)
    with ThreadPoolExecutor(max_workers=workers) as pool:
        for r, fold in enumerate(folds):
            # large forests first, so that the rung does not end with one of them
            jobs = sorted(live, key=lambda i: -(trials[i][resource] if resource else 0))
            for i, score in zip(jobs, pool.map(fit, [(i, fold, shares[r]) for i in jobs])):
                rungs[i].append(score)
                if shares[r] == 1.0:
                    full[i][fold] = score
            if r + 1 < len(folds) and len(live) > 2:
                live = sorted(sorted(live, key=lambda i: (-mean(rungs[i]), i))[:-(-len(live) // 2)])
        again = [(i, fold, 1.0) for i in live for fold in folds if fold not in full[i]]
        for (i, fold, _), score in zip(again, pool.map(fit, again)):
            full[i][fold] = score
    best = max(live, key=lambda i: (mean(list(full[i].values())), -i), default=None)
    rows = []
    for i, p in enumerate(trials):
        s = list(full[i].values()) if i in live else rungs[i]
        rows.append((i, json.dumps(p, sort_keys=True), mean(s), statistics.pstdev(s), len(full[i]) if i in live else 0,
                     i not in live, i == best))
    return df.sparkSession.createDataFrame(rows, "trial int, params string, mean double, std double, folds int, "
                                                 "pruned boolean, best boolean")


def best_params(found: DataFrame) -> dict:
    """The parameters of the best trial of a search."""
    return json.loads(found.where("best").first()["params"])


def best_n_features(train: DataFrame, test: DataFrame, ranked: list[str], make, label: str = "y") -> DataFrame:
    """for n = 1..p fit on the top-n features; F1 on test per n, and ``chosen``: the smallest n with the best F1."""
    rows = []
    for n in range(1, len(ranked) + 1):
        m = make(ranked[:n]).fit(train)
        r = E.metrics(with_score(m.transform(test), label)).first()
        rows.append((n, ",".join(ranked[:n]), float(r["f1_score"])))
    best = max(rows, key=lambda r: (r[2], -r[0]))[0] if rows else 0
    return train.sparkSession.createDataFrame([(*r, r[0] == best) for r in rows],
                                              "n int, features string, f1_score double, chosen boolean")


def evaluate_groups(train: DataFrame, test: DataFrame, groups: dict[str, list[str]], make,
                    sizes=(2, 3), label: str = "y", fold_col: str = "fold") -> DataFrame:
    """every 2- and 3-subset of the feature groups, F1 on test, best first.

    The threshold of each subset comes from cross-validation on the training
    rows (E8: best F1 of each fold's held-out scores, median over folds); the
    model that is tested is then fitted on all of them.
    """
    rows = []
    for k in sizes:
        for combo in itertools.combinations(sorted(groups), k):
            cols = group_columns(train.columns, groups, list(combo))
            oof = cut_lineage(out_of_fold(train, lambda: make(cols), fold_col, label).select(fold_col, "y", "score"))
            per_fold = E.best_threshold(oof, E.grid_e8(), "f1_score", by=[fold_col]).collect()     # one row a fold
            t = statistics.median(r["threshold"] for r in per_fold)
            scored = with_score(make(cols).fit(train).transform(test), label)
            r = E.metrics(scored.withColumn("pred", (F.col("score") >= t).cast("int"))).first()
            rows.append(("+".join(combo), len(cols), float(t), float(r["f1_score"])))
    return train.sparkSession.createDataFrame(
        rows, "groups string, n_features int, threshold double, f1_score double").orderBy(
        F.desc("f1_score"), "groups")


def group_columns(columns: list[str], groups: dict[str, list[str]], chosen: list[str]) -> list[str]:
    """Logical feature groups -> the physical columns present (one-hot
    groups match by prefix, e.g. 'Material type_')."""
    out = []
    for g in chosen:
        for spec in groups.get(g, []):
            out += [c for c in columns if c == spec or (spec.endswith("_") and c.startswith(spec))]
    return list(dict.fromkeys(out))
