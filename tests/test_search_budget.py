"""The search itself on a small table: rungs, pruning, the best trial, and the same result again."""

import inspect
import json

import pytest
from pyspark.sql import functions as F

from assaygraph.operators import models as M


@pytest.fixture(scope="module")
def rows(spark):
    x = spark.range(150).select("id", (F.col("id") % 5).cast("int").alias("fold"), F.rand(3).alias("a"), F.rand(4).alias("b"))
    return x.withColumn("y", ((F.col("a") > 0.5) != (F.col("b") > 0.4)).cast("int")).drop("id")


def test_rungs_halve_the_trials_and_survivors_see_all_folds(rows):
    space = {"num_trees": ("int", 2, 12), "max_depth": ("int", 1, 4)}
    made = []

    def forest(**p):
        made.append(p["num_trees"])
        return M.random_forest(["a", "b"], "y", seed=5, **p)

    def run():
        return [tuple(r) for r in M.search(rows, space, forest, n_trials=8, seed=5, resource="num_trees", least=2).collect()]

    got = run()
    fits = len(made)
    assert [r[0] for r in got] == list(range(8)) and fits == 8 + 4 + 2 + 2 + 2 + 3 * 2     # five rungs, then what is missing
    left = [r for r in got if not r[5]]
    assert len(left) == 2 and all(r[4] == 5 for r in left) and all(r[4] == 0 for r in got if r[5])
    best = [r for r in got if r[6]]
    assert len(best) == 1 and best[0][2] == max(r[2] for r in left)
    assert min(made) >= 2 and max(made[:8]) <= 2                                             # an eighth of 12 trees at first
    assert run() == got
    assert M.best_params(M.search(rows, space, forest, n_trials=1, seed=5)) == json.loads(got[0][1])


def test_default_budget_and_draws():
    assert inspect.signature(M.search).parameters["n_trials"].default == 100
    space = {"reg": ("log", 1e-5, 1.0), "kind": ("cat", ["p", "q"]), "n": ("int", 1, 3), "u": ("float", 0.0, 2.0)}
    draws = M.draw(space, 100, 43)
    assert draws == M.draw(space, 100, 43) != M.draw(space, 100, 44) and len({str(d) for d in draws}) == 100
    assert all(1e-5 <= d["reg"] <= 1 and d["kind"] in "pq" and 1 <= d["n"] <= 3 and 0 <= d["u"] <= 2 for d in draws)


def test_calibration_is_held_out_and_inhomogeneous(rows):
    scored = M.with_score(M.PlattSVM(["a", "b"], "y", "poly", degree=2, coef0=1.0, reg=0.001, seed=5).fit(rows).transform(rows))
    r = scored.agg(F.avg("score"), F.avg("y"), F.min("score"), F.max("score")).first()
    assert abs(r[0] - r[1]) < 0.1 and 0 <= r[2] < r[3] <= 1
    assert M.balanced_accuracy(scored) > 0.75              # exclusive-or needs the product and the linear terms
