"""Equal rows in similarity joins, and splits by a cut key, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaygraph.operators import cluster, similarity, split
from assaygraph.plans.ranking import cut_keys


@pytest.fixture(scope="module")
def crowded(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(240, 4)).round(1)
    x[rng.permutation(240)[:90]] = x[0]                        # more than a third of the rows are one vector
    x[5] = 0.0
    return x, spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>").repartition(4)


def distances(x):
    n = np.linalg.norm(x, axis=1)
    u = x / np.where(n == 0, 1, n)[:, None]
    d = np.maximum(1 - u @ u.T, 0)
    d[n == 0, :] = d[:, n == 0] = 1.0
    return d


def test_nearest_rows_among_equal_ones(crowded, monkeypatch):
    x, df = crowded
    met = []
    inner = similarity._cell_topk
    monkeypatch.setattr(similarity, "_cell_topk", lambda q, r, *a: met.append((q.count(), r.count())) or inner(q, r, *a))
    d = distances(x).round(9)
    for exclude in (True, False):
        got = {}
        for r in similarity.knn(df, df, k=4, exclude_self=exclude).collect():
            got.setdefault(r.query_id, {})[r.rank] = r.neighbor_id
        for i in range(len(x)):
            order = sorted((j for j in range(len(x)) if not (exclude and i == j)), key=lambda j: (d[i, j], j))
            assert [got[i][k] for k in (1, 2, 3, 4)] == order[:4], i
    distinct = len(np.unique(x, axis=0))
    assert met == [(distinct, distinct)] * 2                   # one row for each vector, however many are equal


def test_counts_and_clusters_among_equal_rows(crowded):
    x, df = crowded
    d, eps = distances(x), 0.05
    got = {r["id"]: r.n_eps for r in similarity.neighbor_counts(df, eps).collect()}
    assert got == {i: int((d[i] <= eps).sum()) for i in range(len(x))}
    core = (d <= eps).sum(axis=1) >= 3
    label, n = np.full(len(x), -1), 0
    for i in range(len(x)):
        if core[i] and label[i] < 0:
            todo, label[i] = [i], n
            while todo:
                for j in np.flatnonzero(d[todo.pop()] <= eps):
                    if label[j] < 0:
                        label[j] = n
                        if core[j]:
                            todo.append(j)
            n += 1
    rows = cluster.dbscan(df, eps, 3).collect()
    assert {r["id"]: (r.cluster, r.is_core) for r in rows} == {i: (label[i], bool(core[i])) for i in range(len(x))}


def test_rows_that_differ_are_no_classes(spark):
    df = spark.range(50).select("id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("x"))
    assert similarity.equal_rows(df, "id", "x", 2) is None
    assert similarity.equal_rows(df.limit(0), "id", "x", 2) is None


def test_cut_keys_with_ties_and_groups(spark):
    rng = np.random.default_rng(3)
    rows = [(g, int(v)) for g, n in (("a", 400), ("b", 7), (None, 90)) for v in rng.integers(0, 30, n)]
    df = spark.createDataFrame(rows, "g string, v long").repartition(4)
    for share in (0.0, 0.2, 0.5, 1.0):
        got = {r.g: (r._value, r._take) for r in cut_keys(df, "v", share, F.floor(F.col("_n") * share), ["g"]).collect()}
        for g in ("a", "b", None):
            v = sorted(x for k, x in rows if k == g)
            at = int(len(v) * share)
            value = v[min(at, len(v) - 1)]
            assert got[g] == (value, at - sum(x < value for x in v)), (g, share)


def test_positional_split_by_place(spark):
    ids = list(range(0, 600, 3)) + [9, 9, 9, 9, 2**53 + 1, 2**53 + 2, -5]
    df = spark.createDataFrame([(i, str(i)) for i in ids], "k long, t string").repartition(3)
    out = split.positional_split(df, "k", 0.8)
    train = sorted(r.k for r in out.where("split = 'train'").collect())
    assert train == sorted(ids)[:int(len(ids) * 0.8)] and out.count() == len(ids)
    few = split.positional_split(df.where("k = 9"), "k", 0.5)
    assert few.groupBy("split").count().orderBy("split").collect() == [("test", 3), ("train", 2)]
    assert split.positional_split(df.limit(0), "k").count() == 0
    by_text = split.positional_split(df, "t", 0.25)
    assert by_text.where("split = 'train'").count() == int(len(ids) * 0.25)


def test_no_row_is_sorted_or_stored_by_a_split(spark):
    df = spark.range(5000).select("id", F.rand(1).alias("wide"), (F.col("id") % 3).alias("y"))
    for out in (split.positional_split(df, "id"), split.stratified_split(df, "id", "y")):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "wide" in plan and "Sort" not in plan and "RepartitionByExpression" not in plan
    counts = split.stratified_split(df, "id", "y", 0.2).groupBy("y", "split").count().collect()
    assert {(r.y, r.split): r["count"] for r in counts} == {(y, s): n for y, k in ((0, 1667), (1, 1667), (2, 1666))
                                                           for s, n in (("test", -(-k // 5)), ("train", k - -(-k // 5)))}
