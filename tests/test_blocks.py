"""Similarity joins where cells prune nothing, and inside large keys."""

import numpy as np
import pandas as pd
import pytest

from assaygraph.operators import cluster, graph, similarity
from assaygraph.plans import blocks, cells


@pytest.fixture(scope="module")
def scattered(spark):
    """600 rows in 40 dimensions: all cells are in reach of all rows."""
    x = np.random.default_rng(5).normal(size=(600, 40))
    x[7] = 0
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>").repartition(5)
    n = np.linalg.norm(x, axis=1)
    u = x / np.where(n == 0, 1, n)[:, None]
    return df, np.maximum(np.round(1 - u @ u.T, 9), 0)


@pytest.fixture(params=[True, False])
def paying(request, monkeypatch):
    """Either way must give the same rows; tiles of a few rows."""
    monkeypatch.setattr(similarity, "_cells_pay", lambda *a: request.param)
    return request.param


def test_frames_that_a_task_hands_on_are_bounded(spark):
    x = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(np.random.default_rng(1).normal(size=(3000, 8)))],
                              "id long, x array<double>").coalesce(1)
    grid = cells.build(x, "id", "x", rows_per_cell=64)
    for sent in (cells.reach(x, grid, "x", 2.0), cells.nearness(x, grid, "x")):
        sizes = [r.n for r in sent.mapInPandas(lambda fs: (pd.DataFrame({"n": [len(f)]}) for f in fs), "n long").collect()]
        assert sum(sizes) == 3000 * len(np.flatnonzero(grid.radius >= 0))
    frames = []

    class Rows:
        schema = x.schema

        def mapInPandas(self, f, schema):     # noqa: N802 - stands for a DataFrame
            frames.extend(len(p) for p in f([x.toPandas()]))

    cells.reach(Rows(), grid, "x", 2.0)
    cells.nearness(Rows(), grid, "x")
    assert max(frames) <= 8192 and sum(frames) == 2 * 3000 * len(np.flatnonzero(grid.radius >= 0))


def test_all_pairs_are_copied_for_blocks_not_for_cells(scattered, monkeypatch):
    df, d = scattered
    monkeypatch.setattr(cells, "ROWS_PER_CELL", 4)
    monkeypatch.setattr(cells.build, "__defaults__", (4,))
    asked = []
    inner = blocks.cogroup_blocks
    monkeypatch.setattr(blocks, "cogroup_blocks", lambda *a, **k: asked.append((k.get("key"), k.get("symmetric"))) or inner(*a, **k))
    similarity.knn(df, df, 3, exclude_self=True).collect()
    similarity.radius_join(df, 0.9).count()
    assert (None, True) in asked and asked[-1] == (None, True)


def test_joins_either_way(scattered, paying, monkeypatch):
    df, d = scattered
    got = {(r.query_id, r.rank): r.neighbor_id for r in similarity.knn(df, df, 3, exclude_self=True, block_rows=250).collect()}
    for i in range(0, 600, 13):
        order = sorted((j for j in range(600) if j != i), key=lambda j: (d[i, j], j))
        assert [got[i, k] for k in (1, 2, 3)] == order[:3]
    few = df.where("id % 50 = 0")
    got = {(r.query_id, r.rank): r.neighbor_id for r in similarity.knn(few, df, 2).collect()}
    assert got == {(i, k + 1): sorted(range(600), key=lambda j: (d[i, j], j))[k] for i in range(0, 600, 50) for k in (0, 1)}
    eps = float(np.quantile(d, 0.01))
    pairs = {(r.a, r.b) for r in similarity.radius_join(df, eps).collect()}
    assert pairs == {(int(a), int(b)) for a, b in zip(*np.nonzero(d <= eps)) if a < b}
    n = {r.id: r.n_eps for r in similarity.neighbor_counts(df, eps).collect()}
    assert n == {i: int((d[i] <= eps).sum()) for i in range(600) if (d[i] <= eps).any()} | {i: 0 for i in n if not (d[i] <= eps).any()}


def test_clusters_either_way(scattered, paying):
    df, d = scattered
    eps = float(np.sort(d, axis=1)[:, 2][np.argsort(np.sort(d, axis=1)[:, 2])[150]])
    core = (d <= eps).sum(axis=1) >= 3
    label, n = np.full(600, -1), 0
    for i in range(600):
        if core[i] and label[i] < 0:
            todo, label[i] = [i], n
            while todo:
                for j in np.flatnonzero(d[todo.pop()] <= eps):
                    if label[j] < 0:
                        label[j] = n
                        if core[j]:
                            todo.append(j)
            n += 1
    rows = cluster.dbscan(df, eps, 3, block_rows=250).collect()
    assert {r.id: (r.cluster, r.is_core) for r in rows} == {i: (label[i], bool(core[i])) for i in range(600)}


def test_neighbours_inside_large_keys(spark, paying, monkeypatch):
    """Keys of more rows than a block meet by cells, others (and their rows) as before."""
    copies = 4 if paying else 1
    monkeypatch.setattr(blocks, "DEFAULT_BLOCK_ROWS", 200)
    rng = np.random.default_rng(8)
    x = np.repeat(rng.random((800 // copies, 3)), copies, axis=0)
    c = [0 if i < 600 else 1 + i % 60 for i in range(800)]
    df = spark.createDataFrame([(i, [float(v) for v in r], c[i]) for i, r in enumerate(x)], "id long, x array<double>, cluster int")
    met = []
    inner = similarity._class_topk
    monkeypatch.setattr(similarity, "_class_topk", lambda q, r, *a: met.append(r.count()) or inner(q, r, *a))
    got = {(r.src, r.dst) for r in graph.intra_cluster_knn(df, 4).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    d = np.maximum(np.round(1 - u @ u.T, 9), 0)
    want = set()
    for i in range(800):
        for j in sorted((j for j in range(800) if j != i and c[j] == c[i]), key=lambda j: (d[i, j], j))[:4]:
            want.add((min(i, j), max(i, j)))
    assert got == want and met == [600]


def test_tiles_keep_the_kernels_results(monkeypatch):
    rng = np.random.default_rng(2)
    left = pd.DataFrame({"i": range(90), "v": list(rng.normal(size=(90, 3))), "c": rng.random(90) < 0.7, "w": rng.integers(1, 5, 90)})
    right = pd.DataFrame({"i": range(90, 160), "v": list(rng.normal(size=(70, 3))), "c": rng.random(70) < 0.7,
                          "w": rng.integers(1, 5, 70)})
    args = ("i", "i", "v", "v")
    kernels = [blocks.topk_kernel(3, *args, False), blocks.radius_count_kernel(0.1, *args), blocks.radius_pairs_kernel(0.1, *args),
               blocks.radius_count_kernel(0.1, *args, "w"), cluster._euclid_kernel("i", "i", "v", "w")]
    edges = blocks.dbscan_edge_kernel(0.1, *args, "c", "c")

    def run():
        tables = [k(left, right, m) for k in kernels for m in (False, True)]
        return [t.sort_values(list(t.columns)).reset_index(drop=True) for t in tables], [edges(left, right, m) for m in (False, True)]

    def parts(e):
        up = {int(x): int(x) for x in {*e.a, *e.b}}

        def top(x):
            while up[x] != x:
                x = up[x]
            return x
        for a, b in e[e.kind == "c"][["a", "b"]].itertuples(index=False):
            a, b = sorted((top(int(a)), top(int(b))))
            up[b] = a
        return {x: top(x) for x in {*e[e.kind == "c"].a, *e[e.kind == "c"].b}}, {*e[e.kind == "b"][["a", "b"]].itertuples(index=False, name=None)}

    whole, whole_edges = run()
    monkeypatch.setattr(blocks, "_TILE", 1000)
    tiled, tiled_edges = run()
    for a, b in zip(whole, tiled, strict=True):
        pd.testing.assert_frame_equal(a, b)
    assert [parts(e) for e in whole_edges] == [parts(e) for e in tiled_edges]


def test_silhouette_sums_by_cluster_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "_TILE", 500)
    rng = np.random.default_rng(4)
    x, c = rng.normal(size=(300, 4)), rng.integers(0, 5, 300)
    df = spark.createDataFrame([(i, [float(v) for v in r], int(k)) for i, (r, k) in enumerate(zip(x, c))],
                               "id long, x array<double>, cluster long")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    s = []
    for i in range(300):
        a = d[i][c == c[i]].sum() / ((c == c[i]).sum() - 1)
        b = min(d[i][c == k].mean() for k in range(5) if k != c[i])
        s.append((b - a) / max(a, b))
    assert cluster.cluster_quality(df).first()["silhouette"] == pytest.approx(np.mean(s), abs=1e-9)
