"""Blocks skip what is out of reach inside them, many small keys share a call, and rounded ties count across cells."""

import numpy as np
import pandas as pd
import pytest

from assaygraph.operators import similarity
from assaygraph.plans import blocks, cells


def _sheet(n, seed=1):
    """Rows as the assay view has them: two numbers and a category; some equal, a zero row, one with a missing number."""
    rng = np.random.default_rng(seed)
    x = np.zeros((n, 5))
    x[:, 0], x[:, 1] = rng.exponential(0.08, n).round(4), rng.integers(0, 24, n) / 23
    x[np.arange(n), 2 + rng.integers(0, 3, n)] = 1
    x[n // 2:n // 2 + 20] = x[:20]
    x[7] = 0
    x[11, 0] = np.nan
    return x


def _frame(x):
    ids = np.random.default_rng(2).permutation(len(x)).astype(np.int64)
    return pd.DataFrame({"i": ids, "x": list(x), "c": ids % 3 > 0})


def test_kernels_with_parts_equal_brute_force_and_meet_few_pairs():
    a, b = _frame(_sheet(2500)), _frame(_sheet(2100, 5))
    b["i"] += 400
    u, v = (blocks.unit_rows(np.vstack(f["x"])) for f in (a, b))
    d = np.round(1.0 - u @ v.T, 9)
    d = np.where(d <= 0, 0.0, d)
    far = np.where(np.isnan(d) | (a["i"].to_numpy()[:, None] == b["i"].to_numpy()[None, :]), np.inf, d)
    got = blocks.topk_kernel(4, "i", "i", "x", "x", True)(a, b)
    want = set()
    for i, row in zip(a["i"], far):
        best = np.lexsort((b["i"], row))[:4]
        want |= {(i, b["i"][j], row[j]) for j in best if np.isfinite(row[j])}
    assert set(got.itertuples(index=False, name=None)) == want and len(got) == len(want)

    eps = 2e-5
    e = blocks.dbscan_edge_kernel(eps, "i", "i", "x", "x", "c", "c")(a, b)
    near = d <= eps
    border = e[e["kind"] == "b"]
    rows, cols = np.nonzero(near & ~a["c"].to_numpy()[:, None] & b["c"].to_numpy()[None, :])
    assert sorted(zip(border["a"], border["b"])) == sorted(zip(a["i"].to_numpy()[rows], b["i"].to_numpy()[cols]))
    rows, cols = np.nonzero(near & a["c"].to_numpy()[:, None] & b["c"].to_numpy()[None, :])
    low, member = blocks._star_forest(a["i"].to_numpy()[rows], b["i"].to_numpy()[cols])
    core = e[e["kind"] == "c"]
    assert sorted(zip(core["a"], core["b"])) == sorted(zip(low, member)) and len(core) > 100

    parts, met = blocks._Parts(v), 0
    for pivot, some in parts.groups(u):
        met += len(some) * len(parts.members(parts.within(u[some], pivot, eps)))
    assert met < 0.4 * len(u) * len(v)          # of 17 parts


def test_links_connect_what_all_entries_connect():
    near = np.random.default_rng(3).random((40, 50)) < 0.03
    a, b = np.nonzero(near)
    i, j = blocks._links(near)
    assert near[i, j].all()
    assert [x.tolist() for x in blocks._star_forest(i, j + 40)] == [x.tolist() for x in blocks._star_forest(a, b + 40)]


def test_rounded_ties_in_other_cells_count(spark, monkeypatch):
    """Distances that round to the same nine places are equal: the smaller id is nearer, in whichever cell it lies."""
    monkeypatch.setattr(similarity, "_cells_pay", lambda *a: True)
    monkeypatch.setattr(cells.build, "__defaults__", (4,))
    rng = np.random.default_rng(4)
    t = 0.3 + np.sort(rng.random(120)) * 4e-4
    ids = rng.permutation(120)
    x = np.stack((np.cos(t), np.sin(t)), axis=1)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "id long, x array<double>")
    d = np.maximum(np.round(1 - blocks.unit_rows(x) @ blocks.unit_rows(x).T, 9), 0.0)
    np.fill_diagonal(d, np.inf)
    want = {int(i): int(ids[np.lexsort((ids, row))[0]]) for i, row in zip(ids, d)}
    got = {r["query_id"]: r["neighbor_id"] for r in similarity.knn(df, df, k=1, exclude_self=True).collect()}
    assert got == want


@pytest.mark.parametrize("same", [True, False])
def test_many_small_keys_share_a_call(spark, monkeypatch, same):
    called, plain = [], blocks.small_keys_topk
    monkeypatch.setattr(blocks, "small_keys_topk", lambda q, r, *a: called.append(q.count()) or plain(q, r, *a))
    rng = np.random.default_rng(6)
    x, key, y, other = rng.normal(size=(300, 3)), rng.integers(0, 60, 300), rng.normal(size=(200, 3)), rng.integers(20, 80, 200)
    schema = "id long, x array<double>, c int"
    a = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, key))] + [(900, [1.0, 2.0, 3.0], None)], schema)
    b = a if same else spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(y, other))], schema)
    y, other = (x, key) if same else (y, other)
    d = np.maximum(np.round(1 - blocks.unit_rows(x) @ blocks.unit_rows(y).T, 9), 0.0)
    d[key[:, None] != other[None, :]] = np.inf
    d[np.arange(len(x))[:, None] == np.arange(len(y))[None, :]] = np.inf
    want = {(i, j) for i in range(len(x)) for j in np.argsort(d[i], kind="stable")[:2].tolist() if np.isfinite(d[i, j])}
    got = {(r["query_id"], r["neighbor_id"]) for r in similarity.knn(a, b, k=2, exclude_self=True, key="c").collect()}
    assert got == want and called


@pytest.mark.parametrize("eps", [0.0, 2e-5, 0.02, 0.9])
def test_pairs_found_in_single_precision_first(eps):
    a, b = (blocks.unit_rows(_sheet(n, n)) for n in (400, 300))
    rows, cols, d = blocks._pairs_near(a, b, eps)
    whole = np.round(1.0 - a @ b.T, 9)
    whole = np.where(whole <= 0, 0.0, whole)
    assert np.array_equal(np.argwhere(whole <= eps), np.stack((rows, cols), axis=1)) and np.allclose(d, whole[rows, cols], atol=2e-9)
