"""KS p-values against tabulated values and brute force, and co-moment matrices against numpy."""

import itertools
import math

import numpy as np
import pytest

from assaygraph.operators import features as FE
from assaygraph.operators import ks
from assaygraph.operators.validate import drift_report


def enumerated(d, n1, n2):
    """Share of all orders of the two samples whose statistic reaches d."""
    hits = 0
    for first in itertools.combinations(range(n1 + n2), n1):
        own, i, j, worst = set(first), 0, 0, 0.0
        for s in range(n1 + n2):
            i, j = (i + 1, j) if s in own else (i, j + 1)
            worst = max(worst, abs(i / n1 - j / n2))
        hits += worst >= d - 1e-12
    return hits / math.comb(n1 + n2, n1)


@pytest.mark.parametrize(("n1", "n2"), [(5, 5), (4, 7), (6, 3), (8, 8), (1, 6)])
def test_exact_p_counts_all_orders(n1, n2):
    for d in sorted({abs(i / n1 - j / n2) for i in range(n1 + 1) for j in range(n2 + 1)}):
        assert ks.exact_p(d, n1, n2) == pytest.approx(enumerated(d, n1, n2), abs=1e-12)


def test_tabulated_values():
    # two samples of ten; critical values of one sample at 5 % (n: 5, 10, 20, 40)
    for d, p in ((0.5, 0.16782), (0.6, 0.05245), (0.7, 0.01234)):
        assert ks.exact_p(d, 10, 10) == pytest.approx(p, abs=1e-5)
    for n, d in ((5, 0.56328), (10, 0.40925), (20, 0.29408), (40, 0.21012)):
        assert ks.one_sample_p(d, n) == pytest.approx(0.05, abs=2e-4)


def test_expansion_meets_the_matrix_and_the_exact_distribution():
    for z in (0.5, 0.8, 1.0, 1.36, 1.8, 2.3):
        n = ks._MATRIX_ROWS
        assert ks._expanded_cdf(z, n) == pytest.approx(ks._matrix_cdf(z / math.sqrt(n), n), abs=2e-5)
        d = round(z * math.sqrt(2 / 4000) * 4000) / 4000                      # two samples of 4,000 rows
        assert ks.one_sample_p(d, 2000) == pytest.approx(ks.exact_p(d, 4000, 4000), rel=0.06, abs=2e-3)
    # where the tail formula takes over, p falls as exp(-2 z^2) does
    ratio = ks.one_sample_p(2.41 / math.sqrt(5000), 5000) / ks.one_sample_p(2.39 / math.sqrt(5000), 5000)
    assert ratio == pytest.approx(math.exp(-2 * (2.41 ** 2 - 2.39 ** 2)), rel=0.02)


def test_status_near_the_level(spark):
    """D = 0.6 of ten rows a side: p 0.0524, no drift; the limiting series says 0.0546; D = 0.7 is drift."""
    base = spark.createDataFrame([(float(i),) for i in range(10)], "v double")
    for moved, drift in ((6, False), (7, True)):
        other = spark.createDataFrame([(float(i) + (100 if i < moved else 0),) for i in range(10)], "v double")
        row = drift_report(base, other, ["v"]).first()
        assert row["d_stat"] == pytest.approx(moved / 10) and row["drift_status"] is drift
        assert row["p_value"] == pytest.approx(ks.exact_p(moved / 10, 10, 10))


def _frame(spark, x, names):
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in x]
    return spark.createDataFrame(rows, ", ".join(f"`{n}` double" for n in names)).repartition(5)


def test_correlations_of_columns_with_gaps(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 6)) * [1, 10, 1e-3, 1, 1, 1] + [0, 1e6, 5, 0, 0, 0]
    x[:, 3] = x[:, 0] * 2 + 0.1 * x[:, 3]
    x[:, 4] = 7.25
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 5][~np.isnan(x[:, 2])] = np.nan                       # no row has both 2 and 5
    names = ["a", "b b", "c", "d", "e", "f"]
    got = {(r.col_a, r.col_b): r.r for r in FE.correlation_matrix(_frame(spark, x, names), names).collect()}
    assert len(got) == 15
    for i, j in itertools.combinations(range(6), 2):
        both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        u, v = x[both, i], x[both, j]
        if both.sum() < 2 or u.std() == 0 or v.std() == 0:
            assert got[names[i], names[j]] is None
        else:
            assert got[names[i], names[j]] == pytest.approx(abs(np.corrcoef(u, v)[0, 1]), abs=1e-9)


def test_five_hundred_columns_are_one_pass(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 500))
    x[:, 499] = x[:, 0]
    df = spark.range(400).rdd.mapPartitions(lambda rows: (tuple(map(float, x[r.id])) for r in rows)).toDF([f"c{i}" for i in range(500)])
    got = FE.correlation_matrix(df, df.columns)
    assert got.where("r > 0.999").select("col_a", "col_b").collect() == [("c0", "c499")]
    assert got.count() == 500 * 499 // 2


def test_vif_loop_and_the_whole_filter_against_numpy(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, 6)) + 1
    x[:, 2] = x[:, 0] + x[:, 1] + 0.01 * rng.normal(size=500)
    x[:, 4] = x[:, 3] * 1.02 + 0.05 * rng.normal(size=500)
    names = [f"c{i}" for i in range(6)]

    def vifs(cols):
        out = []
        for c in cols:
            rest = x[:, [k for k in cols if k != c]]
            coef = np.linalg.lstsq(rest, x[:, c], rcond=None)[0]
            out.append((x[:, c] ** 2).sum() / ((x[:, c] - rest @ coef) ** 2).sum())
        return out

    def loop(cols):
        dropped = []
        while len(cols) >= 2:
            v = vifs(cols)
            worst = int(np.argmax(v))
            if v[worst] <= 10:
                break
            dropped.append((names[cols[worst]], v[worst]))
            cols = [c for k, c in enumerate(cols) if k != worst]
        return cols, dropped

    df = _frame(spark, x, names)
    got = FE.high_vif(df, names, 10.0).where("dropped").orderBy("order").collect()
    want = loop(list(range(6)))[1]
    assert [r.column for r in got] == [c for c, _ in want]
    assert [r.vif for r in got] == pytest.approx([v for _, v in want], rel=1e-6)
    # correlation first, then columns of one value, then the loop
    x = np.column_stack((x, np.full(500, 3.0)))
    r = np.corrcoef(x[:, :6].T)
    left = [j for j in range(6) if not any(abs(r[i, j]) > 0.9 for i in range(j))]
    names.append("g")
    assert FE.multicollinearity(_frame(spark, x, names), names, 0.9, 10.0) == [names[c] for c in loop(left)[0]]
