"""Scaling, one-hot encoding and the column transformer.

Fitted parameters are small (two numbers per numeric column and the categories
that become columns), so a fit is one aggregate pass whose single row
is read on the driver; applying them is a projection with literals - no join,
no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ranking import with_index


@dataclass
class EncoderParams:
    num_cols: list[str]
    cat_cols: list[str]
    mins: dict[str, float] = field(default_factory=dict)
    maxs: dict[str, float] = field(default_factory=dict)
    categories: dict[str, list[str]] = field(default_factory=dict)

    def feature_names(self) -> list[str]:
        names = list(self.num_cols)
        for c in self.cat_cols:
            names += [f"{c}_{v}" for v in self.categories[c]]
        return names

    def to_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(c, "min", float(self.mins[c]) if self.mins[c] is not None else None, None, i)
                for i, c in enumerate(self.num_cols)]
        rows += [(c, "max", float(self.maxs[c]) if self.maxs[c] is not None else None, None, i)
                 for i, c in enumerate(self.num_cols)]
        rows += [(c, "category", None, v, i) for c in self.cat_cols for i, v in enumerate(self.categories[c])]
        return spark.createDataFrame(rows, "column string, kind string, num double, text string, pos int")

    @staticmethod
    def from_frame(df: DataFrame, num_cols: list[str], cat_cols: list[str]) -> "EncoderParams":
        rows = df.collect()  # bounded: 2 rows per numeric column + checked category lists
        p = EncoderParams(list(num_cols), list(cat_cols))
        for r in rows:
            if r["kind"] == "min":
                p.mins[r["column"]] = r["num"]
            elif r["kind"] == "max":
                p.maxs[r["column"]] = r["num"]
        for c in cat_cols:
            p.categories[c] = [r["text"] for r in sorted((r for r in rows if r["kind"] == "category"
                                                         and r["column"] == c), key=lambda r: r["pos"])]
        return p


def fit_minmax(df: DataFrame, cols: list[str]) -> tuple[dict, dict]:
    row = df.agg(*[F.min(c).alias(f"mn{i}") for i, c in enumerate(cols)],
                 *[F.max(c).alias(f"mx{i}") for i, c in enumerate(cols)]).first()
    return ({c: row[f"mn{i}"] for i, c in enumerate(cols)}, {c: row[f"mx{i}"] for i, c in enumerate(cols)})


def minmax_expr(col: str | Column, lo, hi) -> Column:
    """(x - min) / (max - min); a constant column maps to 0 (unlike MLlib's 0.5)."""
    c = F.col(col) if isinstance(col, str) else col
    if lo is None or hi is None:            # fitted on no rows
        return F.lit(None).cast("double")
    if hi == lo:
        return F.when(c.isNull(), F.lit(None).cast("double")).otherwise(F.lit(0.0))
    return (c.cast("double") - F.lit(float(lo))) / F.lit(float(hi) - float(lo))


def min_max_scale(df: DataFrame, cols: list[str], fit_on: DataFrame | None = None,
                  suffix: str = "") -> DataFrame:
    """fit on ``fit_on`` (default: df itself), apply to df."""
    mins, maxs = fit_minmax(fit_on if fit_on is not None else df, cols)
    return df.withColumns({f"{c}{suffix}": minmax_expr(c, mins[c], maxs[c]) for c in cols})


def standard_scale(df: DataFrame, cols: list[str], fit_on: DataFrame | None = None,
                   suffix: str = "") -> DataFrame:
    """(x - mean) / population std; a constant column maps to 0."""
    src = fit_on if fit_on is not None else df
    row = src.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
                  *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    out = {}
    for i, c in enumerate(cols):
        m, s = row[f"m{i}"], row[f"s{i}"]
        out[f"{c}{suffix}"] = (F.lit(0.0) if not s else (F.col(c) - F.lit(m)) / F.lit(s))
    return df.withColumns(out)


#: So many values of a column become columns of their own (a literal expression each).
MAX_CATEGORIES = 10_000


def fit_categories(df: DataFrame, col: str, most: int = MAX_CATEGORIES) -> list[str]:
    """Sorted distinct non-null values.  They become columns of the result, so their number is checked before they are
    read; for a column with more use :func:`sparse_one_hot`, which keeps them in a table."""
    vals = df.select(F.col(col).cast("string").alias("v")).where(F.col("v").isNotNull()).distinct()
    rows = vals.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{col} has more than {most} values: use category_index and sparse_one_hot")
    return sorted(r["v"] for r in rows)


def category_index(df: DataFrame, col: str) -> DataFrame:
    """``value, pos``: the sorted distinct values and their places, as a table (any number of values)."""
    values = df.select(F.col(col).cast("string").alias("value")).where(F.col("value").isNotNull()).distinct()
    return with_index(values, ["value"], out="pos")


def sparse_one_hot(df: DataFrame, col: str, index: DataFrame, out: str = "hot") -> DataFrame:
    """F2 for any number of categories: ``out`` is the place of the row's 1 (null: unseen or no value, all zeros)."""
    places = index.select(F.col("value").alias("_value"), F.col("pos").alias(out))
    return df.join(places, F.col(col).cast("string") == F.col("_value"), "left").drop("_value")


def one_hot_exprs(col: str, categories: list[str]) -> list[Column]:
    """one indicator per sorted category; unseen values give all zeros."""
    c = F.col(col).cast("string")
    return [F.coalesce((c == F.lit(v)).cast("double"), F.lit(0.0)) for v in categories]


def fit_encoder(df: DataFrame, num_cols: list[str], cat_cols: list[str]) -> EncoderParams:
    mins, maxs = fit_minmax(df, num_cols) if num_cols else ({}, {})
    cats = {c: fit_categories(df, c) for c in cat_cols}
    return EncoderParams(list(num_cols), list(cat_cols), mins, maxs, cats)


def encode_exprs(params: EncoderParams) -> list[Column]:
    # a missing number stays missing: 0.0 would be the smallest value
    exprs = [minmax_expr(c, params.mins[c], params.maxs[c]) for c in params.num_cols]
    for c in params.cat_cols:
        exprs += one_hot_exprs(c, params.categories[c])
    return exprs


def encoder_sql(params: EncoderParams, names: list[str]) -> str:
    """The fitted encoder as a SQL statement over ``__THIS__`` (literals only),
    usable as an ``SQLTransformer`` stage and saved with a ``PipelineModel``."""
    def q(c):
        return "`" + c.replace("`", "``") + "`"

    parts = []
    for c in params.num_cols:
        lo, hi = params.mins[c], params.maxs[c]
        if lo is None or hi is None or hi == lo:
            parts.append(f"CASE WHEN {q(c)} IS NOT NULL THEN 0.0D END")
        else:
            parts.append(f"(CAST({q(c)} AS DOUBLE) - ({float(lo)!r}D)) / ({float(hi) - float(lo)!r}D)")
    for c in params.cat_cols:
        for v in params.categories[c]:
            lit = v.replace("\\", "\\\\").replace("'", "\\'")
            parts.append(f"CASE WHEN CAST({q(c)} AS STRING) = '{lit}' THEN 1.0 ELSE 0.0 END")
    cols = ", ".join(f"{p} AS {q(n)}" for p, n in zip(parts, names))
    return f"SELECT *, {cols} FROM __THIS__"


def encode(df: DataFrame, params: EncoderParams, out: str = "x") -> DataFrame:
    """``out`` = array [scaled numerics..., one-hot...] in declared order."""
    return df.withColumn(out, F.array(*encode_exprs(params)))


def zero_variance(df: DataFrame, cols: list[str]) -> list[str]:
    """columns with at most one distinct non-null value: least and greatest agree (one pass, no shuffle of values)."""
    same = [F.min(c).eqNullSafe(F.max(c)).alias(f"s{i}") for i, c in enumerate(cols)]
    row = df.agg(*same).first()
    return [c for i, c in enumerate(cols) if row[f"s{i}"]]


def pearson(a: Column, b: Column) -> Column:
    """Pairwise-complete Pearson r; NULL (not an ANSI divide error) when a
    side is constant."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


def co_moments(df: DataFrame, cols: list[str], shift: list[float] | None = None, complete: bool = False) -> DataFrame:
    """``i, n, sx, sxx, sxy``: row i of four p x p matrices over ``cols`` (arrays of p doubles each).

    Entry j is taken over the rows where both columns have a value (``complete``: where all have
    one): their number, the sum of x_i, of its square, and of x_i * x_j, each value less its ``shift``.  Every task adds
    up matrix products of its Arrow batches and reports p rows; these are summed in two steps, so
    no task gets more than a share of them.
    """
    import numpy as np
    import pandas as pd

    p, fields = len(cols), ["n", "sx", "sxx", "sxy"]
    base = np.array(shift if shift is not None else [0.0] * p)
    schema = "i int, part int, n array<double>, sx array<double>, sxx array<double>, sxy array<double>"

    def rows_of(i, part, sums):
        return pd.DataFrame({"i": i, "part": part, **{f: list(s) for f, s in zip(fields, sums)}})

    def products(frames):
        from pyspark import TaskContext

        total = np.zeros((4, p, p))
        for f in frames:
            x = f.to_numpy(dtype=float, na_value=np.nan) - base
            has = ~np.isnan(x)
            if complete:
                x, has = x[has.all(axis=1)], has[has.all(axis=1)]
            x, m = np.where(has, x, 0.0), has.astype(float)
            total += (m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x)
        yield rows_of(np.arange(p), TaskContext.get().partitionId() % 64, total)

    def add(f):
        sums = [[np.sum(np.stack(f[c].to_list()), axis=0)] for c in fields]
        return rows_of([f["i"].iloc[0]], 0, sums)

    x = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{k}") for k, c in enumerate(cols)])
    out = x.mapInPandas(products, schema).groupBy("i", "part").applyInPandas(add, schema)
    return out.groupBy("i").applyInPandas(add, schema).drop("part")


def _centres(df: DataFrame, cols: list[str]) -> list[float]:
    """The mean of each column (the value itself of a constant one), in one pass: sums of squares stay exact enough."""
    x = [F.col(f"`{c}`").cast("double") for c in cols]
    row = df.agg(*[F.when(F.min(c) == F.max(c), F.min(c)).otherwise(F.avg(c)) for c in x]).first()
    return [0.0 if v is None or v != v else float(v) for v in row]


def correlation_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """|Pearson r| for all pairs i < j, pairwise complete: ``col_a, col_b, r``.

    r is null where a column is constant on the common rows, and where these are fewer than two.
    Any number of columns: :func:`co_moments` holds p x p numbers a task, and the
    plan has a fixed number of steps.
    """
    names = F.array(*[F.lit(c) for c in cols])
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], "col_a string, col_b string, r double")
    m = co_moments(df, cols, _centres(df, cols))
    cells = m.select("i", F.posexplode(F.arrays_zip("n", "sx", "sxx", "sxy")).alias("j", "m")).select("i", "j", "m.*")
    # sums of the other column over the same rows stand in row j
    cells = cells.where("i != j").withColumns({"a": F.least("i", "j"), "b": F.greatest("i", "j")})
    both = cells.groupBy("a", "b").agg(
        F.first(F.nullif("n", F.lit(0.0))).alias("n"), F.first("sxy").alias("sxy"),
        *[F.max(F.when(F.col("i") == F.col(s), F.col(c))).alias(f"{c}_{s}") for s in "ab" for c in ("sx", "sxx")])
    var = lambda s: F.col(f"sxx_{s}") - F.col(f"sx_{s}") * F.col(f"sx_{s}") / F.col("n")
    varies = (F.col("n") >= 2) & (var("a") > 1e-13 * F.col("sxx_a")) & (var("b") > 1e-13 * F.col("sxx_b"))   # up to rounding
    cov = F.col("sxy") - F.col("sx_a") * F.col("sx_b") / F.col("n")
    r = F.when(varies, F.abs(cov / F.sqrt(F.abs(var("a") * var("b")))))
    return both.select(names[F.col("a")].alias("col_a"), names[F.col("b")].alias("col_b"), r.alias("r"))


def _corr_lookup(df: DataFrame, cols: list[str]) -> dict[tuple[str, str], float | None]:
    rows = correlation_matrix(df, cols).collect()   # p(p-1)/2 numbers
    out = {}
    for r in rows:
        out[(r["col_a"], r["col_b"])] = out[(r["col_b"], r["col_a"])] = r["r"]
    return out


def high_correlation(df: DataFrame, cols: list[str], threshold: float = 0.9,
                     protected_prefix: str = "Material type_") -> DataFrame:
    """``column, dropped, step``.

    Step 1 (unprotected columns in order): drop j when any earlier i has
    |r| > threshold - also when i itself was dropped.  Step 2: drop a
    survivor whose |r| with any protected column exceeds the threshold.
    One aggregate computes the matrix; the rules run on the p x p numbers.
    """
    protected = [c for c in df.columns if c.startswith(protected_prefix)]
    others = [c for c in cols if not c.startswith(protected_prefix)]
    r = _corr_lookup(df, others + protected)

    def big(a, b):
        v = r.get((a, b))
        return v is not None and v > threshold

    step = {}
    for j, c in enumerate(others):
        if any(big(others[i], c) for i in range(j)):
            step[c] = 1
    for c in others:
        if c not in step and any(big(c, p) for p in protected):
            step[c] = 2
    rows = [(c, c in step, step.get(c, 0)) for c in others]
    return df.sparkSession.createDataFrame(rows, "column string, dropped boolean, step int")


def gram_matrix(df: DataFrame, cols: list[str]):
    """X^T X, the column sums and the row count over rows complete in ``cols``, as numpy (p x p numbers)."""
    import numpy as np

    g, sums, n = np.zeros((len(cols), len(cols))), np.zeros(len(cols)), 0
    for r in (co_moments(df, cols, complete=True).collect() if cols else []):
        g[r["i"]], sums[r["i"]], n = r["sxy"], r["sx"][r["i"]], int(r["n"][r["i"]])
    return g, sums, n


def _vif_from_gram(g, idx: list[int], sums=None, n: int | None = None) -> list[float]:
    """VIF of each column regressed on the others without an intercept, as
    statsmodels computes it: SST / SSR, where SST is uncentred unless the
    other columns span the constant vector (then R^2 is centred).

    SSR_i = G_ii - b' G_oo^+ b (Schur complement); a zero SSR is infinite.
    """
    import numpy as np

    out = []
    for k in idx:
        rest = [m for m in idx if m != k]
        gkk = g[k, k]
        if rest:
            a = g[np.ix_(rest, rest)]
            b = g[rest, k]
            coef = np.linalg.lstsq(a, b, rcond=None)[0]
            ssr = gkk - b @ coef
        else:
            ssr = gkk
        sst = gkk
        if sums is not None and n and rest:
            s_o = sums[rest]
            c = np.linalg.lstsq(g[np.ix_(rest, rest)], s_o, rcond=None)[0]
            if n - s_o @ c <= 1e-9 * n:                     # constant vector in the span of the others
                sst = gkk - sums[k] ** 2 / n
        out.append(float("inf") if ssr <= 1e-12 * max(gkk, 1e-300) else float(sst / ssr))
    return out


def vif(df: DataFrame, cols: list[str]) -> DataFrame:
    """F8: ``column, vif`` from one Gram-matrix pass."""
    g, sums, n = gram_matrix(df, cols)
    vals = _vif_from_gram(g, list(range(len(cols))), sums, n)
    return df.sparkSession.createDataFrame(list(zip(cols, vals)), "column string, vif double")


def high_vif(df: DataFrame, cols: list[str], threshold: float = 10.0) -> DataFrame:
    """F8 loop: drop the largest VIF while it exceeds ``threshold`` (stop at
    fewer than 2 columns).  The Gram matrix is computed once; every round is
    a sub-matrix inverse on the driver.  ``column, dropped, order, vif``."""
    g, sums, n = gram_matrix(df, cols)
    keep = list(range(len(cols)))
    dropped = []
    while len(keep) >= 2:
        vals = _vif_from_gram(g, keep, sums, n)
        k = max(range(len(keep)), key=lambda m: (vals[m], -m))
        if vals[k] > threshold:
            dropped.append((cols[keep[k]], vals[k]))
            keep.pop(k)
        else:
            break
    order = {c: i + 1 for i, (c, _) in enumerate(dropped)}
    vifs = dict(dropped)
    rows = [(c, c in order, order.get(c), vifs.get(c)) for c in cols]
    return df.sparkSession.createDataFrame(rows, "column string, dropped boolean, order int, vif double")


def multicollinearity(df: DataFrame, cols: list[str], corr_threshold: float = 0.9, vif_threshold: float = 10.0,
                      protected_prefix: str = "Material type_") -> list[str]:
    """F6 -> F7 -> F8; returns the surviving unprotected columns."""
    hc = {r["column"] for r in high_correlation(df, cols, corr_threshold, protected_prefix)
          .where("dropped").collect()}
    left = [c for c in cols if c not in hc and not c.startswith(protected_prefix)]
    zv = set(zero_variance(df, left)) if left else set()
    left = [c for c in left if c not in zv]
    if len(left) < 2:
        return left
    hv = {r["column"] for r in high_vif(df, left, vif_threshold).where("dropped").collect()}
    return [c for c in left if c not in hv]
