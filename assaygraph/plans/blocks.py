"""Blocked pairwise work for all-pairs operators (k-NN, radius joins, DBSCAN).

Rows of each side are hashed into blocks of bounded size (per key when the
pairs must share a key, e.g. a cluster id).  Every (left block, right block)
pair becomes one cogroup handled by a vectorised numpy kernel through
``cogroup().applyInPandas``, so a task holds at most ``block_rows`` rows of
each side however large the table or the hottest key is.  The work is still
quadratic - exact all-pairs similarity is - but it is spread over
``blocks_left x blocks_right`` independent tasks and only each kernel's small
result (top-k rows, counts, forest edges) is shuffled onward.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_BLOCK_ROWS = 2048
#: Rows of a block where all pairs have to meet: a row is copied once for each block of the other side.
MAX_BLOCK_ROWS = 16_384
#: Distances that a kernel holds at a time.
_TILE = 2_000_000


def unit_rows(mat: np.ndarray) -> np.ndarray:
    """Row-normalise; a zero row stays zero, so its cosine distance is 1."""
    norms = np.sqrt(np.einsum("ij,ij->i", mat, mat))
    safe = np.where(norms > 0, norms, 1.0)
    return mat / safe[:, None]


def stack_vectors(series: pd.Series, dim: int | None = None) -> np.ndarray:
    if len(series) == 0:
        return np.zeros((0, dim or 0))
    return np.vstack([np.asarray(v, dtype=np.float64) for v in series.to_numpy()])


def cosine_block(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine distances rounded to 9 places, clipped at +0.0."""
    d = 1.0 - unit_rows(a) @ unit_rows(b).T
    d = np.round(d, 9)
    return np.where(d <= 0.0, 0.0, d)


def _pairs_near(a: np.ndarray, b: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and cosine distances (rounded to 9 places) of the pairs of unit rows within ``eps``.

    Single precision, with what it may be wrong by, leaves few pairs to be judged in double precision."""
    cos = a.astype(np.float32) @ b.astype(np.float32).T
    rows, cols = np.nonzero(cos >= np.float32(1.0 - eps - (a.shape[1] + 16) * 2.0 ** -22))
    if 8 * len(rows) > cos.size:
        d = np.round(1.0 - a @ b.T, 9)
        rows, cols = np.nonzero(d <= eps)
        d = d[rows, cols]
    else:
        d = np.empty(len(rows))
        for at in range(0, len(rows), 1 << 16):
            some = slice(at, at + (1 << 16))
            d[some] = np.round(1.0 - np.einsum("ij,ij->i", a[rows[some]], b[cols[some]]), 9)
    d = np.where(d <= 0.0, 0.0, d)
    near = d <= eps
    return rows[near], cols[near], d[near]


def _tiles(n: int, width: int):
    """Slices of ``n`` rows with about ``_TILE`` distances to ``width`` others each."""
    step = max(1, _TILE // max(width, 1))
    return (slice(at, at + step) for at in range(0, n, step))


def cogroup_blocks(left: DataFrame, right: DataFrame, left_id: str, right_id: str, fn, schema: str,
                   key: str | None = None, block_rows: int = DEFAULT_BLOCK_ROWS,
                   counts: tuple[int, int] | None = None, symmetric: bool = False) -> DataFrame:
    """Run ``fn(left_pdf, right_pdf, mirror)`` on every block pair sharing ``key``.

    Without a key the block counts are literals from the two row counts;
    with a key they come from a grouped count (one row per key) joined back,
    so a hot key simply gets more blocks.

    ``symmetric=True`` (both sides are the same rows, the distance is
    symmetric) forms only the block pairs lb <= rb: every row is copied
    B + 1 times instead of 2B and half of the distance blocks are computed;
    off-diagonal kernels are called with ``mirror=True`` and report results
    for the rows of both sides from one distance matrix.
    """
    # fresh attribute ids per side: both sides are often the same DataFrame
    left = left.select(*[F.col(c).alias(c) for c in left.columns])
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    if key is None:
        nl, nr = counts if counts is not None else (left.count(), right.count())
        bl, br = max(1, -(-nl // block_rows)), max(1, -(-nr // block_rows))
        if symmetric:
            bl = br = max(bl, br)
        left = left.withColumn("_k", F.lit(0)).withColumn("_bl", F.lit(bl)).withColumn("_br", F.lit(br))
        right = right.withColumn("_k", F.lit(0)).withColumn("_bl", F.lit(bl)).withColumn("_br", F.lit(br))
        kcol = "_k"
    else:
        kcol = key
        nls = left.groupBy(kcol).agg(F.count(F.lit(1)).alias("_nl"))
        nrs = right.groupBy(kcol).agg(F.count(F.lit(1)).alias("_nr"))
        sizes = (nls.join(nrs, kcol)
                    .select(kcol,
                            F.ceil(F.col("_nl") / F.lit(block_rows)).cast("int").alias("_bl"),
                            F.ceil(F.col("_nr") / F.lit(block_rows)).cast("int").alias("_br")))
        if symmetric:
            sizes = sizes.withColumn("_bl", F.greatest("_bl", "_br")).withColumn("_br", F.col("_bl"))
        left = left.join(sizes, kcol)
        right = right.join(sizes, kcol)
    lb = F.pmod(F.xxhash64(F.col(left_id)), F.col("_bl")).cast("int")
    rb = F.pmod(F.xxhash64(F.col(right_id)), F.col("_br")).cast("int")
    if symmetric:
        lrep = left.withColumn("_lb", lb).withColumn("_rb", F.explode(F.sequence(F.col("_lb"), F.col("_br") - 1)))
        rrep = right.withColumn("_rb", rb).withColumn("_lb", F.explode(F.sequence(F.lit(0), F.col("_rb"))))
    else:
        lrep = left.withColumn("_lb", lb).withColumn("_rb", F.explode(F.sequence(F.lit(0), F.col("_br") - 1)))
        rrep = right.withColumn("_rb", rb).withColumn("_lb", F.explode(F.sequence(F.lit(0), F.col("_bl") - 1)))
    lrep, rrep = lrep.drop("_bl", "_br"), rrep.drop("_bl", "_br")

    def run(key_values, lpdf, rpdf):
        return fn(lpdf, rpdf, symmetric and key_values[1] != key_values[2])

    return (lrep.groupBy(kcol, "_lb", "_rb")
                .cogroup(rrep.groupBy(kcol, "_lb", "_rb"))
                .applyInPandas(run, schema))


#: Rows of a part of a block, on average.
_PART_ROWS = 128
#: Cosine distances count as equal within half of this (they are rounded to 9 places).
ROUNDED = 1e-9
_SLACK = 1e-6


def beyond(d: np.ndarray, own: np.ndarray, between: np.ndarray) -> np.ndarray:
    """What lies at least between rows and the rows nearest to another centre: the way to the plane half-way to it.

    ``d``: distances of the rows to all centres, ``own``: to one of them, ``between``: from that one to all centres."""
    far = np.where(between > 1e-6, 2.0 * between, np.inf)
    return (d * d - (own * own)[:, None]) / far


class _Parts:
    """Unit rows in parts around some of them: what a row need not be compared with inside a block.

    As between cells (:mod:`.cells`): a part that lies farther from a row than the row's bound, by its
    radius or by the plane half-way to its centre, holds nothing for it.  Rows with a missing number are in no part.
    """

    def __init__(self, y: np.ndarray):
        self.y, whole = y, np.flatnonzero(np.isfinite(y).all(axis=1))
        n = -(-len(whole) // _PART_ROWS)
        self.pivots = y[whole[np.linspace(0, len(whole) - 1, n).astype(int)]] if n else y[:0]
        part = self.place(y[whole])
        order = np.argsort(part, kind="stable")
        self.rows = whole[order]
        self.cut = np.searchsorted(part[order], np.arange(n + 1))
        self.size = np.diff(self.cut)
        self.radius = np.zeros(n)
        self.zero = np.zeros(n, bool)                                  # parts with zero vectors
        self.zero[part[~y[whole].any(axis=1)]] = True
        for t in _tiles(len(whole), n):
            np.maximum.at(self.radius, part[t], self.distances(y[whole[t]])[np.arange(len(part[t])), part[t]])

    def place(self, x: np.ndarray) -> np.ndarray:
        out = [(x[t] @ self.pivots.T).argmax(axis=1) for t in _tiles(len(x), len(self.pivots))] if len(self.pivots) else []
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def distances(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(2.0 - 2.0 * (x @ self.pivots.T), 0.0))

    def groups(self, x: np.ndarray):
        """Rows of ``x`` that lie near one pivot, a few at a time: the pivot and the rows' numbers."""
        if not len(self.pivots) or not len(x):
            return
        whole = np.flatnonzero(np.isfinite(x).all(axis=1))
        near = self.place(x[whole])
        order = np.argsort(near, kind="stable")
        at = np.searchsorted(near[order], np.arange(len(self.pivots) + 1))
        for p in range(len(self.pivots)):
            rows = whole[order[at[p]:at[p + 1]]]
            for i in range(0, len(rows), 2 * _PART_ROWS):
                yield p, rows[i:i + 2 * _PART_ROWS]

    def members(self, parts: np.ndarray) -> np.ndarray:
        """Numbers of the rows of ``parts``; of all rows in their order, where these parts are most of them."""
        if 2 * int(self.size[parts].sum()) > len(self.y):
            return np.arange(len(self.y))
        return np.concatenate([self.rows[self.cut[p]:self.cut[p + 1]] for p in parts.tolist()] or [self.rows[:0]])

    def within(self, x: np.ndarray, pivot: int, cap: np.ndarray | float) -> np.ndarray:
        """Parts that may hold a row within the cosine distance ``cap`` of one of the rows ``x`` near ``pivot``."""
        d, reach = self.distances(x), np.sqrt(2.0 * (np.minimum(cap, 2.0) + 2 * ROUNDED)) + _SLACK
        least = np.maximum(d - self.radius[None, :], beyond(d, d[:, pivot], self.distances(self.pivots[pivot:pivot + 1])))
        least[~x.any(axis=1)] = 0.0                                    # zero vectors have no place
        near = least <= (reach[:, None] if isinstance(reach, np.ndarray) else reach)
        return np.flatnonzero((near.any(axis=0) | self.zero) & (self.size > 0))

    def first(self, pivot: int, least: int) -> np.ndarray:
        """The parts nearest to a pivot that have ``least`` rows together (or all)."""
        order = np.argsort(-(self.pivots @ self.pivots[pivot]), kind="stable")
        return order[:int(np.searchsorted(np.cumsum(self.size[order]), least)) + 1]


def _topk_parts(x: np.ndarray, xids: np.ndarray, y: np.ndarray, yids: np.ndarray, k: int, exclude_self: bool):
    """Per row of ``x`` its k nearest of ``y``: nearest parts first, then those within the k-th distance found there."""
    parts, out = _Parts(y), []

    def distances(rows, cols):
        d = x[rows] @ (y if len(cols) == len(y) else y[cols]).T
        np.subtract(1.0, d, out=d)
        if exclude_self:
            d[xids[rows][:, None] == yids[cols][None, :]] = np.inf
        return d

    groups, spared = parts.groups(x), 0
    for n, (pivot, rows) in enumerate(groups, 1):
        cols = parts.members(parts.first(pivot, max(_PART_ROWS, 4 * k)))
        d = distances(rows, cols)
        kth = np.partition(d, k - 1, axis=1)[:, k - 1] if len(cols) >= k else np.full(len(rows), np.inf)
        cols = parts.members(parts.within(x[rows], pivot, kth))
        for t in _tiles(len(rows), len(cols)):
            if len(cols):
                out.append(_topk_rows(distances(rows[t], cols), xids[rows[t]], yids[cols], k))
        spared += len(cols) < len(y)
        if n == 4 and not spared:                   # nothing is out of reach: the other rows meet all at once
            rest, cols = np.concatenate([rows[:0], *(r for _, r in groups)]), np.arange(len(y))
            out += [_topk_rows(distances(rest[t], cols), xids[rest[t]], yids, k) for t in _tiles(len(rest), len(y)) if len(rest[t])]
    return out


def _topk_rows(d: np.ndarray, lids: np.ndarray, rids: np.ndarray, k: int):
    """Row-wise k smallest of ``d`` by (distance rounded to 9 places, id).

    Selection runs on raw distances (one ``np.partition``); only the few
    candidates within 2e-9 of each row's k-th distance are rounded and
    ordered exactly - the same order as rounding everything first.
    """
    kk = min(k, d.shape[1])
    kth = np.partition(d, kk - 1, axis=1)[:, kk - 1]
    rows, cols = np.nonzero(d <= (kth + 2e-9)[:, None])
    dist = d[rows, cols]
    ok = np.isfinite(dist)
    rows, cols, dist = rows[ok], cols[ok], np.round(dist[ok], 9)
    dist = np.where(dist <= 0.0, 0.0, dist)
    order = np.lexsort((rids[cols], dist, rows))
    rows, cols, dist = rows[order], cols[order], dist[order]
    first = np.searchsorted(rows, rows, side="left")
    keep = (np.arange(len(rows)) - first) < kk
    return lids[rows[keep]], rids[cols[keep]], dist[keep]


def topk_kernel(k: int, left_id: str, right_id: str, left_vec: str, right_vec: str, exclude_self: bool):
    """Per left row (and per right row when mirrored) the k nearest rows of
    the other block by (dist, id)."""

    def fn(lpdf: pd.DataFrame, rpdf: pd.DataFrame, mirror: bool = False) -> pd.DataFrame:
        if len(lpdf) == 0 or len(rpdf) == 0:
            return pd.DataFrame({"lid": pd.Series([], dtype="int64"), "rid": pd.Series([], dtype="int64"),
                                 "dist": pd.Series([], dtype="float64")})
        lids = lpdf[left_id].to_numpy(dtype=np.int64)
        rids = rpdf[right_id].to_numpy(dtype=np.int64)
        lx, rx = unit_rows(stack_vectors(lpdf[left_vec])), unit_rows(stack_vectors(rpdf[right_vec]))
        parts = [(lids[:0], rids[:0], np.zeros(0))]
        for x, xids, y, yids in ((lx, lids, rx, rids), (rx, rids, lx, lids))[:2 if mirror else 1]:
            parts += _topk_parts(x, xids, y, yids, k, exclude_self)
        a, b, dist = (np.concatenate(c) for c in zip(*parts))
        return pd.DataFrame({"lid": a, "rid": b, "dist": dist})

    return fn


def small_keys_topk(left: DataFrame, right: DataFrame, k: int, key: str, left_id: str, right_id: str, left_vec: str,
                    right_vec: str, exclude_self: bool, bucket_rows: int = MAX_BLOCK_ROWS) -> DataFrame:
    """``lid, rid, dist``: the k nearest of each left row among the right rows of its ``key``, for keys of bounded size.

    Many keys share a bucket, and so a call of the kernel."""
    left, right = left.where(F.col(key).isNotNull()), right.where(F.col(key).isNotNull())
    n = max(1, -(-(left.count() + right.count()) // bucket_rows))
    bucket = F.pmod(F.xxhash64(key), F.lit(n)).alias("_bucket")

    def fn(lpdf: pd.DataFrame, rpdf: pd.DataFrame) -> pd.DataFrame:
        code = pd.factorize(pd.concat([lpdf[key], rpdf[key]], ignore_index=True))[0]
        lc, rc = code[:len(lpdf)], code[len(lpdf):]
        lo, ro = np.argsort(lc, kind="stable"), np.argsort(rc, kind="stable")
        lids, rids = lpdf[left_id].to_numpy(dtype=np.int64)[lo], rpdf[right_id].to_numpy(dtype=np.int64)[ro]
        out = [(lids[:0], rids[:0], np.zeros(0))]
        if len(lo) and len(ro):
            lx, rx = unit_rows(stack_vectors(lpdf[left_vec]))[lo], unit_rows(stack_vectors(rpdf[right_vec]))[ro]
            lc, rc = lc[lo], rc[ro]
            for c in np.unique(lc).tolist():
                a = slice(*np.searchsorted(lc, (c, c + 1)))
                b = slice(*np.searchsorted(rc, (c, c + 1)))
                if b.start == b.stop:
                    continue
                if (a.stop - a.start) * (b.stop - b.start) > 64 * _PART_ROWS ** 2:
                    out += _topk_parts(lx[a], lids[a], rx[b], rids[b], k, exclude_self)
                    continue
                d = 1.0 - lx[a] @ rx[b].T
                if exclude_self:
                    d[lids[a][:, None] == rids[b][None, :]] = np.inf
                out.append(_topk_rows(d, lids[a], rids[b], k))
        a, b, dist = (np.concatenate(c) for c in zip(*out))
        return pd.DataFrame({"lid": a, "rid": b, "dist": dist})

    return (left.select("*", bucket).groupBy("_bucket").cogroup(right.select("*", bucket).groupBy("_bucket"))
                .applyInPandas(fn, "lid long, rid long, dist double"))


def radius_count_kernel(eps: float, left_id: str, right_id: str, left_vec: str, right_vec: str,
                        right_weight: str | None = None):
    """Per left row, the number of right rows within ``eps`` (self included); a row may stand for several
    (``right_weight``: a column of the right rows, and of the left ones when mirrored)."""

    def fn(lpdf: pd.DataFrame, rpdf: pd.DataFrame, mirror: bool = False) -> pd.DataFrame:
        if len(lpdf) == 0 or len(rpdf) == 0:
            return pd.DataFrame({"lid": pd.Series([], dtype="int64"), "cnt": pd.Series([], dtype="int64")})
        def weights(pdf):
            return np.ones(len(pdf), np.int64) if right_weight is None else pdf[right_weight].to_numpy(dtype=np.int64)

        lx, rx, rw = stack_vectors(lpdf[left_vec]), stack_vectors(rpdf[right_vec]), weights(rpdf)
        lw = weights(lpdf) if mirror else None
        lx, rx = unit_rows(lx), unit_rows(rx)
        n, back = np.zeros(len(lx), np.int64), np.zeros(len(rx), np.int64)
        for t in _tiles(len(lx), len(rx)):
            rows, cols, _ = _pairs_near(lx[t], rx, eps)
            np.add.at(n[t], rows, rw[cols])
            if mirror:
                np.add.at(back, cols, lw[t][rows])
        out = pd.DataFrame({"lid": lpdf[left_id].to_numpy(dtype=np.int64), "cnt": n})
        if mirror:
            out = pd.concat([out, pd.DataFrame({"lid": rpdf[right_id].to_numpy(dtype=np.int64), "cnt": back})],
                            ignore_index=True)
        return out

    return fn


def radius_pairs_kernel(eps: float, left_id: str, right_id: str, left_vec: str, right_vec: str):
    """All pairs with lid < rid within ``eps`` (the plain radius join)."""

    def fn(lpdf: pd.DataFrame, rpdf: pd.DataFrame, mirror: bool = False) -> pd.DataFrame:
        if len(lpdf) == 0 or len(rpdf) == 0:
            return pd.DataFrame({"lid": pd.Series([], dtype="int64"), "rid": pd.Series([], dtype="int64"),
                                 "dist": pd.Series([], dtype="float64")})
        lids = lpdf[left_id].to_numpy(dtype=np.int64)
        rids = rpdf[right_id].to_numpy(dtype=np.int64)
        lx, rx = unit_rows(stack_vectors(lpdf[left_vec])), unit_rows(stack_vectors(rpdf[right_vec]))
        parts = []
        for t in _tiles(len(lx), len(rx)):
            rows, cols, d = _pairs_near(lx[t], rx, eps)
            a, b = lids[t][rows], rids[cols]
            # off-diagonal symmetric block: each unordered pair occurs here only
            keep = slice(None) if mirror else a < b
            parts.append((np.minimum(a, b)[keep], np.maximum(a, b)[keep], d[keep]))
        return pd.DataFrame(dict(zip(("lid", "rid", "dist"), (np.concatenate(c) for c in zip(*parts)))))

    return fn


def _links(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of some entries of ``near`` that connect all that its entries connect.

    One entry for each row and column first; of the others only those that join two parts.
    """
    rows, cols = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
    if not len(rows):
        return rows, cols
    a = np.concatenate((rows, near[:, cols].argmax(axis=0)))
    b = np.concatenate((near[rows].argmax(axis=1), cols))
    lab = np.arange(sum(near.shape))
    low, member = _star_forest(a, b + near.shape[0])
    lab[member] = low
    more = np.nonzero(near & (lab[:near.shape[0], None] != lab[None, near.shape[0]:]))
    return np.concatenate((a, more[0])), np.concatenate((b, more[1]))


def _star_forest(a, b):
    """Star edges (component min, member) of an edge list."""
    uniq, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    ia, ib = inv[:len(a)], inv[len(a):]
    lab = np.arange(len(uniq))
    while True:                                   # labels only fall, so this ends
        low = np.minimum(lab[ia], lab[ib])
        new = lab.copy()
        for at in (ia, ib, lab[ia], lab[ib]):     # a label's own row falls with it: few rounds on long paths
            np.minimum.at(new, at, low)
        new = new[new]
        if np.array_equal(new, lab):
            sel = lab != np.arange(len(uniq))
            return uniq[lab[sel]], uniq[sel]
        lab = new


def dbscan_edge_kernel(eps: float, left_id: str, right_id: str, left_vec: str, right_vec: str,
                       left_core: str, right_core: str):
    """Core-core connectivity edges and (border, core) pairs of a block pair.

    A border row has fewer than ``min_samples`` neighbours, so its pairs are
    bounded; core-core links are reduced to a spanning star forest when a
    block is dense, keeping the shuffled edge count linear in the block size.
    """

    def fn(lpdf: pd.DataFrame, rpdf: pd.DataFrame, mirror: bool = False) -> pd.DataFrame:
        empty = pd.DataFrame({"a": pd.Series([], dtype="int64"), "b": pd.Series([], dtype="int64"),
                              "kind": pd.Series([], dtype="object")})
        if len(lpdf) == 0 or len(rpdf) == 0:
            return empty
        lids = lpdf[left_id].to_numpy(dtype=np.int64)
        rids = rpdf[right_id].to_numpy(dtype=np.int64)
        lcore = lpdf[left_core].to_numpy(dtype=bool)
        rcore = rpdf[right_core].to_numpy(dtype=bool)
        lx, rx = stack_vectors(lpdf[left_vec]), stack_vectors(rpdf[right_vec])
        lx, rx = unit_rows(lx), unit_rows(rx)
        parts, stars, held = [], [(lids[:0], rids[:0])], _Parts(rx)
        for pivot, some in held.groups(lx):
            cols = held.members(held.within(lx[some], pivot, eps))
            for t in _tiles(len(some), len(cols)):
                at = some[t]
                d = np.round(1.0 - lx[at] @ (rx if len(cols) == len(rx) else rx[cols]).T, 9)
                near = np.where(d <= 0.0, 0.0, d) <= eps
                core, ids, far = lcore[at], lids[at], rcore[cols]
                i, j = _links(near[np.ix_(core, far)])
                stars.append((ids[core][i], rids[cols][far][j]))
                rows, to = np.nonzero(near[np.ix_(~core, far)])
                parts.append(pd.DataFrame({"a": ids[~core][rows], "b": rids[cols][far][to], "kind": "b"}))
                if mirror:  # border rows of the right block with core rows of the left block
                    rows, to = np.nonzero(near[np.ix_(core, ~far)])
                    parts.append(pd.DataFrame({"a": rids[cols][~far][to], "b": ids[core][rows], "kind": "b"}))
        a, b = _star_forest(*(np.concatenate(c) for c in zip(*stars)))
        parts.append(pd.DataFrame({"a": a, "b": b, "kind": "c"}))
        out = pd.concat(parts, ignore_index=True)
        return out if len(out) else empty

    return fn
