"""Density clustering on cosine distance.

DBSCAN is decomposed into distributed steps: a blocked neighbour count
(core rows), a second blocked pass that emits core-core connectivity as a
spanning star forest per block plus the bounded (border, core) pairs, then
connected components on the core graph.  Cluster ids follow the classic
sequential numbering (clusters ordered by their lowest core id; a border row
joins the lowest such cluster among its core neighbours), reproduced
order-free with ``min``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import blocks
from ..plans.ranking import exact_quantile_value, with_index
from ..plans.session import cut_lineage
from .similarity import _block_plan, equal_rows, k_distance, pairs_within


def estimate_eps(df: DataFrame, min_samples: int = 3, quantile: float = 0.98, id_col: str = "id",
                 vec: str = "x") -> float:
    """G1: quantile (linear) of the k-distances, rounded to 9 places."""
    # its quantile takes several passes
    return eps_of(cut_lineage(k_distance(df, min_samples, id_col, vec)), quantile)


def eps_of(kd: DataFrame, quantile: float = 0.98) -> float:
    """G1 on known k-distances."""
    v = exact_quantile_value(kd, "kdist", quantile)
    return round(float(v), 9) if v is not None else 0.0


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", nodes: DataFrame | None = None,
                         node_col: str = "id") -> DataFrame:
    """``id, component`` (component = smallest id of the component).

    Alternating large-star / small-star rounds (Kiveris et al. 2014) on the
    canonical edge set, lineage cut by a reliable checkpoint every round.
    Every step is a grouped ``min`` plus an equi-join, so a hub node is a
    hot aggregate key (map-side combined) and a skewed join side (AQE skew
    join), never a collected list.  Stops when the edges form stars centred
    on their minimum: no leaf has two centres and no centre is a leaf.
    """
    e = (edges.select(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b"))
              .where(F.col("a") != F.col("b")).distinct())
    e = cut_lineage(e)
    while True:
        nbr = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        m = nbr.groupBy("u").agg(F.min("v").alias("mv")).select("u", F.least("u", "mv").alias("m"))
        large = (nbr.where(F.col("v") > F.col("u")).join(m, "u")
                    .select(F.least("v", "m").alias("a"), F.greatest("v", "m").alias("b"))
                    .where(F.col("a") != F.col("b")).distinct())
        m2 = large.groupBy("b").agg(F.min("a").alias("m"))
        j = large.join(m2, "b")
        small = (j.select(F.least("a", "m").alias("a"), F.greatest("a", "m").alias("b"))
                  .unionByName(j.select(F.col("m").alias("a"), F.col("b")))
                  .where(F.col("a") != F.col("b")).distinct())
        e = cut_lineage(small)
        multi = e.groupBy("b").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > 1).select("b")
        chain = e.select(F.col("a").alias("b")).join(e.select("b"), "b").select("b")
        if multi.unionByName(chain).limit(1).count() == 0:     # one job: stars centred on minima
            break
    labels = e.select(F.col("b").alias(node_col), F.col("a").alias("component")).unionByName(
        e.select(F.col("a").alias(node_col), F.col("a").alias("component"))).distinct()
    if nodes is not None:
        n = nodes.select(F.col(node_col)).distinct()
        labels = n.join(labels, node_col, "left").select(node_col, F.coalesce("component", F.col(node_col))
                                                         .alias("component"))
    return labels


def dbscan(df: DataFrame, eps: float, min_samples: int = 3, id_col: str = "id", vec: str = "x",
           block_rows: int | None = None, kdist: DataFrame | None = None) -> DataFrame:
    """``id, cluster, is_core`` (noise = -1) with cosine distance <= eps
    and ``min_samples`` counting the row itself.

    A row is core exactly if its k-distance (A2, same ``min_samples``) is at
    most ``eps``: pass ``kdist`` where it is known already.  Rows meet only
    the cells in reach of ``eps`` (:mod:`..plans.cells`).
    """
    t = df.select(F.col(id_col).cast("long").alias("_id"), F.col(vec).cast("array<double>").alias("_x"))
    if min_samples < 2:
        core = t.select("_id", F.lit(True).alias("_core"))
    else:
        kd = k_distance(t, min_samples, "_id", "_x", block_rows) if kdist is None else kdist.withColumnRenamed(id_col, "_id")
        core = kd.select("_id", (F.col("kdist") <= eps).alias("_core"))
    tc = t.join(core, "_id", "left").withColumn("_core", F.coalesce("_core", F.lit(False)))
    # equal rows have one k-distance and one cluster: the row with the smallest id stands for them
    classes = equal_rows(t, "_id", "_x", 1)
    if classes is not None:
        tc = tc.join(classes[0].select("_id"), "_id", "left_semi")
    tc = cut_lineage(tc)
    edges = pairs_within(tc, eps, "_id", "_x", blocks.dbscan_edge_kernel(eps, "_id", "_id", "_x", "_x", "_core", "_core"),
                         "a long, b long, kind string", block_rows)
    edges = cut_lineage(edges.distinct())
    core_nodes = tc.where("_core").select(F.col("_id").alias("id"))
    comp = connected_components(edges.where(F.col("kind") == "c").select(F.col("a").alias("src"),
                                                                          F.col("b").alias("dst")),
                                nodes=core_nodes, node_col="id")
    border = (edges.where(F.col("kind") == "b")
                   .join(comp.select(F.col("id").alias("b"), "component"), "b")
                   .groupBy(F.col("a").alias("id")).agg(F.min("component").alias("component")))
    labelled = comp.unionByName(border)
    order = with_index(labelled.select("component").distinct(), ["component"], out="cluster")
    lab = labelled.join(order, "component").select("id", F.col("cluster").cast("int").alias("cluster"))
    out = (tc.select(F.col("_id").alias("id"), F.col("_core").alias("is_core")).join(lab, "id", "left")
             .select(F.col("id").alias("_first"), F.coalesce("cluster", F.lit(-1)).alias("cluster"), "is_core"))
    if classes is None:
        return out.withColumnRenamed("_first", id_col)
    return classes[1].join(out, "_first").select(F.col("_id").alias(id_col), "cluster", "is_core")


def cluster_counts(clustered: DataFrame, cluster_col: str = "cluster") -> DataFrame:
    """A4: ``cluster, size`` (noise is cluster -1)."""
    return clustered.groupBy(cluster_col).agg(F.count(F.lit(1)).alias("size"))


def cluster_summary(clustered: DataFrame, cluster_col: str = "cluster") -> DataFrame:
    """A4: one row ``n_clusters, n_noise``."""
    return clustered.agg(F.count_distinct(F.when(F.col(cluster_col) != -1, F.col(cluster_col))).alias("n_clusters"),
                         F.count_if(F.col(cluster_col) == -1).alias("n_noise"))


def dominant_category(df: DataFrame, cluster_col: str, category_col: str) -> DataFrame:
    """A3: per cluster (noise skipped) the most frequent category, first in
    sorted order on ties: ``cluster, category, share``."""
    c = (df.where(F.col(cluster_col) != -1).groupBy(cluster_col, category_col)
           .agg(F.count(F.lit(1)).alias("n")))
    tot = c.groupBy(cluster_col).agg(F.sum("n").alias("tot"))
    best = (c.groupBy(cluster_col).agg(F.max("n").alias("n"))
              .join(c, [cluster_col, "n"]).groupBy(cluster_col, "n")
              .agg(F.min(category_col).alias("category")))
    return best.join(tot, cluster_col).select(cluster_col, "category", (F.col("n") / F.col("tot")).alias("share"))


def _euclid_kernel(left_id, right_id, vec, right_cluster):
    import numpy as np
    import pandas as pd

    def fn(lpdf, rpdf, mirror=False):
        if len(lpdf) == 0 or len(rpdf) == 0:
            return pd.DataFrame({"lid": pd.Series([], dtype="int64"), "rc": pd.Series([], dtype="int64"),
                                 "s": pd.Series([], dtype="float64"), "n": pd.Series([], dtype="int64")})
        a = blocks.stack_vectors(lpdf[vec])
        b = blocks.stack_vectors(rpdf[vec])
        rc = rpdf[right_cluster].to_numpy(dtype=np.int64)
        order = np.argsort(rc, kind="stable")
        b = b[order]
        which, starts, sizes = np.unique(rc[order], return_index=True, return_counts=True)
        lids, bb = lpdf[left_id].to_numpy(dtype=np.int64), np.einsum("ij,ij->i", b, b)
        out = []
        for t in blocks._tiles(len(a), len(b)):
            d = np.sqrt(np.maximum(np.einsum("ij,ij->i", a[t], a[t])[:, None] + bb[None, :] - 2 * a[t] @ b.T, 0.0))
            s = np.add.reduceat(d, starts, axis=1)
            out.append(pd.DataFrame({"lid": np.repeat(lids[t], len(which)), "rc": np.tile(which, len(s)), "s": s.reshape(-1),
                                     "n": np.tile(sizes, len(s))}))
        return pd.concat(out, ignore_index=True)

    return fn


def cluster_quality(df: DataFrame, id_col: str = "id", vec: str = "x", cluster_col: str = "cluster") -> DataFrame:
    """G6 (Euclidean, noise rows excluded, needs >= 2 clusters): one row
    ``silhouette, davies_bouldin, calinski_harabasz``.

    Davies-Bouldin and Calinski-Harabasz need only centroids (grouped
    averages over exploded vectors).  The exact silhouette needs every
    pair's distance: blocked kernels emit per (row, other cluster) distance
    sums, aggregated without materialising pairs.
    """
    d = df.where(F.col(cluster_col) != -1).select(F.col(id_col).cast("long").alias("_id"),
                                                  F.col(vec).cast("array<double>").alias("_x"),
                                                  F.col(cluster_col).cast("long").alias("_c"))
    if d.select("_c").distinct().limit(2).count() < 2:       # undefined for one cluster: no row
        return df.sparkSession.createDataFrame([], "silhouette double, davies_bouldin double, calinski_harabasz double")
    flat = d.select("_id", "_c", F.posexplode("_x").alias("p", "v"))
    cent = flat.groupBy("_c", "p").agg(F.avg("v").alias("cv"))
    gcent = flat.groupBy("p").agg(F.avg("v").alias("gv"))
    sizes = d.groupBy("_c").agg(F.count(F.lit(1)).alias("nc"))
    # within-cluster: distance of each row to its centroid
    dist_row = (flat.join(cent, ["_c", "p"]).groupBy("_id", "_c")
                    .agg(F.sum((F.col("v") - F.col("cv")) ** 2).alias("sq")))
    scatter = dist_row.groupBy("_c").agg(F.avg(F.sqrt("sq")).alias("s_i"), F.sum("sq").alias("wss"))
    cc = (cent.alias("x").join(cent.alias("y"), F.col("x.p") == F.col("y.p"))
              .where(F.col("x._c") != F.col("y._c"))
              .groupBy(F.col("x._c").alias("ci"), F.col("y._c").alias("cj"))
              .agg(F.sqrt(F.sum((F.col("x.cv") - F.col("y.cv")) ** 2)).alias("dij")))
    si = scatter.select(F.col("_c").alias("ci"), F.col("s_i").alias("si"))
    sj = scatter.select(F.col("_c").alias("cj"), F.col("s_i").alias("sj"))
    db = (cc.join(si, "ci").join(sj, "cj").groupBy("ci")
            .agg(F.max((F.col("si") + F.col("sj")) / F.col("dij")).alias("r"))
            .agg(F.avg("r").alias("davies_bouldin")))
    bss = (cent.join(gcent, "p").groupBy("_c").agg(F.sum((F.col("cv") - F.col("gv")) ** 2).alias("b"))
               .join(sizes, "_c").agg(F.sum(F.col("b") * F.col("nc")).alias("bss"), F.count(F.lit(1)).alias("k")))
    wss = scatter.agg(F.sum("wss").alias("wss"))
    n = d.agg(F.count(F.lit(1)).alias("n"))
    ch = bss.crossJoin(wss).crossJoin(n).select(
        (F.col("bss") / (F.col("k") - 1) / (F.col("wss") / (F.col("n") - F.col("k")))).alias("calinski_harabasz"))
    b, nn = _block_plan(d, d)
    sums = blocks.cogroup_blocks(d, d, "_id", "_id", _euclid_kernel("_id", "_id", "_x", "_c"),
                                 "lid long, rc long, s double, n long", block_rows=b, counts=nn)
    per = sums.groupBy("lid", "rc").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    own = d.select(F.col("_id").alias("lid"), F.col("_c").alias("oc"))
    pj = per.join(own, "lid")
    a = pj.where(F.col("rc") == F.col("oc")).select("lid", F.when(F.col("n") > 1, F.col("s") / (F.col("n") - 1))
                                                     .alias("a"), F.col("n").alias("own_n"))
    bb = pj.where(F.col("rc") != F.col("oc")).groupBy("lid").agg(F.min(F.col("s") / F.col("n")).alias("b"))
    sil = a.join(bb, "lid").select(F.when(F.col("own_n") <= 1, F.lit(0.0)).otherwise(
        (F.col("b") - F.col("a")) / F.greatest("a", "b")).alias("s")).agg(F.avg("s").alias("silhouette"))
    return sil.crossJoin(db).crossJoin(ch)
