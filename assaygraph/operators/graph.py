"""Similarity graph construction and propagation.

A graph is two DataFrames: ``nodes(node_id, ...)`` and ``edges(src, dst)``
stored once per undirected pair with src < dst and symmetrised on use.
Message passing is a join of edges with node states followed by a grouped
aggregate per destination (softmax = max, exp, sum), so a hub node is a hot
aggregate key, not a collected neighbour list.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ranking import with_index
from ..plans.session import cut_lineage
from . import cluster as CL
from . import similarity as SIM


def distinct_edges(pairs: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """A5: canonical (min, max) pairs without self loops, distinct."""
    return (pairs.select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst"))
                 .where(F.col("src") != F.col("dst")).distinct())


def intra_cluster_knn(df: DataFrame, k: int = 5, id_col: str = "id", vec: str = "x",
                      cluster_col: str = "cluster") -> DataFrame:
    """Per cluster, each row's min(k, size - 1) nearest *other* rows
    (self excluded by id), as undirected distinct edges; noise (-1) skipped.

    Pairs are only formed inside a cluster; a large cluster is split into
    more blocks instead of landing in one task.
    """
    rows = df.where(F.col(cluster_col) != -1)
    nb = SIM.knn(rows, rows, k=k, q_id=id_col, r_id=id_col, vec=vec, exclude_self=True, key=cluster_col)
    return distinct_edges(nb, "query_id", "neighbor_id")


def relabel_dense(nodes: DataFrame, id_col: str = "id", out: str = "node_id") -> DataFrame:
    """Node ids 0..n-1 in id order (skew-safe global ranking)."""
    return with_index(nodes, [id_col], out=out)


def graph_stats(nodes: DataFrame, edges: DataFrame, id_col: str = "node_id") -> DataFrame:
    """``n_nodes, n_edges, n_isolated, max_degree, mean_degree``."""
    sym = edges.select(F.col("src").alias("n")).unionAll(edges.select(F.col("dst").alias("n")))
    deg = nodes.select(F.col(id_col).alias("n")).join(sym.groupBy("n").agg(F.count(F.lit(1)).alias("d")), "n", "left")
    return deg.agg(F.count(F.lit(1)).alias("n_nodes"),
                   F.coalesce(F.sum("d"), F.lit(0)).cast("long").alias("_twice"),
                   F.count_if(F.col("d").isNull()).alias("n_isolated"),
                   F.coalesce(F.max("d"), F.lit(0)).cast("long").alias("max_degree")).select(
        "n_nodes", (F.col("_twice") / 2).cast("long").alias("n_edges"), "n_isolated", "max_degree",
        (F.col("_twice") / F.col("n_nodes")).alias("mean_degree"))


def build_graph(df: DataFrame, id_col: str = "id", vec: str = "x", label: str = "y", split_col: str | None = None,
                min_samples: int = 3, quantile: float = 0.98, k: int = 5) -> tuple[DataFrame, DataFrame, float]:
    """Eps estimate -> DBSCAN -> intra-cluster k-NN graph -> dense ids.

    Returns ``nodes(node_id, <id_col>, x, y, cluster[, split])``,
    ``edges(src, dst)`` on the dense ids and the eps used.  Noise rows are
    not nodes; empty graphs raise as in the reference.
    """
    keep = [id_col, vec, label] + ([split_col] if split_col else [])
    df = cut_lineage(df.select(*keep))                          # read by every step
    kd = cut_lineage(SIM.k_distance(df, min_samples, id_col, vec))
    eps = CL.eps_of(kd, quantile)
    cl = CL.dbscan(df, eps, min_samples, id_col, vec, kdist=kd)
    members = df.join(cl.where(F.col("cluster") != -1).select(id_col, "cluster"), id_col)
    members = cut_lineage(members)
    e = intra_cluster_knn(members, k, id_col, vec, "cluster")
    nodes = relabel_dense(members, id_col, "node_id")
    if nodes.limit(1).count() == 0:
        raise ValueError("no row belongs to a cluster, so there is no graph")
    ids = nodes.select(id_col, "node_id")
    edges = (e.join(ids.select(F.col(id_col).alias("src"), F.col("node_id").alias("s")), "src")
              .join(ids.select(F.col(id_col).alias("dst"), F.col("node_id").alias("d")), "dst")
              .select(F.least("s", "d").alias("src"), F.greatest("s", "d").alias("dst")))
    return nodes.withColumnRenamed(label, "y"), edges, eps


def symmetric(edges: DataFrame, self_loops_from: DataFrame | None = None, id_col: str = "node_id") -> DataFrame:
    """Directed message edges j -> i for both directions (+ self loops)."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    if self_loops_from is not None:
        both = both.unionByName(self_loops_from.select(F.col(id_col).alias("src"), F.col(id_col).alias("dst")))
    return both.distinct()


def _dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda total, v: total + v)


def _softmax_mean(messages: DataFrame) -> DataFrame:
    """``dst, k, value``: softmax(e)-weighted mean of the vectors ``v`` that reach each ``dst``.

    ``messages`` (``dst, e, v``) is frozen once for the maximum and the sums;
    vectors are taken apart for the last sum only.
    """
    messages = cut_lineage(messages)
    top = messages.groupBy("dst").agg(F.max("e").alias("top"))
    weighed = messages.join(top, "dst").select("dst", F.exp(F.col("e") - F.col("top")).alias("w"),
                                               F.posexplode("v").alias("k", "v"))
    return weighed.groupBy("dst", "k").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("value"))


def _as_vectors(long: DataFrame, id_col: str, key: str) -> DataFrame:
    """Long form back to one array for each node (as many entries as the vector has)."""
    return long.groupBy(id_col).agg(F.transform(F.sort_array(F.collect_list(F.struct(key, "value"))),
                                                lambda s: s["value"]).alias("x"))


def attention_layer(spark: SparkSession, nodes: DataFrame, edges: DataFrame, weight: list[list[float]],
                    att_src: list[float], att_dst: list[float], id_col: str = "node_id", vec: str = "x",
                    slope: float = 0.2, activation: str | None = None) -> DataFrame:
    """One single-head graph-attention layer with given weights.

    h = W x; e_ij = LeakyReLU(a_src . h_j + a_dst . h_i) over edges j -> i
    (both directions plus self loops); alpha = softmax_j(e_ij) per i;
    out_i = sum_j alpha_ij h_j, then the optional activation.  Returns
    ``node_id, o, value`` (long form of the output vector).
    W and a are model parameters (bounded by the layer width) and stand in
    the plan as literals: a node's h is computed in its row.
    """
    def literal(values):
        return F.array(*[F.lit(float(v)) for v in values])

    x = F.col(vec).cast("array<double>")
    h = nodes.select(F.col(id_col).alias("n"), F.array(*[_dot(x, literal(row)) for row in weight]).alias("h"))
    h = cut_lineage(h.select("n", "h", _dot(F.col("h"), literal(att_src)).alias("ss"),
                             _dot(F.col("h"), literal(att_dst)).alias("sd")))
    raw = F.col("ss") + F.col("sd")
    messages = (symmetric(edges, nodes, id_col).join(h.select(F.col("n").alias("src"), "ss", F.col("h").alias("v")), "src")
                .join(h.select(F.col("n").alias("dst"), "sd"), "dst")
                .select("dst", F.when(raw >= 0, raw).otherwise(raw * slope).alias("e"), "v"))
    out = _softmax_mean(messages).withColumnRenamed("k", "o")
    if activation == "relu":
        out = out.withColumn("value", F.greatest("value", F.lit(0.0)))
    elif activation == "tanh":
        out = out.withColumn("value", F.tanh("value"))
    return out.select(F.col("dst").alias(id_col), "o", "value")


def attention_forward(spark: SparkSession, nodes: DataFrame, edges: DataFrame,
                      layers: list[list[tuple[list[list[float]], list[float], list[float]]]],
                      activation: str = "relu", id_col: str = "node_id", vec: str = "x") -> DataFrame:
    """G7 stack: each layer is a list of heads (W, a_src, a_dst); hidden layers
    concatenate their heads and apply ``activation``, the last layer uses
    its single head without activation.  Returns ``node_id, o, value`` of the
    last layer.  Each layer is one round of joins + grouped softmax; the
    state between layers is cut with a reliable checkpoint."""
    cur = nodes.select(F.col(id_col).alias("node_id"), F.col(vec).cast("array<double>").alias("x"))
    out = None
    for li, heads in enumerate(layers):
        last = li == len(layers) - 1
        parts = []
        offset = 0
        for w, a_s, a_d in heads:
            h = attention_layer(spark, cur, edges, w, a_s, a_d, "node_id", "x",
                                activation=None if last else activation)
            parts.append(h.withColumn("o", F.col("o") + offset))
            offset += len(w)
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        if not last:
            cur = cut_lineage(_as_vectors(out, "node_id", "o"))
    return out


def propagate(nodes: DataFrame, edges: DataFrame, hops: int = 1, beta: float = 1.0, id_col: str = "node_id",
              vec: str = "x") -> DataFrame:
    """Parameter-free attention propagation (softmax of beta * cosine over
    the neighbours and the node itself), ``hops`` rounds.  Returns
    ``node_id, k, value`` for the final hop."""
    msg = symmetric(edges, nodes, id_col)
    cur = nodes.select(F.col(id_col).alias("n"), F.col(vec).cast("array<double>").alias("x"))
    long = None
    for hop in range(hops):
        if hop:
            cur = _as_vectors(long.withColumnRenamed("dst", "n"), "n", "k")
        norm = F.sqrt(_dot(F.col("x"), F.col("x")))
        unit = cut_lineage(cur.select("n", "x", F.transform("x", lambda v: F.when(norm > 0, v / norm).otherwise(0.0)).alias("u")))
        messages = (msg.join(unit.select(F.col("n").alias("src"), F.col("x").alias("v"), F.col("u").alias("us")), "src")
                    .join(unit.select(F.col("n").alias("dst"), F.col("u").alias("ud")), "dst")
                    .select("dst", (F.lit(beta) * _dot(F.col("us"), F.col("ud"))).alias("e"), "v"))
        long = _softmax_mean(messages)
    return long.select(F.col("dst").alias(id_col), "k", "value")


def fixed_weights(d_in: int, d_out: int, seed: int = 1) -> tuple[list[list[float]], list[float], list[float]]:
    """Deterministic small weights for checks: sin/cos of the indices."""
    w = [[math.sin(seed + 0.7 * o + 0.31 * k) / math.sqrt(d_in) for k in range(d_in)] for o in range(d_out)]
    a_s = [math.cos(seed + 0.5 * o) / 2 for o in range(d_out)]
    a_d = [math.sin(seed + 0.9 * o) / 2 for o in range(d_out)]
    return w, a_s, a_d
