"""Similarity, clustering and graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cluster as CL
from ..operators import graph as GR
from ..operators import similarity as SIM
from ..operators import split as X
from ..plans.ranking import exact_quantiles
from ..plans.session import cut_lineage
from ..sources.tables import table, vectors
from .registry import register
from .sql_common import VEC_CTE, VEC_DIST

D_ALL = f"d AS (SELECT l.id AS i, r.id AS j, l.label AS li, r.label AS lj, {VEC_DIST} AS dist FROM vec l, vec r)"


def eps_cte(q: float) -> str:
    return f"""kd AS (SELECT i, dist FROM (SELECT i, dist, row_number() OVER (PARTITION BY i ORDER BY dist, j) AS rn
                 FROM d WHERE i <> j) WHERE rn = 2),
eps AS (SELECT round(quantile_cont(dist, {q}), 9) AS eps FROM kd)"""


def dbscan_ctes(q: float) -> str:
    return f"""{VEC_CTE.strip()}, {D_ALL}, {eps_cte(q)},
nb AS (SELECT i, j FROM d, eps WHERE d.dist <= eps.eps),
core AS (SELECT i FROM nb GROUP BY i HAVING count(*) >= 3),
ce AS (SELECT nb.i, nb.j FROM nb JOIN core a ON nb.i = a.i JOIN core b ON nb.j = b.i WHERE nb.i <> nb.j),
reach(node, comp) AS (SELECT i, i FROM core UNION SELECT ce.j, reach.comp FROM reach JOIN ce ON reach.node = ce.i),
comp AS (SELECT node AS id, min(comp) AS component FROM reach GROUP BY node),
border AS (SELECT nb.i AS id, min(c.component) AS component FROM nb JOIN comp c ON nb.j = c.id
           WHERE nb.i NOT IN (SELECT i FROM core) GROUP BY nb.i),
lab AS (SELECT * FROM comp UNION ALL SELECT * FROM border),
num AS (SELECT component, CAST(row_number() OVER (ORDER BY component) - 1 AS INTEGER) AS cluster
        FROM (SELECT DISTINCT component FROM lab)),
db AS (SELECT v.id, v.label, coalesce(num.cluster, -1) AS cluster, v.id IN (SELECT i FROM core) AS is_core
       FROM vec v LEFT JOIN lab ON v.id = lab.id LEFT JOIN num ON lab.component = num.component)"""


DBSCAN_Q = 0.25


def _dbscan(spark, sf_dir):
    v = vectors(spark, sf_dir)
    kd = cut_lineage(SIM.k_distance(v, 3))
    return v, CL.dbscan(v, CL.eps_of(kd, DBSCAN_Q), 3, kdist=kd)


@register("knn_self_join", sql=f"""
WITH {VEC_CTE.strip()}, {D_ALL}
SELECT query_id, rank, neighbor_id, dist FROM (
  SELECT i AS query_id, CAST(row_number() OVER (PARTITION BY i ORDER BY dist, j) AS INTEGER) AS rank, j AS neighbor_id,
         round(dist, 6) AS dist FROM d WHERE i <> j) WHERE rank <= 5""")
def knn_self_join(spark, sf_dir):
    """Exact cosine 5-NN of every embedding among the others."""
    v = vectors(spark, sf_dir)
    nb = SIM.knn(v, v, k=5, exclude_self=True)
    return nb.select("query_id", "rank", "neighbor_id", F.round("dist", 6).alias("dist"))


SPLIT_VEC = """
sv AS (SELECT *, row_number() OVER (ORDER BY id) - 1 < floor(count(*) OVER () * 0.8) AS is_ref FROM vec)"""


def _ref_query(spark, sf_dir):
    v = X.positional_split(vectors(spark, sf_dir), "id", 0.8)
    return v.where(F.col("split") == "train"), v.where(F.col("split") == "test")


@register("knn_query_join", sql=f"""
WITH {VEC_CTE.strip()}, {SPLIT_VEC.strip()}
SELECT query_id, rank, neighbor_id, dist FROM (
  SELECT q.id AS query_id, CAST(row_number() OVER (PARTITION BY q.id ORDER BY {VEC_DIST.replace('l.', 'q.')}, r.id)
         AS INTEGER) AS rank, r.id AS neighbor_id, round({VEC_DIST.replace('l.', 'q.')}, 6) AS dist
  FROM sv q, sv r WHERE NOT q.is_ref AND r.is_ref) WHERE rank <= 5""")
def knn_query_join(spark, sf_dir):
    """5 nearest reference rows (first 80 % by id) of each new row."""
    ref, qry = _ref_query(spark, sf_dir)
    nb = SIM.knn(qry, ref, k=5)
    return nb.select("query_id", "rank", "neighbor_id", F.round("dist", 6).alias("dist"))


@register("lookup_by_id", sql=f"""
WITH {VEC_CTE.strip()}, {SPLIT_VEC.strip()},
nn AS (SELECT q.id AS query_id, CAST(row_number() OVER (PARTITION BY q.id ORDER BY {VEC_DIST.replace('l.', 'q.')}, r.id)
        AS INTEGER) AS rank, r.id AS neighbor_id FROM sv q, sv r WHERE NOT q.is_ref AND r.is_ref)
SELECT nn.query_id, nn.rank, nn.neighbor_id, v.label AS neighbor_label FROM nn JOIN vec v ON nn.neighbor_id = v.id
WHERE nn.rank <= 5""")
def lookup_by_id(spark, sf_dir):
    """Neighbour labels fetched by id (equi-join)."""
    ref, qry = _ref_query(spark, sf_dir)
    nb = SIM.knn(qry, ref, k=5)
    labels = ref.select(F.col("id").alias("neighbor_id"), F.col("label").alias("neighbor_label"))
    return SIM.lookup_by_id(nb.select("query_id", "rank", "neighbor_id"), labels, "neighbor_id")


@register("neighborhood_consensus", sql=f"""
WITH {VEC_CTE.strip()}, {SPLIT_VEC.strip()},
nn AS (SELECT q.id AS query_id, r.label AS y, row_number() OVER (PARTITION BY q.id ORDER BY
        {VEC_DIST.replace('l.', 'q.')}, r.id) AS rank FROM sv q, sv r WHERE NOT q.is_ref AND r.is_ref)
SELECT query_id, CASE WHEN bool_and(y % 2 = 0) THEN 'unanimous_0' WHEN bool_and(y % 2 = 1) THEN 'unanimous_1'
  ELSE 'mixed' END AS consensus FROM nn WHERE rank <= 5 GROUP BY query_id""")
def neighborhood_consensus(spark, sf_dir):
    """J7 with a binary label (label parity)."""
    ref, qry = _ref_query(spark, sf_dir)
    nb = SIM.knn(qry, ref, k=5)
    lab = ref.select("id", (F.col("label") % 2).alias("y"))
    return SIM.neighborhood_consensus(nb, lab)


@register("score_knn_vote_embeddings", sql=f"""
WITH {VEC_CTE.strip()}, {SPLIT_VEC.strip()},
nn AS (SELECT q.id AS query_id, r.label % 2 AS y, row_number() OVER (PARTITION BY q.id ORDER BY
        {VEC_DIST.replace('l.', 'q.')}, r.id) AS rank FROM sv q, sv r WHERE NOT q.is_ref AND r.is_ref)
SELECT query_id, CAST(sum(y) AS BIGINT) AS n_pos, count(*) AS n_nbrs, CAST(2 * sum(y) > count(*) AS INTEGER) AS prediction,
  round(CASE WHEN 2 * sum(y) > count(*) THEN sum(y) / count(*) ELSE 1 - sum(y) / count(*) END, 6) AS confidence
FROM nn WHERE rank <= 5 GROUP BY query_id""")
def score_knn_vote_embeddings(spark, sf_dir):
    """R3 on embeddings: majority of the 5 neighbours' label parity."""
    ref, qry = _ref_query(spark, sf_dir)
    nb = SIM.knn(qry, ref, k=5)
    v = SIM.knn_vote(nb, ref.select("id", (F.col("label") % 2).alias("y")))
    return v.select("query_id", "n_pos", "n_nbrs", "prediction", F.round("confidence", 6).alias("confidence"))


@register("cosine_distance", sql=f"""
WITH flat AS (SELECT vec_id AS id, label, u.pos, CAST(u.v AS DOUBLE) AS v
              FROM embeddings, unnest(embedding) WITH ORDINALITY AS u(v, pos)),
cent AS (SELECT label, pos, avg(v) AS c FROM flat GROUP BY label, pos),
cn AS (SELECT label, sqrt(sum(c * c)) AS cn FROM cent GROUP BY label),
dots AS (SELECT f.id, f.label, sum(f.v * c.c) AS dot, sqrt(sum(f.v * f.v)) AS xn
         FROM flat f JOIN cent c ON f.label = c.label AND f.pos = c.pos GROUP BY f.id, f.label)
SELECT d.id, d.label, round(CASE WHEN xn = 0 OR cn = 0 THEN 1.0 WHEN 1 - dot / (xn * cn) <= 0 THEN 0.0
  ELSE 1 - dot / (xn * cn) END, 6) AS dist FROM dots d JOIN cn ON d.label = cn.label""")
def cosine_distance(spark, sf_dir):
    """Cosine distance of each embedding to its label centroid."""
    v = vectors(spark, sf_dir)
    d = SIM.cosine_distance_to_centroid(v, "id", "x", "label")
    return d.select("id", "label", F.round("dist", 6).alias("dist"))


@register("k_distance", sql=f"""
WITH {VEC_CTE.strip()}, {D_ALL}, {eps_cte(0.5)}
SELECT i AS id, round(dist, 6) AS kdist FROM kd""")
def k_distance(spark, sf_dir):
    """A2: distance to the 3rd neighbour counting the row itself."""
    kd = SIM.k_distance(vectors(spark, sf_dir), 3)
    return kd.select("id", F.round("kdist", 6).alias("kdist"))


@register("estimate_eps", sql=f"""
WITH {VEC_CTE.strip()}, {D_ALL}, {eps_cte(0.98)}
SELECT CAST(0.98 AS DOUBLE) AS quantile, round(quantile_cont(dist, 0.98), 9) AS eps FROM kd
UNION ALL SELECT CAST(0.25 AS DOUBLE), round(quantile_cont(dist, 0.25), 9) FROM kd""")
def estimate_eps(spark, sf_dir):
    """G1: eps at the reference quantile (0.98) and at the check quantile."""
    v = vectors(spark, sf_dir)
    kd = cut_lineage(SIM.k_distance(v, 3))
    q = exact_quantiles(kd, "kdist", [0.98, 0.25])
    return q.select(F.col("q").alias("quantile"), F.round("value", 9).alias("eps"))


@register("quantile_linear", sql="""
SELECT CAST(0.98 AS DOUBLE) AS q, round(quantile_cont(l_extendedprice, 0.98), 6) AS value FROM lineitem
UNION ALL SELECT CAST(0.5 AS DOUBLE), round(quantile_cont(l_extendedprice, 0.5), 6) FROM lineitem
UNION ALL SELECT CAST(0.25 AS DOUBLE), round(quantile_cont(l_extendedprice, 0.25), 6) FROM lineitem""")
def quantile_linear(spark, sf_dir):
    """A1: exact linear-interpolation quantiles without a one-task sort."""
    li = table(spark, sf_dir, "lineitem")
    q = exact_quantiles(li, "l_extendedprice", [0.98, 0.5, 0.25])
    return q.select("q", F.round("value", 6).alias("value"))


@register("radius_join", sql=f"""
WITH {VEC_CTE.strip()}, {D_ALL.replace("d AS (", "d AS MATERIALIZED (", 1)}, {eps_cte(0.25)}
SELECT i AS a, j AS b, round(dist, 6) AS dist FROM d, eps WHERE i < j AND d.dist <= eps.eps""")
def radius_join(spark, sf_dir):
    """All pairs within eps (eps = 0.25 quantile of k-distances)."""
    v = vectors(spark, sf_dir)
    eps = CL.estimate_eps(v, 3, DBSCAN_Q)
    return SIM.radius_join(v, eps).select("a", "b", F.round("dist", 6).alias("dist"))


@register("connected_components", sql=f"""
WITH RECURSIVE {dbscan_ctes(DBSCAN_Q)}
SELECT id, component FROM comp""")
def connected_components(spark, sf_dir):
    """Components of the core-core eps graph."""
    v = vectors(spark, sf_dir)
    eps = CL.estimate_eps(v, 3, DBSCAN_Q)
    t = v.select(F.col("id").alias("_id"), F.col("x").alias("_x"))
    cnt = SIM.neighbor_counts(t, eps, "_id", "_x")
    core = cut_lineage(cnt.where(F.col("n_eps") >= 3).select(F.col("_id").alias("id")))    # joined three times
    pairs = SIM.radius_join(v, eps)
    ce = (pairs.join(core.withColumnRenamed("id", "a"), "a").join(core.withColumnRenamed("id", "b"), "b")
               .select(F.col("a").alias("src"), F.col("b").alias("dst")))
    return CL.connected_components(ce, nodes=core, node_col="id")


@register("dbscan", sql=f"WITH RECURSIVE {dbscan_ctes(DBSCAN_Q)} SELECT id, cluster, is_core FROM db")
def dbscan(spark, sf_dir):
    """DBSCAN (cosine, min_samples 3) at the 0.25 k-distance quantile."""
    _, cl = _dbscan(spark, sf_dir)
    return cl.select("id", "cluster", "is_core")


@register("cluster_counts", sql=f"""
WITH RECURSIVE {dbscan_ctes(DBSCAN_Q)} SELECT cluster, count(*) AS size FROM db GROUP BY cluster""")
def cluster_counts(spark, sf_dir):
    """A4: size per cluster (noise = -1)."""
    _, cl = _dbscan(spark, sf_dir)
    return CL.cluster_counts(cl)


@register("cluster_summary", sql=f"""
WITH RECURSIVE {dbscan_ctes(DBSCAN_Q)}
SELECT count(DISTINCT cluster) FILTER (WHERE cluster <> -1) AS n_clusters,
       count(*) FILTER (WHERE cluster = -1) AS n_noise FROM db""")
def cluster_summary(spark, sf_dir):
    """A4: number of clusters and of noise rows."""
    _, cl = _dbscan(spark, sf_dir)
    return CL.cluster_summary(cl)


@register("cluster_profile", sql=f"""
WITH RECURSIVE {dbscan_ctes(DBSCAN_Q)},
c AS (SELECT cluster, label, count(*) AS n FROM db WHERE cluster <> -1 GROUP BY cluster, label),
t AS (SELECT cluster, sum(n) AS tot, max(n) AS mx FROM c GROUP BY cluster)
SELECT c.cluster, min(c.label) AS category, round(max(c.n) / max(t.tot), 6) AS share
FROM c JOIN t ON c.cluster = t.cluster AND c.n = t.mx GROUP BY c.cluster""")
def cluster_profile(spark, sf_dir):
    """A3: dominant label per cluster (smallest label on ties)."""
    v, cl = _dbscan(spark, sf_dir)
    j = cl.join(v.select("id", "label"), "id")
    d = CL.dominant_category(j, "cluster", "label")
    return d.select("cluster", "category", F.round("share", 6).alias("share"))


@register("relabel_dense", sql=f"""
WITH RECURSIVE {dbscan_ctes(DBSCAN_Q)}
SELECT id, row_number() OVER (ORDER BY id) - 1 AS node_id FROM db WHERE cluster <> -1""")
def relabel_dense(spark, sf_dir):
    """Dense node ids 0..n-1 for the non-noise rows."""
    _, cl = _dbscan(spark, sf_dir)
    return GR.relabel_dense(cl.where(F.col("cluster") != -1).select("id"), "id", "node_id")


G4_SQL = f"""
g4 AS (SELECT DISTINCT least(i, j) AS src, greatest(i, j) AS dst FROM (
  SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY dist, j) AS rn FROM d WHERE li = lj AND i <> j) WHERE rn <= 5)"""


@register("intra_cluster_knn_graph", sql=f"WITH {VEC_CTE.strip()}, {D_ALL}, {G4_SQL.strip()} SELECT src, dst FROM g4")
def intra_cluster_knn_graph(spark, sf_dir):
    """G4 with the label as the cluster id."""
    v = vectors(spark, sf_dir).withColumnRenamed("label", "cluster")
    return GR.intra_cluster_knn(v, 5, "id", "x", "cluster")


@register("distinct_edges", sql=f"""
WITH {VEC_CTE.strip()}, {D_ALL}
SELECT DISTINCT least(i, j) AS src, greatest(i, j) AS dst FROM (
  SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY dist, j) AS rn FROM d WHERE i <> j) WHERE rn <= 3""")
def distinct_edges(spark, sf_dir):
    """A5: canonical undirected edges of the 3-NN relation."""
    v = vectors(spark, sf_dir)
    nb = SIM.knn(v, v, k=3, exclude_self=True)
    return GR.distinct_edges(nb, "query_id", "neighbor_id")


@register("graph_stats", sql=f"""
WITH {VEC_CTE.strip()}, {D_ALL}, {G4_SQL.strip()},
sym AS (SELECT src AS n FROM g4 UNION ALL SELECT dst FROM g4),
deg AS (SELECT v.id, count(s.n) AS d FROM vec v LEFT JOIN sym s ON v.id = s.n GROUP BY v.id)
SELECT count(*) AS n_nodes, CAST(sum(d) / 2 AS BIGINT) AS n_edges, count(*) FILTER (WHERE d = 0) AS n_isolated,
       CAST(max(d) AS BIGINT) AS max_degree, round(sum(d) / count(*), 6) AS mean_degree FROM deg""")
def graph_stats(spark, sf_dir):
    """node/edge counts and degrees of the G4 graph."""
    v = vectors(spark, sf_dir)
    e = GR.intra_cluster_knn(v.withColumnRenamed("label", "cluster"), 5, "id", "x", "cluster")
    s = GR.graph_stats(v.withColumnRenamed("id", "node_id"), e)
    return s.select("n_nodes", "n_edges", "n_isolated", "max_degree", F.round("mean_degree", 6).alias("mean_degree"))


@register("topk_per_group", sql="""
SELECT o_custkey, o_orderkey, rank FROM (
  SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)
         AS INTEGER) AS rank FROM orders) WHERE rank <= 3""")
def topk_per_group(spark, sf_dir):
    """Three largest orders per customer (a top-k report)."""
    o = table(spark, sf_dir, "orders")
    t = SIM.topk_per_group(o, "o_custkey", [F.desc("o_totalprice"), "o_orderkey"], 3)
    return t.select("o_custkey", "o_orderkey", F.col("rank").cast("int").alias("rank"))


G7_D_OUT = 4


def _g7_sql() -> str:
    w, a_s, a_d = GR.fixed_weights(64, G7_D_OUT)
    wv = ", ".join(f"({k}, {o}, {w[o][k]!r})" for o in range(G7_D_OUT) for k in range(64))
    av = ", ".join(f"({o}, {a_s[o]!r}, {a_d[o]!r})" for o in range(G7_D_OUT))
    return f"""
WITH {VEC_CTE.strip()}, {D_ALL}, {G4_SQL.strip()},
w(k, o, w) AS (VALUES {wv}),
a(o, a_s, a_d) AS (VALUES {av}),
flat AS (SELECT vec_id AS n, CAST(u.pos - 1 AS INTEGER) AS k, CAST(u.v AS DOUBLE) AS v
         FROM embeddings, unnest(embedding) WITH ORDINALITY AS u(v, pos)),
h AS (SELECT n, o, sum(v * w) AS h FROM flat JOIN w USING (k) GROUP BY n, o),
s AS (SELECT n, sum(h * a_s) AS ss, sum(h * a_d) AS sd FROM h JOIN a USING (o) GROUP BY n),
msg AS (SELECT src, dst FROM g4 UNION SELECT dst, src FROM g4 UNION SELECT id, id FROM vec),
e AS (SELECT m.src, m.dst, s1.ss + s2.sd AS raw FROM msg m JOIN s s1 ON m.src = s1.n JOIN s s2 ON m.dst = s2.n),
e2 AS (SELECT src, dst, CASE WHEN raw >= 0 THEN raw ELSE raw * 0.2 END AS e FROM e),
ex AS (SELECT src, dst, exp(e - max(e) OVER (PARTITION BY dst)) AS ex FROM e2),
al AS (SELECT src, dst, ex / sum(ex) OVER (PARTITION BY dst) AS alpha FROM ex)
SELECT al.dst AS node_id, h.o, round(greatest(sum(al.alpha * h.h), 0.0), 6) AS value
FROM al JOIN h ON al.src = h.n GROUP BY al.dst, h.o"""


@register("attention_layer", sql=_g7_sql())
def attention_layer(spark, sf_dir):
    """One attention layer (fixed weights, 1 head, relu) on the G4 graph."""
    v = vectors(spark, sf_dir)
    e = GR.intra_cluster_knn(v.withColumnRenamed("label", "cluster"), 5, "id", "x", "cluster")
    w, a_s, a_d = GR.fixed_weights(64, G7_D_OUT)
    out = GR.attention_layer(spark, v.withColumnRenamed("id", "node_id"), e, w, a_s, a_d, activation="relu")
    return out.select("node_id", "o", F.round("value", 6).alias("value"))


@register("attention_propagation", sql=f"""
WITH {VEC_CTE.strip()}, {D_ALL}, {G4_SQL.strip()},
flat AS (SELECT vec_id AS n, CAST(u.pos - 1 AS INTEGER) AS k, CAST(u.v AS DOUBLE) AS v
         FROM embeddings, unnest(embedding) WITH ORDINALITY AS u(v, pos)),
nr AS (SELECT n, sqrt(sum(v * v)) AS nr FROM flat GROUP BY n),
un AS (SELECT f.n, f.k, CASE WHEN nr.nr > 0 THEN f.v / nr.nr ELSE 0.0 END AS u FROM flat f JOIN nr USING (n)),
msg AS (SELECT src, dst FROM g4 UNION SELECT dst, src FROM g4 UNION SELECT id, id FROM vec),
cs AS (SELECT m.src, m.dst, sum(a.u * b.u) AS c FROM msg m JOIN un a ON a.n = m.src JOIN un b ON b.n = m.dst AND b.k = a.k
       GROUP BY m.src, m.dst),
ex AS (SELECT src, dst, exp(c - max(c) OVER (PARTITION BY dst)) AS ex FROM cs),
al AS (SELECT src, dst, ex / sum(ex) OVER (PARTITION BY dst) AS alpha FROM ex)
SELECT al.dst AS node_id, f.k, round(sum(al.alpha * f.v), 6) AS value FROM al JOIN flat f ON f.n = al.src
GROUP BY al.dst, f.k""")
def attention_propagation(spark, sf_dir):
    """One hop of parameter-free cosine attention on the G4 graph."""
    v = vectors(spark, sf_dir)
    e = GR.intra_cluster_knn(v.withColumnRenamed("label", "cluster"), 5, "id", "x", "cluster")
    out = GR.propagate(v.withColumnRenamed("id", "node_id"), e, hops=1, beta=1.0)
    return out.select("node_id", F.col("k").cast("int").alias("k"), F.round("value", 6).alias("value"))


@register("attach_new_nodes", sql=f"""
WITH {VEC_CTE.strip()}, {SPLIT_VEC.strip()},
ref AS (SELECT * FROM sv WHERE is_ref),
dr AS (SELECT l.id AS i, r.id AS j, {VEC_DIST} AS dist FROM ref l, ref r WHERE l.label = r.label AND l.id <> r.id),
base AS (SELECT DISTINCT least(i, j) AS src, greatest(i, j) AS dst FROM (
  SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY dist, j) AS rn FROM dr) WHERE rn <= 5),
nn AS (SELECT query_id, neighbor_id FROM (SELECT q.id AS query_id, r.id AS neighbor_id,
         row_number() OVER (PARTITION BY q.id ORDER BY {VEC_DIST.replace('l.', 'q.')}, r.id) AS rn
       FROM sv q, ref r WHERE NOT q.is_ref) WHERE rn <= 5)
SELECT src, dst FROM base UNION ALL SELECT query_id, neighbor_id FROM nn UNION ALL SELECT neighbor_id, query_id FROM nn""")
def attach_new_nodes(spark, sf_dir):
    """Base graph on the reference rows plus two directed edges from each
    new row to each of its 5 nearest reference rows (rows never see each other)."""
    ref, qry = _ref_query(spark, sf_dir)
    base = GR.intra_cluster_knn(ref.withColumnRenamed("label", "cluster"), 5, "id", "x", "cluster")
    nb = SIM.knn(qry, ref, k=5)
    _, edges = SIM.attach_new_nodes(ref.select(F.col("id").alias("node_id")), base,
                                    qry.select(F.col("id").alias("node_id")), nb)
    return edges


@register("cluster_quality", sql="""
WITH vec AS (SELECT vec_id AS id, label AS c, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
flat AS (SELECT vec_id AS id, label AS c, u.pos, CAST(u.v AS DOUBLE) AS v
         FROM embeddings, unnest(embedding) WITH ORDINALITY AS u(v, pos)),
cent AS (SELECT c, pos, avg(v) AS cv FROM flat GROUP BY c, pos),
gc AS (SELECT pos, avg(v) AS gv FROM flat GROUP BY pos),
sz AS (SELECT c, count(*) AS nc FROM vec GROUP BY c),
dr AS (SELECT f.id, f.c, sum((f.v - ce.cv) * (f.v - ce.cv)) AS sq FROM flat f JOIN cent ce USING (c, pos) GROUP BY f.id, f.c),
sc AS (SELECT c, avg(sqrt(sq)) AS si, sum(sq) AS wss FROM dr GROUP BY c),
cc AS (SELECT a.c AS ci, b.c AS cj, sqrt(sum((a.cv - b.cv) * (a.cv - b.cv))) AS dij FROM cent a JOIN cent b
       ON a.pos = b.pos AND a.c <> b.c GROUP BY a.c, b.c),
db AS (SELECT avg(r) AS davies_bouldin FROM (SELECT cc.ci, max((x.si + y.si) / cc.dij) AS r FROM cc
       JOIN sc x ON cc.ci = x.c JOIN sc y ON cc.cj = y.c GROUP BY cc.ci)),
bss AS (SELECT sum(b * nc) AS bss, count(*) AS k FROM (SELECT ce.c, sum((ce.cv - gc.gv) * (ce.cv - gc.gv)) AS b
        FROM cent ce JOIN gc USING (pos) GROUP BY ce.c) JOIN sz USING (c)),
ch AS (SELECT bss / (k - 1) / ((SELECT sum(wss) FROM sc) / ((SELECT count(*) FROM vec) - k)) AS calinski_harabasz FROM bss),
pd AS (SELECT a.id, a.c AS oc, b.c AS rc, sum(list_distance(a.x, b.x)) AS s, count(*) AS n
       FROM vec a, vec b GROUP BY a.id, a.c, b.c),
aa AS (SELECT id, CASE WHEN n > 1 THEN s / (n - 1) END AS a, n AS own_n FROM pd WHERE rc = oc),
bb AS (SELECT id, min(s / n) AS b FROM pd WHERE rc <> oc GROUP BY id),
sil AS (SELECT avg(CASE WHEN own_n <= 1 THEN 0.0 ELSE (b - a) / greatest(a, b) END) AS silhouette
        FROM aa JOIN bb USING (id))
SELECT round(silhouette, 6) AS silhouette, round(davies_bouldin, 6) AS davies_bouldin,
       round(calinski_harabasz, 6) AS calinski_harabasz FROM sil, db, ch""")
def cluster_quality(spark, sf_dir):
    """Silhouette, Davies-Bouldin, Calinski-Harabasz (Euclidean) with the
    label as the clustering."""
    v = vectors(spark, sf_dir).withColumnRenamed("label", "cluster")
    q = CL.cluster_quality(v, "id", "x", "cluster")
    return q.select(*[F.round(c, 6).alias(c) for c in ("silhouette", "davies_bouldin", "calinski_harabasz")])


@register("mask_filter", sql=f"WITH RECURSIVE {dbscan_ctes(DBSCAN_Q)} SELECT id, cluster FROM db WHERE cluster <> -1")
def mask_filter(spark, sf_dir):
    """Keep the non-noise rows (boolean mask as a filter)."""
    _, cl = _dbscan(spark, sf_dir)
    return cl.where(F.col("cluster") != -1).select("id", "cluster")


def _assay_encoded(spark, sf_dir):
    from ..operators import features as FE
    from ..sources.tables import assay_base

    a = assay_base(spark, sf_dir)
    params = FE.fit_encoder(a, ["dose", "hr"], ["material"])
    return FE.encode(a, params).select(F.col("row_id").alias("id"), "x", F.col("toxic").alias("y"), "material")


@register("dbscan_assay")
def dbscan_assay(spark, sf_dir):
    """G1 + G2 at the reference setting (cosine, min_samples 3, eps at the
    0.98 k-distance quantile) on the whole encoded assay view: one row per
    cluster with its size and dominant material (A3, A4)."""
    enc = _assay_encoded(spark, sf_dir)
    kd = cut_lineage(SIM.k_distance(enc, 3))
    eps = CL.eps_of(kd, 0.98)
    cl = CL.dbscan(enc, eps, 3, kdist=kd)
    j = cl.join(enc.select("id", "material"), "id")
    sizes = CL.cluster_counts(j)
    dom = CL.dominant_category(j, "cluster", "material")
    return (sizes.join(dom, "cluster", "left")
                 .select("cluster", "size", "category", F.round("share", 6).alias("share"),
                         F.lit(eps).alias("eps")))


@register("build_graph")
def build_graph(spark, sf_dir):
    """Eps -> DBSCAN -> intra-cluster 5-NN graph -> dense node ids over the
    whole assay view; reported as graph statistics (A7) plus eps."""
    enc = _assay_encoded(spark, sf_dir)
    nodes, edges, eps = GR.build_graph(enc, "id", "x", "y", quantile=0.98, k=5)
    return GR.graph_stats(nodes, edges).withColumn("eps", F.lit(eps))


@register("knn_approx", sql="SELECT vec_id AS query_id, 5 AS n, true AS recall_met FROM embeddings")
def knn_approx(spark, sf_dir):
    """J3 approximate path: k neighbours for every row and the target recall met on the sample of queries
    (recall against the exact join is tested)."""
    v = vectors(spark, sf_dir)
    nb = SIM.knn_approx(v, v, k=5, exclude_self=True, target_recall=0.9)
    return nb.groupBy("query_id").agg(F.count(F.lit(1)).cast("int").alias("n"), (F.min("recall") >= 0.9).alias("recall_met"))
