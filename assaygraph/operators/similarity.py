"""Cosine similarity joins (J1-J7), k-distance (A2) and top-k per group."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans import blocks, cells
from ..plans.session import cut_lineage, parallelism


def _block_plan(left: DataFrame, right: DataFrame, block_rows: int | None = None) -> tuple[int, tuple[int, int]]:
    """Rows per block and the two row counts: blocks of at most 16,384 rows,
    small enough that there are a few block pairs per core."""
    nl = left.count()
    nr = nl if right is left else right.count()
    return block_rows or _block_rows(left, nl, nr), (nl, nr)


def _block_rows(df: DataFrame, nl: int, nr: int) -> int:
    target = 4 * parallelism(df.sparkSession)
    b = int(math.sqrt(max(nl * nr, 1) / target)) if nl and nr else blocks.DEFAULT_BLOCK_ROWS
    return max(256, min(blocks.MAX_BLOCK_ROWS, b))


#: Queries on which it is measured how many cells are in reach.
_PROBES = 512


def _some(df: DataFrame, id_col: str, n: int) -> DataFrame:
    """About ``_PROBES`` of ``n`` rows, by a hash of the id."""
    return df.where(F.pmod(F.xxhash64(id_col, F.lit("probe")), F.lit(1_000_000)) < int(1_000_000 * min(1.0, _PROBES / max(n, 1))) + 1)


def _cells_pay(met: float, nl: int, nr: int, rows: int, per_cell: float = cells.ROWS_PER_CELL) -> bool:
    """Whether ``met`` cells a row on average cost less than all pairs in blocks (the result is the same).

    A copy of a row in the shuffle costs about as much as ``copy`` distances."""
    copy = 2048
    whole = copy * (-(-nr // rows) + -(-nl // rows) * nr / max(nl, 1)) + nr
    return met * (copy + per_cell) <= whole


def _topk_window(df: DataFrame, keys: list, order: list, k: int, rank_col: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


def topk_per_group(df: DataFrame, key: str, order: list, k: int, rank_col: str = "rank") -> DataFrame:
    """First k rows per key by ``order`` (make it a total order).

    Ranks up to k are found in each task first (the optimizer's partial group
    limit below the shuffle), so a key that holds a third of the rows sends k
    rows a task to its final ranking.
    """
    return _topk_window(df, [key], order, k, rank_col)


def _sides(queries: DataFrame, reference: DataFrame, q_id: str, r_id: str, vec: str, ref_vec: str | None,
           key: str | None = None) -> tuple[DataFrame, DataFrame]:
    qcols = [F.col(q_id).cast("long").alias("_qid"), F.col(vec).cast("array<double>").alias("_qx")]
    rcols = [F.col(r_id).cast("long").alias("_rid"), F.col(ref_vec or vec).cast("array<double>").alias("_rx")]
    if key:
        qcols.append(F.col(key).alias("_key"))
        rcols.append(F.col(key).alias("_key"))
    return queries.select(*qcols), reference.select(*rcols)


def _keyed_topk(q: DataFrame, r: DataFrame, k: int, key: str, exclude_self: bool, block_rows: int | None) -> DataFrame:
    """``lid, rid, dist``: the k nearest of each pair of blocks with the same key (a cell)."""
    return blocks.cogroup_blocks(q, r, "_qid", "_rid", blocks.topk_kernel(k, "_qid", "_rid", "_qx", "_rx", exclude_self),
                                 "lid long, rid long, dist double", key=key,
                                 block_rows=block_rows or blocks.MAX_BLOCK_ROWS)


def knn(queries: DataFrame, reference: DataFrame, k: int = 5, q_id: str = "id", r_id: str = "id",
        vec: str = "x", ref_vec: str | None = None, exclude_self: bool = False, key: str | None = None,
        block_rows: int | None = None) -> DataFrame:
    """J3/J4 exact cosine k-NN: ``query_id, rank, neighbor_id, dist``.

    Ties are broken by (distance rounded to 9 places, neighbour id);
    ``exclude_self`` drops the pair with equal ids (not list position 0).
    With ``key`` only rows with the same key value are compared (G4).

    Equal rows are one (:func:`equal_rows`), and the reference rows lie in
    cells (:mod:`..plans.cells`).
    Each query meets its own cell first; the k-th distance found there bounds
    the cells that can hold anything better, and only those are met then.
    With a key this is done for keys of more rows than a block.
    """
    q, r = _sides(queries, reference, q_id, r_id, vec, ref_vec, key)
    same = queries is reference and q_id == r_id and ref_vec in (None, vec)
    if key:
        most = block_rows or blocks.DEFAULT_BLOCK_ROWS
        sizes = r.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
        if not same:
            sizes = sizes.unionByName(q.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")))
        large = cut_lineage(sizes.where(F.col("_n") > most).select("_key").distinct())
        cand = blocks.small_keys_topk(q.join(large, "_key", "left_anti"), r.join(large, "_key", "left_anti"), k, "_key", "_qid",
                                      "_rid", "_qx", "_rx", exclude_self)
        if not large.isEmpty():
            cand = cand.unionByName(_class_topk(q.join(large, "_key", "left_semi"), r.join(large, "_key", "left_semi"), k,
                                                exclude_self, block_rows, True, same))
    else:
        cand = _class_topk(q, r, k, exclude_self, block_rows, False, same)
    # candidates per query row are bounded (k per reference block met)
    top = _topk_window(cand, ["lid"], ["dist", "rid"], k, "rank")
    return top.select(F.col("lid").alias("query_id"), F.col("rank").cast("int").alias("rank"),
                      F.col("rid").alias("neighbor_id"), "dist")


def _class_topk(q: DataFrame, r: DataFrame, k: int, exclude_self: bool, block_rows: int | None, key: bool,
                same: bool) -> DataFrame:
    """``lid, rid, dist``: candidates that hold the k nearest rows of each query, equal rows (of a key) met as one."""
    keys = ["_key"] if key else []
    more = k + 1 if exclude_self else k
    refs = equal_rows(r, "_rid", "_rx", more, keys)
    if not same:
        asks = equal_rows(q, "_qid", "_qx", 1, keys)
    else:
        asks = refs and (refs[0].select(F.col("_rid").alias("_qid"), F.col("_rx").alias("_qx"), *keys),
                         refs[1].withColumnRenamed("_rid", "_qid"))
    if refs is None and asks is None:
        return _cell_topk(q, r, k, exclude_self, block_rows, key, same)
    # the k nearest classes by (distance, smallest id) hold the k nearest rows
    found = _cell_topk(q if asks is None else asks[0], r if refs is None else refs[0], more, False, block_rows, key,
                       same and refs is not None and asks is not None)
    cand = _topk_window(found, ["lid"], ["dist", "rid"], more, "rank").drop("rank")
    if refs is not None:
        ids = refs[0].select(F.col("_rid").alias("rid"), "_ids")
        cand = cand.join(ids, "rid").select("lid", F.explode("_ids").alias("rid"), "dist")
        cand = _topk_window(cand, ["lid"], ["dist", "rid"], more, "rank").drop("rank")
    if asks is not None:
        cand = (cand.join(asks[1].select(F.col("_first").alias("lid"), "_qid"), "lid")
                    .select(F.col("_qid").alias("lid"), "rid", "dist"))
    return cand.where(F.col("lid") != F.col("rid")) if exclude_self else cand


#: Up to so many equal rows are compared like any others, if nearly all rows differ.
FEW_EQUAL = 64


def equal_rows(rows: DataFrame, id_col: str, vec: str, keep: int,
               keys: list[str] = ()) -> tuple[DataFrame, DataFrame] | None:
    """Classes of rows with one vector (and equal ``keys``), or None where classes would spare next to nothing.

    First their representatives: ``id_col`` (the smallest id), ``vec``, ``keys``, ``_ids`` (the
    ``keep`` smallest); then ``id_col, _first`` of all rows.  Joins on representatives form
    no pair twice, however many rows are equal.  Which way is taken changes the cost only.
    """
    sizes = rows.groupBy(F.xxhash64(vec, *keys)).agg(F.count(F.lit(1)).alias("c"))
    total, largest, distinct = sizes.agg(F.sum("c"), F.max("c"), F.count(F.lit(1))).first()
    if not total or (largest <= FEW_EQUAL and distinct > 0.9 * total):
        return None
    some = _topk_window(rows.select(id_col, vec, *keys), [vec, *keys], [id_col], keep, "rank")
    firsts = cut_lineage(some.groupBy(vec, *keys).agg(F.sort_array(F.collect_list(id_col)).alias("_ids"))     # keep ids a class
                             .select(F.col("_ids")[0].alias(id_col), vec, *keys, "_ids"))
    members = rows.select(id_col, vec, *keys).join(firsts.select(F.col(id_col).alias("_first"), vec, *keys), [vec, *keys])
    return firsts, members.select(id_col, "_first")


def _cell_topk(q: DataFrame, r: DataFrame, k: int, exclude_self: bool, block_rows: int | None,
               key: bool = False, same: bool = False) -> DataFrame:
    """``lid, rid, dist``: candidates that hold the k nearest rows of each query (``key``: among rows of its ``_key``).

    Where most cells are in reach (measured on some queries), all pairs meet in
    large blocks instead: a row is then copied for each block, not for each cell.
    """
    keys = ["_key"] if key else []
    cell = cells.build(r.select("_rid", "_rx", *keys), "_rid", "_rx")
    q = cut_lineage(q.select("_qid", "_qx", *keys))
    nq, nr = q.count(), cell.rows.count()
    at = (F.concat_ws("/", "_cell", "_key") if key else F.col("_cell")).alias("_at")
    to = cell.rows.select("_rid", "_rx", at)

    def meet(sent):
        # counted first, then dealt out
        return _keyed_topk(cut_lineage(sent.select("_qid", "_qx", at)), to, k, "_at", exclude_self, block_rows)

    first = cut_lineage(meet(cells.reach(q, cell, "_qx", home=True)))

    def bounded(df, found):
        # k candidates a block pair: the k-th best of them is the bound
        kth = (_topk_window(found, ["lid"], ["dist", "rid"], k, "rank").where(F.col("rank") == k)
               .select(F.col("lid").alias("_qid"), F.col("dist").alias("_kth")))
        return df.join(kth, "_qid", "left")

    rows = block_rows or _block_rows(q, nq, nr)
    met = cells.spread(bounded(_some(q, "_qid", nq), _some(first, "lid", nq)), cell, "_qx", "_kth")
    if not _cells_pay(met, nq, nr, rows, nr / max(len(cell.centres), 1)):
        kernel = blocks.topk_kernel(k, "_qid", "_rid", "_qx", "_rx", exclude_self)
        return blocks.cogroup_blocks(q, cell.rows.drop("_cell"), "_qid", "_rid", kernel, "lid long, rid long, dist double",
                                     key="_key" if key else None, block_rows=rows, counts=(nq, nr), symmetric=same)
    return first.unionByName(meet(cells.reach(bounded(q, first), cell, "_qx", "_kth", home=False)))


def pairs_within(rows: DataFrame, eps: float, id_col: str, vec: str, kernel, schema: str,
                 block_rows: int | None = None) -> DataFrame:
    """``kernel`` on blocks in which every pair of ``rows`` within ``eps`` meets.

    Rows are repeated for the cells in reach of ``eps`` (a pair then meets in
    both orders), or where most cells are in reach meet in large blocks.
    """
    cell = cells.build(rows, id_col, vec)
    own = cell.rows.drop("_cell")
    n = own.count()
    large = block_rows or _block_rows(own, n, n)
    if _cells_pay(cells.spread(_some(own, id_col, n), cell, vec, eps), n, n, large, n / max(len(cell.centres), 1)):
        return blocks.cogroup_blocks(cut_lineage(cells.reach(own, cell, vec, eps)), cell.rows, id_col, id_col, kernel, schema,
                                     key="_cell", block_rows=block_rows or blocks.MAX_BLOCK_ROWS)
    return blocks.cogroup_blocks(own, own, id_col, id_col, kernel, schema, block_rows=large, counts=(n, n), symmetric=True)


def k_distance(df: DataFrame, min_samples: int = 3, id_col: str = "id", vec: str = "x",
               block_rows: int | None = None) -> DataFrame:
    """A2: distance to the ``min_samples``-th neighbour counting the row itself
    first, i.e. the (min_samples-1)-th other row: ``id, kdist``."""
    nb = knn(df, df, k=min_samples - 1, q_id=id_col, r_id=id_col, vec=vec, exclude_self=True,
             block_rows=block_rows)
    return (nb.where(F.col("rank") == min_samples - 1)
              .select(F.col("query_id").alias(id_col), F.col("dist").alias("kdist")))


def radius_join(df: DataFrame, eps: float, id_col: str = "id", vec: str = "x",
                block_rows: int | None = None) -> DataFrame:
    """All pairs (a < b) within cosine distance ``eps``: ``a, b, dist``."""
    rows = df.select(F.col(id_col).cast("long").alias("_id"), F.col(vec).cast("array<double>").alias("_x"))
    pairs = pairs_within(rows, eps, "_id", "_x", blocks.radius_pairs_kernel(eps, "_id", "_id", "_x", "_x"),
                         "lid long, rid long, dist double", block_rows)
    return pairs.select(F.col("lid").alias("a"), F.col("rid").alias("b"), "dist")


def neighbor_counts(df: DataFrame, eps: float, id_col: str = "id", vec: str = "x",
                    block_rows: int | None = None) -> DataFrame:
    """Rows within ``eps`` of each row, itself included: ``id, n_eps``.  Equal rows are met as one, with their number."""
    rows = df.select(F.col(id_col).cast("long").alias(id_col), F.col(vec).cast("array<double>").alias(vec))
    classes = equal_rows(rows, id_col, vec, 1)
    if classes is not None:
        sizes = classes[1].groupBy("_first").agg(F.count(F.lit(1)).alias("_w")).withColumnRenamed("_first", id_col)
        rows = classes[0].drop("_ids").join(sizes, id_col)
    kernel = blocks.radius_count_kernel(eps, id_col, id_col, vec, vec, None if classes is None else "_w")
    cnt = pairs_within(rows, eps, id_col, vec, kernel, "lid long, cnt long", block_rows)
    out = cnt.groupBy("lid").agg(F.sum("cnt").alias("n_eps")).withColumnRenamed("lid", id_col)
    if classes is None:
        return out
    return classes[1].join(out.withColumnRenamed(id_col, "_first"), "_first").select(id_col, "n_eps")


def cosine_distance_to_centroid(df: DataFrame, id_col: str, vec: str, group: str) -> DataFrame:
    """J2 over a relational plan: distance of each row to its group centroid.

    Vectors are exploded to (id, pos, value); the centroid is an aggregate per
    (group, pos) and the dot product a grouped sum, so no array math runs
    row-at-a-time and a hot group is just more rows of the same aggregate.
    """
    flat = df.select(id_col, group, F.posexplode(F.col(vec).cast("array<double>")).alias("pos", "v"))
    cent = flat.groupBy(group, "pos").agg(F.avg("v").alias("c"))
    cnorm = cent.groupBy(group).agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("cn"))
    dots = (flat.join(cent, [group, "pos"])
                .groupBy(id_col, group)
                .agg(F.sum(F.col("v") * F.col("c")).alias("dot"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("xn")))
    d = dots.join(cnorm, group)
    dist = F.when((F.col("xn") == 0) | (F.col("cn") == 0), F.lit(1.0)).otherwise(
        1 - F.col("dot") / (F.col("xn") * F.col("cn")))
    return d.select(id_col, group, F.when(dist <= 0, F.lit(0.0)).otherwise(dist).alias("dist"))


def lookup_by_id(ids: DataFrame, ref: DataFrame, id_col: str, ref_id: str | None = None) -> DataFrame:
    """Fetch reference attributes for ids (inner equi-join; AQE picks the
    broadcast side from the measured size)."""
    return ids.join(ref.withColumnRenamed(ref_id, id_col) if ref_id and ref_id != id_col else ref, id_col)


def attach_new_nodes(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, neighbors: DataFrame,
                     id_col: str = "node_id") -> tuple[DataFrame, DataFrame]:
    """New rows become nodes with two directed edges to each neighbour."""
    add = neighbors.select(F.explode(F.array(
        F.struct(F.col("query_id").alias("src"), F.col("neighbor_id").alias("dst")),
        F.struct(F.col("neighbor_id").alias("src"), F.col("query_id").alias("dst")))).alias("e")).select("e.*")
    return nodes.unionByName(new_nodes, allowMissingColumns=True), edges.select("src", "dst").unionByName(add)


def neighborhood_consensus(neighbors: DataFrame, labels: DataFrame, label_col: str = "y",
                           id_col: str = "id") -> DataFrame:
    """Unanimous-0 / unanimous-1 / mixed label of each query's neighbours."""
    j = neighbors.join(labels.select(F.col(id_col).alias("neighbor_id"), F.col(label_col).alias("_y")),
                       "neighbor_id")
    g = j.groupBy("query_id").agg(F.bool_and(F.col("_y") == 0).alias("all0"),
                                  F.bool_and(F.col("_y") == 1).alias("all1"))
    return g.select("query_id", F.when(F.col("all0"), F.lit("unanimous_0"))
                    .when(F.col("all1"), F.lit("unanimous_1")).otherwise(F.lit("mixed")).alias("consensus"))


def knn_vote(neighbors: DataFrame, labels: DataFrame, label_col: str = "y", id_col: str = "id") -> DataFrame:
    """Majority vote of the neighbours' labels and the vote share."""
    j = neighbors.join(labels.select(F.col(id_col).alias("neighbor_id"), F.col(label_col).alias("_y")),
                       "neighbor_id")
    g = j.groupBy("query_id").agg(F.sum("_y").cast("long").alias("n_pos"), F.count(F.lit(1)).alias("n_nbrs"))
    pred = (2 * F.col("n_pos") > F.col("n_nbrs")).cast("int")
    share = F.col("n_pos") / F.col("n_nbrs")
    return g.select("query_id", "n_pos", "n_nbrs", pred.alias("prediction"),
                    F.when(pred == 1, share).otherwise(1 - share).alias("confidence"))


def knn_approx(queries: DataFrame, reference: DataFrame, k: int = 5, q_id: str = "id", r_id: str = "id",
               vec: str = "x", exclude_self: bool = False, target_recall: float = 0.9, sample_rows: int = 256,
               seed: int = 7) -> DataFrame:
    """J3/J4 approximate cosine k-NN: each query meets only its nearest cells.

    How many is measured, not guessed: the exact neighbours of at most
    ``sample_rows`` queries (by a hash of the id) tell in which of its cells,
    by nearness, each neighbour lies; the smallest number that covers
    ``target_recall`` of them (and a margin of 0.03) is used for all queries.
    Cells grow as the square root of the table.  A query whose cells hold
    fewer than k rows gets exact neighbours, so none comes short.  Where so
    many cells are needed that all pairs in blocks cost less (vectors without
    structure in many dimensions), all queries get exact neighbours.  Returns
    the columns of :func:`knn` and ``recall``, the share covered in the sample
    (1 where all are exact).
    """
    q, r = _sides(queries, reference, q_id, r_id, vec, None)
    r, q = cut_lineage(r), cut_lineage(q)
    n = r.count()
    cell = cells.build(r, "_rid", "_rx", rows_per_cell=max(k, math.isqrt(max(n, 1))))
    total = q.count()
    part = F.pmod(F.xxhash64("_qid", F.lit(seed)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, sample_rows / max(total, 1)))
    some = q.where(part).limit(4 * sample_rows)
    truth = knn(some, r, k, "_qid", "_rid", "_qx", "_rx", exclude_self)
    order = cells.nearness(some, cell, "_qx")
    places = (truth.select(F.col("query_id").alias("_qid"), F.col("neighbor_id").alias("_rid"))
                   .join(cell.rows.select("_rid", "_cell"), "_rid").join(order, ["_qid", "_cell"])
                   .groupBy("nth").agg(F.count(F.lit(1)).alias("n")).orderBy("nth").collect())     # one row a cell
    found, probes, all_ = 0, 1, sum(p["n"] for p in places)
    for p in places:
        probes, found = p["nth"] + 1, found + p["n"]
        if found >= min(1.0, target_recall + 0.03) * all_:
            break
    if probes > 1 and not _cells_pay(probes, total, n, _block_rows(q, total, n), n / max(len(cell.centres), 1)):
        exact = knn(queries, reference, k, q_id, r_id, vec, exclude_self=exclude_self)
        return exact.withColumn("recall", F.lit(1.0))
    sent = cells.nearness(q, cell, "_qx", probes).select("_qid", "_qx", "_cell")
    cand = cut_lineage(_keyed_topk(sent, cell.rows, k, "_cell", exclude_self, None))
    have = cand.groupBy("lid").agg(F.count(F.lit(1)).alias("_n"))
    short = q.join(have.where(F.col("_n") >= k), F.col("_qid") == F.col("lid"), "left_anti")
    exact = knn(short, r, k, "_qid", "_rid", "_qx", "_rx", exclude_self)
    top = _topk_window(cand.join(short.select(F.col("_qid").alias("lid")), "lid", "left_anti"), ["lid"], ["dist", "rid"],
                       k, "rank")
    out = top.select(F.col("lid").alias("query_id"), F.col("rank").cast("int").alias("rank"),
                     F.col("rid").alias("neighbor_id"), "dist").unionByName(exact)
    return out.withColumn("recall", F.lit(found / all_ if all_ else 1.0))
