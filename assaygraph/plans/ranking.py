"""Skew-safe global positions, prefix sums and exact quantiles.

A ``Window`` without ``partitionBy`` (or partitioned by a key that holds a
third of the rows) sorts everything in one task.  Here rows are instead
range-partitioned on (group, order) with an explicit partition count - a
range partitioner samples the full composite key, so a hot group is spread
over many partitions - sorted inside each partition, numbered with
``monotonically_increasing_id`` (partition index in the upper bits), and the
per-(partition, group) counts - at most partitions + groups rows - give each
partition its offset.  This is ``zipWithIndex`` expressed on DataFrames: the
rows stay in the JVM and never pass through one task or the driver.

The range-partitioned rows are frozen with a reliable ``checkpoint()`` (in
the session's shared checkpoint folder): the range partitioner samples its
input, and two differently pruned uses of one DataFrame could otherwise be
sampled from different layouts.  The checkpoint also makes the numbering
survive executor loss.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import cut_lineage, parallelism, shuffle_partitions


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` that treats NULL = NULL (group keys may be null)."""
    if not keys:
        return left.crossJoin(right) if how == "inner" else left.join(right, how=how)
    renamed = right.select(*[F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = None
    for k in keys:
        part = left[k].eqNullSafe(renamed[f"__r_{k}"])
        cond = part if cond is None else cond & part
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


TARGET_PARTITION_BYTES = 64 << 20


def target_partitions(df: DataFrame) -> int:
    """Range partitions for ``df``: about 64 MB each by the optimizer's size
    estimate (no job; estimates over-count through joins), at least one per
    task slot and at most ``spark.sql.shuffle.partitions``.  Small inputs
    stop paying for hundreds of near-empty tasks and files; large ones keep
    the session's fan-out."""
    cap = max(shuffle_partitions(df.sparkSession), 1)
    try:
        size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())
    except Exception:  # noqa: BLE001 - e.g. Spark Connect: keep the session setting
        return cap
    # at least one partition per task slot: the ranked rows feed later stages
    return max(min(parallelism(df.sparkSession), cap), min(cap, -(-size // TARGET_PARTITION_BYTES)))


def _ranged(df: DataFrame, order_by: Sequence[str | Column], partition_by: Sequence[str],
            num_partitions: int | None):
    n = num_partitions or target_partitions(df)
    keys = [*partition_by, *order_by]
    ranged = (df.repartitionByRange(n, *keys)
                .sortWithinPartitions(*keys)
                .withColumn("_mid", F.monotonically_increasing_id())
                .withColumn("_pid", F.shiftright("_mid", 33)))
    return cut_lineage(ranged)


def with_index(df: DataFrame, order_by: Sequence[str | Column], partition_by: Sequence[str] = (),
               out: str = "idx", num_partitions: int | None = None) -> DataFrame:
    """Add the exact 0-based position of each row inside ``partition_by``.

    ``order_by`` should be a total order (end it with a unique key) when the
    assignment of positions to tied rows matters.  Rows with repeated or
    null keys keep their number: nothing is joined back.
    """
    pb = list(partition_by)
    ranged = _ranged(df, order_by, pb, num_partitions)
    stats = ranged.groupBy("_pid", *pb).agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    w = Window.partitionBy(*pb).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.select("_pid", *pb, "_first", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    # stats has at most partitions + groups rows; without groups it is bounded
    # by the partition count and safe to broadcast, otherwise AQE decides on
    # the measured size.
    if not pb:
        stats = F.broadcast(stats)
    joined = null_safe_join(ranged, stats, ["_pid", *pb])
    return (joined.withColumn(out, F.col("_before") + F.col("_mid") - F.col("_first"))
                  .drop("_mid", "_pid", "_first", "_before"))


def running_sum(df: DataFrame, order_by: Sequence[str | Column], value_cols: Sequence[str],
                partition_by: Sequence[str] = (), prefix: str = "cum_",
                num_partitions: int | None = None) -> DataFrame:
    """Inclusive running sums of ``value_cols`` in ``order_by`` order per group.

    Local sums run in a window keyed by the range partition (bounded size);
    the totals of earlier partitions are added as an offset.
    """
    pb = list(partition_by)
    ranged = _ranged(df, order_by, pb, num_partitions)
    local_w = Window.partitionBy("_pid", *pb).orderBy("_mid").rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.select("*", *[F.sum(c).over(local_w).alias(f"_loc_{c}") for c in value_cols])
    totals = ranged.groupBy("_pid", *pb).agg(*[F.sum(c).alias(f"_tot_{c}") for c in value_cols])
    w = Window.partitionBy(*pb).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_pid", *pb, *[F.coalesce(F.sum(f"_tot_{c}").over(w), F.lit(0)).alias(f"_off_{c}")
                                          for c in value_cols])
    if not pb:
        offsets = F.broadcast(offsets)
    joined = null_safe_join(local, offsets, ["_pid", *pb])
    out = joined.select(*df.columns, *[(F.col(f"_off_{c}") + F.col(f"_loc_{c}")).alias(f"{prefix}{c}")
                                       for c in value_cols])
    return out


def column_quantiles(df: DataFrame, cols: Sequence[str], qs: Sequence[float]) -> DataFrame:
    """``column, q, value``: exact linear quantiles of several columns, all of them in two passes over the rows.

    The first pass is one aggregate with a sketch of each column; its single row gives a bracket for
    each wanted rank.  In the second one, rows below a bracket are only counted, and the few values
    inside are grouped, so no row is joined or sorted.  A bracket that misses its rank is widened to
    the whole column (:func:`exact_quantiles`).  A column without values has no row.
    """
    spark, margin = df.sparkSession, 2.0 / ACCURACY
    x = [F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double") + F.lit(0.0)) for c in cols]
    asked = F.array(*[F.lit(min(1.0, max(0.0, q + d))) for q in qs for d in (-margin, margin)])
    first = df.agg(*[e for i, v in enumerate(x) for e in (
        F.count(v).alias(f"n{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"),
        F.percentile_approx(v, asked, ACCURACY).alias(f"s{i}"))]).first()
    targets = []                                 # number of its bracket, column, q, position, bounds
    for i in range(len(cols)):
        for k, q in enumerate(qs):
            if first[f"n{i}"]:
                a = first[f"lo{i}"] if q <= margin else first[f"s{i}"][2 * k]
                b = first[f"hi{i}"] if q >= 1 - margin else first[f"s{i}"][2 * k + 1]
                targets.append((len(targets), i, float(q), q * (first[f"n{i}"] - 1), float(a), float(b)))
    if not targets:
        return spark.createDataFrame([], "column string, q double, value double")
    inside = F.array(*[F.when((x[i] >= a) & (x[i] <= b), F.struct(F.lit(t).alias("t"), x[i].alias("v")))
                       for t, i, _, _, a, b in targets])
    below = df.agg(*[F.count_if(x[i] < a).alias(f"b{t}") for t, i, _, _, a, _ in targets]).first()
    values = (df.select(F.explode(F.filter(inside, lambda s: s.isNotNull())).alias("s"))
                .groupBy("s.t", "s.v").agg(F.count(F.lit(1)).alias("c")))
    places = spark.createDataFrame([(t, int(below[f"b{t}"]), int(math.floor(pos)), int(math.ceil(pos)))
                                    for t, _, _, pos, _, _ in targets], "t int, below long, lo long, hi long")
    cum = running_sum(values, ["v"], ["c"], ["t"], prefix="upto_").join(F.broadcast(places), "t")     # a row for each bracket
    end = F.col("below") + F.col("upto_c")
    at = lambda p: F.min(F.when((end > F.col(p)) & (end - F.col("c") <= F.col(p)), F.col("v")))
    hit = {r["t"]: r for r in cum.groupBy("t").agg(at("lo").alias("l"), at("hi").alias("h")).collect()}
    out, missed = [], []
    for t, i, q, pos, _, _ in targets:
        r = hit.get(t)
        if r is None or r["l"] is None or r["h"] is None:
            missed.append((i, q))
        else:
            out.append((cols[i], q, r["l"] + (pos - math.floor(pos)) * (r["h"] - r["l"])))
    for i, q in missed:
        out.append((cols[i], q, exact_quantile_value(df.select(x[i].alias("v")), "v", q)))
    return spark.createDataFrame(out, "column string, q double, value double")


#: Rank error of the sketch that brackets a quantile, as a share 1 / ACCURACY of the rows.
ACCURACY = 5000


def exact_quantiles(df: DataFrame, col: str, qs: Sequence[float], partition_by: Sequence[str] = (),
                    out: str = "value") -> DataFrame:
    """Linear-interpolation quantiles (numpy ``linear`` / SQL ``quantile_cont``).

    Exact without sorting the rows: a mergeable sketch brackets each wanted
    rank, one more pass counts the rows below the bracket and groups the few
    values inside by value, and only those are put in order (skew-safe running
    sums, so a bracket may hold any number of values).  A bracket that turns
    out not to hold its rank - the sketch promises an error, it does not prove
    it - is widened to all values of that group.
    Returns ``partition_by..., q, value``; NULLs and NaNs are ignored, a group
    without other values has no row.
    """
    pb = list(partition_by)
    base = df.select(*pb, F.col(col).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    # -0.0 and 0.0 are one value for grouping
    base = base.withColumn("_v", F.col("_v") + F.lit(0.0))
    margin = 2.0 / ACCURACY
    low = F.array(*[F.lit(max(0.0, q - margin)) for q in qs])
    high = F.array(*[F.lit(min(1.0, q + margin)) for q in qs])
    sketch = base.groupBy(*pb).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
                                   F.percentile_approx("_v", low, ACCURACY).alias("_lows"),
                                   F.percentile_approx("_v", high, ACCURACY).alias("_highs"))
    wanted = F.transform(F.array(*[F.struct(F.lit(float(q)).alias("q"), F.lit(i).alias("i")) for i, q in enumerate(qs)]),
                         lambda x: F.struct(x["q"].alias("q"),
                                            F.when(x["q"] <= margin, F.col("_min")).otherwise(F.col("_lows")[x["i"]]).alias("a"),
                                            F.when(x["q"] >= 1 - margin, F.col("_max")).otherwise(F.col("_highs")[x["i"]]).alias("b")))
    sketch = sketch.select(*pb, "_n", "_min", "_max", F.explode(wanted).alias("_w"))
    pos = F.col("_w.q") * (F.col("_n") - 1)
    targets = cut_lineage(sketch.where("_n > 0").select(
        *pb, F.col("_w.q").alias("q"), F.col("_w.a").alias("_a"), F.col("_w.b").alias("_b"), "_min", "_max",
        F.floor(pos).cast("long").alias("_lo"), F.ceil(pos).cast("long").alias("_hi"),
        (pos - F.floor(pos)).alias("_frac")))
    hit = _between(base, targets, pb)
    short = targets.join(hit.select(*[F.col(c).alias(f"_h_{c}") for c in [*pb, "q"]]),
                         _same([*pb, "q"]), "left_anti")
    short = cut_lineage(short)
    if not short.isEmpty():
        hit = hit.unionByName(_between(base, short.withColumns({"_a": F.col("_min"), "_b": F.col("_max")}), pb))
    return hit.select(*pb, "q", (F.col("_vlo") + F.col("_frac") * (F.col("_vhi") - F.col("_vlo"))).alias(out))


def _same(cols: Sequence[str]) -> Column:
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_h_{c}"))
    return cond


def _between(base: DataFrame, targets: DataFrame, pb: list[str]) -> DataFrame:
    """``pb..., q, _frac, _vlo, _vhi`` of the targets whose ranks lie in their bracket ``_a .. _b``."""
    ask = targets.select(*pb, "q", "_a", "_b")
    met = null_safe_join(base, ask, pb) if pb else base.crossJoin(F.broadcast(ask))       # as many rows as quantiles
    inside = F.when(F.col("_v") >= F.col("_a"), F.col("_v"))                              # null: below the bracket
    counts = met.where(F.col("_v") <= F.col("_b")).groupBy(*pb, "q", inside.alias("_x")).agg(
        F.count(F.lit(1)).alias("_c"))
    cum = running_sum(counts, [F.col("_x").asc_nulls_first()], ["_c"], [*pb, "q"], prefix="_upto")
    rows = null_safe_join(cum, targets.drop("_a", "_b"), [*pb, "q"])
    # the value at a position is the first one whose running count passes it; below the bracket is no answer
    at = lambda p: F.min(F.when((F.col("_upto_c") > F.col(p)) & (F.col("_upto_c") - F.col("_c") <= F.col(p)),
                                F.struct(F.col("_x").isNull().alias("miss"), F.col("_x").alias("x"))))
    out = rows.groupBy(*pb, "q").agg(F.first("_frac").alias("_frac"), at("_lo").alias("_l"), at("_hi").alias("_h"))
    return (out.where(F.col("_l").isNotNull() & F.col("_h").isNotNull() & ~F.col("_l.miss") & ~F.col("_h.miss"))
               .select(*pb, "q", "_frac", F.col("_l.x").alias("_vlo"), F.col("_h.x").alias("_vhi")))


def cut_keys(df: DataFrame, col: str, share: float, position: Column, partition_by: Sequence[str] = ()) -> DataFrame:
    """``partition_by..., _value, _take``: the value at a 0-based position of each group's numeric ``col``.

    ``position`` is an expression of the group's row count ``_n`` near ``share * _n``.
    Rows below ``_value`` come before the position, and so do ``_take`` of the rows equal to it.  A
    position beyond the last row gives the greatest value and all of its rows.  No row is sorted:
    a sketch brackets the position, rows below are counted, and values inside are grouped; a
    bracket that misses is widened to the whole group.
    """
    pb = list(partition_by)
    base = df.select(*pb, F.col(col).alias("_v"))
    margin = 2.0 / ACCURACY
    ends = F.percentile_approx("_v", F.array(F.lit(max(0.0, share - margin)), F.lit(min(1.0, share + margin))), ACCURACY)
    sketch = base.groupBy(*pb).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
                                   ends.alias("_ends"))
    pos = F.least(position.cast("long"), F.col("_n"))
    # one row a group, read by every pass below
    ask = cut_lineage(sketch.select(*pb, "_min", "_max", pos.alias("_pos"), F.col("_ends")[0].alias("_a"), F.col("_ends")[1].alias("_b")))

    def located(ask: DataFrame) -> DataFrame:
        near = null_safe_join(base, ask.select(*pb, "_a", "_b"), pb) if pb else base.crossJoin(F.broadcast(ask.select("_a", "_b")))
        inside = F.when(F.col("_v") >= F.col("_a"), F.col("_v"))                    # null: below the bracket
        counts = near.where(F.col("_v") <= F.col("_b")).groupBy(*pb, inside.alias("_x")).agg(F.count(F.lit(1)).alias("_c"))
        cum = running_sum(counts, [F.col("_x").asc_nulls_first()], ["_c"], pb, prefix="_upto")
        rows = null_safe_join(cum, ask.select(*pb, "_pos", "_max"), pb) if pb else cum.crossJoin(F.broadcast(ask.select("_pos", "_max")))
        before = F.col("_upto_c") - F.col("_c")
        hit = (before <= F.col("_pos")) & ((F.col("_pos") < F.col("_upto_c")) | ((F.col("_x") == F.col("_max")) & (F.col("_pos") == F.col("_upto_c"))))
        return rows.where(hit & F.col("_x").isNotNull()).select(*pb, F.col("_x").alias("_value"), (F.col("_pos") - before).alias("_take"))

    found = cut_lineage(located(ask))
    missed = ask.join(found.select(*[F.col(c).alias(f"_h_{c}") for c in pb], F.lit(1).alias("_hit")), _same(pb), "left_anti")
    missed = cut_lineage(missed)
    if not missed.isEmpty():
        found = found.unionByName(located(missed.withColumns({"_a": F.col("_min"), "_b": F.col("_max")})))
    return found


def exact_quantile_value(df: DataFrame, col: str, q: float) -> float | None:
    """Single ungrouped quantile returned to the driver (one number)."""
    row = exact_quantiles(df, col, [q]).first()
    return None if row is None else row["value"]
