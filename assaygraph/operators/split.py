"""Splits, folds and class weights.

Order-dependent splits use explicit ids and the skew-safe global ranking of
:mod:`assaygraph.plans.ranking`; random assignment uses a hash of id and
seed (stable under any partitioning, reproducible in SQL).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..plans.ranking import cut_keys, null_safe_join, with_index
from ..plans.session import cut_lineage


def mix(id_col: str | Column, seed: int) -> Column:
    """Pseudo-random integer in [0, 16^13) from an id (any number or text) and a seed.

    The first 13 hex digits of md5(id ':' seed): another seed gives an
    unrelated order, no id overflows, and SQL states it in the same way.
    """
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.conv(F.substring(F.md5(F.concat(c.cast("string"), F.lit(f":{int(seed)}")).cast("binary")), 1, 13),
                  16, 10).cast("long")


def mix_sql(id_expr: str, seed: int) -> str:
    return f"CAST(concat('0x', substr(md5(concat(CAST({id_expr} AS VARCHAR), ':{int(seed)}')), 1, 13)) AS BIGINT)"


def _front(df: DataFrame, col: str, share: float, position: Column, out: str, names: tuple[str, str],
           partition_by: list[str], tie_order: list[str]) -> DataFrame:
    """``out`` is the first name for the rows of each group before ``position`` in the order of ``col``, else the second.

    The rows are only filtered against the value at the position.  If rows share that value and
    some of them come before, those alone are put in order by ``tie_order``.
    """
    cut = cut_lineage(cut_keys(df.where(F.col(col).isNotNull()), col, share, position, partition_by))
    joined = null_safe_join(df, F.broadcast(cut) if not partition_by else cut, partition_by, "left")
    first = F.coalesce(F.col(col) < F.col("_value"), F.col(col).isNull() & F.col("_value").isNotNull())
    at_value = cut.where("_take > 0").isEmpty()
    side = joined.withColumn(out, F.when(first, F.lit(names[0])).otherwise(F.lit(names[1])))
    if at_value:
        return side.drop("_value", "_take")
    same = F.coalesce((F.col(col) == F.col("_value")) & (F.col("_take") > 0), F.lit(False))
    ties = with_index(side.where(same), tie_order, partition_by, out="_nth")
    ties = ties.withColumn(out, F.when(F.col("_nth") < F.col("_take"), F.lit(names[0])).otherwise(F.lit(names[1]))).drop("_nth")
    return side.where(~same).unionByName(ties).drop("_value", "_take")


def positional_split(df: DataFrame, id_col: str, frac: float = 0.8, out: str = "split") -> DataFrame:
    """First floor(frac * n) rows by ``id_col`` -> 'train', the rest 'test'.

    Numeric ids are split at the value of that place, without a sort; rows without an id come first.
    Other ids are numbered.
    """
    if isinstance(df.schema[id_col].dataType, NumericType):
        nulls = df.where(F.col(id_col).isNull()).count()
        # the places of the rows with an id, after those without one
        n = F.col("_n") + nulls
        return _front(df, id_col, frac, F.greatest(F.lit(0), F.floor(n * F.lit(frac)) - nulls), out, ("train", "test"), [], [id_col])
    ranked = with_index(df, [id_col], out="_pos")
    cut = int(ranked.count() * frac)
    return ranked.withColumn(out, F.when(F.col("_pos") < cut, F.lit("train")).otherwise(F.lit("test"))).drop("_pos")


def hash_split(df: DataFrame, id_col: str, frac: float = 0.8, seed: int = 42, out: str = "split") -> DataFrame:
    """Seeded random split; a row's side depends only on its id."""
    u = F.pmod(mix(id_col, seed), F.lit(10000))
    return df.withColumn(out, F.when(u < F.lit(int(round(frac * 10000))), F.lit("train")).otherwise(F.lit("test")))


def _class_positions(df: DataFrame, id_col: str, label: str, seed: int) -> DataFrame:
    """Position of each row inside its class in hashed order, plus class size."""
    keyed = df.withColumn("_h", mix(id_col, seed))
    ranked = with_index(keyed, ["_h", id_col], [label], out="_pos")
    sizes = ranked.groupBy(label).agg(F.count(F.lit(1)).alias("_cn"))   # from the checkpointed rows
    return null_safe_join(ranked, sizes, [label])


def stratified_split(df: DataFrame, id_col: str, label: str, test_frac: float = 0.2, seed: int = 43,
                     out: str = "split") -> DataFrame:
    """Per class the first ceil(test_frac * n_c) rows in hashed order go
    to 'test' (exact per-class counts, as a stratified splitter rounds the
    test side up); a class with one row stays in 'train'."""
    keyed = df.withColumn("_h", F.coalesce(mix(id_col, seed), F.lit(-1)))
    n_test = F.when(F.col("_n") <= 1, F.lit(0)).otherwise(F.ceil(F.col("_n") * F.lit(test_frac)))
    return _front(keyed, "_h", test_frac, n_test, out, ("test", "train"), [label], ["_h", id_col]).drop("_h")


def stratified_folds(df: DataFrame, id_col: str, label: str, k: int = 5, seed: int = 43,
                     out: str = "fold") -> DataFrame:
    """fold = (position inside the class in hashed order) mod k."""
    p = _class_positions(df, id_col, label, seed)
    return p.withColumn(out, F.pmod(F.col("_pos"), F.lit(k)).cast("int")).drop("_h", "_pos", "_cn")


def class_weights(df: DataFrame, label: str, train_col: str | None = None, n_classes: int | None = None) -> DataFrame:
    """w_c = N / (C * max(count_c, 1)) with counts on the train rows and
    C = max label + 1 over all rows.  Returns ``label, count, weight``."""
    spark = df.sparkSession
    if n_classes is None:
        n_classes = int(df.agg(F.max(label)).first()[0]) + 1
    src = df.where(F.col(train_col)) if train_col else df
    counts = src.groupBy(label).agg(F.count(F.lit(1)).alias("count"))
    grid = spark.range(n_classes).select(F.col("id").cast("int").alias(label))
    c = grid.join(counts, label, "left").fillna(0, ["count"])
    total = F.sum("count").over(Window.partitionBy())  # C rows only
    return c.select(label, F.col("count").cast("long").alias("count"),
                    (total / (F.lit(n_classes) * F.greatest(F.col("count"), F.lit(1)))).alias("weight"))
