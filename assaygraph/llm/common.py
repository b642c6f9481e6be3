"""Helpers shared by the operators of this package."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole input table, through Spark's reader (any file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read back.

    Cuts the lineage: later jobs read files that outlive any executor.
    """
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def tidy_shuffles(spark: SparkSession):
    """Inside, the shuffle files of each query go when it has ended: for steps that are stored one by one."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def small_enough(df: DataFrame, max_rows: int) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows: the size check before a broadcast."""
    return df.limit(max_rows + 1).count() <= max_rows


def maybe_broadcast(df: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """``df`` with a broadcast hint if it is proven to be small; else as it is (a shuffle join)."""
    return F.broadcast(df) if small_enough(df, max_rows) else df


def unused(columns: list[str], *names: str) -> list[str]:
    """The names with as many underscores in front as it takes to clash with no column."""
    front = "_"
    while any(c.lower() in {(front + n).lower() for n in names} for c in columns):
        front += "_"
    return [front + n for n in names]


def ascii_lower(col):
    """A-Z in lower case, all other characters unchanged."""
    lowered = F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    # a text of one byte a character has no other letters, and is lowered at once
    return F.when(F.octet_length(col) == F.length(col), F.lower(col)).otherwise(lowered)
