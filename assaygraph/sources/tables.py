"""Input tables and the assay view derived from them.

The assay view re-expresses the reference's measurement table on the driver's
``events`` table (same expressions in Spark and in the SQL oracle):
material = event_type, dose = value, exposure time text = hour(ts) || 'h',
row_id = event_id and a planted target toxic = dose > per-material median.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ranking import exact_quantiles

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

# Column names of the reference's assay table (fixed values).
MATERIAL = "Material type"
DOSE = "Exposure dose (ug/mL)"
TIME = "Exposure time"
TARGET = "Toxicity"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def assay_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, material, dose, hr, toxic (clean typed assay rows)."""
    ev = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("row_id"), F.col("event_type").alias("material"),
        F.col("value").alias("dose"), F.hour("ts").alias("hr"))
    med = exact_quantiles(ev, "dose", [0.5], ["material"], out="med").drop("q")
    # one row per material: bounded by the category count (AQE broadcasts it)
    return (ev.join(med, "material", "left")
              .select("row_id", "material", "dose", "hr",
                      (F.col("dose") > F.col("med")).cast("int").alias("toxic")))


def assay_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assay rows in the reference's raw text layout."""
    b = assay_base(spark, sf_dir)
    return b.select(
        "row_id",
        F.col("material").alias(MATERIAL),
        F.col("dose").alias(DOSE),
        F.concat(F.col("hr").cast("string"), F.lit("h")).alias(TIME),
        F.when(F.col("toxic") == 1, F.lit("Toxic")).otherwise(F.lit("nonToxic")).alias(TARGET))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as id, x array<double>, label."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"), "label")
