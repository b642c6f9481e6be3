"""Derived fixtures used by several queries, stated once for Spark and SQL.

Dirty text variants are derived from whole tables by expression (every row
is kept; a residue of the id only decides which variant a row gets).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.tables import DOSE, MATERIAL, TARGET, TIME, table

DIRTY_ASSAY_SQL = """
dirty AS (
  SELECT event_id AS row_id,
    CASE WHEN event_id % 13 = 0 THEN '  ' || event_type || ' ' ELSE event_type END AS material_text,
    CASE WHEN event_id % 10 = 0 THEN NULL
         WHEN event_id % 10 = 1 THEN replace(CAST(value AS VARCHAR), '.', ',')
         WHEN event_id % 10 = 2 THEN CAST(value AS VARCHAR) || ' ug'
         ELSE CAST(value AS VARCHAR) END AS dose_text,
    CASE WHEN event_id % 7 = 0 THEN NULL
         WHEN event_id % 7 = 1 THEN 'about ' || CAST(hour(ts) AS VARCHAR) || '.5 h'
         ELSE CAST(hour(ts) AS VARCHAR) || 'h' END AS time_text,
    CASE WHEN event_id % 7 = 0 THEN NULL
         WHEN event_id % 7 = 1 THEN CAST(hour(ts) AS VARCHAR) || ',5'
         ELSE CAST(hour(ts) AS VARCHAR) END AS time_num_text,
    CASE event_id % 6 WHEN 0 THEN 'Toxic' WHEN 1 THEN ' non-toxic ' WHEN 2 THEN 'NONTOXIC'
         WHEN 3 THEN CAST(CAST(value > 25 AS INTEGER) AS VARCHAR) WHEN 4 THEN 'nonToxic' ELSE 'maybe' END
      AS label_text
  FROM events)
"""


def dirty_assay(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    i = F.col("event_id")
    v = F.col("value").cast("string")
    hr = F.hour("ts").cast("string")
    return ev.select(
        i.alias("row_id"),
        F.when(i % 13 == 0, F.concat(F.lit("  "), F.col("event_type"), F.lit(" "))).otherwise(F.col("event_type"))
         .alias("material_text"),
        F.when(i % 10 == 0, F.lit(None).cast("string"))
         .when(i % 10 == 1, F.replace(v, F.lit("."), F.lit(",")))
         .when(i % 10 == 2, F.concat(v, F.lit(" ug"))).otherwise(v).alias("dose_text"),
        F.when(i % 7 == 0, F.lit(None).cast("string"))
         .when(i % 7 == 1, F.concat(F.lit("about "), hr, F.lit(".5 h")))
         .otherwise(F.concat(hr, F.lit("h"))).alias("time_text"),
        F.when(i % 7 == 0, F.lit(None).cast("string"))
         .when(i % 7 == 1, F.concat(hr, F.lit(",5"))).otherwise(hr).alias("time_num_text"),
        F.when(i % 6 == 0, F.lit("Toxic")).when(i % 6 == 1, F.lit(" non-toxic "))
         .when(i % 6 == 2, F.lit("NONTOXIC"))
         .when(i % 6 == 3, (F.col("value") > 25).cast("int").cast("string"))
         .when(i % 6 == 4, F.lit("nonToxic")).otherwise(F.lit("maybe")).alias("label_text"))


def dirty_assay_raw(spark, sf_dir):
    """The dirty fixture under the reference's column names plus noise columns."""
    d = dirty_assay(spark, sf_dir)
    return d.select(
        "row_id",
        F.col("material_text").alias("﻿ " + MATERIAL + " "),
        F.col("dose_text").alias(DOSE),
        F.col("time_text").alias(TIME),
        "time_num_text",
        F.col("label_text").alias(TARGET),
        F.lit(None).cast("string").alias("Unnamed: 0"),
        F.lit("MTT").alias("Assay"),
        F.lit(None).cast("double").alias("Viability (%)"))
