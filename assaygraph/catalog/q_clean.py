"""Cleaning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import clean as C
from ..sources.tables import DOSE, MATERIAL, TARGET, TIME, table
from .fixtures import DIRTY_ASSAY_SQL, dirty_assay, dirty_assay_raw
from .registry import register

NUM = r"(\d+\.?\d*)"


@register("normalize_columns", sql="SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def normalize_columns(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    messy = p.toDF("﻿p_partkey", " p_name", "p_brand ", "\tp_type", "p_size", "ｐ_retailprice")
    return C.normalize_columns(messy)


@register("drop_all_null_columns", sql="""
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS VARCHAR) AS o_orderdate,
       o_orderpriority, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS half_null
FROM orders""")
def drop_all_null_columns(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("string"))
    o = o.withColumns({"empty_text": F.lit(None).cast("string"), "empty_num": F.lit(None).cast("double"),
                       "half_null": F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus"))})
    return C.drop_all_null_columns(o)


@register("drop_columns_by_pattern", sql="SELECT p_partkey, p_name, p_brand FROM part")
def drop_columns_by_pattern(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand",
                                            F.col("p_size").alias("Unnamed: 0"), F.col("p_type").alias("unnamed_x"))
    return C.drop_matching(p)


@register("drop_columns_if_present", sql=f"""
WITH {DIRTY_ASSAY_SQL.strip()}
SELECT row_id, dose_text FROM dirty""")
def drop_columns_if_present(spark, sf_dir):
    d = dirty_assay_raw(spark, sf_dir).select("row_id", F.col(f"`{DOSE}`").alias("dose_text"), "Assay",
                                              "Viability (%)")
    return C.drop_present(d)


@register("select_required", sql="SELECT l_quantity, l_discount, l_returnflag FROM lineitem")
def select_required(spark, sf_dir):
    return C.select_required(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_returnflag"])


@register("extract_number", sql=rf"""
SELECT p_partkey,
  coalesce(TRY_CAST(NULLIF(regexp_extract(CAST(p_size AS VARCHAR) || 'h', '{NUM}', 1), '') AS DOUBLE), 0.0) AS size_h,
  coalesce(TRY_CAST(NULLIF(regexp_extract(p_name, '{NUM}', 1), '') AS DOUBLE), 0.0) AS name_num,
  TRY_CAST(NULLIF(regexp_extract(p_brand, '{NUM}', 1), '') AS DOUBLE) AS brand_num
FROM part""")
def extract_number(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey",
                    S.extract_number(F.concat(F.col("p_size").cast("string"), F.lit("h"))).alias("size_h"),
                    S.extract_number(F.col("p_name")).alias("name_num"),
                    S.extract_number(F.col("p_brand"), fill=None).alias("brand_num"))


@register("extract_number_time", sql=rf"""
WITH {DIRTY_ASSAY_SQL.strip()}
SELECT row_id, coalesce(TRY_CAST(NULLIF(regexp_extract(time_text, '{NUM}', 1), '') AS DOUBLE), 0.0) AS time_h
FROM dirty""")
def extract_number_time(spark, sf_dir):
    d = C.extract_number(dirty_assay_raw(spark, sf_dir), TIME)
    return d.select("row_id", F.col(f"`{TIME}`").alias("time_h"))


@register("coerce_numeric", sql=f"""
WITH {DIRTY_ASSAY_SQL.strip()}
SELECT row_id, coalesce(TRY_CAST(dose_text AS DOUBLE), 0.0) AS dose FROM dirty""")
def coerce_numeric(spark, sf_dir):
    d = C.coerce_numeric(dirty_assay_raw(spark, sf_dir), "Exposure dose", 0.0)
    return d.select("row_id", F.col(f"`{DOSE}`").alias("dose"))


@register("decimal_comma", sql=f"""
WITH {DIRTY_ASSAY_SQL.strip()}
SELECT row_id, TRY_CAST(replace(dose_text, ',', '.') AS DOUBLE) AS dose FROM dirty""")
def decimal_comma(spark, sf_dir):
    d = C.decimal_comma(dirty_assay_raw(spark, sf_dir), [DOSE])
    return d.select("row_id", F.col(f"`{DOSE}`").alias("dose"))


LABEL_SQL = """CASE lower(trim(label_text))
    WHEN 'nontoxic' THEN 0 WHEN 'toxic' THEN 1 WHEN 'non-toxic' THEN 0 WHEN 'non toxic' THEN 0
    WHEN '1' THEN 1 WHEN '0' THEN 0 END"""


@register("map_labels", sql=f"""
WITH {DIRTY_ASSAY_SQL.strip()}
SELECT row_id, CAST({LABEL_SQL} AS INTEGER) AS toxicity FROM dirty WHERE {LABEL_SQL} IS NOT NULL""")
def map_labels(spark, sf_dir):
    d = C.map_labels(dirty_assay_raw(spark, sf_dir), TARGET)
    return d.select("row_id", F.col(TARGET).alias("toxicity"))


@register("drop_duplicates_full_row", sql="""
SELECT min(doc_id) AS doc_id, lang, n_chars, md5(text) AS text_md5 FROM documents GROUP BY text, lang, n_chars""")
def drop_duplicates_full_row(spark, sf_dir):
    d = table(spark, sf_dir, "documents").drop("source")   # descriptive column dropped first
    kept = C.drop_duplicates(d, id_col="doc_id")
    return kept.select("doc_id", "lang", "n_chars", F.md5("text").alias("text_md5"))


@register("drop_null_rows", sql=f"""
WITH {DIRTY_ASSAY_SQL.strip()}
SELECT row_id, TRY_CAST(replace(dose_text, ',', '.') AS DOUBLE) AS dose,
       TRY_CAST(replace(time_num_text, ',', '.') AS DOUBLE) AS time, trim(material_text) AS material
FROM dirty
WHERE TRY_CAST(replace(dose_text, ',', '.') AS DOUBLE) IS NOT NULL
  AND TRY_CAST(replace(time_num_text, ',', '.') AS DOUBLE) IS NOT NULL AND material_text IS NOT NULL""")
def drop_null_rows(spark, sf_dir):
    """Batch-scoring front end: P8 on dose and time, P5, then P11."""
    d = dirty_assay_raw(spark, sf_dir).drop(TIME).withColumnRenamed("time_num_text", TIME)
    d = C.decimal_comma(d, [DOSE, TIME])
    d = C.select_required(d, ["row_id", DOSE, TIME, "﻿ " + MATERIAL + " "])
    d = C.drop_null_rows(d, [DOSE, TIME, "﻿ " + MATERIAL + " "])
    return d.select("row_id", F.col(f"`{DOSE}`").alias("dose"), F.col(f"`{TIME}`").alias("time"),
                    F.trim(F.col(f"`﻿ {MATERIAL} `")).alias("material"))


@register("positive_bounds", sql="""
SELECT CASE WHEN NOT (l_quantity - 25 > 0) THEN 'dose must be > 0'
            WHEN NOT (l_discount * 100 - 2 > 0) THEN 'time must be > 0' ELSE 'ok' END AS status,
       CAST(count(*) AS BIGINT) AS n
FROM lineitem GROUP BY 1""")
def positive_bounds(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") - 25).alias("dose"),
                                                 (F.col("l_discount") * 100 - 2).alias("time"))
    ok, bad = C.split_valid(li, {"dose": 0, "time": 0})
    allrows = ok.withColumn("reason", F.lit("ok")).unionByName(bad)
    return allrows.groupBy(F.col("reason").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@register("clean_assay", sql=rf"""
WITH {DIRTY_ASSAY_SQL.strip()},
c AS (
  SELECT row_id, trim(material_text) AS material,
    coalesce(TRY_CAST(dose_text AS DOUBLE), 0.0) AS dose,
    coalesce(TRY_CAST(NULLIF(regexp_extract(time_text, '{NUM}', 1), '') AS DOUBLE), 0.0) AS time,
    CAST({LABEL_SQL} AS INTEGER) AS toxicity
  FROM dirty WHERE {LABEL_SQL} IS NOT NULL)
SELECT min(row_id) AS row_id, material, dose, time, toxicity FROM c GROUP BY material, dose, time, toxicity""")
def clean_assay(spark, sf_dir):
    """P1-P4, P6, P7, P9, P10 chained (the reference's cleaning step)."""
    raw = dirty_assay_raw(spark, sf_dir).drop("time_num_text")
    raw = raw.withColumn("﻿ " + MATERIAL + " ", S.strip(F.col(f"`﻿ {MATERIAL} `")))
    c = C.clean(raw, id_col="row_id")
    return c.select("row_id", F.col(f"`{MATERIAL}`").alias("material"), F.col(f"`{DOSE}`").alias("dose"),
                    F.col(f"`{TIME}`").alias("time"), F.col(TARGET).alias("toxicity"))
