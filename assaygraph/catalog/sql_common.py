"""SQL fragments shared by the DuckDB oracle queries (same expressions as Spark)."""

ASSAY_CTE = """
ev AS (SELECT event_id AS row_id, event_type AS material, value AS dose, hour(ts) AS hr FROM events),
med AS (SELECT material, quantile_cont(dose, 0.5) AS med FROM ev GROUP BY material),
assay AS (SELECT ev.row_id, ev.material, ev.dose, ev.hr, CAST(ev.dose > med.med AS INTEGER) AS toxic
          FROM ev LEFT JOIN med ON ev.material = med.material)
"""

# min-max scaled dose and hour plus the material (one-hot implied by equality)
ASSAY_ENC_CTE = ASSAY_CTE + """,
mm AS (SELECT min(dose) AS dmin, max(dose) AS dmax, min(hr) AS hmin, max(hr) AS hmax FROM assay),
enc AS (SELECT a.row_id, a.material, a.toxic,
          CASE WHEN mm.dmax = mm.dmin THEN 0.0 ELSE (a.dose - mm.dmin) / (mm.dmax - mm.dmin) END AS xd,
          CASE WHEN mm.hmax = mm.hmin THEN 0.0 ELSE CAST(a.hr - mm.hmin AS DOUBLE) / (mm.hmax - mm.hmin) END AS xh
        FROM assay a, mm)
"""

# cosine distance of two encoded assay rows l, r: one-hot part contributes 1 when equal
ASSAY_DIST = """round(CASE WHEN (1 - (l.xd * r.xd + l.xh * r.xh + CASE WHEN l.material = r.material THEN 1 ELSE 0 END)
      / (sqrt(l.xd * l.xd + l.xh * l.xh + 1) * sqrt(r.xd * r.xd + r.xh * r.xh + 1))) <= 0 THEN 0.0
    ELSE 1 - (l.xd * r.xd + l.xh * r.xh + CASE WHEN l.material = r.material THEN 1 ELSE 0 END)
      / (sqrt(l.xd * l.xd + l.xh * l.xh + 1) * sqrt(r.xd * r.xd + r.xh * r.xh + 1)) END, 9)"""

VEC_CTE = """
vec AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS x,
               sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS nrm
        FROM embeddings)
"""

VEC_DIST = """round(CASE WHEN l.nrm = 0 OR r.nrm = 0 THEN 1.0
    WHEN 1 - list_dot_product(l.x, r.x) / (l.nrm * r.nrm) <= 0 THEN 0.0
    ELSE 1 - list_dot_product(l.x, r.x) / (l.nrm * r.nrm) END, 9)"""
