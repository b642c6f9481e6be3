"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import (bpe, covertree, decontamination, licenses, lines, packing, phrases, ranked, runs, sanitise, simhash,
               suffixes, token_files, toxicity)
from .common import folder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn

    return deco


@register("op1_weak_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op2_simhash_pivots")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@register("op3_token_files")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents"), path, bpe.default_path(), end_id=2)
    return token_files.read(spark, path)


@register("op4_phrase_automata")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = phrases.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@register("op5_certified_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), bpe.default_path(), 2048, end_id=0)


@register("op6_positional_index")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op7_information_sanitiser")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitise.digest(sanitise.spans(table(spark, sf_dir, "documents")))


@register("op9_site_lines", """
WITH l AS (
  SELECT d.doc_id, d.source, d.text, i.i, string_split(d.text, chr(10))[i.i] AS line
  FROM documents d, LATERAL (SELECT unnest(generate_series(1, len(string_split(d.text, chr(10))))) AS i) i),
h AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
c AS (SELECT source, trim(line, ' ') AS k, count(DISTINCT doc_id) AS n FROM l GROUP BY ALL),
hot AS (SELECT c.source, c.k FROM c JOIN h ON c.source IS NOT DISTINCT FROM h.source
        WHERE c.k <> '' AND c.n >= 3 AND c.n > h.pages * CAST(0.1 AS DOUBLE)),
f AS (SELECT l.doc_id, l.i, l.line, hot.k IS NOT NULL AS gone
      FROM l LEFT JOIN hot ON l.source IS NOT DISTINCT FROM hot.source AND trim(l.line, ' ') = hot.k),
g AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
             sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
      FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(g.n_lines, 0) AS n_lines, coalesce(g.n_dropped, 0) AS n_dropped,
       coalesce(g.kept_sha256, sha256('')) AS kept_sha256
FROM documents d LEFT JOIN g USING (doc_id)
""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.drop_boilerplate(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"),
                       F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@register("op8_licence_scan")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), F.concat_ws("/", "source", "lang", "doc_id"))


@register("op10_cover_tree")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.near_duplicates(table(spark, sf_dir, "embeddings"))


@register("op11_difference_cover")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffixes.remove_substrings(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"),
                       F.sha2("kept", 256).alias("kept_sha256"))


@register("op12_ball_trees", r"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(
             translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents),
d AS (SELECT doc_id, count(*) AS n FROM w GROUP BY doc_id),
s AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_words FROM d),
f AS (SELECT doc_id, t, count(*) AS tf FROM w GROUP BY ALL),
g AS (SELECT t, count(*) AS df FROM f GROUP BY t),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(
             translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
x AS (SELECT q.item_id, f.doc_id,
             sum(floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2 * df + 1)))::BIGINT
                 * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_words))))::BIGINT AS score
      FROM q JOIN g USING (t) JOIN f USING (t) JOIN d USING (doc_id) CROSS JOIN s GROUP BY ALL),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
      FROM x WHERE score > 0)
SELECT * FROM r WHERE rank <= 50
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op13_square_catchers")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digest(runs.periodic_runs(runs.with_periodic_tails(table(spark, sf_dir, "documents"))))


@register("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
