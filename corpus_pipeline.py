"""The training-data pipeline: five stages over ``documents``, each stored as Parquet.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage
before kept.  All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaygraph.llm import bpe, decontamination, lines, packing, simhash, toxicity
from assaygraph.llm.common import folder, maybe_broadcast, stored, table

#: The pipeline's rows: SQL can express neither the learned scores nor the token ids.
ORACLE_SQL = None
#: Sets of up to so many ids (8 bytes each) are broadcast; larger ones are joined by a shuffle.
IDS = 2_000_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts as toxic go."""
    scored = toxicity.score(docs, table(spark, sf_dir, "labels"))
    toxic = scored.where("predicted = 1").select("doc_id").distinct()
    return docs.join(maybe_broadcast(toxic, IDS), "doc_id", "left_anti").select(docs.columns)


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a large share of a source's documents has go from their texts."""
    kept = lines.drop_boilerplate(docs)
    changed = F.when(F.col("_n_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.withColumn("n_chars", F.coalesce(changed, F.col("n_chars"))).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest id."""
    groups = simhash.near_duplicates(docs, shingle_words=3, max_bits=2)
    copies = groups.where("doc_id != component_id").select("doc_id").distinct()
    kept = docs.join(maybe_broadcast(copies, IDS), "doc_id", "left_anti").select(docs.columns)
    # a row that stands there twice is a copy of itself, which ids cannot tell apart
    twice = stored(docs.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated-ids")
    if twice.isEmpty():
        return kept
    twice = maybe_broadcast(twice, IDS)
    once = kept.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(twice, "doc_id", "left_anti").unionByName(once.select(docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go."""
    hits = decontamination.contamination(docs, table(spark, sf_dir, "benchmark"))
    bad = hits.where("contaminated").select("doc_id").distinct()
    return docs.join(maybe_broadcast(bad, IDS), "doc_id", "left_anti").select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 2048: one row for each piece of a document."""
    return packing.pack_documents(docs, bpe.default_path(), 2048, end_id=0)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_boilerplate_lines),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = folder(spark, "stage-" + name.replace(" ", "-"))
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
