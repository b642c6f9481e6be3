"""The pipeline on the smallest tables, and stage by stage against plain versions."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

import __spark_entry__  # noqa: E402
import corpus_pipeline  # noqa: E402
from assaygraph.llm import bpe, lines, toxicity  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage gets and returns."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, SF).cache()
        out.append((name, docs, after))
        docs = after
    return out


def test_names_and_columns(spark, stages):
    assert [n for n, _, _ in stages] == ["toxicity", "line dedup", "simhash near-dedup", "benchmark decontamination",
                                         "best-fit packing"]
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    for _, _, after in stages[:-1]:
        assert [(f.name, f.dataType) for f in after.schema] == [(f.name, f.dataType) for f in schema]
    for n in range(1, 11):
        assert sum(q.startswith(f"op{n}_") for q in __spark_entry__.queries()) == 1
    assert "pipeline" in __spark_entry__.queries()


def test_decisions_take_effect(spark, stages):
    (_, docs, clean), (_, _, cut), (_, _, single), (_, _, fair), (_, _, packed) = stages
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    text = lambda df: {r.doc_id: r.text for r in df.collect()}
    scored = toxicity.score(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert ids(clean) == sorted(r.doc_id for r in scored if not r.predicted)
    want = {r.doc_id: r.text for r in lines.drop_boilerplate(clean).collect()}
    assert text(cut) == want
    comp = {i: c for i, _, c in brute.simhash_rows(list(text(cut).items()))}
    assert ids(single) == sorted(set(comp.values()))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {r[0] for r in brute.contamination(list(text(single).items()), items) if r[-1]}
    assert ids(fair) == sorted(set(ids(single)) - bad)
    got = {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed.collect()}
    assert got == brute.piece_rows(list(text(fair).items()), bpe.default_path())


def test_repeated_rows_count_once(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    few = docs.where("doc_id < 30")
    once = corpus_pipeline.drop_near_duplicates(spark, few, SF)
    twice = corpus_pipeline.drop_near_duplicates(spark, few.unionByName(few.where("doc_id < 10")), SF)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))


def test_empty(spark):
    none = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).collect() == []


@pytest.mark.parametrize("name", ["op9_site_lines"])
def test_oracle(spark, duck, name):
    rows = [tuple(r) for r in __spark_entry__.queries()[name](spark, SF).collect()]
    assert sorted(rows) == sorted(duck.execute(__spark_entry__.oracle_sql()[name]).fetchall())


