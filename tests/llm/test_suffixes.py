"""Difference-cover substring dedup against brute force on bytes."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaygraph.llm import suffixes
from assaygraph.llm.queries import QUERIES


def brute(docs, size):
    """``{(id, text): (n_bytes, ranges, kept)}``; null ids are the smallest."""
    rank = lambda key: (key is not None, key or 0)
    raw = [(rank(key), (text or "").encode()) for key, text in docs]
    first = {}
    for key, b in raw:
        for i in range(len(b) - size + 1):
            w = b[i:i + size]
            if w not in first or key < first[w]:
                first[w] = key
    out = []
    for (key, b), (own, _) in zip(raw, docs, strict=True):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - size + 1):
            if first[b[i:i + size]] < key:
                gone[i:i + size] = True
        step = np.flatnonzero(np.diff(gone.view(np.int8), prepend=0, append=0)).tolist()
        out.append((own, len(b), int(gone.sum()), list(zip(step[::2], step[1::2], strict=True)), bytes(np.frombuffer(b, np.uint8)[~gone])))
    return sorted(out, key=repr)


def docs_of(seed, alphabet="abcdeé 漢\n"):
    rng = random.Random(seed)
    prose = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    shared = [prose(rng.choice([12, 20, 45, 60, 200])) for _ in range(8)]
    texts = []
    for _ in range(60):
        parts = [prose(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randint(0, len(s) // 3)
            parts += [s[a:rng.randint(a + 1, len(s))], prose(rng.choice([0, 0, 1, 30]))]
        texts.append("".join(parts))
    texts += [texts[3], texts[3], texts[4] + "x", "x" + texts[5], None, "", "a", "a" * 400, "b" + "a" * 300, "ab" * 200]
    texts += [texts[6][:60] + "#" + texts[6][61:]]
    docs = [(i, t) for i, t in enumerate(texts)]
    docs += [(3, texts[8]), (3, texts[9]), (None, texts[10]), (None, texts[10]), (1000, texts[10]), (1001, "é" * 50)]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize(("size", "seed", "shard_bytes"), [(50, 1, 10**9), (50, 2, 700), (28, 3, 2000), (64, 4, 500), (35, 5, 900)])
def test_removed_bytes_equal_brute_force(spark, size, seed, shard_bytes):
    docs = docs_of(seed, "ab" if seed == 5 else "abcdeé 漢\n")
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    frame = frame.withColumn("shard", F.lit("x")).withColumn("nth", F.lit(0)).withColumn("kept", F.lit(None).cast("int"))
    got = [(r.doc_id, r.n_bytes, r.n_removed, [(x.start, x.end) for x in r.removed], bytes(r.kept))
           for r in suffixes.remove_substrings(frame, size, shard_bytes).collect()]
    assert sorted(got, key=repr) == brute(docs, size)


def test_long_texts_empty_tables_and_small_sizes(spark):
    rng = random.Random(9)
    long_ = "".join(rng.choice("abcdefgh") for _ in range(60_000))
    docs = [(1, long_), (2, long_[30_000:] + "zz"), (3, "q" + long_[:100])]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.removed)) for r in suffixes.remove_substrings(frame).collect()}
    assert got == {1: (60_000, 0, 0), 2: (30_002, 30_000, 1), 3: (101, 100, 1)}
    assert suffixes.remove_substrings(frame.limit(0)).count() == 0
    assert suffixes.remove_substrings(frame.where("doc_id = 3").withColumn("text", F.lit(None).cast("string"))).first().n_bytes == 0
    with pytest.raises(ValueError):
        suffixes.remove_substrings(frame, 20)


def test_residues_cover_all_differences_and_colliding_hashes_are_told_apart(monkeypatch):
    cover = set(suffixes._COVER)
    assert {(a - b) % suffixes._V for a in cover for b in cover} == set(range(suffixes._V))
    monkeypatch.setattr(suffixes, "_mixed", lambda cols: cols[0] % np.uint64(3))
    rng = np.random.default_rng(0)
    cols = [rng.integers(0, 5, 200, np.uint64), rng.integers(0, 4, 200, np.uint64)]
    order, new = suffixes._sorted(cols)
    assert new.sum() == len({*zip(*(c.tolist() for c in cols), strict=True)})
    assert [tuple(c[order][new].tolist()) for c in cols] != []


def test_query_equals_brute_force_on_given_documents(spark):
    d = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = sorted([tuple(r) for r in QUERIES["op11_difference_cover"](spark, d).collect()], key=repr)
    want = [(i, n, k, len(r), hashlib.sha256(kept).hexdigest()) for i, n, k, r, kept in brute(docs, 50)]
    assert got == sorted(want, key=repr)
    assert sum(r[2] for r in got) > 0
