"""Ranked search: ball trees against scores of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from assaygraph.llm import ranked
from assaygraph.llm.queries import QUERIES

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    lower = {c: c + 32 for c in range(65, 91)}
    return TERM.findall((text or "").translate(lower))


def brute(docs, items, k=50):
    counts = [(i, Counter(words(t))) for i, t in docs]
    n_docs, total = sum(1 for _, c in counts if c), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in counts:
            n = sum(c.values())
            m = 50 + 50 * n * n_docs // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m))
                        for t in set(words(text)) if t in c)
            if score > 0:
                scored.append((-score, i is None, i, score))
        best = sorted(scored, key=lambda r: (r[0], r[1], r[2] or 0))[:k]
        out += [(item, r + 1, i, s) for r, (_, _, i, s) in enumerate(best)]
    return sorted(out, key=str)


def data(n=700, seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéß漢") for _ in range(rng.randint(1, 4))) for _ in range(300)]
    prose = lambda k: rng.choice([" ", "-", "\x00, "]).join(rng.choice(vocabulary) for _ in range(k))
    items = [(i, prose(rng.randint(1, 25))) for i in range(25)]
    items += [(25, None), (26, ""), (27, "!? ."), (28, "zzzzz unseen"), (3, items[3][1]), (None, "Ab aB ab")]
    docs = [(i, prose(rng.choice([1, 5, 40, 40, 300]))) for i in range(n)]
    docs += [(n + i, docs[7][1]) for i in range(90)] + [(5000 + i, items[i][1].upper() + " x9 " + prose(5)) for i in range(10)]
    docs += [(n + 100, None), (n + 101, ""), (n + 102, "..."), (None, docs[8][1]), (None, docs[9][1]), (8, docs[8][1]),
             (n + 103, "ab " * 30_000), (2**60 + 1, docs[10][1])]
    rng.shuffle(docs)
    return docs, items


def test_search_equals_scores_of_all_documents(spark):
    docs, items = data()
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumn("score", F.lit(1)).withColumn("item", F.lit(2))
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit(0))
    want = brute(docs, items)
    for options in ({}, {"tree_docs": 50, "leaf": 4}, {"block_items": 7}):
        got = sorted([tuple(r) for r in ranked.search(frame, asked, **options).collect()], key=str)
        assert got == want
    top = ranked.search(frame, asked, k=3)
    assert top.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted([tuple(r) for r in top.collect()], key=str) == brute(docs, items, 3)


def test_empty_tables_and_tables_without_terms(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([("x", "a"), (None, None)], "item_id string, text string")
    assert [tuple(r) for r in ranked.search(docs, items).collect()] == brute([(1, "a b"), (2, None)], [("x", "a")])
    assert ranked.search(docs.limit(0), items).count() == 0
    assert ranked.search(docs, items.limit(0)).count() == 0
    assert ranked.search(docs.where("text is null"), items).count() == 0


def test_bounds_hold_and_prune(spark):
    rng = np.random.default_rng(2)
    n_terms, rows = 400, []
    topics = [rng.choice(n_terms, 30, replace=False) for _ in range(40)]
    for i in range(2000):
        t = np.unique(rng.choice(topics[i % 40], 12))
        rows.append((t, rng.integers(1, 1_000_001, len(t))))
    at = np.cumsum([0, *[len(t) for t, _ in rows]])
    tree = ranked.BallTree(at, np.concatenate([t for t, _ in rows]), np.concatenate([v for _, v in rows]), n_terms)
    queries = ranked.Queries([topics[k][:10].tolist() for k in range(5)], rng.integers(0, 12_000, n_terms))
    bounds = tree.bounds(queries)
    for q in range(5):
        w = np.zeros(n_terms, np.int64)
        w[queries.term[queries.at[q]:queries.at[q + 1]]] = queries.w[queries.at[q]:queries.at[q + 1]]
        score = np.array([int(w[t] @ v) for t, v in rows])
        for node, members in enumerate(tree.rows):
            assert bounds[node, q] >= score[members].max()
    best = [ranked._Best(10) for _ in range(5)]
    leaves = sum(c is None for c in tree.child)
    assert ranked.walk(tree, np.arange(2000), queries, best) < 5 * leaves / 3


def test_query_on_given_tables(spark):
    d = "/root/testdata/sf0.001"
    got = sorted([tuple(r) for r in QUERIES["op12_ball_trees"](spark, d).collect()], key=str)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    assert got == brute(docs, items)
