"""Periodic runs: the online catchers against brute force, and whole queries on hand rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaygraph.llm import runs
from assaygraph.llm.queries import QUERIES


def brute(words, least=12):
    found = {}
    for p in range(1, len(words) // 2 + 1):
        i = p
        while i < len(words):
            start = i
            while i < len(words) and words[i] == words[i - p]:
                i += 1
            if i - start + p >= max(least, 2 * p):
                found.setdefault((start - p, i), p)
            i += 1
    return sorted((s, e - s, p) for (s, e), p in found.items())


@pytest.mark.parametrize("seed", range(4))
def test_catchers_find_the_runs_of_brute_force_whatever_the_chunks(seed):
    rng = random.Random(seed)
    for _ in range(300):
        n, k = rng.randint(0, 200), rng.choice([1, 2, 2, 3, 5, 40])
        words = [rng.randrange(k) for _ in range(n)]
        for _ in range(rng.randint(0, 3) if n > 20 else 0):
            a = rng.randrange(n - 10)
            p = rng.randint(1, max(1, (n - a) // 2))
            for i in range(a + p, min(n, a + rng.randint(p, 4 * p))):
                words[i] = words[i - p]
        catcher, at = runs.SquareCatcher(rng.choice([1, 12])), 0
        while at < n:
            step = rng.choice([1, 2, 7, 50, 1000])
            catcher.append(words[at:at + step])
            at += step
        assert catcher.runs() == brute(words, catcher.least)


def test_words_of_fibonacci_have_all_their_runs():
    a, b = [0], [0, 1]
    while len(b) < 900:
        a, b = b, b + a
    catcher = runs.SquareCatcher()
    catcher.append(b)
    assert catcher.runs() == brute(b)


def test_long_repetitive_texts_stay_cheap():
    for words, most in ((np.zeros(400_000), 1), (np.arange(400_000) % 777, 1)):
        catcher = runs.SquareCatcher()
        catcher.append(words)
        assert len(catcher.runs()) == most
        assert sum(len(h) for _, h in catcher._hash) < 14 * len(words)


def test_texts_without_runs_nulls_repeats_and_other_columns(spark):
    loop = "a b c " * 5
    rows = [(1, loop + "d", "x"), (1, loop + "d", "y"), (None, loop, "z"), (2, None, "x"), (3, "", "x"), (4, " \t\n", "x"),
            (5, "one two three", "x"), (6, "w " * 12, "x"), (7, "w " * 11, "x"), (8, "é e b " * 6 + "é e", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string").withColumn("id", F.lit(0))
    out = runs.periodic_runs(docs)
    got = sorted([(r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in out.collect()])
    assert got == [(0, 15, [(0, 15, 3)], "a b c"), (1, 16, [(0, 15, 3)], "a b c d"), (1, 16, [(0, 15, 3)], "a b c d"),
                   (2, 0, [], ""), (3, 0, [], ""), (4, 0, [], ""), (5, 3, [], "one two three"), (6, 12, [(0, 12, 1)], "w"),
                   (7, 11, [], " ".join("w" * 11)), (8, 13, [(0, 13, 2)], "é e b")]
    digests = {r.doc_id: r for r in runs.digest(out.where("doc_id in (2, 8)")).collect()}
    assert digests[2][1:6] == (0, None, None, None, None) and digests[8][1:6] == (1, 0, 13, 2, 6500)
    assert digests[2].runs_sha256 == digests[2].collapsed_sha256 == hashlib.sha256(b"").hexdigest()
    assert digests[8].runs_sha256 == hashlib.sha256(b"0,13,2\n").hexdigest()
    assert runs.periodic_runs(docs.limit(0)).count() == 0


def test_longest_run_ties_go_to_the_smallest_start_then_period(spark):
    docs = spark.createDataFrame([(1, "a " * 12 + "x " + "b " * 12)], "doc_id long, text string")
    assert runs.digest(runs.periodic_runs(docs)).first()[1:6] == (2, 0, 12, 1, 12000)


def test_query_equals_brute_force_on_all_documents(spark, tmp_path):
    rng = random.Random(3)
    texts = [(i, " ".join(rng.choice("abcdefghij") + str(rng.randrange(9)) for _ in range(rng.choice([0, 1, 30, 200]))))
             for i in range(600)] + [(600, None), (None, "a b"), (601, "\n")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op13_square_catchers"](spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    planted = 0
    for key, text in texts:
        words = (text or "").split()
        n, h = len(words), zlib.crc32(str(key).encode())
        g = h // 10
        if key is not None and h % 10 == 0 and n > 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        found = brute(words)
        planted += bool(found)
        stays = [not any(s + q <= i < s + m for s, m, q in found) for i in range(n)]
        s, m, q = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        kept = " ".join(w for w, k in zip(words, stays, strict=True) if k)
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in found)
        assert got[key] == (len(found), s, m, q, 1000 * m // q if found else None,
                            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())
    assert planted > 10
