"""Each operator against a brute-force version, on a table with all the awkward rows."""

from __future__ import annotations

import hashlib
import random
import re
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from assaygraph.llm import (bpe, covertree, decontamination, licenses, lines, packing, phrases, sanitise,  # noqa: E402
                            simhash, token_files, toxicity)
from assaygraph.llm.common import folder  # noqa: E402

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, row long, pos int, term string, fp long, "
          "bin long, shard int, host string, component long, _n long, w string")
ITEMS = [(1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "one two THREE"), (3, None),
         (4, ""), (5, "..."), (6, "to to to to to to to to to to to"), (7, "one two three"),
         (8, "absent words only here and nowhere else at all anywhere indeed")]


def _rows():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    texts = [prose(rng.randint(1, 120)) for _ in range(60)]
    long_ = prose(6000)
    shared = prose(60)
    texts += [None, "", "  \n\t ", "a", "A b", "x" * 5000, long_, long_ + " tail", "\n".join([prose(9)] * 4)]
    texts += [texts[3]] * 5 + [texts[4].upper()] + [texts[5] + " zz"]
    texts += [f"{prose(15)} {shared} {prose(10)}" for _ in range(8)]
    texts += ["to " * 80, "To to\x0bTO " * 30, "é è ê ß 漢字 " * 20, " " + prose(25) + " end", "😀 " * 40]
    texts += [f"{prose(5)} {ITEMS[0][1]}!! {prose(5)}", "one, two; three.", "ONE two three four", "zero one two"]
    texts += ["Menu\n" + prose(20) + "\n  Menu  \n\nfooter"] * 14
    texts += ["mail bob.x@ex-ample.co.uk now, 10.0.0.1 or 256.1.1.1 or 1.2.3.4.5; a@b.c_x@d.e @ x@y",
              "card 4111 1111 1111 1111 and 4111-1111-1111-1112, 1234567890123456789012345, 79927398713 00000000000000",
              "+1 (499) 555-6503 or +123 or +44 20 7946 0958 end +1-2-3-4-5-6-7-8-9-0-1-2-3-4-5-6 é +49(0)301234567",
              "007.000255.1.1 9.9.9.9x 1.1.1.1@mail.org +1.1.1.1.1234567"]
    for i in range(6):
        texts.append(f"{prose(6)} Zorblax secretname sam@corp{i % 2}.org Quuxville {prose(6)}")
    return [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or ""), 7, 1, "t", 3, 9, 0, "h", 1, 2, "w")
            for i, t in enumerate(texts)]


ROWS = _rows()
PAIRS = [(r[0], r[1]) for r in ROWS]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def twice(spark):
    """Repeated rows and rows without an id."""
    rows = [r for r in ROWS if r[0] in (2, 3, 60, 70)] * 2 + [(None, *ROWS[3][1:]), (None, None, *ROWS[3][2:])]
    return spark.createDataFrame(rows, SCHEMA)


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.select(*cols).collect()), key=repr)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# 2: SimHash


def test_simhash(docs, none, twice):
    want = sorted(brute.simhash_rows(PAIRS), key=repr)
    assert rows_of(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == want
    assert simhash.near_duplicates(none).collect() == []
    got = rows_of(simhash.near_duplicates(twice), "doc_id", "component_id")
    assert len(got) == 10 and sum(k is None for k, _ in got) == 2
    assert Counter(k for k, _ in got)[3] == 2


def test_simhash_links_in_crowded_cells(spark):
    """Dense balls of fingerprints, few pivots, small blocks: no link is lost."""
    rng = random.Random(1)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for _ in range(3):
        centre = rng.getrandbits(64)
        fps |= {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(150)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    found = simhash.links(df, 2, max_pivots=7, block_rows=40).collect()
    linked = [(a, b) for n, a in enumerate(signed) for b in signed[n + 1:] if ((a ^ b) & (2**64 - 1)).bit_count() <= 2]
    assert brute.components(signed, [(r.a, r.b) for r in found]) == brute.components(signed, linked)


# 3 and 5: tokens


def test_encoder_equals_library():
    from tokenizers import Tokenizer

    path, rng = bpe.default_path(), random.Random(2)
    own, theirs = bpe.encoder(path), Tokenizer.from_file(path)
    parts = [" ", "  ", "\n", "\t", "a", "b'll", "'s", "12", "é", " ", "　", "!", "<|endoftext|>", "\x1c", "\x85",
             "the", "word.", "😀", "\r\n", "漢"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)] + [t or "" for _, t in PAIRS]
    for t in texts:
        assert own.encode(t) == b"".join(i.to_bytes(4, "little") for i in theirs.encode(t, add_special_tokens=False).ids)


def test_variable_length_coding():
    import numpy as np

    rng = np.random.default_rng(3)
    for n in (0, 1, 3, 4, 5, 1000):
        ranks = (rng.integers(0, 2**32, n, dtype=np.uint64) >> rng.integers(0, 32, n).astype(np.uint64)).astype(np.uint32)
        control, data = token_files.encode_ranks(ranks)
        assert len(control) == -(-n // 4)
        assert (token_files.decode_ranks(control, data, n) == ranks).all()


def test_token_files(spark, docs, none, twice):
    path = folder(spark, "t")
    token_files.write(docs, path, bpe.default_path(), block_tokens=500)
    got = rows_of(token_files.read(spark, path), "doc_id", "start", "n_tokens", "ids_crc32")
    assert sorted(got) == brute.token_rows(PAIRS, bpe.default_path(), 2)
    book = [tuple(r) for r in spark.read.parquet(f"{path}/codebook").orderBy("rank").select("n", "token", "rank").collect()]
    assert [r[2] for r in book] == list(range(len(book))) and book == sorted(book, key=lambda r: (-r[0], r[1]))
    path = folder(spark, "t")
    token_files.write(none, path, bpe.default_path())
    assert token_files.read(spark, path).collect() == []
    path = folder(spark, "t")
    token_files.write(twice, path, bpe.default_path())
    got = sorted(token_files.read(spark, path).select("start", "n_tokens", "doc_id").collect())
    assert [r[2] for r in got] == [None, None, 2, 2, 3, 3, 60, 60, 70, 70]
    assert [r[0] for r in got] == [sum(r[1] for r in got[:i]) for i in range(len(got))]


SPILL = """
import random, sys
from pyspark.sql import SparkSession
from assaygraph.llm import bpe, token_files
spark = (SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[1])
         .config("spark.shuffle.spill.numElementsForceSpillThreshold", "700").getOrCreate())
texts = [(k, f"w{k % 97} " * (k % 5)) for k in range(20_000)]
random.Random(1).shuffle(texts)
docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
token_files.write(docs, sys.argv[1] + "/out", bpe.default_path(), block_tokens=300, partitions=3)
start = 0
for k, row in enumerate(token_files.read(spark, sys.argv[1] + "/out").orderBy("doc_id").collect()):
    assert (row.doc_id, row.start) == (k, start), (k, row, start)
    start += row.n_tokens
assert k == 19_999
"""


def test_token_files_keep_their_order_when_sorts_spill(tmp_path):
    """In a session of its own: the threshold that makes sorts spill is read when Spark starts."""
    run = subprocess.run([sys.executable, "-c", SPILL, str(tmp_path)], cwd=Path(__file__).parents[2], timeout=300,
                         capture_output=True, text=True, check=False)
    assert run.returncode == 0, run.stderr[-2000:]


def _check_packing(got, want, capacity):
    assert {r[:5] for r in got} == want and len(got) == len(want)
    bins = {}
    for r in got:
        bins.setdefault(r[5], []).append((r[6], r[3]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing(docs, none, twice):
    cols = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    got = rows_of(packing.pack_documents(docs, bpe.default_path(), 512), *cols)
    n = _check_packing(got, brute.piece_rows(PAIRS, bpe.default_path(), capacity=512), 512)
    assert n <= -(-sum(r[3] for r in got) // 512) + 1
    assert packing.pack_documents(none, bpe.default_path()).collect() == []
    assert len(packing.pack_documents(twice, bpe.default_path()).collect()) == 10


def test_best_fit_and_bounds():
    import numpy as np

    rng = np.random.default_rng(4)
    for top in (30, 60, 100):
        sizes = rng.integers(1, top, 400)
        bins = packing.best_fit(sizes, 100)
        load = np.bincount(bins, sizes)
        assert load.max() <= 100 and packing.lower_bound(sizes, 100) <= len(load) <= packing.lower_bound(sizes, 100) * 1.1 + 1
    assert packing.lower_bound(np.array([51] * 10), 100) == 10          # the sum alone proves 6
    assert packing.lower_bound(np.array([34] * 6), 100) == 3
    assert packing.lower_bound(np.array([], dtype=int), 100) == 0


def test_repacking_does_not_lose_items(spark):
    rng = random.Random(6)
    sizes = [rng.randint(1, 99) for _ in range(900)]
    items = spark.createDataFrame(list(enumerate(sizes)), "item long, length long")
    got = packing.pack(items, 100, group_rows=50, rounds=4).collect()
    assert sorted((r.item, r.length) for r in got) == list(enumerate(sizes))
    load = Counter()
    for r in got:
        load[r.bin] += r.length
    one = packing.pack(items, 100, group_rows=50, rounds=1).select("bin").distinct().count()
    assert max(load.values()) <= 100 and len(load) <= one


# 4: repeated phrases


def test_phrases(docs, none, twice):
    out = phrases.remove_repeats(docs, shard_chars=3000)
    got = rows_of(out.withColumn("sha", F.sha2("kept", 256)), "doc_id", "n_words", "n_removed", "sha")
    assert sorted(got) == sorted(brute.repeated_windows(PAIRS))
    for r in out.collect():
        assert r.n_removed == sum(s.end - s.start for s in r.removed)
    assert phrases.remove_repeats(none).collect() == []
    got = rows_of(phrases.remove_repeats(twice), "doc_id", "n_words", "n_removed")
    assert len(got) == 10
    whole = [r for r in got if r[0] == 2]
    assert sorted(r[2] for r in whole) == [0, whole[0][1]] or whole[0][1] < 20


def test_phrases_with_many_automata(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(90)]
    base = [" ".join(rng.choices(words, k=120)) for _ in range(6)]
    rows = [(i, " ".join(rng.choice(base).split()[rng.randint(0, 60):][:rng.randint(10, 70)] + rng.choices(words, k=9)
                         + rng.choice(base).split()[rng.randint(0, 60):])) for i in range(60)]
    rows += [(100 + i, "a b " * (10 + i)) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = phrases.remove_repeats(df, shard_chars=4000, automaton_blocks=7)
    got = rows_of(out.withColumn("sha", F.sha2("kept", 256)), "doc_id", "n_words", "n_removed", "sha")
    assert sorted(got) == sorted(brute.repeated_windows(rows))


def test_runs_before_those_of_an_earlier_automaton():
    """A near copy with one changed word: its later run is found by the first automaton, its earlier run by the second."""
    body = [b"w%d" % i for i in range(200)]
    texts = [body[100:120], body, [*body[:90], b"other", *body[91:]]]
    passages = [(0, 0, 1), (1, 0, 181)]                     # the first one puts a block of the second into automaton 1
    found = {(a, b) for d, a, b in phrases._locate(texts, passages, 20, 2) if d == 2}
    assert {(0, 90), (91, 200)} <= found


# 6: decontamination


def test_contamination(spark, docs, none, twice):
    items = spark.createDataFrame([(*i, 5) for i in ITEMS], "item_id long, text string, term int")
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    got = rows_of(decontamination.contamination(docs, items), *cols)
    assert sorted(got) == sorted(brute.contamination(PAIRS, ITEMS))
    assert sum(r[-1] for r in got) >= 5
    assert decontamination.contamination(none, items).collect() == []
    empty = decontamination.contamination(docs, items.limit(0))
    assert rows_of(empty, "doc_id", "n_hit", "contaminated") == sorted(((i, 0, False) for i, _ in PAIRS), key=repr)
    got = decontamination.contamination(twice, items).collect()
    assert len(got) == 10 and sum(r.doc_id is None for r in got) == 2


def test_index_and_proximity(spark, docs):
    items = spark.createDataFrame([(1, "gamma alpha"), (2, "three one")], "item_id long, text string")
    index = decontamination.build_index(docs, folder(spark, "t"))
    assert index.where(F.col("term") != decontamination.END).count() == sum(len(brute._test_words(t)) for _, t in PAIRS)
    one, _ = decontamination.windows(items)
    near = decontamination.proximity_matches(index, one, slop=5).join(one, "w")
    rows = {tuple(r.words): 0 for r in one.collect()}
    for r in near.collect():
        rows[tuple(r.words)] += 1
    assert rows == {("gamma", "alpha"): 1, ("three", "one"): 2}
    assert decontamination.phrase_matches(index, one).collect() == []


def test_index_keeps_the_postings_of_a_term_together(spark):
    """A part is in order of the terms' hashes: no words are compared."""
    texts = spark.createDataFrame([(i, f"w{i % 7} Shared w{i % 5} ÀB{i} shared") for i in range(60)], "doc_id long, text string").coalesce(1)
    index = decontamination.build_index(texts, folder(spark, "t"))
    got = [r.term for r in index.select("term").coalesce(1).collect()]
    runs = [t for i, t in enumerate(got) if not i or got[i - 1] != t]
    assert len(runs) == len(set(got)) and {"w3", "shared", "Àb59", decontamination.END} <= set(got)
    hashes = [r[0] for r in spark.createDataFrame([(t,) for t in runs], "t string").coalesce(1).select(F.xxhash64("t")).collect()]
    assert hashes == sorted(hashes)


# 7: personal data


def test_spans(docs, none, twice):
    found = sanitise.spans(docs, min_documents=2)
    got = {r.doc_id: r for r in sanitise.digest(found).collect()}
    assert len(got) == len(PAIRS)
    for i, t in PAIRS:
        base = brute.personal(t)
        assert got[i].base_sha256 == sha(",".join(f"{k}:{a}:{b}" for k, a, b in base)), (i, t, got[i].spans)
        counts = Counter(k for k, _, _ in base)
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(counts[k] for k in sanitise.PATTERNS)
    assert sanitise.digest(sanitise.spans(none)).collect() == []
    assert sanitise.digest(sanitise.spans(twice)).count() == 10


def test_disclosing_terms(docs):
    clean = {r.doc_id: r.sanitised for r in sanitise.sanitise(docs, min_documents=2).select("doc_id", "sanitised").collect()}
    for i, t in PAIRS:
        if t and "Zorblax" in t:
            assert "[email]" in clean[i] and "sam@corp" not in clean[i]
            for word in ("Zorblax", "secretname", "Quuxville"):
                assert word not in clean[i], clean[i]
        elif not brute.personal(t):
            assert clean[i] == t


def test_disclosure_is_by_corpus_counts(spark):
    """A word that is everywhere tells nothing, one that is only beside the address tells all."""
    rows = [(i, f"common filler text number{i} here") for i in range(50)]
    rows += [(100 + i, f"common zanzibar anna@corp.org common quokka{i}") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sanitise.entities(df)
    risky, _ = sanitise.disclosing_terms(df, found, 0.5, 3)
    assert [(r.term, round(r.share, 3), r.action) for r in risky.collect()] == [("zanzibar", 1.0, "removed")]


def test_terms_of_entities_in_one_document(spark):
    """With the parameters as the query has them: a word beside an address of one document, and again further on.

    A rare word that is only far from it (quagga) is chance, as every rare word of a document would be.
    """
    filler = " ".join(f"filler{k}" for k in range(40))
    rows = [(i, f"common {filler} other{i % 9}") for i in range(60)]
    rows += [(100, f"common {filler} Zanzibar anna@corp.org {filler} common zanzibar é quagga.")]
    rows += [(101, "common quokka bob@corp.org 10.0.0.1"), (102, "common quokka bob@corp.org other1")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    texts = dict(rows)
    got = {}
    for r in sanitise.spans(df).where("kind in ('generalised', 'removed')").collect():
        got.setdefault(r.doc_id, []).append((texts[r.doc_id][r.start:r.end], r.kind))
    assert {k: sorted(v) for k, v in got.items()} == {
        100: [("Zanzibar", "removed"), ("zanzibar", "removed")],
        101: [("quokka", "removed")], 102: [("quokka", "removed")]}


def test_copies_are_one_context_and_other_documents_are_several(spark):
    """A word far from the entity counts if documents with different words around it hold both, not if copies do."""
    filler = [" ".join(f"filler{k}" for k in range(a, a + 30)) for a in range(6)]
    rows = [(i, f"common {filler[i % 6]} other{i}") for i in range(60)]
    copy = f"ann@corp.org common common common common {filler[0]} left quokka right {filler[0]}"
    rows += [(100 + i, copy) for i in range(4)]
    rows += [(200 + i, f"bob@corp.org common common common common {filler[i]} left{i} zanzibar right{i} {filler[i]}") for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    risky, _ = sanitise.disclosing_terms(df, sanitise.entities(df))
    assert [(r.entity, r.term, r.action) for r in risky.collect()] == [("email:bob@corp.org", "zanzibar", "removed")]


def test_sanitiser_with_production_parameters_takes_few_words(spark):
    """On the given documents with a planted name beside each of ten addresses, and one name in documents apart."""
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    planted = [(10**6 + i, f"ask Brannoxid{i} person{i}@planted.org for more " + "of the words here " * 20) for i in range(10)]
    df = given.unionByName(spark.createDataFrame(planted, "doc_id long, text string"))
    found = sanitise.spans(df)
    texts = {r.doc_id: r.text or "" for r in df.collect()}
    words, added, names = 0, 0, set()
    for r in found.where("kind is not null").groupBy("doc_id").agg(F.collect_list(F.struct("kind", "start", "end")).alias("x")).collect():
        if r.doc_id < 10**6:
            words += len(texts[r.doc_id].split())
            added += sum(x.kind in sanitise.ADDED for x in r.x)
        else:
            names |= {texts[r.doc_id][x.start:x.end] for x in r.x if x.kind in sanitise.ADDED}
    assert names >= {f"Brannoxid{i}" for i in range(10)} and not names & {"the", "words"}
    assert 0 < added < 0.05 * words, (added, words)
    print("added", added, "of", words)


# 8: licences


def test_licences(spark, none):
    rows = [(1, "a/b/1", "Released under the MIT License.\nsome words"), (2, "a/b/2", "plain words"), (3, "a/b/c/3", "more"),
            (4, "a/4", "x"), (5, "a/b/c/5", "text\nLicensed under the Apache License, Version 2.0."), (6, None, "none"),
            (7, "a/b/7", None), (8, "a/b/8", ""), (9, "z/9", "\n  \nThis work is licensed under CC BY-NC 4.0."),
            (10, "z/y/10", "word " * 70 + "Released under the MIT License. " + "word " * 70), (11, "z/y/11", "licence of birds"),
            (12, "a/b/12", "Released under the MIT License."), (13, "a/b/13", "Licensed under CC BY 4.0.")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, path string, text string, dir int")
    got = {r.doc_id: (r.licence, r.origin, r.directory) for r in licenses.scan(df, F.col("path")).collect()}
    assert got[1] == ("MIT", "file", None) and got[2] == ("MIT", "inherited", "a/b") == got[7] == got[8]
    assert got[3] == ("MIT", "inherited", "a/b") and got[4] == (None, "none", None) == got[6]
    assert got[5] == ("Apache-2.0", "header", None) and got[9][:2] == ("CC-BY-NC-4.0", "file")
    assert got[11] == ("CC-BY-NC-4.0", "inherited", "z") and got[13] == ("CC-BY-4.0", "file", None)
    assert licenses.scan(none, F.col("host")).collect() == []


GPL = """/*
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 */
int main() { return 0; }
"""


def test_licence_headers_files_and_tags(spark):
    noise = "quorn vellum ".split()
    mit = next(t for n, t in licenses.TEMPLATES if n == "MIT" and len(t) > 300)
    apache = next(t for n, t in licenses.TEMPLATES if n == "Apache-2.0" and len(t) > 400).split()
    bsd = {n: next(t for m, t in licenses.TEMPLATES if m == n and len(t) > 300) for n in ("BSD-2-Clause", "BSD-3-Clause")}
    wrapped = "\n".join("# " + " ".join(apache[k:k + 9]) for k in range(0, len(apache), 9))
    texts = {1: ("GPL-3.0", "#!/bin/sh\n" + GPL), 2: ("MIT", "// SPDX-License-Identifier: MIT\ncode"),
             3: ("Apache-2.0", "import os\n" + wrapped + "\nx = 1"), 4: ("MIT", "MIT License\n\nCopyright (c) 2020 Someone\n\n" + mit),
             5: ("MIT", " ".join(noise * 300) + " Released under the MIT License. " + " ".join(noise * 300)),
             6: ("GPL-2.0", GPL.replace("version 3", "version 2").replace("software:", "software;")),
             7: ("BSD-3-Clause", bsd["BSD-3-Clause"]), 8: ("BSD-2-Clause", "-- " + bsd["BSD-2-Clause"].replace(". ", ".\n-- ")),
             9: (None, "The license of birds is a copyright of the commons, said nobody with permission."),
             10: ("CC-BY-SA-4.0", "x " * 4000 + "Licensed under CC BY-SA 4.0."), 11: ("MIT", "Released under the MIT License."),
             12: ("MIT", "Released under the MIT License.")}
    rows = [(k, f"d{k}/f", t, 1, "t") for k, (_, t) in texts.items()] + [(7, "d7/f", texts[7][1], 1, "t"), (13, "d7/sub/x", None, 1, "t")]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string, row int, term string").repartition(3)
    got = sorted([(r.doc_id, r.licence, r.origin) for r in licenses.scan(df, F.col("path")).collect()])
    want = {k: n for k, (n, _) in texts.items()}
    assert [g[:2] for g in got] == sorted([*want.items(), (7, "BSD-3-Clause"), (13, "BSD-3-Clause")], key=lambda r: r[0])
    origin = {k: o for k, _, o in got}
    assert origin[1] == origin[3] == origin[5] == origin[10] == "header" and origin[8] == origin[7] == origin[2] == "file"
    assert origin[13] == "inherited" and origin[9] == "none"


def test_licence_cosine_equals_brute_force(spark):
    import math

    texts = ["licensed under the apache license 2.0", "released under the mit license", "copyright all rights reserved by nobody",
             "spdx license identifier mit", "license license license of the birds"]
    df = spark.createDataFrame([(t, k + 1) for k, t in enumerate(texts)], "text string, n long")
    got = {r.text: (r.licence, r.similarity) for r in licenses.classify(df, 0.05).collect()}
    split = lambda t: re.findall(r"[^\W_]+(?:\.[0-9]+)*", t.lower())
    sides = [(n, Counter(split(t))) for n, t in licenses.TEMPLATES]
    n_all = Counter()
    for k, t in enumerate(texts):
        n_all.update({w: k + 1 for w in set(split(t))})
    for _, c in sides:
        n_all.update(c.keys())
    total = sum(range(1, len(texts) + 1)) + len(sides)
    vector = lambda c: {w: (1 + math.log(k)) * (math.log((1 + total) / (1 + n_all[w])) + 1) for w, k in c.items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    for t in texts:
        own = vector(Counter(split(t)))
        best = min((-round(sum(own.get(w, 0) * x for w, x in vector(c).items()) / norm(own) / norm(vector(c)), 9), n) for n, c in sides)
        assert got[t] == (best[1], pytest.approx(-best[0], abs=1e-8))


# 9: lines


def test_lines(docs, none, twice):
    out = lines.drop_boilerplate(docs, 0.1, 3)
    hosts, counts = Counter(r[3] for r in ROWS), Counter()
    for r in ROWS:
        counts.update({(r[3], x.strip(" ")) for x in (r[1] or "").split("\n")} - {(r[3], "")})
    hot = {k for k, n in counts.items() if n >= 3 and n > hosts[k[0]] * 0.1}
    assert hot
    for r in out.collect():
        t = ROWS[r.doc_id][1]
        all_ = t.split("\n") if t is not None else []
        kept = [x for x in all_ if (r.source, x.strip(" ")) not in hot]
        assert (r._n_lines, r._n_dropped) == (len(all_), len(all_) - len(kept))
        assert r.text == (None if t is None else "\n".join(kept))
    assert out.columns == docs.columns + ["_n_lines", "_n_dropped"]
    clash = docs.withColumns({c: F.lit("mine") for c in ("_all", "_host", "__hot", "_kept", "_new")})
    assert {r._all + r._host + r["__hot"] + r._kept + r._new for r in lines.drop_boilerplate(clash).collect()} == {"mine" * 5}
    few = clash.select("doc_id", F.lit("s").alias("source"), F.concat(F.lit("own"), "doc_id", F.lit("\nfooter")).alias("text")).limit(9)
    assert {r._n_dropped for r in lines.drop_boilerplate(few).collect()} == {1}      # on 9 of 9 pages
    assert lines.drop_boilerplate(none).collect() == []
    assert lines.drop_boilerplate(twice).count() == 10


# 10: cover trees


def _vectors():
    rng = random.Random(8)
    unit = lambda: [rng.gauss(0, 1) for _ in range(16)]
    rows = [unit() for _ in range(120)]
    for n, spread in ((40, 0.02), (30, 0.12), (25, 0.3)):
        c = unit()
        rows += [[x + rng.gauss(0, spread) for x in c] for _ in range(n)]
    rows += [rows[0]] * 6 + [[2.0 * x for x in rows[1]]] + [None, [0.0] * 16, [None, *rows[2][1:]], [float("nan")] * 16,
                                                            [float("inf"), *rows[2][1:]], [], [-0.0] * 16, [1.0, 2.0]]
    return [(i, r, 0, "c") for i, r in enumerate(rows)]


@pytest.mark.parametrize("block_rows", [3000, 23])
def test_cover_tree(spark, block_rows):
    import numpy as np

    rows = _vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, c string").repartition(3)
    back = {r.vec_id: r.embedding for r in df.collect()}
    good = [i for i, v in back.items() if v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)]
    x = np.array([back[i] for i in good], dtype=float)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    n = {i: 0 for i in back} | {i: int(k) for i, k in zip(good, near.sum(axis=1))}
    comp = brute.components(list(back), [(good[a], good[b]) for a, b in zip(*np.nonzero(near))])
    got = rows_of(covertree.near_duplicates(df, block_rows=block_rows), "vec_id", "n_links", "component_id", "kept")
    assert sorted(got) == sorted((i, n[i], comp[i], comp[i] == i) for i in back)
    assert sum(n.values()) > 1000
    assert covertree.near_duplicates(df.limit(0)).collect() == []


def test_cover_tree_of_scattered_vectors_is_met_at_its_rows(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 64))
    x[550:] = x[:50] + rng.normal(size=(50, 64)) * 0.1
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    a, b = covertree.CoverTree(x[:300]), covertree.CoverTree(x[300:])
    listed, plain = [], covertree._Walk._list
    monkeypatch.setattr(covertree._Walk, "_list",
                        lambda self, *args: (listed.append(args[-1].sum()), plain(self, *args))[1])
    for one, two in ((a, b), (a, a)):
        ones = np.ones(300)
        n_one, n_two, _ = covertree.dual_links(one, two, ones, ones, 0.9)
        near = one.x @ two.x.T >= 0.9
        assert n_one.tolist() == (near.sum(axis=1) - (one is two)).tolist()
        if one is not two:
            assert near.any() and n_two.tolist() == near.sum(axis=0).tolist()
    assert sum(listed) == 0             # no upper level was looked at in vain


def test_cover_trees_go_round_and_are_not_copied_for_each_pair(spark, monkeypatch):
    import numpy as np

    x = np.random.default_rng(8).normal(size=(400, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    plans, plain = [], covertree.stored

    def stored(frame, name):
        if name == "cover-links":
            plans.append(frame._jdf.queryExecution().executedPlan().toString())
        return plain(frame, name)

    monkeypatch.setattr(covertree, "stored", stored)
    monkeypatch.setattr(covertree, "_ROUND_BYTES", 30_000, raising=False)
    got = rows_of(covertree.near_duplicates(df, block_rows=40), "vec_id", "n_links", "component_id")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    comp = brute.components(list(range(400)), list(zip(*(k.tolist() for k in np.nonzero(near)))))
    assert got == sorted(((i, int(near[i].sum()), comp[i]) for i in range(400)), key=repr) and near.any()
    assert len(plans) > 1 and not any("Exchange" in p for p in plans)


def test_cover_tree_with_many_lengths(spark):
    """240 vectors of 120 lengths, each with a partner; and repeated and null ids."""
    rng = random.Random(4)
    rows = []
    for k in range(120):
        v = [rng.gauss(0, 1) for _ in range(k + 1)]
        rows += [(2 * k, v), (2 * k + 1, [x * 1.001 + 1e-4 for x in v])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id) for r in covertree.near_duplicates(df, block_rows=50).collect()}
    assert got == {i: (1, i - i % 2) for i in range(240)}
    again = spark.createDataFrame([*rows[40:44], rows[40], (None, rows[41][1])], "vec_id long, embedding array<double>")
    got = sorted(map(str, rows_of(covertree.near_duplicates(again), "vec_id", "n_links", "component_id", "kept")))
    assert got == sorted(map(str, [(40, 3, 40, True), (40, 3, 40, True), (41, 3, 40, False), (42, 1, 42, True), (43, 1, 42, False),
                                   (None, 3, 40, False)]))


# 1: toxicity


def _toxic(n, seed):
    rng = random.Random(seed)
    common = ["".join(rng.choice("abcdeilmnorst") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    bad = ["vilest", "rotten", "grubsnout", "foulish"]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(common) for _ in range(rng.randint(10, 80))]
        toxic = rng.random() < 0.15
        if toxic:
            words += rng.sample(bad, 2) if rng.random() < 0.6 else [f"krumpel{rng.choice(common)}" for _ in range(3)]
            rng.shuffle(words)
        docs.append((i, " ".join(words), "x", 1))
        if rng.random() < 0.6:
            labels.append((i, 1, int(toxic)))
    return docs, labels


def test_toxicity(spark, docs, none):
    import zlib

    rows, marks = _toxic(1500, 9)
    rows += [(2000, None, "x", 1), (2001, "", "x", 1), (2001, "", "x", 1), (None, "vilest rotten words", "x", 1),
             (2002, "word " * 30000 + "vilest rotten", "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, votes string, y int").repartition(4)
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = toxicity.score(df, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    by = {r.doc_id: r for r in got}
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [(y, by[i].predicted) for i, _, y in marks if by[i].held_out]
    assert sum(y == p for y, p in held) / len(held) > 0.95 and sum(p for y, p in held if y) / sum(y for y, _ in held) > 0.8
    assert by[2000].score == by[2001].score < 0.3 < by[None].score
    again = {r.doc_id: r.score for r in toxicity.score(df, labels).collect()}
    assert all(abs(again[k] - r.score) < 1e-9 for k, r in by.items())
    # held-out labels are not learned from
    flipped = labels.withColumn("toxic", F.when(toxicity.is_training(), F.col("toxic")).otherwise(1 - F.col("toxic")))
    assert {r.doc_id: r.score for r in toxicity.score(df, flipped).collect()} == pytest.approx(again)
    assert toxicity.score(none, labels).collect() == []
    assert {r.score < 1e-6 for r in toxicity.score(docs, labels.limit(0)).collect()} == {True}


def test_toxicity_counts_terms_on_all_labels(spark):
    """Many more labels than the classifier is fitted on: a word that marks a tenth of the toxic texts is not lost."""
    rows, marks = _toxic(3000, 11)
    clean = [(i, t) for (i, t, *_), y in zip(rows, (dict((i, y) for i, _, y in marks).get(r[0]) for r in rows)) if y == 0]
    rows += [(5000 + i, t + " quibblesnark", "x", 1) for i, t in clean[:40]]
    marks += [(5000 + i, 1, 1) for i, _ in clean[:40]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, votes string, y int").repartition(4)
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, labels, max_labelled=150).collect()}
    held = [(i, y, got[i].predicted) for i, _, y in marks if got[i].held_out]
    rare = [p for i, _, p in held if i >= 5000]
    assert len(rare) >= 5 and sum(rare) / len(rare) > 0.8
    assert sum(y == p for _, y, p in held) / len(held) > 0.95


def test_label_model_finds_rates_and_correlations():
    import numpy as np

    rng = np.random.default_rng(10)
    y = rng.random(20000) < 0.2
    fire = lambda hit, false: np.where(y, rng.random(20000) < hit, rng.random(20000) < false)
    first = fire(0.7, 0.02)
    votes = [first, np.where(rng.random(20000) < 0.95, first, fire(0.7, 0.02)), fire(0.6, 0.01), fire(0.5, 0.03),
             fire(0.8, 0.05)]
    packed = sum(v.astype(np.int64) << k for k, v in enumerate(votes))
    values, counts = np.unique(packed, return_counts=True)
    model = toxicity.LabelModel(values, counts, 0.2, n_voters=5)
    assert [0, 1] in model.factors
    assert abs(model.accuracy[0][2] - 0.6) < 0.08 and abs(model.accuracy[1][2] - 0.01) < 0.03
    q = np.array([model.of_votes[v] for v in packed.tolist()])
    assert ((q > 0.5) == y).mean() > 0.93


def test_phrase_windows_are_sorted_once_unless_hashes_clash(monkeypatch):
    import numpy as np

    from assaygraph.llm import phrases

    rng, calls, inner = np.random.default_rng(1), [], np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda k: calls.append(1) or inner(k))
    h = rng.integers(0, 50, 400, dtype=np.uint64)
    for x, sorts in ((h.astype(np.uint16), 0), (rng.integers(0, 3, 400).astype(np.uint16), 1), (h[:0].astype(np.uint16), 0)):
        calls.clear()
        order, new = phrases._in_order(h[:len(x)], x)
        assert len(calls) == sorts and order.tolist() == inner((x, h[:len(x)])).tolist()
        pairs = list(zip(h[order].tolist(), x[order].tolist()))
        assert new.tolist() == [i == 0 or p != pairs[i - 1] for i, p in enumerate(pairs)]


def test_phrase_words_are_hashed_once_for_a_shard(monkeypatch):
    from assaygraph.llm import phrases

    calls, inner = [], phrases.xxhash.xxh64_intdigest
    monkeypatch.setattr(phrases.xxhash, "xxh64_intdigest", lambda w, seed: calls.append(w) or inner(w, seed))
    long = "z" * 50
    texts = [f" {long} b\x0b{long}\n", None, "", "\t ", f"b \x1cc {long}"]
    shard = phrases._Shard(texts, 2, 1, True)
    assert sorted(calls) == sorted(set(calls)) and b"z" * 50 in calls
    words = [(t or "").encode().split() for t in texts]
    assert [shard.distinct[n].tolist() for n in shard.numbers()] == words
    assert shard.counts.tolist() == [max(0, len(w) - 1) for w in words]


def test_words_of_both_halves_of_the_cache_are_found_and_others_named():
    words = bpe._Words(2)
    words.learn({"a": b"1", "b": b"2", "c": b"3", "d" * 41: b"4"})       # more than there is room for: the older half
    words.learn({"e": b"5"})
    asked = ["e", "x", "b", "d" * 41, "a"]
    assert words.find(asked) == ([b"5", None, b"2", None, b"1"], [1, 3])
    assert words.peek("b") == b"2" and words.peek("c") is None           # what was asked for is in the newer half
