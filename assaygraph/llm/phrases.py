"""Substring dedup by repeated-phrase automata.

A window is ``size`` words in sequence; a word goes if a window covers it that
also starts earlier (smaller id, or same document and earlier start).

1. Documents go to shards by rising id (ranges of about ``shard_chars``
   characters), stored bucketed by shard: texts are shuffled once, later steps
   bring their findings to them.
2. Anchors: each window has one phrase of ``anchor`` words, the one with the
   smallest hash; equal windows have equal anchors.  Each shard reports its
   distinct anchors; those of two or more shards are what can recur elsewhere.
3. Confirmed windows: each shard reports its distinct windows with such an
   anchor, by an 80-bit hash, and learns which other shards have and whether
   an earlier one does.  Windows that recur inside a shard it knows itself.
4. Automata: in each shard, the first places of its confirmed windows form
   passages.  Aligned blocks of half a window are compiled to Aho-Corasick
   automata (several, if there are more than ``automaton_blocks``), and all
   documents are streamed through them.  A hit is extended word by word; from
   ``size`` words on it is an occurrence of the passage.

What a shard reports is distinct, so a passage that a third of all documents
share is reported once a shard, and no task gets all its occurrences.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import folder

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))     # odd multipliers of the rolling hashes


def _numbered(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of texts, the numbers among them of all words in a row, and how many words each text has."""
    raw = [text.encode("utf-8", "surrogatepass") if isinstance(text, str) else None for text in texts]
    # bytes are split at ASCII white space, so they may pass as text whatever they hold
    parts = pc.ascii_split_whitespace(pa.array(raw, pa.large_binary()).cast(pa.large_string(), safe=False))
    flat = parts.flatten().dictionary_encode()
    distinct = flat.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False)
    # white space at either end of a text leaves an empty word there
    ids = flat.indices.to_numpy()
    real = (distinct != b"")[ids] if len(ids) else np.zeros(0, bool)
    ends = np.cumsum(pc.fill_null(pc.list_value_length(parts), 0).to_numpy())
    counts = np.diff(np.concatenate(([0], np.cumsum(real)))[ends], prepend=0)
    return distinct, ids[real], counts.astype(np.int64)


def _roll(h: np.ndarray, k: int, by: np.uint64) -> np.ndarray:
    """A hash of each ``k`` neighbours, by doubling: two of length m make one of length 2m."""
    out, have, power, m = None, 0, h, 1
    while True:
        if k & m:                                  # the windows so far stand before this power of two
            if out is None:
                out = power
            else:
                n = len(h) - have - m + 1
                out = out[:n] * _power(by, m) + power[have:have + n]
            have += m
        if m * 2 > k:
            break
        power = power[:-m] * _power(by, m) + power[m:]
        m *= 2
    x = out ^ (out >> np.uint64(31))               # mixed, so that any bits of it can be used
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _power(by: np.uint64, n: int) -> np.uint64:
    return np.uint64(pow(int(by), n, 1 << 64))


def _least(x: np.ndarray, k: int) -> np.ndarray:
    """Minimum of each ``k`` neighbours."""
    m, have = x, 1
    while 2 * have <= k:
        m, have = np.minimum(m[:-have], m[have:]), 2 * have
    return np.minimum(m[:len(x) - k + 1], m[k - have:]) if have < k else m


class _Shard:
    """Hashes of all windows of a shard's documents, in order; words are numbers, each distinct one is hashed once."""

    def __init__(self, texts, size: int, anchor: int, second: bool):
        self.distinct, self.ids, n = _numbered(texts)
        self.ends = np.cumsum(n)
        self.counts = np.maximum(0, n - size + 1)
        total = len(self.ids)
        h = np.fromiter((xxhash.xxh64_intdigest(w, 7) for w in self.distinct), np.uint64, len(self.distinct))[self.ids]
        # hashes run over all documents in a row; those of windows that cross a border are left out
        left = np.repeat(self.ends, n) - np.arange(total)
        inside = left[:max(0, total - size + 1)] >= size
        self.anchor = self.hash = np.empty(0, np.uint64)
        self.extra = np.empty(0, np.uint16)
        if inside.any():
            self.anchor = _least(_roll(h, anchor, _MIX[0]), size - anchor + 1)[inside]
            if second:
                self.hash = _roll(h, size, _MIX[0])[inside]
                self.extra = (_roll(h, size, _MIX[1]) >> np.uint64(48)).astype(np.uint16)[inside]

    def numbers(self) -> list[np.ndarray]:
        """The numbers of each document's words."""
        return np.split(self.ids, self.ends[:-1])


def _by_bucket(h: np.ndarray, n: int):
    """``bucket, positions`` of a sorted array's entries, positions rising."""
    bucket = (h >> np.uint64(20)) % np.uint64(n)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order], prepend=np.uint64(n)))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)]):
        yield int(bucket[order[a]]), order[a:b]


def _in_order(h: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by ``h``, then ``x``, and where in it another pair begins.

    Equal ``h`` with different ``x`` hardly occur, so one sort will do nearly always.
    """
    order = np.argsort(h, kind="stable")
    for again in (False, True):
        other, parts = np.diff(h[order]) != 0, np.diff(x[order]) != 0
        if again or not (parts & ~other).any():
            break
        order = np.lexsort((x, h))
    new = np.ones(len(order), bool)
    new[1:] = other | parts
    return order, new


def _candidates(shard: _Shard, masks: pd.DataFrame, n: int):
    """Distinct windows whose anchor other shards have too: positions of one of each, sorted by hash."""
    anchors = np.unique(shard.anchor)
    elsewhere = np.zeros(len(anchors), bool)
    found = dict(zip(masks["bucket"], masks["mask"]))
    for bucket, at in _by_bucket(anchors, n):
        if bucket in found:
            elsewhere[at] = np.unpackbits(np.frombuffer(found[bucket], np.uint8), count=len(at)).astype(bool)
    known = anchors[elsewhere]
    if not len(known):
        return np.empty(0, np.int64)
    at = np.minimum(np.searchsorted(known, shard.anchor), len(known) - 1)
    at = np.flatnonzero(known[at] == shard.anchor)
    order, new = _in_order(shard.hash[at], shard.extra[at])
    return at[order[new]]


def _passages(shard: _Shard, first: np.ndarray, size: int):
    """Runs of windows that follow each other in one document: ``(document, start, end)`` in windows."""
    begin = np.cumsum(shard.counts) - shard.counts
    doc = np.searchsorted(begin, first, side="right") - 1
    # documents without windows share their begin with the next one: the last of these is the right one
    cut = np.flatnonzero((np.diff(first, prepend=-2) != 1) | (np.diff(doc, prepend=-1) != 0))
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(first)]):
        d = int(doc[a])
        yield d, int(first[a] - begin[d]), int(first[b - 1] - begin[d]) + 1


def _locate(texts: list, passages, size: int, automaton_blocks: int):
    """Occurrences of passages elsewhere: ``(document, first word, end)``, each of ``size`` words or more.

    A text is a sequence of words, or of their numbers."""
    import ahocorasick

    if not passages:
        return
    block = size // 2
    ends = np.cumsum([len(w) for w in texts])
    whole = np.concatenate([np.asarray(w) for w in texts if len(w)])
    used = np.unique(np.concatenate([np.asarray(texts[d][a:b + size - 1]) for d, a, b in passages]))
    at = np.minimum(np.searchsorted(used, whole), len(used) - 1)
    whole = np.where(used[at] == whole, at + 1, 0)           # 0: in no passage
    begin = ends - [len(w) for w in texts]
    bodies = [whole[begin[d] + a:begin[d] + b + size - 1] for d, a, b in passages]
    # a word is a fixed number of symbols of 6 bits, so that no node has many children
    width = max(1, math.ceil(math.log(len(used) + 2, 64)))
    spelling = ((np.arange(len(used) + 1)[:, None] >> (6 * np.arange(width - 1, -1, -1))) & 63).astype(np.uint8)

    def spell(ids: np.ndarray) -> str:
        return spelling[ids].tobytes().decode("latin-1")

    shards, where = [], {}
    for p, body in enumerate(bodies):
        line = spell(body)
        for at in range(0, len(body) - block + 1, block):
            where.setdefault(line[at * width:(at + block) * width], []).append((p, at))
    keys = list(where)
    for k in range(0, len(keys), automaton_blocks):
        automaton = ahocorasick.Automaton()
        for key in keys[k:k + automaton_blocks]:
            automaton.add_word(key, where[key])
        automaton.make_automaton()
        shards.append(automaton)
    if not shards:
        return
    spelled = spell(whole)
    for d, (words, end_of) in enumerate(zip(texts, ends.tolist())):
        if len(words) < size:
            continue
        own = whole[end_of - len(words):end_of]
        line = spelled[(end_of - len(words)) * width:end_of * width]
        for automaton in shards:
            reached: dict[tuple[int, int], int] = {}         # anew: the next automaton's hits start at the front again
            for end, places in automaton.iter(line):
                if (end + 1) % width:
                    continue                      # not at a word's end
                at = (end + 1) // width - block
                for p, offset in places:
                    key = (p, at - offset)
                    if reached.get(key, -1) > at or (passages[p][0] == d and passages[p][1] == at - offset):
                        continue                  # seen, or the passage's own place
                    body = bodies[p]
                    lo = max(0, offset - at)
                    hi = min(len(body), offset + len(own) - at)
                    differ = (body[lo:hi] != own[lo + at - offset:hi + at - offset]).nonzero()[0]
                    cut = int(differ.searchsorted(offset - lo))
                    a = lo + (int(differ[cut - 1]) + 1 if cut else 0)
                    b = lo + int(differ[cut]) if cut < len(differ) else hi
                    reached[key] = b + at - offset
                    if b - a >= size:
                        yield d, a + at - offset, b + at - offset


def remove_repeats(docs: DataFrame, size: int = 20, anchor: int = 8, shard_chars: int = 8_000_000,
                   automaton_blocks: int = 100_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>, n_words, n_removed, removed array<struct<start,end>>, kept string`` for each row of ``docs``.

    Words stand between ASCII white space, unchanged.  ``removed`` are ranges
    of words (end exclusive); ``kept`` are the other words joined by a space.
    Null, empty and blank texts have no words and ``kept`` is empty.  Repeated
    rows: of two rows with one id the one with the smaller text is the earlier.
    Rows with a null id come before all others.  An empty table stays empty;
    other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // shard_chars), 1)
    ranged = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions("doc_id", "text")
    ranged = ranged.select(F.spark_partition_id().alias("shard"), F.monotonically_increasing_id().alias("nth"),
                           "doc_id", "text")
    name = f"phrase_shards_{uuid.uuid4().hex}"
    (ranged.write.bucketBy(n, "shard").option("path", folder(spark, "phrase-shards")).option("compression", "zstd")
           .saveAsTable(name))
    shards = spark.table(name)

    def anchors(f: pd.DataFrame) -> pd.DataFrame:
        h = np.unique(_Shard(f.sort_values("nth")["text"], size, anchor, False).anchor)
        out = [(b, h[at].tobytes()) for b, at in _by_bucket(h, n)]
        return pd.DataFrame({"bucket": [b for b, _ in out], "shard": f["shard"].iloc[0], "hashes": [x for _, x in out]})

    def shared(f: pd.DataFrame) -> pd.DataFrame:
        h = np.concatenate([np.frombuffer(x, np.uint64) for x in f["hashes"]])
        _, back, count = np.unique(h, return_inverse=True, return_counts=True)
        cuts = np.cumsum([0, *[len(x) // 8 for x in f["hashes"]]])
        more = count[back] > 1
        masks = [more[a:b] for a, b in zip(cuts, cuts[1:])]
        return pd.DataFrame({"shard": f["shard"], "bucket": f["bucket"], "any": [m.any() for m in masks],
                             "mask": [np.packbits(m).tobytes() for m in masks]}).query("any")[["shard", "bucket", "mask"]]

    found = (shards.groupBy("shard").applyInPandas(anchors, "bucket int, shard int, hashes binary")
                   .groupBy("bucket").applyInPandas(shared, "shard int, bucket int, mask binary"))

    def candidates(f: pd.DataFrame, masks: pd.DataFrame) -> pd.DataFrame:
        if not len(f) or not len(masks):
            return pd.DataFrame({"bucket": [], "shard": [], "hashes": [], "extras": []})
        s = _Shard(f.sort_values("nth")["text"], size, anchor, True)
        at = _candidates(s, masks, n)
        h, x = s.hash[at], s.extra[at]
        out = [(b, h[k].tobytes(), x[k].tobytes()) for b, k in _by_bucket(h, n)]
        return pd.DataFrame({"bucket": [o[0] for o in out], "shard": f["shard"].iloc[0],
                             "hashes": [o[1] for o in out], "extras": [o[2] for o in out]})

    def confirm(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("shard")
        h = np.concatenate([np.frombuffer(x, np.uint64) for x in f["hashes"]])
        x = np.concatenate([np.frombuffer(e, np.uint16) for e in f["extras"]])
        order, new = _in_order(h, x)              # stable: the earliest shard first
        group = np.cumsum(new) - 1
        many, earlier = np.zeros(len(h), bool), np.zeros(len(h), bool)
        many[order] = np.bincount(group)[group] > 1
        earlier[order] = ~new
        cuts = np.cumsum([0, *[len(e) // 2 for e in f["extras"]]])
        rows = [(many[a:b], earlier[a:b]) for a, b in zip(cuts, cuts[1:])]
        return pd.DataFrame({"shard": f["shard"].to_numpy(), "bucket": f["bucket"].to_numpy(),
                             "any": [m.any() for m, _ in rows], "many": [np.packbits(m).tobytes() for m, _ in rows],
                             "earlier": [np.packbits(e).tobytes() for _, e in rows]}).query("any").drop(columns="any")

    at = folder(spark, "phrase-anchors")
    found.write.parquet(at)
    found = spark.read.schema(found.schema).parquet(at)
    confirmed = (shards.groupBy("shard").cogroup(found.groupBy("shard"))
                       .applyInPandas(candidates, "bucket int, shard int, hashes binary, extras binary")
                       .groupBy("bucket").applyInPandas(confirm, "shard int, bucket int, many binary, earlier binary"))
    masks = (found.select("shard", "bucket", "mask", F.lit(None).cast("binary").alias("many"),
                          F.lit(None).cast("binary").alias("earlier"))
                  .unionByName(confirmed.select("shard", "bucket", F.lit(None).cast("binary").alias("mask"), "many", "earlier")))

    def strip(f: pd.DataFrame, masks: pd.DataFrame):
        if not len(f):
            return pd.DataFrame({c: [] for c in ("doc_id", "n_words", "n_removed", "removed", "kept")})
        f = f.sort_values("nth")
        s = _Shard(f["text"].tolist(), size, anchor, True)
        order, new = _in_order(s.hash, s.extra)   # stable: the first place of each window first
        group = np.cumsum(new) - 1
        firsts = order[new]
        confirmed = np.bincount(group)[group[new]] > 1 if len(order) else np.zeros(0, bool)
        earlier = np.zeros(len(firsts), bool)
        sent = _candidates(s, masks[masks["mask"].notna()], n)
        if len(sent):
            of = {b: (m, e) for b, m, e in zip(masks["bucket"], masks["many"], masks["earlier"]) if m is not None}
            place = np.zeros(len(s.hash), np.int64)
            place[order] = group                  # any place of a window -> its number among the distinct ones
            for b, k in _by_bucket(s.hash[sent], n):
                if b in of:
                    bits = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(k)).astype(bool) for x in of[b]]
                    confirmed[place[sent[k]]] |= bits[0]
                    earlier[place[sent[k]]] |= bits[1]
        begin = np.cumsum(s.counts) - s.counts
        gone = [None] * len(s.counts)

        def cover(d: int, a: int, b: int) -> None:
            if gone[d] is None:
                gone[d] = np.zeros(s.counts[d] + size - 1, bool)
            gone[d][a:b] = True

        ordered = np.sort(firsts[confirmed])
        passages = list(_passages(s, ordered, size))
        for d, a, b in _locate(s.numbers(), passages, size, automaton_blocks):
            cover(d, a, b)
        for w in np.sort(firsts[earlier]).tolist():           # first here, but an earlier shard has it
            d = int(np.searchsorted(begin, w, side="right")) - 1
            cover(d, w - int(begin[d]), w - int(begin[d]) + size)
        out, row, before = [], s.distinct[s.ids].tolist(), 0
        for d, end in enumerate(s.ends.tolist()):
            words, before = row[before:end], end
            if gone[d] is None:
                out.append((len(words), 0, [], b" ".join(words).decode("utf-8", "surrogatepass")))
                continue
            edge = np.flatnonzero(np.diff(np.concatenate(([0], gone[d].view(np.int8), [0]))))
            kept = [w for w, g in zip(words, gone[d].tolist()) if not g]
            out.append((len(words), int(gone[d].sum()),
                        [{"start": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()],
                        b" ".join(kept).decode("utf-8", "surrogatepass")))
        return pd.DataFrame({"doc_id": f["doc_id"].to_numpy(), "n_words": [o[0] for o in out],
                             "n_removed": [o[1] for o in out], "removed": [o[2] for o in out], "kept": [o[3] for o in out]})

    out = (shards.groupBy("shard").cogroup(masks.groupBy("shard"))
                 .applyInPandas(strip, "doc_id long, n_words long, n_removed long, "
                                       "removed array<struct<start:int,end:int>>, kept string"))
    return out.withColumnRenamed("doc_id", id_col)
