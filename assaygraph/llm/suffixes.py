"""Substring dedup by suffixes sampled with a difference cover.

Each byte goes that is covered by a string of ``size`` bytes which also starts
in a document with a smaller id.  Documents stay where they are: each shard
(a part of a scan partition) sends sorted distinct keys to buckets and gets one
answer for each key, so texts are never moved and no key carries its places.

1. Whole copies (SHA-256 of the text) of a text with a smaller id go; nothing
   else can hold a string that their first text has not.
2. Discarding.  A window of ``size`` bytes can recur only if its anchor (the
   20-byte string with the smallest hash inside it) does.  Shards report
   distinct anchors; windows whose anchor is known in one document only are out.
3. Sampling.  Residues {1, 2, 4} modulo 7 are a difference cover: for any two
   places i, j there is a shift d in 0 ... 6 that takes both to sampled
   places.  So equal windows at i and j show up as sampled suffixes i + d and
   j + d that agree on ``size - d`` bytes, after the same d bytes.
4. Names.  At sampled places the triples of three 7-byte letters are sorted in
   their bucket; equal triples get one name.  Names of one document only end here.
5. Recursion.  A sampled suffix is now the sequence of names 21 bytes apart
   (again sampled places); these are sorted, which orders suffixes by as
   many whole names as the window has.
6. Merging.  The remaining suffixes enter through the sampled one d places on:
   in the order of (names, the bytes after them, the d bytes before), neighbours with equal
   prefixes are one string, for each d in turn.  The smallest document id of a
   string is its first place; all others are repeats.

Letters, names and bytes are compared as they are; hashes only decide where and
in which order keys stand.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import folder, maybe_broadcast, stored, tidy_shuffles
from .phrases import _by_bucket, _least, _roll

_V, _COVER = 7, (1, 2, 4)
_LETTER, _TRIPLE = 7, 21
_ANCHOR = 20
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)     # odd multipliers
_FIRST = -2 ** 63                                # stands for a null id: before all others


def _mixed(cols) -> np.ndarray:
    h = np.zeros(len(cols[0]), np.uint64)
    for c in cols:
        h = (h ^ c.view(np.uint64)) * _A
        h ^= h >> np.uint64(32)
    h *= _B
    return h ^ (h >> np.uint64(29))


def _sorted(cols):
    """``order, new``: rows in an order in which equal rows are neighbours; where a new one begins."""
    if not len(cols[0]):
        return np.empty(0, np.int64), np.empty(0, bool)
    h = _mixed(cols)
    order = np.argsort(h)

    ordered = h[order]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    same = np.flatnonzero(~new)
    if any((c[order[same]] != c[order[same - 1]]).any() for c in cols):     # other rows with one hash: sort by the values too
        order = np.lexsort((*cols, h))
        differ = np.zeros(len(order) - 1, bool)
        for c in cols:
            differ |= c[order[1:]] != c[order[:-1]]
        new = np.concatenate(([True], differ))
    return order, new


def _pack(cols) -> bytes:
    """Columns of 64-bit numbers, byte plane by byte plane, compressed."""
    planes = [np.ascontiguousarray(np.asarray(c).astype("<u8")).view(np.uint8).reshape(-1, 8).T for c in cols]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(p.tobytes() for p in planes))


def _unpack(raw: bytes, n_cols: int) -> list[np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(n_cols, 8, -1)
    return [np.ascontiguousarray(p.T).view("<u8").reshape(-1) for p in planes]


class _Shard:
    """The texts of a shard as one array of bytes, by document id."""

    def __init__(self, f: pd.DataFrame, size: int, told: pd.DataFrame):
        """``told``: what the shard has been told; its whole copies count as empty here."""
        f = f.sort_values(["doc_id", "nth"])
        copies = told.loc[told["kind"] == "copies", "payload"]
        self.copy = f["nth"].isin(np.frombuffer(copies.iloc[0], ">i8")).to_numpy() if len(copies) else np.zeros(len(f), bool)
        texts = [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in f["text"].tolist()]
        self.whole = np.array([len(t) for t in texts], np.int64)
        texts = [b"" if c else t for t, c in zip(texts, self.copy.tolist())]
        self.size = size
        self.ids = f["doc_id"].to_numpy(np.int64)
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.end = np.cumsum(self.sizes)
        self.begin = self.end - self.sizes
        self.n = int(self.end[-1]) if len(texts) else 0
        self.raw = b"\xff" * 8 + b"".join(texts) + b"\xff" * 96
        self.buf = np.frombuffer(self.raw, np.uint8)[8:]

    def eight(self, at: np.ndarray) -> np.ndarray:
        """The eight bytes from each place on, as a number, the first byte highest; from -8 on."""
        any_place = np.ndarray((len(self.raw) - 7,), ">u8", self.raw, strides=(1,))
        return any_place[at + 8].astype(np.uint64)

    def document(self, at: np.ndarray) -> np.ndarray:
        """The document of each place (empty documents share their begin with the one behind them)."""
        return np.searchsorted(self.begin, at, side="right") - 1

    def anchors(self):
        """``start, value, end, document``: stretches of windows of one document with one anchor."""
        if self.n < self.size:
            none = np.empty(0, np.int64)
            return none, none.view(np.uint64), none, none
        table = np.random.default_rng(7).integers(0, 2 ** 63, 256, np.uint64)
        value = _least(_roll(table[self.buf[:self.n]], _ANCHOR, _A), self.size - _ANCHOR + 1)
        long = self.sizes >= self.size
        change = np.concatenate(([True], value[1:] != value[:-1]))
        change[self.begin[long]] = True
        start = np.flatnonzero(change)
        doc = self.document(start)
        last = self.end[doc] - self.size + 1                     # windows of the document end before
        end = np.minimum(np.append(start[1:], len(value)), last)
        fits = end > start
        return start[fits], value[start[fits]], end[fits], doc[fits]

    def suspects(self, masks: pd.DataFrame, buckets: int):
        """Stretches of windows whose anchor stands in more than one document: ``start, end``."""
        start, value, end, doc = self.anchors()
        if not len(start):
            return start, end
        known, back = np.unique(value, return_inverse=True)
        more = np.zeros(len(known), bool)
        found = dict(zip(masks["bucket"], masks["payload"]))
        for bucket, at in _by_bucket(known, buckets):
            if bucket in found:
                more[at] = np.unpackbits(np.frombuffer(found[bucket], np.uint8), count=len(at)).astype(bool)
        first, final = np.full(len(known), len(self.ids)), np.full(len(known), -1)
        np.minimum.at(first, back, doc)
        np.maximum.at(final, back, doc)
        keep = (more | (first < final))[back]
        start, end = start[keep], end[keep]
        if not len(start):
            return start, end
        new = np.concatenate(([True], start[1:] != end[:-1]))    # joined where one begins as the other ends
        return start[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]

    def sample(self, start: np.ndarray, end: np.ndarray) -> None:
        """Sets ``windows`` (whether a window is suspect), ``at`` (sampled places) and the triples at them."""
        edge = np.zeros(self.n + 1, np.int8)
        np.add.at(edge, start, 1)
        np.add.at(edge, end, -1)
        self.windows = np.cumsum(edge, dtype=np.int8)[:self.n].astype(bool)
        near = self.windows.copy()
        for d in range(1, _V):
            near[d:] |= self.windows[:-d]
        at = np.flatnonzero(near)
        covered = np.isin(np.arange(_V), _COVER)
        at = at[covered[(at - self.begin[self.document(at)]) % _V]]
        self.at, self.names_in = at, (self.size - _V + 1) // _TRIPLE
        named = np.zeros(self.n + 64, bool)
        for k in range(self.names_in):
            named[at + k * _TRIPLE] = True
        self.named = np.flatnonzero(named)
        self.triples = [self._letter(self.named + k * _LETTER) for k in range(3)]
        order, new = _sorted(self.triples)
        # distinct triples, by bucket: the bucket is a part of the order's hash
        one = order[new]
        self.distinct = [c[one] for c in self.triples]
        self.number = np.empty(len(order), np.int64)             # of each named place: its distinct triple
        self.number[order] = np.cumsum(new) - 1

    def _letter(self, at: np.ndarray) -> np.ndarray:
        return self.eight(at) >> np.uint64(8 * (8 - _LETTER))

    def entries(self, name: np.ndarray):
        """Columns of each sampled suffix: names, the bytes before, the bytes after (0xFF, which no text has, beyond the text)."""
        at, doc = self.at, self.document(self.at)
        names = [name[self.number[np.searchsorted(self.named, at + k * _TRIPLE)]] for k in range(self.names_in)]
        full = np.uint64(2 ** 64 - 1)
        filled = lambda n: full >> (np.uint64(8) * (8 - n).astype(np.uint64))  # noqa: E731  all ones in the n low bytes, n > 0
        there = np.minimum(at - self.begin[doc], _V - 1)
        before = self.eight(at - 8) & np.uint64((1 << 8 * (_V - 1)) - 1)
        before = np.where(there > 0, before & filled(np.maximum(there, 1)), 0) | (full << (np.uint64(8) * there.astype(np.uint64)))
        after, rest = [], self.size - self.names_in * _TRIPLE
        for w in range(0, rest, 8):
            place = at + self.names_in * _TRIPLE + w
            beyond = np.clip(8 - (self.end[doc] - place), 0, 8)
            word = self.eight(np.minimum(place, self.n))
            after.append(np.where(beyond > 0, word | filled(np.maximum(beyond, 1)), word))
        return names, before, after, doc


def _repeats(names, before, after, ids: np.ndarray, size: int) -> np.ndarray:
    """Bit d of each suffix: a document with a smaller id has the window that starts d bytes before it."""
    out = np.zeros(len(ids), np.uint8)
    if not len(ids):
        return out
    order, new = _sorted(names)
    group = np.empty(len(order), np.uint64)
    group[order] = np.cumsum(new)
    several = np.bincount(group.view(np.int64))[group.view(np.int64)] > 1
    some = np.flatnonzero(several)               # a suffix alone in its class has no equal window
    group, before, after, ids = group[some], before[some], [c[some] for c in after], ids[some]
    if not len(some):
        return out
    rest = size - len(names) * _TRIPLE
    for d in range(_V):
        cols = [group, before & np.uint64((1 << 8 * d) - 1)]
        for k, c in enumerate(after):
            b = min(max(rest - d - 8 * k, 0), 8)
            cols.append(c & np.uint64((1 << 64) - (1 << 8 * (8 - b))))
        order, new = _sorted(cols)
        least = np.minimum.reduceat(ids[order], np.flatnonzero(new))
        of = np.empty(len(order), np.int64)
        of[order] = least[np.cumsum(new) - 1]
        out[some] |= (ids > of).astype(np.uint8) << np.uint8(d)
    return out


_REPLY = "shard int, kind string, bucket int, payload binary"


def _replies(rows) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["shard", "kind", "bucket", "payload"])


def remove_substrings(docs: DataFrame, size: int = 50, shard_bytes: int = 6_000_000, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """``<id_col>, n_bytes, n_removed, removed array<struct<start,end>>, kept binary`` for each row of ``docs``.

    Texts are UTF-8 bytes, null ones empty.  ``removed`` are the ranges that
    go (end exclusive), ``kept`` the other bytes.  Strings never cross
    documents.  Rows with one id do not remove each other, and null ids come
    before all others (and do not remove each other).  An empty table stays
    empty; other columns are not read.
    """
    if size < _ANCHOR + _V:
        raise ValueError(f"size must be {_ANCHOR + _V} or more")
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_FIRST)).alias("doc_id"),
                       F.col(text_col).cast("string").alias("text"))
    parts = rows.groupBy(F.spark_partition_id()).agg(F.sum(F.octet_length("text")).alias("b"))
    count, most = parts.agg(F.count("*"), F.max("b")).first()
    split = max(1, -(-(most or 0) // shard_bytes))
    n = max(1, count * split)
    buckets = max(n, int(spark.conf.get("spark.sql.shuffle.partitions")))
    nth = F.monotonically_increasing_id()
    placed = rows.withColumn("nth", nth).withColumn(
        "shard", (F.spark_partition_id() * split + F.pmod(F.hash("nth"), F.lit(split))).cast("int"))
    name = f"suffix_shards_{uuid.uuid4().hex}"
    (placed.write.bucketBy(n, "shard").option("path", folder(spark, "suffix-shards")).option("compression", "zstd")
           .saveAsTable(name))
    shards = spark.table(name)
    spark.sql(f"DROP TABLE {name}")              # its files stay, and this frame reads them

    def anchors(f: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        if not len(f):
            return _replies([])
        h = np.unique(_Shard(f, size, told).anchors()[1])
        shard = int(f["shard"].iloc[0])
        return _replies([(shard, "anchors", b, h[at].tobytes()) for b, at in _by_bucket(h, buckets)])

    def shared(f: pd.DataFrame) -> pd.DataFrame:
        h = np.concatenate([np.frombuffer(x, np.uint64) for x in f["payload"]])
        _, back, times = np.unique(h, return_inverse=True, return_counts=True)
        many, cuts = times[back] > 1, np.cumsum([0, *[len(x) // 8 for x in f["payload"]]])
        return _replies([(s, "shared", int(b), np.packbits(many[x:y]).tobytes())
                         for s, b, x, y in zip(f["shard"], f["bucket"], cuts, cuts[1:]) if many[x:y].any()])

    def find(f: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        if not len(f):
            return _replies([])
        s = _Shard(f, size, told)
        start, end = s.suspects(told[told["kind"] == "shared"], buckets)
        return _replies([(int(f["shard"].iloc[0]), "suspects", 0, _pack([start, end]))] if len(start) else [])

    def load(f: pd.DataFrame, told: pd.DataFrame) -> _Shard | None:
        s = _Shard(f, size, told)
        found = told.loc[told["kind"] == "suspects", "payload"]
        if not len(found):
            return None
        s.sample(*(x.view(np.int64) for x in _unpack(found.iloc[0], 2)))
        return s

    def by_triple(s: _Shard):
        return _by_bucket(_mixed(s.distinct), buckets)

    def triples(f: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        s = load(f, told) if len(f) else None
        if s is None:
            return _replies([])
        shard = int(f["shard"].iloc[0])
        return _replies([(shard, "triples", b, _pack([c[at] for c in s.distinct])) for b, at in by_triple(s)])

    def give_names(f: pd.DataFrame) -> pd.DataFrame:
        each = [_unpack(x, 3) for x in f["payload"]]
        order, new = _sorted([np.concatenate(c) for c in zip(*each)])
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(new) - 1
        many = (np.bincount(rank) > 1)[rank]     # a shard sends a triple once: more than one has it
        bucket, cuts = int(f["bucket"].iloc[0]), np.cumsum([0, *[len(e[0]) for e in each]])
        return _replies([(s, "names", bucket, _pack([np.diff(rank[x:y], prepend=0).view(np.uint64), many[x:y]]))
                         for s, x, y in zip(f["shard"], cuts, cuts[1:])])

    def named(f: pd.DataFrame, told: pd.DataFrame):
        """The shard, columns of its sampled suffixes, and which of them other shards may have."""
        s = load(f, told) if len(f) else None
        if s is None:
            return None
        name, many = np.zeros(len(s.distinct[0]), np.uint64), np.zeros(len(s.distinct[0]), bool)
        got = dict(zip(told.loc[told["kind"] == "names", "bucket"], told.loc[told["kind"] == "names", "payload"]))
        for b, at in by_triple(s):
            step, more = _unpack(got[b], 2)
            name[at] = np.cumsum(step.view(np.int64)).view(np.uint64) * np.uint64(buckets) + np.uint64(b)
            many[at] = more.astype(bool)
        names, before, after, doc = s.entries(name)
        elsewhere = np.ones(len(s.at), bool)
        for k in range(s.names_in):
            elsewhere &= many[s.number[np.searchsorted(s.named, s.at + k * _TRIPLE)]]
        return s, names, before, after, doc, elsewhere

    def sent(s, names, before, after, doc, elsewhere):
        """Distinct suffixes for other shards: columns, smallest id, and the number of each suffix among them."""
        some = np.flatnonzero(elsewhere)
        cols = [c[some] for c in (*names, before, *after)]
        order, new = _sorted(cols)
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        least = np.minimum.reduceat(s.ids[doc[some]][order], np.flatnonzero(new)) if len(order) else np.empty(0, np.int64)
        return some, [c[order[new]] for c in cols], least, number

    def suffixes(f: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        found = named(f, told)
        if found is None:
            return _replies([])
        _, cols, least, _ = sent(*found)
        shard, k = int(f["shard"].iloc[0]), found[0].names_in
        if not len(least):
            return _replies([])
        return _replies([(shard, "suffixes", b, _pack([*(c[at] for c in cols), least[at].view(np.uint64)]))
                         for b, at in _by_bucket(_mixed(cols[:k]), buckets)])

    k_names = (size - _V + 1) // _TRIPLE
    n_cols = k_names + 2 + -(-(size - k_names * _TRIPLE) // 8)

    def merge(f: pd.DataFrame) -> pd.DataFrame:
        each = [_unpack(x, n_cols) for x in f["payload"]]
        *cols, ids = [np.concatenate(c) for c in zip(*each)]
        bits = _repeats(cols[:k_names], cols[k_names], cols[k_names + 1:], ids.view(np.int64), size)
        cuts = np.cumsum([0, *[len(e[0]) for e in each]])
        return _replies([(s, "repeats", int(b), zstandard.ZstdCompressor(level=1).compress(bits[x:y].tobytes()))
                         for s, b, x, y in zip(f["shard"], f["bucket"], cuts, cuts[1:]) if bits[x:y].any()])

    def strip(f: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        columns = ["doc_id", "n_bytes", "n_removed", "removed", "kept"]
        if not len(f):
            return pd.DataFrame({c: [] for c in columns})
        found = named(f, told)
        s = found[0] if found else _Shard(f, size, told)
        gone = np.zeros(s.n, bool)
        if found:
            _, names, before, after, doc, _ = found
            bits = _repeats(names, before, after, s.ids[doc], size)
            some, cols, least, number = sent(*found)
            got = dict(zip(told.loc[told["kind"] == "repeats", "bucket"], told.loc[told["kind"] == "repeats", "payload"]))
            if got and len(least):
                own = np.zeros(len(least), np.uint8)
                for b, at in _by_bucket(_mixed(cols[:s.names_in]), buckets):
                    if b in got:
                        own[at] = np.frombuffer(zstandard.ZstdDecompressor().decompress(got[b]), np.uint8)
                bits[some] |= own[number]
            repeat = np.zeros(s.n, bool)
            for d in range(_V):
                at = s.at[(bits >> np.uint8(d) & 1).astype(bool)] - d
                repeat[at[at >= 0]] = True
            repeat &= s.windows
            edge = np.zeros(s.n + 1, np.int32)
            edge[:-1] += repeat
            starts = np.flatnonzero(repeat)
            edge[starts + size] -= 1
            gone = np.cumsum(edge)[:s.n] > 0
        step = np.flatnonzero(np.diff(gone.view(np.int8), prepend=0, append=0))
        # a stretch that runs on into the next document is cut there
        a, b = step[::2], step[1::2]
        raw, out = s.buf[:s.n], []
        for begin, end, key, copy, n_bytes in zip(s.begin.tolist(), s.end.tolist(), s.ids.tolist(), s.copy.tolist(), s.whole.tolist()):
            if copy:
                out.append((key, n_bytes, n_bytes, [{"start": 0, "end": n_bytes}], b""))
                continue
            lo, hi = np.searchsorted(b, begin, side="right"), np.searchsorted(a, end, side="left")
            if lo >= hi or begin == end:
                out.append((key, end - begin, 0, [], raw[begin:end].tobytes()))
                continue
            x, y = np.maximum(a[lo:hi], begin) - begin, np.minimum(b[lo:hi], end) - begin
            out.append((key, end - begin, int((y - x).sum()),
                        [{"start": p, "end": q} for p, q in zip(x.tolist(), y.tolist())],
                        raw[begin:end][~gone[begin:end]].tobytes()))
        return pd.DataFrame(out, columns=columns)

    def ask(kernel, told: DataFrame) -> DataFrame:
        return shards.groupBy("shard").cogroup(told.groupBy("shard")).applyInPandas(kernel, _REPLY)

    with tidy_shuffles(spark):
        texts = stored(shards.where(F.octet_length("text") >= size)
                             .select("shard", "nth", "doc_id", F.sha2("text", 256).alias("sha")), "suffix-digests")
        first = texts.groupBy("sha").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
        copies = texts.join(maybe_broadcast(stored(first, "suffix-copied")), "sha").where("doc_id > first")
        listed = F.unhex(F.concat_ws("", F.collect_list(F.lpad(F.hex("nth"), 16, "0"))))
        told = stored(copies.groupBy("shard").agg(listed.alias("payload"))
                            .select("shard", F.lit("copies").alias("kind"), F.lit(0).alias("bucket"), "payload"), "suffix-copies")
        known = stored(ask(anchors, told).groupBy("bucket").applyInPandas(shared, _REPLY), "suffix-anchors")
        told = told.unionByName(stored(ask(find, told.unionByName(known)), "suffix-suspects"))
        told = told.unionByName(stored(ask(triples, told).groupBy("bucket").applyInPandas(give_names, _REPLY), "suffix-names"))
        told = told.unionByName(stored(ask(suffixes, told).groupBy("bucket").applyInPandas(merge, _REPLY), "suffix-repeats"))
    out = (shards.groupBy("shard").cogroup(told.groupBy("shard"))
                 .applyInPandas(strip, "doc_id long, n_bytes long, n_removed long, "
                                       "removed array<struct<start:long,end:long>>, kept binary"))
    return out.withColumn("doc_id", F.when(F.col("doc_id") != _FIRST, F.col("doc_id"))).withColumnRenamed("doc_id", id_col)
