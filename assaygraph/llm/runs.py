"""Periodic runs in word sequences, found online by catchers of squares.

A run is a stretch of consecutive words with smallest period ``q`` and at
least ``max(least, 2 q)`` words that no neighbouring word extends.  Words are
appended to a :class:`SquareCatcher`; at any time it holds the runs of what it
has read.

* A completed block of ``m = 4, 8, 16, ...`` words (starting at a multiple of
  ``m``) is a catcher for the periods ``2m ... 4m - 1``: the left half of any
  square of such a period holds a whole block at its front.  The word that
  completes a window of ``m`` words asks the two blocks at those distances
  whether they are equal to it, by a hash kept for each power of two.
* An equal block opens a stretch of that period: words are compared, to the
  left at once, to the right as far as the text goes and with each appended
  word from then on.  With ``2 q`` words it is a square, and the squares of
  one stretch are one run, which ends at the first word that differs.
* Periods 1 to 7 need no blocks: each appended word meets the words so far back.

Each appended word takes two comparisons at each of log n levels, whatever the
text.  Words of a block inside a run that is known already open nothing (a
multiple of its period ends with it).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)     # odd multipliers
_SHORT = 8                                       # periods below are compared directly
_CHUNK = 1 << 16                                 # words appended at a time


def _pair(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A hash of two hashes, not linear, so that no text makes sums cancel."""
    h = x * _A ^ (y + _B) * _B
    h ^= h >> np.uint64(29)
    h *= _A
    return h ^ (h >> np.uint64(32))


def _agree(x: np.ndarray, y: np.ndarray, back: bool = False) -> int:
    """Equal entries at the front of two arrays of one length (at the end, if ``back``)."""
    if back:
        x, y = x[::-1], y[::-1]
    at, step, n = 0, 32, len(x)
    while at < n:
        differ = np.flatnonzero(x[at:at + step] != y[at:at + step])
        if len(differ):
            return at + int(differ[0])
        at, step = at + step, step * 4
    return n


class SquareCatcher:
    """Runs of a sequence of integers that grows at its end."""

    def __init__(self, least: int = 12):
        self.least = least
        self.n = 0
        self._w = np.empty(256, np.int64)
        self._hash: list[tuple[int, np.ndarray]] = []           # of windows of 1, 2, 4, ...: first place, hashes
        self._broken = {p: p - 1 for p in range(1, _SHORT)}     # last word that differs from the one p before
        self._live: dict[int, int] = {}                         # longer period -> start of the stretch at the end
        self._closed: list[tuple[int, int, int]] = []           # start, end, period

    def append(self, words) -> None:
        words = np.asarray(words, np.int64)
        for k in range(0, len(words), _CHUNK):
            self._append(words[k:k + _CHUNK])

    def _append(self, new: np.ndarray) -> None:
        old, n = self.n, self.n + len(new)
        if n > len(self._w):
            grown = np.empty(max(n, 2 * len(self._w)), np.int64)
            grown[:old] = self._w[:old]
            self._w = grown
        self._w[old:n] = new
        self.n = n
        w = self._w[:n]
        for p, start in list(self._live.items()):
            more = _agree(w[old:], w[old - p:n - p])
            if old + more < n:
                del self._live[p]
                self._close(start, old + more, p)
        for p in range(1, min(_SHORT, n)):
            first = max(old, p)
            differ = np.flatnonzero(w[first:] != w[first - p:n - p])
            if len(differ):
                bounds = np.concatenate(([self._broken[p]], differ + first))
                for k in np.flatnonzero(np.diff(bounds) - 1 + p >= max(self.least, 2 * p)).tolist():
                    self._closed.append((int(bounds[k]) + 1 - p, int(bounds[k + 1]), p))
                self._broken[p] = int(bounds[-1])
        self._advance(old)
        k, m = 2, 4
        while 4 * m <= n:
            self._catch(k, m, old)
            k, m = k + 1, 2 * m

    def _close(self, start: int, end: int, p: int) -> None:
        if end - start >= max(self.least, 2 * p):
            self._closed.append((start, end, p))

    def _advance(self, old: int) -> None:
        """Hashes of the windows that the appended words complete; no more than 5 m + 1 are kept of each length m."""
        n, k, m = self.n, 0, 1
        while m <= n:
            first = max(0, old - m + 1)                          # first window that is new
            if k == 0:
                own = self._w[first:n].view(np.uint64)
                new = _pair(own, own)
            else:
                base, lower = self._hash[k - 1]
                half = m // 2
                new = _pair(lower[first - base:n - m + 1 - base], lower[first + half - base:n - half + 1 - base])
            if k == len(self._hash):
                self._hash.append((first, new))
            else:
                base, have = self._hash[k]
                keep = max(base, min(first, old - 5 * m))
                self._hash[k] = (keep, np.concatenate((have[keep - base:], new)))
            k, m = k + 1, 2 * m

    def _known(self) -> list[tuple[int, int, int]]:
        """Runs so far, those that reach the end of the text included."""
        out = list(self._closed)
        for p, last in self._broken.items():
            if self.n + p - 1 - last >= max(self.least, 2 * p) and self.n > p:
                out.append((last + 1 - p, self.n, p))
        out += [(s, self.n, p) for p, s in self._live.items() if self.n - s >= max(self.least, 2 * p)]
        return out

    def _catch(self, k: int, m: int, old: int) -> None:
        """Appended windows of ``m`` words meet the two blocks 2m ... 4m - 1 words before."""
        base, h = self._hash[k]
        j = np.arange(max(2 * m, old - m + 1), self.n - m + 1)
        if not len(j):
            return
        block = (j - 2 * m) // m * m
        own = h[j - base]
        near = np.flatnonzero(own == h[block - base])
        far = np.flatnonzero((own == h[np.maximum(block - m, base) - base]) & (block >= m))
        if not len(near) and not len(far):
            return
        c = np.concatenate((block[near], block[far] - m))
        p = np.concatenate((j[near], j[far])) - c
        known = self.runs()
        if known:
            starts, lengths, periods = (np.array(x) for x in zip(*known))
            ends = starts + lengths
            reach = np.maximum.accumulate(ends)
            by = np.maximum.accumulate(np.where(ends == reach, np.arange(len(ends)), 0))     # which run reaches so far
            at = np.searchsorted(starts, c, side="right") - 1
            inside = (at >= 0) & (reach[at] >= c + p + m) & (p % periods[by[at]] == 0)
            c, p = c[~inside], p[~inside]
        w, n = self._w, self.n
        order = np.lexsort((c, p))
        period, end = 0, 0                                       # the last stretch of this period ends there
        for c, p in zip(c[order].tolist(), p[order].tolist()):
            if p != period:
                period, end = p, 0
            if c + p + m <= end or self._live.get(p, n) <= c:
                continue
            right = _agree(w[c:n - p], w[c + p:n])
            if right < m:
                continue                                         # equal hashes, other words
            start = c - _agree(w[:c], w[p:c + p], back=True)
            end = c + p + right
            if end == n:
                self._live[p] = start
            else:
                self._close(start, end, p)

    def runs(self) -> list[tuple[int, int, int]]:
        """``start, length, period`` by start, then period; the smallest period of each stretch."""
        least: dict[tuple[int, int], int] = {}
        for start, end, p in self._known():
            least[start, end] = min(p, least.get((start, end), p))
        return sorted((s, e - s, p) for (s, e), p in least.items())


def _numbered(words: list) -> np.ndarray:
    number: dict[bytes, int] = {}
    return np.fromiter((number.setdefault(x, len(number)) for x in words), np.int64, len(words))


def periodic_runs(docs: DataFrame, least: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>, n_words, runs array<struct<start,length,period>>, collapsed`` for each row of ``docs``.

    Words stand between ASCII white space and count from 0.  ``runs`` are in
    order of start, then period.  ``collapsed`` are the words that no run
    holds after its first period, joined by a space.  Null, empty and blank
    texts have no words, no runs and an empty ``collapsed``.  Each row is
    judged alone: repeated rows and null ids give a row each, an empty table
    none; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def kernel(frames):
        for f in frames:
            found, kept, sizes = [], [], []
            for text in f["text"].tolist():
                words = text.encode("utf-8", "surrogatepass").split() if isinstance(text, str) else []
                runs = []
                if len(words) >= least:
                    catcher = SquareCatcher(least)
                    catcher.append(_numbered(words))
                    runs = catcher.runs()
                sizes.append(len(words))
                found.append([{"start": s, "length": n, "period": p} for s, n, p in runs])
                if runs:
                    stays = np.ones(len(words), bool)
                    for s, n, p in runs:
                        stays[s + p:s + n] = False
                    words = [words[k] for k in np.flatnonzero(stays).tolist()]
                kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            yield pd.DataFrame({"id": f["id"], "n_words": sizes, "runs": found, "collapsed": kept})

    out = rows.mapInPandas(kernel, f"id {kind}, n_words long, "
                                   "runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return out.withColumnRenamed("id", id_col)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``<id_col>, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256`` of found runs.

    The four numbers are of the longest run (ties: smallest start, then
    period) and null where there is none.
    """
    longest = F.reduce("runs", F.expr("cast(null as struct<start:bigint,length:bigint,period:bigint>)"),
                       lambda a, x: F.when(a.isNull() | (x["length"] > a["length"]), x).otherwise(a))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]),
                                                   F.lit("\n")))
    return (found.withColumn("longest", longest)
                 .select(id_col, F.size("runs").cast("long").alias("n_runs"),
                         *[F.col(f"longest.{c}").alias(c) for c in ("start", "length", "period")],
                         F.expr("(1000 * longest.length) div longest.period").alias("exponent_milli"),
                         F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"),
                         F.sha2("collapsed", 256).alias("collapsed_sha256")))


def with_periodic_tails(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with a periodic tail in about a tenth of the texts, chosen by the crc32 of the id.

    With h the crc32 of the decimal id, g = h div 10 and n words: where h mod
    10 is 0 and there are words, each word from a = g mod n on becomes word
    a + (i - a) mod p, with p = 1 + (n - a) div (3 + g mod 8); words are then
    joined by a space.  Null ids and null texts stay as they are.
    """
    h: Column = F.crc32(F.col(id_col).cast("string").cast("binary"))
    words = F.expr(f"filter(split(`{text_col}`, '[\\\\x20\\\\x09-\\\\x0D]+'), x -> x != '')")
    chosen = docs.select("*", h.alias("__h")).withColumn("__w", F.when(F.col("__h") % 10 == 0, words))
    chosen = (chosen.withColumn("__n", F.size("__w").cast("long"))
                    .withColumn("__g", F.expr("__h div 10")))
    chosen = chosen.withColumn("__a", F.when(F.col("__n") > 0, F.expr("__g % __n")))
    chosen = chosen.withColumn("__p", F.expr("1 + (__n - __a) div (3 + __g % 8)"))
    tail = F.expr("concat_ws(' ', transform(__w, (x, i) -> if(i < __a, x, __w[cast(__a + (i - __a) % __p as int)])))")
    text = F.when(F.col("__p").isNotNull(), tail).otherwise(F.col(text_col))
    return chosen.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
