"""Exact ranked lexical search: best-first over ball trees of sparse document vectors.

A document is a sparse vector over the query terms: entry t is the saturated
frequency ``(10^9 tf) div (1000 tf + 20 m)``, with m from its length.  A query is
a vector of integer term weights.  Their inner product is the score.

1. Terms of the documents that occur in a query are counted once and stored;
   N, L and the document frequencies are sums over all documents.
2. Each task reads its documents in order and makes a ball tree of each
   ``tree_docs`` of them.  A node has the centroid c of its vectors and the
   radius around it, over all terms and over each band of terms.
3. Each query walks each tree best-first.  For x in a node,
   q.x <= q.c + sum over bands |q_b| r_b (Cauchy and Schwarz by band).  The
   least bound of three holds: one band, 32 bands, a band for each term (there
   the radius is how far a value is above its mean, and 0 for terms that the
   node lacks).  It is formed in doubles and rounded up by more than their
   error, so a subtree goes only if none of its documents can reach the k-th
   best score so far.  Documents of a leaf are scored in 64-bit integers.
4. Tasks report their k best for each query; the k best of those stay.

A task holds one tree and k documents for each query, whatever the input.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: ASCII that is no letter or digit stands between terms; A-Z are lower-cased; other characters stay.
_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: Rounding: sums of up to 2^20 doubles have a relative error below 2^-32, all terms being positive.
_UP = 1 + 2.0 ** -30
_BANDS = 32


def terms(text) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_BYTES).split() if isinstance(text, str) else []


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Queries:
    """Weight vectors of queries as arrays: ``at[i]:at[i+1]`` are the terms and weights of query ``i``."""

    def __init__(self, term_lists: list[list[int]], weights: np.ndarray):
        self.at = np.cumsum([0, *map(len, term_lists)])
        self.term = np.array([t for ts in term_lists for t in ts], np.int64)
        self.w = weights[self.term] if len(self.term) else np.empty(0, np.int64)

    def __len__(self) -> int:
        return len(self.at) - 1

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum of the values (one for each entry) of each query."""
        total = np.concatenate(([0.0], np.cumsum(values)))
        return total[self.at[1:]] - total[self.at[:-1]]


class BallTree:
    """A ball tree of sparse rows (``at``, ``term``, ``value``); values are integers of at most 10^6."""

    def __init__(self, at: np.ndarray, term: np.ndarray, value: np.ndarray, n_terms: int, leaf: int = 32):
        self.at, self.term, self.value, self.n_terms, self.leaf = at, term, value, n_terms, leaf
        self.child: list[tuple[int, int] | None] = []           # of each node; None: a leaf
        self.rows: list[np.ndarray] = []
        self.centre: list[tuple[np.ndarray, ...]] = []           # terms, means, radius of each term
        self.radius: list[np.ndarray] = []                       # of each band, then of all terms
        self._blocks: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self._grow(np.arange(len(at) - 1))

    def _entries(self, rows: np.ndarray):
        """Row number (from 0), term and value of all entries of the rows."""
        size = self.at[rows + 1] - self.at[rows]
        own = np.repeat(np.arange(len(rows)), size)
        place = np.arange(size.sum()) + np.repeat(self.at[rows] - np.cumsum(size) + size, size)
        return own, self.term[place], self.value[place].astype(float)

    def _grow(self, rows: np.ndarray) -> int:
        me = len(self.child)
        for held in (self.child, self.rows, self.centre, self.radius):
            held.append(None)
        own, term, value = self._entries(rows)
        mean = np.bincount(term, value, self.n_terms) / len(rows)
        used = np.flatnonzero(mean)
        above = np.zeros(self.n_terms)
        np.maximum.at(above, term, value)
        self.rows[me], self.centre[me] = rows, (used, mean[used], np.maximum(above[used] - mean[used], 0) * _UP)
        # |x - c|^2 by band: |c|^2 and, where x has an entry, (x - c)^2 - c^2
        band = term % _BANDS
        c2 = np.bincount(used % _BANDS, mean[used] ** 2, _BANDS)
        off = np.bincount(own * _BANDS + band, (value - mean[term]) ** 2 - mean[term] ** 2, len(rows) * _BANDS)
        d2 = np.maximum(off.reshape(-1, _BANDS) + c2, 0)
        whole = d2.sum(axis=1)
        # the difference of sums may lose about c2 * 2^-40 of either
        loss = (c2 + d2.max(axis=0)) * 2.0 ** -40 + 1
        self.radius[me] = np.append(np.sqrt(d2.max(axis=0) + loss), np.sqrt(whole.max() + loss.sum())) * _UP
        if len(rows) <= self.leaf or whole.max() <= loss.sum():
            return me
        # two far rows; the others by which of them is nearer
        dot = lambda x: np.bincount(own, value * x[term], len(rows))
        norm = np.bincount(own, value ** 2, len(rows))
        a = self._dense(rows[int(whole.argmax())])
        from_a = norm - 2 * dot(a)
        b = self._dense(rows[int(from_a.argmax())])
        side = dot(b - a)
        order = np.argsort(side, kind="stable")
        cut = min(max(int(np.searchsorted(side[order], ((b ** 2).sum() - (a ** 2).sum()) / 2)), len(rows) // 8), len(rows) - len(rows) // 8)
        left = self._grow(rows[np.sort(order[:cut])])
        self.child[me] = (left, self._grow(rows[np.sort(order[cut:])]))
        return me

    def _dense(self, row: int) -> np.ndarray:
        out = np.zeros(self.n_terms)
        out[self.term[self.at[row]:self.at[row + 1]]] = self.value[self.at[row]:self.at[row + 1]]
        return out

    def bounds(self, queries: Queries) -> np.ndarray:
        """At least the score of any document below each node, for each query: nodes x queries."""
        q = queries.w.astype(float)
        of = np.repeat(np.arange(len(queries)), np.diff(queries.at))
        length = np.sqrt(np.bincount(of * _BANDS + queries.term % _BANDS, q * q, len(queries) * _BANDS)).reshape(-1, _BANDS)
        length = np.column_stack((length, np.sqrt(queries.sums(q * q)))) * _UP
        out, mean, above = np.empty((len(self.child), len(queries))), np.zeros(self.n_terms), np.zeros(self.n_terms)
        for k, ((used, c, r1), r) in enumerate(zip(self.centre, self.radius)):
            mean[used], above[used] = c, r1
            near = np.bincount(of, q * mean[queries.term], len(queries))
            far = np.bincount(of, q * above[queries.term], len(queries))
            mean[used] = above[used] = 0
            far = np.minimum(far, np.minimum(length[:, :-1] @ r[:-1], length[:, -1] * r[-1]))
            out[k] = np.ceil((near + far) * _UP * _UP) + 1
        return out

    def scores(self, node: int, terms_: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Exact scores of the documents of a leaf."""
        if node not in self._blocks:
            own, term, value = self._entries(self.rows[node])
            used, at = np.unique(term, return_inverse=True)
            block = np.zeros((len(used), len(self.rows[node])), np.int64)
            block[at, own] = value.astype(np.int64)
            self._blocks[node] = used, block
        used, block = self._blocks[node]
        at = np.searchsorted(used, terms_)
        at[at == len(used)] = 0
        has = used[at] == terms_
        return w[has] @ block[at[has]]


class _Best:
    """The k best documents of one query: highest score first, then smallest key."""

    def __init__(self, k: int):
        self.k, self.score, self.key = k, np.empty(0, np.int64), np.empty(0, np.int64)

    @property
    def least(self) -> int:
        """What a further document must reach (with an earlier key, if it only reaches it)."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, key: np.ndarray) -> None:
        some = score >= self.least
        if some.any():
            score, key = np.concatenate((self.score, score[some])), np.concatenate((self.key, key[some]))
            order = np.lexsort((key, -score))[:self.k]
            self.score, self.key = score[order], key[order]


def walk(tree: BallTree, keys: np.ndarray, queries: Queries, best: list[_Best]) -> int:
    """Best-first walk of all queries through one tree; the number of leaves that were scored."""
    bounds, seen = tree.bounds(queries), 0
    for i, held in enumerate(best):
        a, b = queries.at[i], queries.at[i + 1]
        if a == b:
            continue
        term, w, bound = queries.term[a:b], queries.w[a:b], bounds[:, i]
        todo = [(-bound[0], 0)]
        while todo and -todo[0][0] >= held.least:
            _, node = heapq.heappop(todo)
            if tree.child[node] is None:
                held.add(tree.scores(node, term, w), keys[tree.rows[node]])
                seen += 1
            else:
                for child in tree.child[node]:
                    if bound[child] >= held.least:
                        heapq.heappush(todo, (-bound[child], child))
    return seen


_NONE = np.iinfo(np.int64).max                   # stands for a null id: after all others


def _counted(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """``doc_id, n, term, tf`` (arrays of 32-bit numbers) of each document, for the numbered terms."""
    shared = docs.sparkSession.sparkContext.broadcast(number)

    def kernel(frames):
        of = shared.value
        for f in frames:
            n, term, tf = [], [], []
            for text in f["text"].tolist():
                words = terms(text)
                n.append(len(words))
                own = [t for t in map(of.get, words) if t is not None]
                t, c = np.unique(np.array(own, np.int32), return_counts=True)
                term.append(t.tobytes())
                tf.append(c.astype(np.int32).tobytes())
            yield pd.DataFrame({"doc_id": f["doc_id"], "n": n, "term": term, "tf": tf})

    return docs.mapInPandas(kernel, "doc_id long, n long, term binary, tf binary")


def _frequencies(counted: DataFrame, n_terms: int) -> np.ndarray:
    """Documents with each term: sums of one array for each task; as many rows as terms."""
    def kernel(frames):
        total = np.zeros(n_terms, np.int64)
        for f in frames:
            total += np.bincount(np.frombuffer(b"".join(f["term"]), np.int32), minlength=n_terms)
        term = np.flatnonzero(total)
        yield pd.DataFrame({"t": term, "df": total[term]})

    out = np.zeros(n_terms, np.int64)
    sums = counted.select("term").mapInPandas(kernel, "t long, df long").groupBy("t").agg(F.sum("df").alias("df"))
    for t, df in sums.collect():                 # bounded by the terms of a block of items
        out[t] = df
    return out


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", item_col: str = "item_id",
           text_col: str = "text", tree_docs: int = 4096, leaf: int = 32, block_items: int = 5000) -> DataFrame:
    """``<item_col>, rank, <id_col>, score``: the ``k`` best documents of each item, scores above 0 only.

    Equal scores stand by rising id, null ids last.  Null texts, and texts
    without terms, match nothing and count for neither N nor L.  Repeated
    documents are ranked each by itself; each row of ``items`` is a query, so a repeated item gives its rows
    again.  Empty tables give no rows.  Other columns are not read.

    Items are taken in blocks of about ``block_items``, one pass over the documents for
    each; only the terms of a block are sent to tasks.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NONE)).alias("doc_id"),
                       F.col(text_col).cast("string").alias("text"))
    asked = items.select(F.col(item_col).alias("item"), F.col(text_col).cast("string").alias("text"))
    blocks = max(1, -(-asked.count() // block_items))
    out = None
    for b in range(blocks):
        some = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
        found = _search(rows, some, k, tree_docs, leaf)
        out = found if out is None else out.unionByName(found)
    return out.select(F.col("item").alias(item_col), "rank", F.when(F.col("doc_id") != _NONE, F.col("doc_id")).alias(id_col),
                      "score")


def _search(rows: DataFrame, asked: DataFrame, k: int, tree_docs: int, leaf: int) -> DataFrame:
    spark = rows.sparkSession
    kind = asked.schema["item"].dataType.simpleString()
    block = asked.collect()                      # a block of queries
    lists = [sorted(set(terms(row["text"]))) for row in block]
    number = {t: i for i, t in enumerate(sorted({t for ts in lists for t in ts}))}
    n_terms = max(1, len(number))
    counted = stored(_counted(rows, number), "lexical-terms")
    n_docs, n_words = counted.agg(F.sum(F.when(F.col("n") > 0, 1)), F.sum("n")).first()
    n_docs, n_words = n_docs or 0, n_words or 0
    df = _frequencies(counted, n_terms)
    weights = np.array([weight(n_docs, int(x)) for x in df], np.int64)
    shared = spark.sparkContext.broadcast(Queries([[number[t] for t in ts] for ts in lists], weights))

    def kernel(frames):
        queries = shared.value
        best = [_Best(k) for _ in range(len(queries))]
        held, size = [], 0

        def flush():
            f = pd.concat(held)
            term = [np.frombuffer(x, np.int32) for x in f["term"]]
            at = np.cumsum([0, *map(len, term)])
            tf = np.frombuffer(b"".join(f["tf"]), np.int32).astype(np.int64)
            m = np.array([50 + 50 * n * n_docs // n_words for n in f["n"].tolist()], np.int64)
            value = 1_000_000_000 * tf // (1000 * tf + 20 * np.repeat(m, np.diff(at)))
            tree = BallTree(at, np.concatenate(term).astype(np.int64), value, n_terms, leaf)
            walk(tree, f["doc_id"].to_numpy(np.int64), queries, best)

        for f in frames:
            for a in range(0, len(f), tree_docs):
                held.append(f.iloc[a:a + tree_docs])
                size += len(held[-1])
                if size >= tree_docs:
                    flush()
                    held, size = [], 0
        if size:
            flush()
        for i, b in enumerate(best):
            if len(b.key):
                yield pd.DataFrame({"i": i, "doc_id": b.key, "score": b.score})

    found = (counted.where(F.length("term") > 0).select("doc_id", "n", "term", "tf")
                    .mapInPandas(kernel, "i int, doc_id long, score long"))
    order = Window.partitionBy("i").orderBy(F.desc("score"), "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, row["item"]) for i, row in enumerate(block)], f"i int, item {kind}")
    return ranked.join(F.broadcast(names), "i").select("item", "rank", "doc_id", "score")
