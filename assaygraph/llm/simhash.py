"""SimHash near-duplicates by pivot distance tables.

A table of Hamming distances from each fingerprint to many reference
fingerprints (pivots) replaces most pair comparisons:

* Each fingerprint is *kept* at its nearest pivot.  Let x and y differ in at
  most ``max_bits`` bits and let y be the one nearer to its own nearest pivot
  q.  Then ``d(x, q) <= d(y, q) + max_bits <= min_p d(x, p) + max_bits``: so x
  *asks* at every pivot within ``max_bits`` of its own minimum, and no pair is
  missed.  Every fingerprint goes to a few pivots, not to all.
* At a pivot, a pair is discarded as soon as one coordinate (distance to a
  pivot) differs by more than ``max_bits``; survivors are verified on bits.

Equal fingerprints are one class from the start (one row per class with its
smallest id), so groups of copies never meet as pairs.  Pivots are a hash
sample of the fingerprints, so that dense regions get pivots of their own;
crowded pivots are cut into blocks of bounded size, all pairs of blocks
compared.  A block returns the edges of a spanning forest, not all pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.cluster import connected_components
from .common import stored

#: Hashes whose bits are counted at a time.
_CHUNK = 1 << 15


def fingerprint(text: str | None, shingle_words: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a text: A-Z lowered, words between ASCII white space."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, k = b" ".join(words), min(shingle_words, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[:len(words) - k + 1].tolist()
    ends, digest, n = (ends[k - 1:] - 1).tolist(), xxhash.xxh64_intdigest, len(starts)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        h = np.array([digest(joined[a:b], seed) for a, b in zip(starts[at:at + _CHUNK], ends[at:at + _CHUNK])],
                     dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = 3, seed: int = 42, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``_id long, fp long``: one row for each input row (fp: the bits as a signed long)."""
    def kernel(frames):
        for f in frames:
            fps = np.array([fingerprint(t, shingle_words, seed) for t in f["_text"]], dtype=np.uint64)
            yield pd.DataFrame({"_id": f["_id"], "fp": fps.view(np.int64)})

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return rows.mapInPandas(kernel, "_id long, fp long")


def _forest(pairs_a: np.ndarray, pairs_b: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the given links, as stars at each part's smallest member."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in zip(pairs_a.tolist(), pairs_b.tolist()):
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(x, root(x)) for x in parent if root(x) != x]


def links(classes: DataFrame, max_bits: int = 2, max_pivots: int = 65_536, table_pivots: int = 8,
          block_rows: int = 4096) -> DataFrame:
    """``a long, b long``: a forest that connects what links of ``fp`` at ``max_bits`` or fewer bits connect.

    ``classes`` has one row per distinct ``fp``.  ``max_pivots`` bounds what is
    broadcast (8 bytes each); it changes the cost, never the result.
    """
    spark = classes.sparkSession
    n = classes.count()
    want = int(min(max_pivots, max(64, 2 * math.isqrt(max(n, 1)))))
    pivots = np.array([r[0] for r in classes.orderBy(F.xxhash64("fp"), "fp").select("fp").limit(want).collect()],
                      dtype=np.int64).view(np.uint64)
    if not len(pivots):
        return spark.createDataFrame([], "a long, b long")

    def assign(frames):
        for f in frames:
            fp = f["fp"].to_numpy().view(np.uint64)
            step = max(1, 2_000_000 // len(pivots))
            for at in range(0, len(fp), step):
                some = fp[at:at + step]
                d = np.bitwise_count(some[:, None] ^ pivots[None, :])
                low = d.min(axis=1)
                row, cell = np.nonzero(d <= (low + max_bits)[:, None])
                yield pd.DataFrame({"cell": cell.astype(np.int32), "fp": some[row].view(np.int64),
                                    "kept": cell == d.argmin(axis=1)[row]})

    placed = stored(classes.select("fp").mapInPandas(assign, "cell int, fp long, kept boolean"), "simhash-cells")
    # one row for each pivot, so bounded by max_pivots: blocks of kept rows and of asking rows
    blocks = placed.groupBy("cell").agg(F.ceil(F.count_if("kept") / block_rows).cast("int").alias("n_kept"),
                                        F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("n_asking"))
    placed = placed.join(F.broadcast(blocks.where("n_kept > 0")), "cell")
    part = F.xxhash64("fp", F.lit("block"))
    kept = (placed.where("kept").withColumn("i", F.pmod(part, F.col("n_kept")).cast("int"))
                  .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n_asking") - 1))))
    asking = (placed.withColumn("j", F.pmod(part, F.col("n_asking")).cast("int"))
                    .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n_kept") - 1))))
    cols = ["cell", "i", "j", "fp"]
    rows = (kept.select(*cols, F.lit(True).alias("kept"))
                .unionByName(asking.select(*cols, F.lit(False).alias("kept"))))

    def compare(f: pd.DataFrame) -> pd.DataFrame:
        own = pivots[int(f["cell"].iloc[0])]
        coords = np.concatenate(([own], pivots[:table_pivots]))
        fp = f["fp"].to_numpy().view(np.uint64)
        is_kept = f["kept"].to_numpy().astype(bool)
        stay, ask = fp[is_kept], fp[~is_kept]
        table = [np.bitwise_count(x[None, :] ^ coords[:, None]).astype(np.int8) for x in (stay, ask)]
        found_a, found_b = [], []
        step = max(1, 4_000_000 // max(1, len(stay)))
        for at in range(0, len(ask), step):
            near = np.abs(table[1][0, at:at + step, None] - table[0][0][None, :]) <= max_bits
            p, q = np.nonzero(near)
            p += at
            for c in range(1, len(coords)):
                ok = np.abs(table[1][c][p] - table[0][c][q]) <= max_bits
                p, q = p[ok], q[ok]
            ok = (np.bitwise_count(ask[p] ^ stay[q]) <= max_bits) & (ask[p] != stay[q])
            found_a.append(ask[p[ok]])
            found_b.append(stay[q[ok]])
        edges = _forest(np.concatenate(found_a or [ask[:0]]).view(np.int64),
                        np.concatenate(found_b or [ask[:0]]).view(np.int64))
        return pd.DataFrame(edges, columns=["a", "b"], dtype="int64")

    return rows.groupBy("cell", "i", "j").applyInPandas(compare, "a long, b long")


def near_duplicates(docs: DataFrame, shingle_words: int = 3, max_bits: int = 2, seed: int = 42,
                    id_col: str = "doc_id", text_col: str = "text", max_pivots: int = 65_536) -> DataFrame:
    """``<id_col> long, fingerprint string, component_id long`` for each input row.

    ``component_id`` is the smallest id reachable over links of ``max_bits`` or
    fewer differing bits.  Null, empty and blank texts have fingerprint zero
    and link like any other.  Repeated rows stay repeated.  Rows with a null
    id get a fingerprint and the component of their class (null if all ids of
    the component are null).  Other columns are not read.  An empty table
    gives an empty result.
    """
    fps = stored(fingerprints(docs, shingle_words, seed, id_col, text_col), "simhash-fps")
    classes = stored(fps.groupBy("fp").agg(F.min("_id").alias("rep")), "simhash-classes")
    found = stored(links(classes, max_bits, max_pivots), "simhash-links")
    comps = connected_components(found, "a", "b", node_col="fp")
    named = classes.join(comps, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    lows = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.join(lows, "component").select("fp", "component_id")
    return (fps.join(named, "fp")
               .select(F.col("_id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                       "component_id"))
