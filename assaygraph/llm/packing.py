"""Best-fit packing with certified bin counts.

Every document becomes pieces of at most ``capacity`` tokens (only longer
documents are cut, the first piece takes the remainder).  A full piece is a
sequence of its own.  The others are dealt evenly over partitions, each packed
by best-fit decreasing.  Dual-feasible functions give a lower bound for each
partition: a partition that meets it is certified as optimal.  Partitions with
a gap give up their sequences that are not full; these documents change
places, are packed again in fewer and larger groups, and the better of old and
new stays, until no round helps.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import encoder
from .common import stored

_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, vocab: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """The pieces of all documents: ids by the vocabulary file, then ``end_id``."""
    end = int(end_id).to_bytes(4, "little")

    def kernel(frames):
        enc = encoder(vocab)
        for f in frames:
            rows = []
            for key, raw in zip(f["_id"].tolist(), enc.encode_all(f["_text"].tolist())):
                raw += end
                n = len(raw) // 4
                cuts = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                rows += [(key, i, a, b - a, zlib.crc32(raw[4 * a:4 * b]))
                         for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield out.astype({"doc_id": "Int64"})
        enc.rest()

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return rows.mapInPandas(kernel, _PIECE)


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each item: longest first, each into the fullest bin that takes it."""
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_, bins, out = 0, 0, np.empty(len(lengths), np.int64)      # open_: bit f is set if a bin has f free
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = open_ >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            b = by_free[free].pop()
            if not by_free[free]:
                open_ &= ~(1 << free)
        else:
            free, b, bins = capacity, bins, bins + 1
        out[i] = b
        if free > size:
            by_free[free - size].append(b)
            open_ |= 1 << (free - size)
    return out


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The largest bound that three families of dual-feasible functions prove for a bin count.

    For a dual-feasible f, items of one bin have sum f <= f(capacity); so no
    packing has fewer bins than sum f(items) / f(capacity).  Integers only.
    """
    sizes, counts = np.unique(lengths, return_counts=True)
    sizes, counts = sizes.astype(np.int64), counts.astype(np.int64)
    if not len(sizes):
        return 0
    best = -(-int((sizes * counts).sum()) // capacity)
    for k in range(1, 21):                  # rounding down to k-ths, exact multiples kept
        scaled = (k + 1) * sizes
        f = np.where(scaled % capacity == 0, sizes * k, scaled // capacity * capacity)
        best = max(best, -(-int((f * counts).sum()) // (k * capacity)))
    for eps in np.unique(np.minimum(sizes, capacity - sizes + 1)).tolist():
        if not 0 < eps <= capacity // 2:
            continue
        f = np.where(sizes > capacity - eps, capacity, np.where(sizes < eps, 0, sizes))
        best = max(best, -(-int((f * counts).sum()) // capacity))
        whole = capacity // eps             # small items count in units of eps, large ones by what they leave
        f = np.where(2 * sizes > capacity, 2 * (whole - (capacity - sizes) // eps),
                     np.where(2 * sizes == capacity, whole, 2 * (sizes // eps)))
        best = max(best, -(-int((f * counts).sum()) // (2 * whole)))
    return best


def _pack_group(f: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Packs one group anew; keeps the bins that it had if they were no more."""
    lengths = f["length"].to_numpy()
    order = np.argsort(f["item"].to_numpy(), kind="stable")      # the same result whatever the order of arrival
    bins = np.empty(len(f), np.int64)
    bins[order] = best_fit(lengths[order], capacity)
    items = pd.Series(f["item"].to_numpy())
    name = items.groupby(bins).transform("min").to_numpy()       # a bin is named by its first item
    had = f["bin"].to_numpy()
    if had[0] >= 0 and len(np.unique(had)) <= bins.max() + 1:
        name = had
    gap = len(np.unique(name)) - lower_bound(lengths, capacity)
    load = pd.Series(lengths).groupby(name).transform("sum").to_numpy()
    return pd.DataFrame({"item": f["item"].to_numpy(), "length": lengths, "bin": name,
                         "loose": (gap > 0) & (load < capacity)})


def pack(items: DataFrame, capacity: int = 2048, group_rows: int = 20_000, rounds: int = 4) -> DataFrame:
    """``item, length, bin`` for rows ``item long, length long`` (distinct items, lengths below ``capacity``).

    ``bin`` is the smallest item of the bin.  Groups have about ``group_rows``
    items by a hash, so none is hot; in each further round only the loose
    sequences of partitions with a gap take part.
    """
    schema = "item long, length long, bin long, loose boolean"
    n = items.count()
    current = items.select("item", "length", F.lit(-1).cast("long").alias("bin"))
    done = []
    for turn in range(rounds):
        groups = max(1, round(n / (group_rows << turn)))
        # by the bin once there is one: a bin moves as a whole, and all its documents are packed anew
        key = F.when(F.col("bin") < 0, F.col("item")).otherwise(F.col("bin"))
        keyed = current.withColumn("_g", F.pmod(F.xxhash64(key, F.lit(turn)), F.lit(groups)))
        packed = stored(keyed.groupBy("_g").applyInPandas(lambda f: _pack_group(f, capacity), schema), "packing-round")
        done.append(packed.where("not loose"))
        current = packed.where("loose").select("item", "length", "bin")
        left = current.count()
        if not left or groups == 1 or turn == rounds - 1:
            done.append(packed.where("loose"))
            break
        n = left
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("item", "length", "bin")


def pack_documents(docs: DataFrame, vocab: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """Pieces with ``sequence_id long`` and ``offset long`` (columns of ``pieces`` first).

    Null and empty texts are one piece of the end id alone.  Repeated rows are
    packed as often as they stand there; rows with a null id keep it.  An
    empty table gives no rows.  Other columns are not read.
    """
    cut = pieces(docs, vocab, capacity, end_id, id_col, text_col)
    cut = stored(cut.withColumn("item", F.monotonically_increasing_id()), "packing-items")
    small = cut.where(F.col("length") < capacity)
    bins = stored(pack(small.select("item", "length"), capacity), "packing-bins")
    placed = small.join(bins.select("item", "bin"), "item")
    whole = cut.where(F.col("length") >= capacity).withColumn("bin", F.col("item"))
    whole = whole.withColumn("offset", F.lit(0).cast("long"))
    upto = Window.partitionBy("bin").orderBy("item").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(upto), F.lit(0).cast("long")))
    cols = [F.col("doc_id").alias(id_col), "piece", "start", "length", "ids_crc32",
            F.col("bin").alias("sequence_id"), "offset"]
    return placed.select(*cols).unionByName(whole.select(*cols))
