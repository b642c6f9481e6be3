"""Token ids in byte-aligned variable-length coding.

File format: a folder with two Parquet tables.

* ``codebook``: ``token, rank, n``; tokens by falling corpus count, then id.
* ``blocks``: one row for each block of documents, by rising id within a block
  and across blocks: ``seq`` (blocks stand in this order; its upper 31 bits are the
  part of the table), ``doc_ids``, ``n_tokens`` (of each document), ``control``, ``data``.  Each token is its rank in 1 to 4 bytes, little-endian
  and without leading zero bytes; ``control`` has two bits for each token (its
  number of bytes less one), four tokens in a byte from the low bits up.

Frequent tokens have small ranks, so most take one byte.  Decoding needs no
loop: a table of 256 rows gives the four lengths behind a control byte, and
sums of them the place of each token's bytes.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import encoder
from .common import stored, tidy_shuffles

#: Lengths of the four tokens behind each control byte.
LENGTHS = ((np.arange(256)[:, None] >> (2 * np.arange(4))[None, :]) & 3).astype(np.int64) + 1


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """``control, data`` of an array of ranks."""
    ranks = np.ascontiguousarray(ranks, dtype="<u4")
    if not len(ranks):
        return b"", b""
    code = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    padded[:len(ranks)] = code
    four = padded.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    used = np.arange(4)[None, :] <= code[:, None]
    return control.tobytes(), ranks.view(np.uint8).reshape(-1, 4)[used].tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` ranks behind ``control`` and ``data``: table lookup, no loop over tokens."""
    if not n:
        return np.empty(0, np.uint32)
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    at = np.cumsum(size) - size
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = raw[at].astype(np.uint32)
    for k in range(1, int(size.max())):
        more = np.flatnonzero(size > k)
        out[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _tokens(docs: DataFrame, vocab: str, end_id: int, id_col: str, text_col: str, partitions: int | None,
            part_chars: int):
    """``nth, doc_id, ids`` where ``nth`` rises with the id; ids are packed as 16-bit numbers where all fit, else 32-bit.

    Rows with ``nth`` -1 hold the token counts of a task.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = partitions or max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-chars // part_chars))
    # the front of the text spreads rows that share an id (or have none) over several tasks
    rows = rows.repartitionByRange(n, F.col("doc_id"), F.substring("text", 1, 32)).sortWithinPartitions("doc_id", "text")
    rows = rows.withColumn("nth", F.monotonically_increasing_id())
    end = int(end_id).to_bytes(4, "little")

    def kernel(frames):
        enc, total = encoder(vocab), np.zeros(1 << 16, np.int64)
        for f in frames:
            out = []
            for raw in enc.encode_all(f["text"].tolist()):
                ids = np.frombuffer(raw + end, "<u4")
                short = ids.max() <= 0xFFFF
                out.append((b"\2" if short else b"\4") + (ids.astype("<u2") if short else ids).tobytes())
            c = np.bincount(np.concatenate([_ids(raw) for raw in out]) if out else np.empty(0, np.int64), minlength=len(total))
            c[:len(total)] += total
            total = c
            yield pd.DataFrame({"nth": f["nth"], "doc_id": f["doc_id"].astype("Int64"), "ids": out})
        enc.rest()
        # the counts of the task, on a row of their own
        token = np.flatnonzero(total)
        yield pd.DataFrame({"nth": [-1], "doc_id": pd.array([None], "Int64"),
                            "ids": [np.concatenate((token, total[token])).astype("<i8").tobytes()]})

    return rows.mapInPandas(kernel, "nth long, doc_id long, ids binary")


def _ids(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if raw[0] == 2 else "<u4", offset=1)


def codebook(counts: DataFrame) -> DataFrame:
    """``token, rank, n`` over all documents, from the counts of all tasks; at most one row for each entry of the vocabulary."""
    def pairs(frames):
        for f in frames:
            for raw in f["ids"]:
                token, n = np.frombuffer(raw, "<i8").reshape(2, -1)
                yield pd.DataFrame({"token": token, "n": n})

    counts = counts.select("ids").mapInPandas(pairs, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    by_count = Window.orderBy(F.desc("n"), "token")           # one row for each entry of the vocabulary
    return counts.withColumn("rank", F.row_number().over(by_count) - 1)


def write(docs: DataFrame, path: str, vocab: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text",
          block_tokens: int = 1 << 20, partitions: int | None = None, part_chars: int = 8_000_000) -> None:
    """Writes the token ids of all documents (and ``end_id`` after each) to the folder ``path``.

    Null and empty texts have the end id alone.  Repeated ids stand next to
    each other, by text; null ids come first.  Documents are never cut: a
    block ends with the document that reaches ``block_tokens``.  An empty
    table gives empty files that read back as no rows.

    Each row carries its place in the order (``nth``), so no later step relies
    on the order in which Spark reads files or merges spilled runs.
    """
    spark = docs.sparkSession
    with tidy_shuffles(spark):
        raw = stored(_tokens(docs, vocab, end_id, id_col, text_col, partitions, part_chars), "token-ids")
    codebook(raw.where("nth < 0")).coalesce(1).write.parquet(f"{path}/codebook")
    # the rank of each vocabulary entry: bounded by the vocabulary, whatever the corpus
    book = spark.read.parquet(f"{path}/codebook").select("token", "rank").collect()
    rank = np.zeros(max((r[0] for r in book), default=0) + 1, np.uint32)
    for token, place in book:
        rank[token] = place
    shared = spark.sparkContext.broadcast(rank)

    def kernel(frames):
        first, rows, held = 0, [], 0

        def block():
            control, data = encode_ranks(shared.value[np.concatenate([ids for _, ids in rows])])
            return pd.DataFrame({"doc_ids": [[k for k, _ in rows]], "n_tokens": [[len(x) for _, x in rows]],
                                 "control": [control], "data": [data], "seq": [first]})

        for f in frames:
            keys = [None if null else key for null, key in zip(f["no_id"].tolist(), f["doc_id"].tolist())]
            for nth, key, ids in zip(f["nth"].tolist(), keys, f["ids"].tolist()):
                if rows and (nth != first + len(rows) or held >= block_tokens):
                    yield block()
                    rows, held = [], 0
                if not rows:
                    first = nth
                rows.append((key, _ids(ids)))
                held += len(rows[-1][1])
        if rows:
            yield block()

    known = raw.where("nth >= 0").select("nth", F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.isnull("doc_id").alias("no_id"), "ids")
    blocks = known.mapInPandas(kernel, _BLOCKS)
    blocks.write.option("compression", "zstd").parquet(f"{path}/blocks")


_BLOCKS = "doc_ids array<long>, n_tokens array<int>, control binary, data binary, seq long"


def read(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` for each document of the files.

    ``start`` counts the ids of all documents before; ``ids_crc32`` is of the
    decoded ids as little-endian unsigned 32-bit integers.
    """
    book = spark.read.schema("token long, n long, rank int").parquet(f"{path}/codebook").select("token", "rank")
    token = np.zeros(book.count() + 1, np.uint32)              # bounded by the vocabulary
    for t, place in book.collect():
        token[place] = t
    shared = spark.sparkContext.broadcast(token)

    def kernel(frames):
        for f in frames:
            for seq, keys, sizes, control, data in zip(f["seq"], f["doc_ids"], f["n_tokens"], f["control"], f["data"]):
                sizes = np.asarray(sizes, np.int64)
                raw = shared.value[decode_ranks(control, data, int(sizes.sum()))].astype("<u4").tobytes()
                ends = 4 * np.cumsum(sizes)
                crcs = [zlib.crc32(raw[e - 4 * n:e]) for e, n in zip(ends.tolist(), sizes.tolist())]
                yield pd.DataFrame({"seq": seq, "doc_id": pd.array(list(keys), dtype="Int64"), "before": ends // 4 - sizes,
                                    "n_tokens": sizes, "ids_crc32": crcs})

    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    sizes = blocks.select(F.shiftright("seq", 33).alias("shard"), "seq", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    # starts of blocks: within a part by its blocks, across parts by one row for each part
    in_shard = Window.partitionBy("shard").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    of_shards = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    shards = sizes.groupBy("shard").agg(F.sum("n").alias("n")).withColumn("s0", F.coalesce(F.sum("n").over(of_shards), zero))
    starts = (sizes.withColumn("b0", F.coalesce(F.sum("n").over(in_shard), zero)).drop("n")
                   .join(shards.select("shard", "s0"), "shard")
                   .select("seq", (F.col("b0") + F.col("s0")).alias("block_start")))
    rows = blocks.mapInPandas(kernel, "seq long, doc_id long, before long, n_tokens long, ids_crc32 long")
    return (rows.join(starts, "seq")
                .select("doc_id", (F.col("block_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"))
