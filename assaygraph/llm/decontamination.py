"""Benchmark decontamination over a distributed positional inverted index.

The index is a table of postings ``term, row, pos`` of every training token in
the shared folder.  It is split by documents: each part holds the postings of
its documents, those of a term next to each other (sorted by the term's 64-bit
hash, which takes no comparison of words), so building it moves no posting
between machines.

A phrase is found by intersecting offset-adjusted lists (``pos - offset`` of
each of its terms), from the term with the fewest postings in the training
text upwards.  The rarest lists are short, and what survives them fixes the
few documents whose other postings are needed at all.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, folder, maybe_broadcast, stored

#: What stands between words, after A-Z are lowered.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Term of the posting at the end of each document (no word has this character); its position is the number of words.
END = "\x00"
_INDEX = "term string, row long, pos int, doc_id long"
#: Distinct words and windows of the test items are broadcast up to this many; beyond it, joined by a shuffle.
_SMALL = 1_000_000


def words(col):
    """The words of a text; none for null."""
    parts = F.split(ascii_lower(F.coalesce(col.cast("string"), F.lit(""))), BETWEEN, -1)
    return F.array_remove(parts, "")


def build_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the postings of ``docs`` to ``path`` and reads them back.

    ``row`` tells apart repeated ids.  Each document has one posting of the
    term ``END`` (with its ``doc_id``), so documents without words stay too.
    """
    listed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"),
                         F.array_append(words(F.col(text_col)), F.lit(END)).alias("_w"))
    postings = listed.select("doc_id", "row", F.posexplode("_w").alias("pos", "term"))
    postings = postings.select("term", "row", "pos", F.when(F.col("term") == END, F.col("doc_id")).alias("doc_id"))
    postings.sortWithinPartitions(F.xxhash64("term")).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(_INDEX).parquet(path)


def windows(items: DataFrame, size: int = 10, id_col: str = "item_id",
            text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``w, len, words`` (distinct windows) and ``w, item`` (items of each).

    A window is ``size`` words in sequence; an item of fewer, but not none, is one window.
    """
    listed = items.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("_w"))
    listed = listed.where(F.size("_w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("_w") - (size - 1), F.lit(1)))
    cut = listed.select("item", F.explode(F.transform(starts, lambda s: F.slice(F.col("_w"), s, size))).alias("words"))
    cut = stored(cut.distinct(), "test-windows")
    one = cut.select("words").distinct().withColumn("w", F.monotonically_increasing_id())
    one = stored(one.withColumn("len", F.size("words")), "distinct-windows")
    return one, stored(cut.join(one, "words").select("w", "item"), "window-items")


def _postings(index: DataFrame, one: DataFrame) -> DataFrame:
    """Postings of the windows' words (that many rows of the index are read past, not joined)."""
    own = maybe_broadcast(stored(one.select(F.explode("words").alias("term")).distinct(), "window-words"), _SMALL)
    return index.select("term", "row", "pos").join(own, "term", "left_semi")


def _ranked(one: DataFrame, postings: DataFrame) -> DataFrame:
    """``w, len, by_rarity``: ``(n, offset, term)`` of each window's words, rarest first.

    Windows with a word that no document has are left out: they cannot occur.
    """
    n = stored(postings.groupBy("term").agg(F.count(F.lit(1)).alias("n")), "index-counts")
    each = one.select("w", "len", F.posexplode("words").alias("offset", "term")).join(n, "term")
    lists = F.sort_array(F.collect_list(F.struct("n", "offset", "term")))
    out = each.groupBy("w", "len").agg(lists.alias("by_rarity"))
    return stored(out.where(F.size("by_rarity") == F.col("len")), "ranked-windows")


def _lists(index: DataFrame, ranked: DataFrame, k: int) -> DataFrame:
    """Postings of the terms that are ``k``-th rarest in a window."""
    wanted = ranked.where(F.col("len") > k).select(F.col("by_rarity")[k]["term"].alias("term")).distinct()
    return index.select("term", "row", "pos").join(maybe_broadcast(wanted, _SMALL), "term", "left_semi")


def phrase_matches(index: DataFrame, one: DataFrame, lists: int = 3) -> DataFrame:
    """``w, row, start, len``: every place where a window's words stand in sequence.

    The ``lists`` rarest terms are intersected one by one; the others at once,
    over the postings of the documents that are left.
    """
    ranked = _ranked(one, _postings(index, one))

    def nth(k: int) -> DataFrame:
        """``w, len, term, offset``: the ``k``-th rarest word of each window that has so many."""
        t = F.col("by_rarity")[k]
        return ranked.where(F.col("len") > k).select("w", "len", t["term"].alias("term"), t["offset"].alias("offset"))

    found = (index.select("term", "row", "pos").join(maybe_broadcast(nth(0)), "term")
                  .select("w", "len", "row", (F.col("pos") - F.col("offset")).alias("start"))
                  .where("start >= 0"))
    for k in range(1, lists):
        more = (found.where(F.col("len") > k).join(maybe_broadcast(nth(k).drop("len")), "w")
                     .withColumn("pos", F.col("start") + F.col("offset")).drop("offset"))
        hit = more.join(_lists(index, ranked, k), ["term", "row", "pos"]).drop("term", "pos")
        found = stored(hit.unionByName(found.where(F.col("len") <= k)), f"phrases-{k}")
    whole = found.where(F.col("len") <= lists).select("w", "row", "start", "len")
    rest = found.where(F.col("len") > lists)
    in_rows = stored(rest.select("row").distinct(), "phrase-rows")
    near = _postings(index, one).join(maybe_broadcast(in_rows, 2_000_000), "row", "left_semi")
    others = ranked.select("w", F.slice("by_rarity", lists + 1, 1 << 30).alias("others"))
    need = rest.select("w", "row", "start", "len").join(maybe_broadcast(others), "w")
    need = need.select("w", "row", "start", "len", F.explode("others").alias("t"))
    need = need.select("w", "row", "start", "len", F.col("t")["term"].alias("term"),
                       (F.col("start") + F.col("t")["offset"]).alias("pos"))
    full = (need.join(near, ["term", "row", "pos"]).groupBy("w", "row", "start", "len")
                .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == F.col("len") - lists).drop("n"))
    return whole.unionByName(full)


def proximity_matches(index: DataFrame, one: DataFrame, slop: int = 20) -> DataFrame:
    """``w, row, pos``: places of a window's rarest term with all its other terms at most ``slop`` words away, in any order.

    Positions are looked up by cells of ``slop`` words (own and both
    neighbours), so lists of one document are not paired as a whole.
    """
    postings = _postings(index, one)
    ranked = _ranked(one, postings)
    first = F.col("by_rarity")[0]["term"]
    others = F.array_remove(F.array_distinct(F.transform("by_rarity", lambda t: t["term"])), first)
    wanted = ranked.select("w", first.alias("term"), others.alias("others")).distinct()
    anchors = stored(postings.join(maybe_broadcast(wanted), "term").select("w", "row", "pos", "others").distinct(),
                     "proximity-anchors")
    alone = anchors.where(F.size("others") == 0).select("w", "row", "pos")
    rows = maybe_broadcast(anchors.select("row").distinct(), 2_000_000)
    cell = F.floor(F.col("pos") / slop)
    near = (postings.join(rows, "row", "left_semi").withColumnRenamed("pos", "at")
                    .withColumn("cell", F.floor(F.col("at") / slop)))
    need = (anchors.select("w", "row", "pos", F.size("others").alias("n"), F.explode("others").alias("term"))
                   .withColumn("cell", F.explode(F.sequence(cell - 1, cell + 1))))
    hit = (need.join(near, ["term", "row", "cell"]).where(F.abs(F.col("at") - F.col("pos")) <= slop)
               .groupBy("w", "row", "pos", "n").agg(F.count_distinct("term").alias("k")).where("k = n"))
    return alone.unionByName(hit.select("w", "row", "pos"))


def contamination(docs: DataFrame, items: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``<id_col>, n_words, n_hit, n_items, items_sha256, contaminated`` for each row of ``docs``.

    Null and empty texts have no words; items without words have no windows;
    repeated items count as the ids they have, repeated rows as rows of their
    own.  Empty tables give no rows, or rows without hits.  Other columns are
    not read.
    """
    spark: SparkSession = docs.sparkSession
    index = build_index(docs, folder(spark, "positional-index"), id_col, text_col)
    one, of_items = windows(items, size, item_col, item_text_col)
    found = stored(phrase_matches(index, one), "phrases")
    before = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    spans = found.select("row", "start", (F.col("start") + F.col("len")).alias("end")).distinct()
    spans = spans.withColumn("from", F.greatest("start", F.coalesce(F.max("end").over(before), F.col("start"))))
    hits = spans.groupBy("row").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.col("from"))).alias("n_hit"))
    pairs = found.select("row", "w").distinct().join(maybe_broadcast(of_items), "w").select("row", "item").distinct()
    per_row = pairs.groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("items"))
    ends = index.where(F.col("term") == END).select("row", "doc_id", F.col("pos").cast("long").alias("n_words"))
    out = ends.join(hits.join(per_row, "row"), "row", "left")
    none = F.array().cast("array<string>")
    return out.select(F.col("doc_id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                      F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
                      F.sha2(F.array_join(F.coalesce("items", none), ","), 256).alias("items_sha256"),
                      (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))
