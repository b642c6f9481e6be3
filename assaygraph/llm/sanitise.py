"""Information-theoretic sanitisation of personal data.

Base patterns find the protected entities (mail and IP addresses, card and
phone numbers) with their places.  Words next to an entity may give it away
as well.  How much is estimated from the whole corpus: with N documents,
n(e) of them with entity e, n(t) with term t and n(t, e) with t beside e,

    IC(e)     = log2(N / n(e))                       what e tells
    PMI(t; e) = log2(N * n(t, e) / (n(t) * n(e)))    what t tells about e

Terms are the words (of three letters or digits and more) of the documents
that hold e, outside the base spans.  ``t`` discloses the share PMI / IC of e,
times what the evidence is worth:

* how far t gets with e: n(t, e) / min(``min_documents``, n(e)), at most 1;
* that it is no chance.  Any rare word shares its documents with e, so
  counts of one document, or of copies of one, prove nothing by themselves.  Either t stands
  close to e: up to ``near`` characters count in full, each further ``fade`` halve it.  Or
  e's documents hold t in different contexts (words to the left and right, which copies share):
  ``min_documents`` of them count in full, one does not at all.

From ``threshold`` on every occurrence of t in a document of e becomes a span too:
*generalised* to a class word if the term also lives elsewhere, *removed* if
it occurs nowhere but with e.

DataFrame functions only: places come from the lengths of what a pattern
matches and of what lies between, as running sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import maybe_broadcast, stored

# The patterns of the four kinds, in the order in which kinds are listed.  They match what the plain
# patterns match; possessive quantifiers and the look-behind only spare the engine steps back and hopeless starts.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text with a match has for certain: a cheap test before the pattern runs.
_HINT = {"email": "@", "ip": ".", "card": None, "phone": "+"}
ADDED = ("generalised", "removed")
#: So many of the most frequent terms, and of entities, are broadcast.
KNOWN = 200_000
_WORD = r"[\p{L}\p{N}]{3,}+"
_ORDER = [*PATTERNS, *ADDED]


def _valid(kind: Column, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    parts = F.split(match, r"\.")
    small = F.forall(parts, lambda p: p.rlike(r"^0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2}|)$"))
    return (F.when(kind == "email", True).when(kind == "ip", small)
             .when(kind == "card", F.length(digits).between(14, 19) & F.call_function("luhn_check", digits))
             .otherwise(F.length(digits).between(10, 15)))


def _matches(text: Column, kind: str) -> Column:
    """Array of the kind's matches: number, match, and length of the text between."""
    pattern, hint = F.lit(PATTERNS[kind]), _HINT[kind]
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    between = F.split(text, PATTERNS[kind], -1)
    none = F.array().cast("array<struct<kind:string,nth:int,match:string,gap:int>>")
    rows = F.transform(F.arrays_zip(found.alias("m"), F.slice(between, 1, F.size(found)).alias("b")),
                       lambda z, i: F.struct(F.lit(kind).alias("kind"), i.alias("nth"), z["m"].alias("match"),
                                             F.length(z["b"]).alias("gap")))
    has = text.rlike(PATTERNS[kind])
    if hint:
        has = F.contains(text, F.lit(hint)) & has
    return F.when(has, rows).otherwise(none)


def entities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each base span (``kind, start, end``, both in code points, end exclusive), with its ``match``.

    A document without any has one row with a null kind.  ``row`` tells apart
    repeated ids.  ``masked`` is the document's text with blanks in place of
    its base spans, on one row of the document only.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    listed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"),
                         text.alias("_t"))
    listed = listed.withColumn("e", F.concat(*[_matches(F.col("_t"), k) for k in PATTERNS]))
    rows = stored(listed.select("doc_id", "row", F.when(F.size("e") > 0, F.col("_t")).alias("_t"), "e"), "pii-matches")
    found = rows.select("doc_id", "row", F.explode("e").alias("e")).select("doc_id", "row", "e.*")
    upto = Window.partitionBy("row", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumn("end", F.sum(F.col("gap") + F.length("match")).over(upto))
    found = found.withColumn("start", F.col("end") - F.length("match")).where(_valid(F.col("kind"), F.col("match")))
    order = Window.partitionBy("row").orderBy("start", "end", "kind")
    found = found.withColumn("nth", F.row_number().over(order))
    found = found.withColumn("ahead", F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    found = stored(found.select("doc_id", "row", "kind", "start", "end", "match", "nth", "ahead"), "pii-found")
    holes = found.where("end > ahead").groupBy("row").agg(F.sort_array(F.collect_list(F.struct(
        F.greatest("start", "ahead").cast("int").alias("s"), F.col("end").cast("int").alias("e"),
        F.col("ahead").cast("int").alias("a")))).alias("h"))
    text = F.col("_t")
    pieces = F.transform("h", lambda x: F.concat(F.substring(text, x["a"] + 1, x["s"] - x["a"]),
                                                 F.repeat(F.lit(" "), x["e"] - x["s"])))
    tail = F.substring(text, F.element_at("h", -1)["e"] + 1, F.length(text))
    masked = holes.join(rows.where("_t is not null").select("row", "_t"), "row").select(
        "row", F.lit(1).alias("nth"), F.concat(F.array_join(pieces, ""), tail).alias("masked"))
    found = found.join(masked, ["row", "nth"], "left").select("doc_id", "row", "kind", "start", "end", "match", "masked")
    null = F.lit(None)
    bare = rows.select("doc_id", "row").join(found.select("row").distinct(), "row", "left_anti")
    bare = bare.select("doc_id", "row", *[null.cast(found.schema[c].dataType).alias(c)
                                          for c in ("kind", "start", "end", "match", "masked")])
    return stored(found.unionByName(bare), "pii-entities")


def _places(found: DataFrame) -> DataFrame:
    """``doc_id, row, term, start, end, context`` of each word of the documents with base spans, outside these.

    Places are running sums of what a word and the text before it take;
    ``context`` is a hash of the words on both sides.
    """
    text = F.col("masked")
    words, gaps = F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)), F.split(text, _WORD, -1)
    listed = found.where("masked is not null").select("doc_id", "row", words.alias("w"), gaps.alias("g"))
    each = F.transform("w", lambda w, i: F.struct(
        F.lower(w).alias("term"), F.length(w).alias("n"), F.length(F.get("g", i)).alias("gap"),
        F.xxhash64(F.lower(F.get("w", i - 1)), F.lower(F.get("w", i + 1))).alias("context")))
    places = listed.select("doc_id", "row", F.posexplode(each).alias("nth", "x")).select("doc_id", "row", "nth", "x.*")
    upto = Window.partitionBy("row").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    places = places.withColumn("end", F.sum(F.col("gap") + F.col("n")).over(upto))
    return stored(places.select("doc_id", "row", "term", (F.col("end") - F.col("n")).alias("start"), "end", "context"),
                  "pii-places")


def _pairs(found: DataFrame, places: DataFrame, n: int, n_term: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """``row, entity, term, distance, context`` of terms and entities in one document, and ``entity, n_entity``.

    ``distance`` in characters is the least there is between the two, ``context`` that of
    the term's first place.  Left out are only pairs that cannot reach the threshold: as n(t, e) <= n(e),
    it takes n(t) <= N * (n(e) / N) ** threshold.  The most frequent terms and
    entities are known by a bounded broadcast; others count as the least of these.
    """
    name = F.concat_ws(":", "kind", F.when(F.col("kind") == "email", F.lower("match")).otherwise(
        F.when(F.col("kind") == "ip", F.col("match")).otherwise(F.regexp_replace("match", "[^0-9]", ""))))
    base = stored(found.where("kind is not null").select("row", name.alias("entity"), "start", "end"), "pii-base")
    n_entity = base.select("row", "entity").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    n_entity = stored(n_entity, "pii-n-entity")
    often = stored(n_entity.where("n_entity > 1").orderBy(F.desc("n_entity"), "entity").limit(KNOWN), "pii-often")
    size, least = often.agg(F.count(F.lit(1)), F.min("n_entity")).first()
    others = least if size == KNOWN else 1
    base = base.join(F.broadcast(often), "entity", "left")
    most = F.lit(float(n)) * F.pow(F.coalesce("n_entity", F.lit(others)) / F.lit(float(max(n, 1))), F.lit(threshold))
    base = base.select("row", "entity", F.col("start").alias("s"), F.col("end").alias("e"), (most * (1 + 1e-9)).alias("most"))
    common = n_term.where(F.col("n_term") > float(n) ** (1 - threshold)).orderBy(F.desc("n_term"), "term").limit(KNOWN)
    terms = places.join(F.broadcast(common), "term", "left")
    pairs = terms.join(base, "row").where(F.coalesce("n_term", F.lit(0)) <= F.col("most"))
    far = F.greatest(F.lit(0), F.col("start") - F.col("e"), F.col("s") - F.col("end"))
    return stored(pairs.groupBy("row", "entity", "term").agg(F.min(far).alias("distance"),
                                                            F.min_by("context", "start").alias("context")), "pii-pairs"), n_entity


def _terms(text: Column) -> Column:
    return F.array_distinct(F.transform(F.split(text, r"[^\p{L}\p{N}]++"), F.lower))


def disclosing_terms(docs: DataFrame, found: DataFrame, threshold: float = 0.5, min_documents: int = 3, near: int = 8,
                     fade: int = 16, text_col: str = "text",
                     places: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``entity, term, share, n_term, n_both, action`` of terms from ``threshold`` on, and ``row, entity, term`` of pairs."""
    n = docs.count()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = docs.select(F.explode(_terms(text)).alias("term"))
    n_term = own.groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))       # of every term, summed up in each task first
    n_term = stored(n_term, "pii-n-term")
    pairs, n_entity = _pairs(found, places or _places(found), n, n_term, threshold)
    both = stored(pairs.groupBy("entity", "term").agg(
        F.count(F.lit(1)).alias("n_both"), F.min("distance").alias("distance"),
        F.count_distinct("context").alias("contexts")), "pii-both")
    out = both.join(n_term, "term").join(n_entity, "entity")
    pmi = F.log2(F.lit(float(n)) * F.col("n_both") / (F.col("n_term") * F.col("n_entity")))
    ic = F.log2(F.lit(float(n)) / F.col("n_entity"))
    reach = F.least(F.lit(1.0), F.col("n_both") / F.least(F.lit(min_documents), "n_entity"))
    close = F.pow(F.lit(2.0), -F.greatest(F.lit(0), F.col("distance") - near) / F.lit(float(fade)))
    apart = F.least(F.lit(1.0), (F.col("contexts") - 1) / F.lit(float(max(min_documents - 1, 1))))
    weight = reach * F.greatest(close, apart)
    out = out.withColumn("share", F.when(ic > 0, F.round(pmi / ic * weight, 9))).where(F.col("share") >= threshold)
    action = F.when(F.col("n_term") > F.col("n_both"), ADDED[0]).otherwise(ADDED[1])
    return out.select("entity", "term", "share", "n_term", "n_both", action.alias("action")), pairs.select("row", "entity", "term")


def spans(docs: DataFrame, threshold: float = 0.5, min_documents: int = 3, near: int = 8, fade: int = 16,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, row, kind, start, end`` of all spans; one row with a null kind for a document without any."""
    found = entities(docs, id_col, text_col)
    places = _places(found)
    risky, pairs = disclosing_terms(docs, found, threshold, min_documents, near, fade, text_col, places)
    risky = stored(risky.select("entity", "term", "n_both", "action"), "pii-risky")
    # pairs of many documents go to them by a broadcast, so that no key of the shuffle has many rows
    many = maybe_broadcast(risky.where("n_both > 1000").drop("n_both"))
    few = risky.where("n_both <= 1000").drop("n_both")
    told = pairs.join(many, ["entity", "term"]).unionByName(pairs.join(few, ["entity", "term"]))
    told = stored(told.groupBy("row", "term").agg(F.max("action").alias("kind")), "pii-told")
    extra = places.join(told, ["row", "term"])
    return found.select("doc_id", "row", "kind", "start", "end").unionByName(
        extra.select("doc_id", "row", "kind", "start", "end"))


def digest(found: DataFrame) -> DataFrame:
    """One row for each document: counts by base kind, hash of the base spans, and all spans as text."""
    rank = F.array_position(F.array(*[F.lit(k) for k in _ORDER]), F.col("kind"))
    each = found.select("doc_id", "row", "kind", F.when(F.col("kind").isNotNull(), F.struct(
        F.col("start").alias("s"), rank.alias("k"), F.concat_ws(":", "kind", "start", "end").alias("text"))).alias("x"))
    counts = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in PATTERNS]
    out = each.groupBy("row").agg(F.first("doc_id").alias("doc_id"), *counts,
                                  F.sort_array(F.collect_list("x")).alias("x"))
    base = F.filter("x", lambda x: x["k"] <= len(PATTERNS))
    text = lambda a: F.array_join(F.transform(a, lambda x: x["text"]), ",")
    return out.select("doc_id", *[f"n_{k}" for k in PATTERNS], F.sha2(text(base), 256).alias("base_sha256"),
                      text(F.col("x")).alias("spans"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out_col: str = "sanitised",
             **options) -> DataFrame:
    """``docs`` with ``out_col``: base spans and generalised terms replaced by class words, removed terms taken out.

    Overlapping spans are replaced as one, by the first one's word.  A null
    text stays null.  Ids must be distinct here (texts are joined by id); for
    repeated ids use ``spans``.  Null ids keep their text unchanged.
    """
    found = spans(docs, id_col=id_col, text_col=text_col, **options).where("kind is not null")
    order = Window.partitionBy("doc_id").orderBy("start", "end", "kind")
    ahead = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    found = found.withColumn("new", F.when(F.col("start") < ahead, 0).otherwise(1))
    found = found.withColumn("part", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    words = F.create_map(*[F.lit(x) for k in PATTERNS for x in (k, f"[{k}]")],
                         F.lit(ADDED[0]), F.lit("[term]"), F.lit(ADDED[1]), F.lit(""))
    parts = found.groupBy("doc_id", "part").agg(F.min("start").alias("s"), F.max("end").alias("e"),
                                                F.min_by("kind", F.struct("start", "end")).alias("kind"))
    parts = parts.groupBy("doc_id").agg(F.sort_array(F.collect_list(
        F.struct("s", "e", words[F.col("kind")].alias("word")))).alias("_spans"))
    joined = docs.join(parts.withColumnRenamed("doc_id", "_doc"), F.col(id_col) == F.col("_doc"), "left")
    spans_, text = F.col("_spans"), F.col(text_col).cast("string")
    pieces = F.transform(spans_, lambda x, i: F.concat(
        F.substring(text, (F.when(i == 0, 0).otherwise(F.element_at(spans_, i)["e"]) + 1).cast("int"),
                    (x["s"] - F.when(i == 0, 0).otherwise(F.element_at(spans_, i)["e"])).cast("int")), x["word"]))
    tail = F.substring(text, (F.element_at(spans_, -1)["e"] + 1).cast("int"), F.length(text))
    new = F.when(spans_.isNull(), text).otherwise(F.concat(F.array_join(pieces, ""), tail))
    return joined.withColumn(out_col, new).drop("_doc", "_spans")
