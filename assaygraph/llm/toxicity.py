"""Toxicity by weak supervision.

1. Lexicon: terms (words, and as patterns: one, two or three different words
   with a common prefix) that labelled training rows tie to the label, found
   by grouped counts.
2. Voters: word lists, prefix patterns, number and density of hits.  Each
   document of the corpus gets a vector of votes; the number of documents per
   vector (at most ``2 ** voters`` rows) holds all that the next step needs.
3. Label model: a generative model of the votes.  EM estimates how often each
   voter fires on either class; voters whose votes agree more than the classes
   explain are correlated, and become one factor with a joint table.
4. Classifier: logistic regression of the posterior labels on the terms.

Labels are read for the lexicon and the class share only, never for a score.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import maybe_broadcast, stored

_WORD = re.compile(r"[^\W\d_]+")
PREFIXES, DEPTH = (4, 5, 6), 3
#: Kinds of voters: word lists, prefix lists, and two rules on hits.
LISTS = 6
VOTERS = 2 * LISTS + 2


def _prefixes(word: str) -> list[str]:
    return [word[:n] for n in PREFIXES if len(word) >= n]


def _terms(text: str) -> set[str]:
    """Words of a text, and patterns ``abcd*k``: ``k`` different words start with ``abcd``."""
    words = set(_WORD.findall(text.lower()))
    many = Counter(p for w in words for p in _prefixes(w))
    return words | {f"{p}*{k}" for p, n in many.items() for k in range(1, min(n, DEPTH) + 1)}


def is_training(id_col: str = "doc_id"):
    """Rows whose labels may be learned from: the others are held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 != 2, F.lit(False))


def labelled_texts(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """``y, text``: all distinct labelled training texts."""
    marks = (labels.where(is_training(id_col) & F.col(label_col).isNotNull())
                   .groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(label_col).cast("int").alias("y")))
    texts = docs.where(is_training(id_col)).select(F.col(id_col).cast("long").alias("_id"),
                                                   F.col(text_col).cast("string").alias("text"))
    return texts.join(maybe_broadcast(marks, 2_000_000), "_id").where("text is not null").groupBy(
        F.xxhash64("text"), F.length("text")).agg(F.first("text").alias("text"), F.max("y").alias("y")).select("y", "text")


def fitting_sample(hits: DataFrame, max_labelled: int) -> pd.DataFrame:
    """``hits, votes, weight`` of about ``max_labelled`` texts at most, chosen by a hash.

    Texts with and without terms are drawn apart, up to half of the sample
    each (more where the others are fewer), and weighted back to their
    numbers, so that terms of a rare label have texts to be fitted on.
    """
    some = F.size("hits") > 0
    n = hits.agg(F.count_if(some).alias("some"), F.count_if(~some).alias("none")).first()
    take = min(n["some"], max(max_labelled // 2, max_labelled - n["none"]))
    rates = [min(1.0, k / max(m, 1)) for k, m in ((take, n["some"]), (max_labelled - take, n["none"]))]
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000))
    cut = F.when(some, int(rates[0] * 1_000_000)).otherwise(int(rates[1] * 1_000_000))
    out = hits.where(drawn < cut).select("hits", "votes").toPandas()
    with_terms = out["hits"].map(len).to_numpy() > 0
    sizes = [max(int(with_terms.sum()), 1), max(int((~with_terms).sum()), 1)]
    out["weight"] = np.where(with_terms, n["some"] / sizes[0], n["none"] / sizes[1])
    return out


def lexicon(labelled: DataFrame, max_terms: int = 4000, least: int = 5, evidence: float = 30.0,
            precision: float = 0.8) -> list[str]:
    """Terms of the label, strongest first.

    Each is in ``least`` texts of the label, in more of them than ``precision``
    of all its texts, with a likelihood ratio of ``evidence`` or more.
    """
    def kernel(frames):
        for f in frames:
            pos: dict[str, int] = {}
            neg: dict[str, int] = {}
            for y, text in zip(f["y"].tolist(), f["text"].tolist()):
                into = pos if y else neg
                for t in _terms(text):
                    into[t] = into.get(t, 0) + 1
            yield pd.DataFrame({"term": list(pos) + list(neg), "pos": list(pos.values()) + [0] * len(neg),
                                "neg": [0] * len(pos) + list(neg.values())})

    total = labelled.agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") != 1).alias("n")).first()
    if not total["p"] or not total["n"]:
        return []
    counts = labelled.mapInPandas(kernel, "term string, pos long, neg long").groupBy("term").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where(F.col("pos") >= least)
    all_ = F.col("pos") + F.col("neg")
    share = total["p"] / (total["p"] + total["n"])
    part = lambda k, e: F.when(k > 0, k * F.log(k / e)).otherwise(0.0)
    g = 2 * (part(F.col("pos"), all_ * share) + part(F.col("neg"), all_ * (1 - share)))
    best = counts.where((F.col("pos") > all_ * share) & (F.col("pos") > (all_ + 1) * precision)).withColumn("g", F.round(g, 6)).where(F.col("g") >= evidence)
    return [r[0] for r in best.orderBy(F.desc("g"), "term").limit(max_terms).select("term").collect()]


def _hits(docs: DataFrame, terms: list[str], id_col: str, text_col: str) -> DataFrame:
    """``doc_id, hits, votes`` of each row: lexicon terms in its whole text, and the votes as bits."""
    number = {t: i for i, t in enumerate(terms)}
    levels: dict[str, list[tuple[int, int]]] = {}                   # prefix -> (k, number) of its patterns
    voter, of_kind = [0] * len(terms), [0, 0]
    for t, i in number.items():                # lists by turns, so that each has strong and weak terms
        prefix, star, k = t.partition("*")
        if star:
            levels.setdefault(prefix, []).append((int(k), i))
        voter[i] = 1 << (of_kind[bool(star)] % LISTS + LISTS * bool(star))
        of_kind[bool(star)] += 1

    class Known(dict):
        """Word -> its number (-1: none) and the prefixes that patterns ask for; None if it is of no use."""

        def __missing__(self, word):
            found = (number.get(word, -1), [p for p in _prefixes(word) if p in levels])
            found = found if found[0] >= 0 or found[1] else None
            if len(self) >= 300_000:
                self.clear()
            self[word] = found
            return found

    def kernel(frames):
        known = Known()
        for f in frames:
            hits, votes = [], []
            for text in f["_text"].tolist():
                words = set(_WORD.findall((text or "").lower()))
                own, many = [], Counter()
                for found in map(known.__getitem__, words):
                    if found is not None:
                        if found[0] >= 0:
                            own.append(found[0])
                        many.update(found[1])
                own += [i for p, n in many.items() for k, i in levels[p] if n >= k]
                vote = 0
                for i in own:
                    vote |= voter[i]
                vote |= (len(own) >= 4) << (2 * LISTS) | (50 * len(own) > len(words)) << (2 * LISTS + 1)
                hits.append(sorted(own))
                votes.append(vote)
            yield pd.DataFrame({"doc_id": f["_id"], "hits": hits, "votes": np.array(votes, dtype=np.int64)})

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return rows.mapInPandas(kernel, "doc_id long, hits array<int>, votes long")


class LabelModel:
    """Class share, firing rates and correlations of voters, from the number of documents per vote vector."""

    def __init__(self, votes: np.ndarray, counts: np.ndarray, share: float, n_voters: int = VOTERS,
                 excess: float = 0.1, largest: int = 6, rounds: int = 100):
        self.bits = (votes[:, None] >> np.arange(n_voters)) & 1
        self.n_voters, self.share = n_voters, min(max(share, 1e-4), 1 - 1e-4)
        counts = counts.astype(float)
        # first guess: a document with more votes is likelier of the class
        fired = self.bits.sum(axis=1)
        guess = np.where(fired >= 2, 0.95, np.where(fired == 1, 0.5, 0.02))
        self.factors = [[j] for j in range(n_voters)]
        q = self._em(votes, counts, guess, rounds)
        self.accuracy = self._rates(q, counts)
        self.correlation = self._excess(q, counts)
        self.factors = self._merge(excess, largest)
        self.posterior = self._em(votes, counts, q, rounds)
        self.of_votes = dict(zip(votes.tolist(), self.posterior.tolist()))

    def _rates(self, q, counts):
        """P(fires | class) and P(fires | not class) of each voter."""
        rate = lambda w: (self.bits * w[:, None]).sum(axis=0) / max(w.sum(), 1e-12)
        return np.stack([rate(q * counts), rate((1 - q) * counts)])

    def _excess(self, q, counts):
        """Correlation of each pair of voters within the classes (that classes alone leave at zero)."""
        out = np.zeros((self.n_voters, self.n_voters))
        for w in (q * counts, (1 - q) * counts):
            total = max(w.sum(), 1e-12)
            mean = (self.bits * w[:, None]).sum(axis=0) / total
            cov = (self.bits * w[:, None]).T @ self.bits / total - np.outer(mean, mean)
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
            out = np.maximum(out, np.where(np.outer(sd, sd) > 1e-9, cov / np.outer(sd, sd), 0.0) * (total > 1))
        np.fill_diagonal(out, 0.0)
        return out

    def _merge(self, excess, largest):
        """Factors: voters joined from the most correlated pair down, up to ``largest`` in one."""
        of = {j: [j] for j in range(self.n_voters)}
        i, j = np.triu_indices(self.n_voters, 1)
        for k in np.argsort(-self.correlation[i, j], kind="stable"):
            a, b = of[int(i[k])], of[int(j[k])]
            if self.correlation[i[k], j[k]] < excess:
                break
            if a is not b and len(a) + len(b) <= largest:
                a += b
                for x in b:
                    of[x] = a
        return [sorted(x) for x in {id(v): v for v in of.values()}.values()]

    def _em(self, votes, counts, q, rounds):
        states = [(self.bits[:, f] << np.arange(len(f))).sum(axis=1) for f in self.factors]
        for _ in range(rounds):
            w1, w0 = q * counts, (1 - q) * counts
            log1, log0 = np.full(len(votes), np.log(self.share)), np.full(len(votes), np.log(1 - self.share))
            for f, s in zip(self.factors, states):
                n = 1 << len(f)
                p1 = np.bincount(s, w1, n) + 0.1
                p0 = np.bincount(s, w0, n) + 0.1
                log1 += np.log(p1 / p1.sum())[s]
                log0 += np.log(p0 / p0.sum())[s]
            new = 1 / (1 + np.exp(np.clip(log0 - log1, -50, 50)))
            if np.abs(new - q).max(initial=0.0) < 1e-6:
                return new
            q = new
        return q


def fit_linear(hits: list, target: np.ndarray, n_terms: int, l2: float = 1e-4, rounds: int = 500, weight=None):
    """Logistic regression on soft labels: ``bias, weights``; Adam steps over sparse rows of ones, each of its ``weight``."""
    sizes = np.array([len(h) for h in hits], dtype=np.int64)
    col = np.concatenate([np.asarray(h, np.int64) for h in hits]) if sizes.sum() else np.empty(0, np.int64)
    row, n = np.repeat(np.arange(len(hits)), sizes), max(len(hits), 1)
    weight = np.ones(len(hits)) if weight is None else weight * len(hits) / weight.sum()
    mean = (target * weight).mean()
    w = np.zeros(n_terms + 1)                                       # the last one is the bias
    w[-1] = float(np.log((mean + 1e-4) / (1 - mean + 1e-4)))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for turn in range(1, rounds + 1):
        z = w[-1] + np.bincount(row, w[col], n)[:len(hits)]
        err = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - target) * weight
        g = np.append(np.bincount(col, err[row], n_terms) / n, err.mean())
        g[:-1] += l2 * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 / np.sqrt(1 + turn / 50) * (m / (1 - 0.9 ** turn)) / (np.sqrt(v / (1 - 0.999 ** turn)) + 1e-8)
    return float(w[-1]), w[:-1]


def score(docs: DataFrame, labels: DataFrame, max_labelled: int = 12_000, max_terms: int = 4000,
          threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """``<id_col>, held_out, score, predicted`` for each row of ``docs``.

    The lexicon and the class share are counted on all labelled training
    texts.  ``max_labelled`` bounds the texts that the classifier is fitted on,
    ``max_terms`` the lexicon.  Null and empty texts
    have no terms: their score is that of a document without any.  Without
    labels of both classes no term is learned and all scores are the labelled
    share (0 without labels).  Repeated rows stay; a label given twice counts
    as the larger one; rows with a null id are scored and not held out.  An
    empty table stays empty; other columns are not read.
    """
    labelled = stored(labelled_texts(docs, labels, id_col, text_col, label_col), "toxicity-labelled")
    terms = lexicon(labelled, max_terms)
    share = labelled.agg(F.avg((F.col("y") == 1).cast("double"))).first()[0] or 0.0
    rows = stored(_hits(docs, terms, id_col, text_col), "toxicity-hits")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    if terms:
        by_votes = rows.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).orderBy("votes").toPandas()
        if not len(by_votes):
            model = None
        else:
            model = LabelModel(by_votes["votes"].to_numpy(), by_votes["n"].to_numpy(), share)
        own = _hits(labelled.select(F.xxhash64("text").alias("k"), "text"), terms, "k", "text")
        own = fitting_sample(stored(own, "toxicity-fit"), max_labelled)
        posterior = np.array([model.of_votes.get(v, share) if model else share for v in own["votes"]])
        bias, w = fit_linear(own["hits"].tolist(), posterior, len(terms), weight=own["weight"].to_numpy())
    else:
        w = np.zeros(0)
        bias = float(np.log(share / (1 - share))) if 0 < share < 1 else (-50.0 if share <= 0 else 50.0)
    weights = w.tolist()

    def kernel(frames):
        for f in frames:
            z = np.array([bias + sum(weights[i] for i in h) for h in f["hits"]], dtype=np.float64)
            s = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
            yield pd.DataFrame({"doc_id": f["doc_id"], "held_out": f["held_out"], "score": s,
                                "predicted": (s >= threshold).astype(np.int32)})

    out = rows.select("doc_id", held.alias("held_out"), "hits").mapInPandas(
        kernel, "doc_id long, held_out boolean, score double, predicted int")
    return out.withColumnRenamed("doc_id", id_col)
