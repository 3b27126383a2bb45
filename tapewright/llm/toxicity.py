"""Toxicity scores by a counterfactual-regularised linear classifier.

Features are the presence of words and how many words share a beginning, as far as
the labelled sample ties them to label 1 (G-squared); identity terms are features
whatever their tie.  The weights minimise the logistic loss on the sample plus a
penalty on counterfactual pairs: a labelled sentence that names a group, and the same
sentence with the term swapped for another one or for a neutral word; the squared
change of the score's argument is added.  Where sentences name no group, a bounded
part of the sample is copied with a term put in, under the sentence's own label, so
that the pairs don't depend on the corpus naming groups.  A neutral mention of a
group then moves no score by itself.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import written

# Identity terms that may be swapped for one another, and the neutral word.
IDENTITY_TERMS = (
    "women", "men", "girls", "boys", "gay", "lesbian", "straight", "transgender", "muslim", "muslims", "christian", "christians",
    "jewish", "jews", "hindu", "hindus", "atheist", "atheists", "catholic", "catholics", "black", "white", "asian", "asians",
    "african", "africans", "european", "europeans", "american", "americans", "mexican", "mexicans", "immigrants", "refugees",
    "foreigners", "disabled", "deaf", "blind", "elderly", "young",
    "frauen", "männer", "juden", "christen", "ausländer", "flüchtlinge",
    "femmes", "hommes", "juifs", "musulmans", "chrétiens", "étrangers", "réfugiés",
    "mujeres", "hombres", "judíos", "musulmanes", "cristianos", "extranjeros", "refugiados",
)
NEUTRAL = "people"

#: Bounds: rows of the labelled sample, features beside the identity terms, sentences copied with a term put in.
MAX_LABELLED, MAX_FEATURES, MAX_MENTIONS = 12_000, 1024, 2_000
#: Lengths of word beginnings, and numbers of distinct words that share one.
PREFIXES, SHARED = (4, 5, 6), (1, 2, 3)
EDGES = ".,;:!?|\"'()[]{}<>#*$%&@~^_=+/\\-`“”„«»‘’…¡¿"
MEMO_ENTRIES = 400_000


def words_of(text: str | None) -> set[str]:
    return {word for raw in set((text or "").lower().split()) if (word := raw.strip(EDGES))}


def _own(word: str) -> str:
    return f"w{word[:24]}"


def _beginnings(word: str) -> list[str]:
    return [f"{n}{word[:n]}" for n in PREFIXES if len(word) > n]


def features(words: set[str]) -> set[str]:
    """A word's own feature, and ``beginning*k`` where at least k distinct words share a beginning."""
    shared = Counter(b for word in words for b in _beginnings(word))
    return {_own(word) for word in words} | {f"{b}*{k}" for b, n in shared.items() for k in SHARED if k <= n}


def swaps(words: set[str], terms: tuple[str, ...] = IDENTITY_TERMS) -> list[set[str]]:
    """Feature sets of the counterfactuals of a text; none if it names no group.

    Each named term is swapped for the neutral word and for the next two terms of the list.
    """
    named = words & set(terms)
    if not named:
        return []
    others = [{NEUTRAL}, *({terms[(terms.index(t) + step) % len(terms)] for t in named} for step in (1, 2))]
    return [features(words - named | other) for other in others]


def mention(text: str | None, terms: tuple[str, ...] = IDENTITY_TERMS) -> set[str]:
    """The words of a text with a term put in; the text decides which."""
    return words_of(text) | {terms[zlib.crc32((text or "").encode()) % len(terms)]}


@dataclass(frozen=True)
class Model:
    """``pairs``: counterfactual pairs that the penalty was taken over."""

    weights: dict[str, float]
    bias: float
    pairs: int = 0

    def scorer(self):
        """text -> score in (0, 1)."""
        index = {f: i for i, f in enumerate(self.weights)}
        weight = list(self.weights.values())
        counted = {f.rpartition("*")[0] for f in index if f[0] != "w"}
        memo: dict[str, tuple[str, int | None, list[str]] | tuple[()]] = {}

        def parts(raw: str):
            word = raw.strip(EDGES)
            own, shared = index.get(_own(word)), [b for b in _beginnings(word) if b in counted]
            return (word, own, shared) if own is not None or shared else ()

        def score(text: str | None) -> float:
            if len(memo) > MEMO_ENTRIES:
                memo.clear()
            telling = {}
            for raw in set((text or "").lower().split()):
                hit = memo.get(raw)
                if hit is None:
                    hit = parts(raw)
                    if len(raw) <= 48:
                        memo[raw] = hit
                if hit:
                    telling[hit[0]] = hit
            seen = {own for _, own, _ in telling.values() if own is not None}
            for b, n in Counter(b for _, _, shared in telling.values() for b in shared).items():
                seen.update(i for k in SHARED if k <= n and (i := index.get(f"{b}*{k}")) is not None)
            z = self.bias + sum(weight[i] for i in sorted(seen))
            return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))

        return score


def held_out(doc_id: Column) -> Column:
    """The rows that no label is learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, *, max_labelled: int = MAX_LABELLED, seed: int = 11) -> DataFrame:
    """``text, toxic`` of at most ``max_labelled`` labelled rows that aren't held out."""
    usable = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    chosen = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(max_labelled)
    # bounded by max_labelled rows of two numbers
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")


def _feature_counts(batches):
    counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for pdf in batches:
        for text, toxic in zip(pdf["text"], pdf["toxic"]):
            counts[toxic].update(features(words_of(text)))
    names = list(counts[0].keys() | counts[1].keys())
    for at in range(0, len(names), 50_000):
        part = names[at : at + 50_000]
        yield pd.DataFrame({"feature": part, "n0": [counts[0][f] for f in part], "n1": [counts[1][f] for f in part]})


def fit(sample: DataFrame, *, max_features: int = MAX_FEATURES, least_rows: int = 3, least_g2: float = 6.6, ridge: float = 1e-4, counterfactual: float = 1.0, max_mentions: int = MAX_MENTIONS, rounds: int = 600) -> Model:
    """Train on a bounded sample (``text, toxic``).

    An empty sample, or one without both labels, gives a constant score: the
    (smoothed) share of label 1.  ``max_features`` bounds the model, not the rows:
    every row counts in the choice of features.  Up to ``max_mentions`` sentences,
    the first by a hash of the text, are copied with an identity term put in.
    """
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    bias = math.log((n1 + 0.5) / (n0 + 0.5))
    if not n0 or not n1:
        return Model({}, min(bias, -1e-9) if not n1 else bias)
    counts = sample.mapInPandas(_feature_counts, "feature string, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("b"), F.sum("n1").alias("a"))
    a, b, all_ = F.col("a").cast("double"), F.col("b").cast("double"), float(n0 + n1)

    def part(x: Column, row: Column, column: float) -> Column:
        return F.when(x > 0, x * F.ln(x * all_ / (row * column))).otherwise(0.0)

    g2 = 2 * (part(a, a + b, n1) + part(b, a + b, n0) + part(n1 - a, all_ - a - b, n1) + part(n0 - b, all_ - a - b, n0))
    least = min(least_rows, max(1, n1 // 10))
    best = counts.where((a + b >= least) & (a + b < all_)).select("feature", F.round(g2, 6).alias("g2"), (a * n0 > b * n1).alias("up")).where((F.col("g2") > least_g2) & F.col("up"))
    names = [r["feature"] for r in best.orderBy(F.desc("g2"), "feature").limit(max_features).collect()]
    names += sorted({_own(t) for t in IDENTITY_TERMS} - set(names))
    at = {f: i for i, f in enumerate(names)}
    order = F.xxhash64(F.lit(17), "text")
    last = sample.where("text is not null").select(order.alias("h")).orderBy("h").offset(max_mentions).first() if max_mentions else None
    copied = F.lit(max_mentions > 0) if last is None else order < F.lit(last["h"])

    def vectors(batches):
        def known(features_: set[str]) -> list[int]:
            return sorted(at[f] for f in features_ if f in at)

        for pdf in batches:
            rows = []
            for text, toxic, copy in zip(pdf["text"], pdf["toxic"], pdf["copied"]):
                for words in [words_of(text), *([mention(text)] if copy else [])]:
                    rows.append((toxic, known(features(words)), [known(s) for s in swaps(words)]))
            yield pd.DataFrame(rows, columns=["toxic", "own", "others"])

    rows = sample.withColumn("copied", F.coalesce(copied, F.lit(False))).mapInPandas(vectors, "toxic int, own array<int>, others array<array<int>>").collect()  # bounded like the sample
    return _solve(sorted((r["toxic"], tuple(r["own"]), tuple(map(tuple, r["others"]))) for r in rows), names, bias, ridge, counterfactual, rounds)


def _solve(rows, names: list[str], bias: float, ridge: float, counterfactual: float, rounds: int) -> Model:
    """Minimises the mean logistic loss, half the ridge times the squared weights, and the strength times the mean squared change of a pair."""
    k, n = len(names), len(rows)
    y = np.array([r[0] for r in rows], float)
    row = np.array([i for i, r in enumerate(rows) for _ in r[1]], np.int64)
    col = np.array([c for r in rows for c in r[1]], np.int64)
    pair, pcol, psign, pairs = [], [], [], 0
    for _, own, others in rows:
        for other in others:
            diff = [(c, 1.0) for c in set(own) - set(other)] + [(c, -1.0) for c in set(other) - set(own)]
            if diff:
                pair += [pairs] * len(diff)
                pcol += [c for c, _ in diff]
                psign += [s for _, s in diff]
                pairs += 1
    pair, pcol, psign = np.array(pair, np.int64), np.array(pcol, np.int64), np.array(psign)
    w, m, v = np.zeros(k), np.zeros(k + 1), np.zeros(k + 1)
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[col], n) + bias, -60, 60)))
        g = np.bincount(col, (p - y)[row], k) / n + ridge * w
        if pairs:
            change = np.bincount(pair, psign * w[pcol], pairs)
            g += 2 * counterfactual * np.bincount(pcol, psign * change[pair], k) / pairs
        full = np.append(g, (p - y).mean())
        m, v = 0.9 * m + 0.1 * full, 0.999 * v + 0.001 * full * full
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    return Model({f: float(x) for f, x in zip(names, w) if x != 0}, float(bias), pairs)


def train(docs: DataFrame, labels: DataFrame, **options) -> Model:
    """Fit on the labelled rows of ``docs`` that aren't held out."""
    keep = {k: options.pop(k) for k in ("max_labelled", "seed") if k in options}
    return fit(written(labelled_sample(docs, labels, **keep)), **options)


def score(docs: DataFrame, model: Model, *, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a column of scores from 0 to 1.

    Only the text decides: equal texts score alike, and a null or empty text
    scores as a text without any feature.  Rows and other columns stay; a column
    already named ``out`` is replaced.
    """
    sent, token = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        own = _scorer(token, sent)
        return pd.Series([own(t) for t in texts], dtype="float64")

    return docs.withColumn(out, scored(F.coalesce(F.col(text_col), F.lit(""))))


_SCORERS: dict[str, Callable[[str | None], float]] = {}


def _scorer(token: str, sent) -> Callable[[str | None], float]:
    """The scorer, with its memo, of the model that a worker has seen last."""
    if token not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[token] = sent.value.scorer()
    return _SCORERS[token]
