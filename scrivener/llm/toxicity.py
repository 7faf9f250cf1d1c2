"""Toxicity scores by non-negative positive-unlabelled learning."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of the fitting sample: confirmed positives and unlabelled texts that reach the driver.
MAX_POSITIVE, MAX_UNLABELLED = 2500, 5000
#: Lengths, in UTF-8 bytes, of the word beginnings that count as features beside whole words.
PREFIXES = (3, 4, 5, 6, 7, 8)
MAX_FEATURES, MIN_TEXTS, MIN_Z = 4000, 6, 3.0
_SPACED = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256))


def words(text: str | None) -> set[bytes]:
    """Distinct lower-case words of a text in UTF-8; ASCII digits and signs count as white space."""
    return set(text.lower().encode("utf-8", "replace").translate(_SPACED).split()) if text else set()


def word_features(word: bytes) -> list[bytes]:
    return [word, *(b"^" + word[:k] for k in PREFIXES if len(word) >= k)]


@dataclass
class PULinear:
    """A linear scorer over the presence of words and word beginnings."""

    weights: dict[bytes, float]
    bias: float

    def scorer(self):
        """Function from a text to its score; keeps the features of the words it has met."""
        ids = {f: i for i, f in enumerate(self.weights)}
        values = list(self.weights.values())
        known: set[bytes] = set()
        telling: dict[bytes, tuple[int, ...]] = {}

        def score(text: str | None) -> float:
            hit: set[int] = set()
            here = words(text)
            for w in here - known:
                if f := tuple(ids[x] for x in word_features(w) if x in ids):
                    telling[w] = f
            for w in here:
                if w in telling:
                    hit.update(telling[w])
            if len(known) > 300_000:
                known.clear(), telling.clear()
            else:
                known.update(here)
            z = self.bias + sum(values[i] for i in sorted(hit))
            return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

        return score


def _features(text: str | None) -> set[bytes]:
    return {f for w in words(text) for f in word_features(w)}


def _matrix(texts: list[str | None], index: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    rows, cols = [], []
    for i, t in enumerate(texts):
        hit = {index[f] for f in _features(t) if f in index}
        cols.append(np.fromiter(sorted(hit), np.int64, len(hit)))
        rows.append(np.full(len(hit), i))
    return np.concatenate(rows or [np.zeros(0, int)]), np.concatenate(cols or [np.zeros(0, int)])


def _telling(positive: list[str | None], unlabelled: list[str | None]) -> list[bytes]:
    """Features whose share of positives stands out from that of unlabelled texts, strongest first."""
    n, m = len(positive), len(unlabelled)
    p, u = Counter(), Counter()
    for texts, count in ((positive, p), (unlabelled, u)):
        for t in texts:
            count.update(_features(t))

    def z(f: bytes) -> float:
        both = (p[f] + u[f] + 1) / (n + m + 2)
        return (p[f] / n - u[f] / m) / np.sqrt(both * (1 - both) * (1 / n + 1 / m))

    strong = {f: s for f in p.keys() | u.keys() if p[f] + u[f] >= MIN_TEXTS and abs(s := z(f)) >= MIN_Z}
    return sorted(strong, key=lambda f: (-abs(strong[f]), f))[:MAX_FEATURES]


Rows = tuple[np.ndarray, np.ndarray, int]  # text and feature of each entry, number of texts


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def risk_gradient(w: np.ndarray, positive: Rows, unlabelled: Rows, prior: float, gamma: float = 1.0) -> tuple[float, float, np.ndarray]:
    """(pi R_p+, R_u- - pi R_p-, direction of descent) of weights whose last is the bias, with logistic loss.

    The direction is the gradient of the sum of both parts while the second, the estimated
    risk of the negatives, is not below zero; else that of the second part turned round.
    """

    def scores(rows: Rows) -> np.ndarray:
        return np.bincount(rows[0], w[rows[1]], rows[2]) + w[-1]

    def pull(rows: Rows, per_text: np.ndarray) -> np.ndarray:
        return np.r_[np.bincount(rows[1], per_text[rows[0]], len(w) - 1), per_text.sum()]

    fp, fu = scores(positive), scores(unlabelled)
    n, m = positive[2], unlabelled[2]
    found = prior * np.logaddexp(0, -fp).mean()
    negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
    of_negative = pull(unlabelled, _sigmoid(fu) / m) - pull(positive, prior * _sigmoid(fp) / n)
    if negative < 0:
        return found, negative, -gamma * of_negative
    return found, negative, of_negative - pull(positive, prior * _sigmoid(-fp) / n)


def fit(positive: list[str | None], unlabelled: list[str | None], prior: float, *, steps: int = 120, rate: float = 0.05, decay: float = 2e-3, gamma: float = 1.0) -> PULinear:
    """Minimise the non-negative PU risk ``pi R_p+ + max(0, R_u- - pi R_p-)`` with logistic loss.

    The negative risk is what the unlabelled texts show less the share of positives
    among them, ``prior``; where that estimate falls below zero the step goes the other
    way, which keeps a flexible model from fitting it. Without positives or unlabelled
    texts the score is the prior for every text.
    """
    prior = float(np.clip(prior, 1e-3, 0.999))
    bias = float(np.log(prior / (1 - prior)))
    if not positive or not unlabelled:
        return PULinear({}, bias)
    kept = _telling(positive, unlabelled)
    index = {f: i for i, f in enumerate(kept)}
    p, u = ((*_matrix(texts, index), len(texts)) for texts in (positive, unlabelled))
    w = np.r_[np.zeros(len(kept)), bias]
    m1, m2 = np.zeros(len(w)), np.zeros(len(w))
    for t in range(1, steps + 1):
        g = risk_gradient(w, p, u, prior, gamma)[2]
        g[:-1] += decay * w[:-1]
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        w -= rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-6)
    return PULinear({f: float(w[i]) for f, i in index.items() if w[i]}, float(w[-1]))


def _sampled(df: DataFrame, key: str, share: float) -> DataFrame:
    return df.where(F.pmod(F.xxhash64(F.lit(29), F.col(key)), F.lit(1_000_000)) < int(round(share * 1_000_000)))


def distinct_words(text: Column) -> Column:
    """The distinct words of a text as one string: what the model reads of it, however long it is."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([b" ".join(sorted(words(t))).decode("utf-8", "replace") for t in batch])

    return F.pandas_udf(run, "string")(text)


def learn(docs: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id", label: str = "toxic", max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> PULinear:
    """Fit on the texts of ``docs`` that ``labels`` confirms (1), with all other texts as unlabelled.

    The class prior is the share of 1 among all non-null labels. The driver gets about
    ``max_positive`` confirmed and ``max_unlabelled`` other texts, both chosen by a hash
    of the key, as their distinct words; that bound is the parameter, whatever the table's
    size. A document that several rows label 1 counts once. Empty tables give
    a constant model.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("_k"), F.col(label).alias("_y"))
    n, positives = known.agg(F.count("*"), F.sum("_y")).first()
    positives = int(positives or 0)
    total = docs.count()
    toxic = _sampled(known.where("_y = 1"), "_k", min(1.0, max_positive / max(positives, 1))).select("_k").distinct()
    # bounded by max_positive, so safe to broadcast
    sure = docs.join(F.broadcast(toxic), docs[key] == toxic["_k"]).select(distinct_words(F.col(text)).alias("t")).toPandas()["t"]
    rest = _sampled(docs, key, min(1.0, max_unlabelled / max(total, 1))).select(distinct_words(F.col(text)).alias("t")).toPandas()["t"]
    return fit(sure.tolist(), rest.tolist(), positives / n if n else 0.1)


def score(text: Column, model: PULinear) -> Column:
    """Probability-like toxicity (0 to 1) of whole texts; null and empty texts get the model's score of no words."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = model.scorer()
        for batch in batches:
            yield pd.Series([f(t) for t in batch], dtype="float64")

    return F.pandas_udf(run, "double")(text)
