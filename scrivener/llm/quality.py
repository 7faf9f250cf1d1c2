"""Quality scores by positive-unlabelled learning over the shape of texts.

Trusted positives and the unlabelled corpus are compared by :data:`FEATURES`, each cut into
a few fixed bins. A combination of bins is a cell; there are at most :func:`most_cells` of
them, whatever the corpus holds, so one scan and one aggregate with map-side combine count
*all* positives and *all* unlabelled texts by cell, and the risk over the whole corpus is
a sum over cells. Nothing is sampled.

The class prior (the share of good texts among unlabelled ones) is estimated from the same
counts: among the texts that score highest, the corpus must hold at least the prior times
the share that the positives hold, so the smallest such ratio bounds the prior; where the
bound is tightest it is the estimate (best bin estimation, with a margin for small counts).
Fitting and estimating are alternated.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Features of a text and where their bins end; a value on an edge belongs to the bin above.
FEATURES: dict[str, tuple[float, ...]] = {
    "words": (1, 8, 32, 128, 1024),  # number of words
    "repeated": (0.1, 0.3, 0.6),  # words that equal the one before, of all words
    "distinct": (0.15, 0.3, 0.45),  # distinct words, of all words but at most 1,000
    "lines": (0.15, 0.4),  # lines that occurred before, of all lines with a word
    "signs": (0.15, 0.35, 1.0),  # signs that prose hardly has, a word
    "capitals": (0.15, 0.5),  # ASCII capitals, of all ASCII letters
    "digits": (0.5,),  # ASCII digits, of all bytes but white space
    "length": (2.5, 4.0, 12.0),  # bytes a word
    "stops": (0.02,),  # . and , a word
}
_EDGES = [np.array(e) for e in FEATURES.values()]
_BINS = np.array([len(e) + 1 for e in _EDGES])
_FIRST = np.r_[0, np.cumsum(_BINS)[:-1]]
#: Cell numbers are the bins read as digits.
_PLACE = np.r_[1, np.cumprod(_BINS)[:-1]]
#: Rounds of fitting and estimating the prior, and the share of positives that the tightest bound must rest on.
ROUNDS, MIN_SHARE = 3, 0.05

_SIGNS = b"#*$%&|<>!=~^_{}[]\\"
_CAPITALS, _SMALL, _DIGITS = (bytes(range(ord(a), ord(b) + 1)) for a, b in ("AZ", "az", "09"))


def most_cells() -> int:
    return int(np.prod(_BINS))


def features(text: str | None) -> tuple[float, ...]:
    """The values of :data:`FEATURES` of a whole text, zeros where it has no words."""
    raw = text.encode("utf-8", "replace") if text else b""
    words = raw.split()
    if not words:
        return (0.0,) * len(FEATURES)
    n, solid = len(words), sum(map(len, words))
    size = lambda drop: len(raw) - len(raw.translate(None, drop))
    big = size(_CAPITALS)
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return (
        float(n), sum(map(eq, words, words[1:])) / n, len(set(words)) / min(n, 1000), 1 - len(set(lines)) / len(lines), size(_SIGNS) / n,
        big / max(big + size(_SMALL), 1), size(_DIGITS) / solid, solid / n, size(b".,") / n,
    )


def cell(text: Column) -> Column:
    """The cell of a whole text as an int; null and empty texts share the cell of zeros."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            values = np.array([features(t.as_py()) for t in batch]).reshape(-1, len(FEATURES))
            digits = [np.searchsorted(e, values[:, k], side="right") for k, e in enumerate(_EDGES)]
            yield pa.array(np.array(digits).T.reshape(-1, len(FEATURES)) @ _PLACE, pa.int32())

    return F.arrow_udf(run, "int")(text)


def one_hot(cells: np.ndarray) -> np.ndarray:
    """For each cell the places of its bins among all weights."""
    return cells[:, None] // _PLACE % _BINS + _FIRST


@dataclass
class PUQuality:
    """A linear scorer over bins."""

    weights: np.ndarray
    bias: float
    prior: float

    def margins(self, cells: np.ndarray) -> np.ndarray:
        return self.weights[one_hot(cells)].sum(axis=1) + self.bias


def risk_gradient(w: np.ndarray, hot: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float, np.ndarray]:
    """(pi R_p+, R_u- - pi R_p-, direction of descent) with logistic loss, over cells with shares ``p`` of positives and ``u`` of unlabelled texts.

    ``w`` ends with the bias. Where the second part, the risk of the negatives, is below zero
    the direction is that part's gradient turned round, so that it rises again.
    """
    z = w[hot].sum(axis=1) + w[-1]
    found = prior * (p * np.logaddexp(0, -z)).sum()
    negative = (u * np.logaddexp(0, z)).sum() - prior * (p * np.logaddexp(0, z)).sum()
    of_negative = (u - prior * p) / (1 + np.exp(-z))
    pull = -of_negative if negative < 0 else of_negative - prior * p / (1 + np.exp(z))
    return float(found), float(negative), np.r_[np.bincount(hot.ravel(), np.repeat(pull, hot.shape[1]), len(w) - 1), pull.sum()]


def fit_cells(cells: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, prior: float, *, steps: int = 400, rate: float = 0.1, decay: float = 1e-4) -> PUQuality:
    """Minimise the non-negative risk ``pi R_p+ + max(0, R_u- - pi R_p-)`` over all texts, given as counts by cell."""
    hot, p, u = one_hot(cells), positive / positive.sum(), unlabelled / unlabelled.sum()
    w = np.zeros(int(_BINS.sum()) + 1)
    w[-1] = np.log(prior / (1 - prior))
    m1, m2 = np.zeros(len(w)), np.zeros(len(w))
    for t in range(1, steps + 1):
        g = risk_gradient(w, hot, p, u, prior)[2]
        g[:-1] += decay * w[:-1]
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        w -= rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
    return PUQuality(w[:-1], float(w[-1]), prior)


def class_prior(margins: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, *, delta: float = 0.1) -> float:
    """The share of positives among unlabelled texts: the smallest ratio of upper tails, each with a margin for its count."""
    n, m = positive.sum(), unlabelled.sum()
    order = np.argsort(-margins, kind="stable")
    last = np.r_[np.diff(margins[order]) != 0, True]  # cells with equal margins come together
    p, u = (np.cumsum(x[order])[last] / x.sum() for x in (positive, unlabelled))
    error = np.sqrt(np.log(4 / delta) / 2 / m) + np.sqrt(np.log(4 / delta) / 2 / n)
    usable = p >= min(MIN_SHARE, p.max())
    at = int(np.argmin(np.where(usable, (u + error) / np.maximum(p, 1e-12), np.inf)))
    return float(np.clip(u[at] / p[at], 0.01, 0.99))


def fit(cells: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray) -> PUQuality:
    """Weights and class prior from counts by cell. Without positives or without unlabelled texts every score is 0.5."""
    if not positive.sum() or not unlabelled.sum():
        return PUQuality(np.zeros(int(_BINS.sum())), 0.0, 0.5)
    model = fit_cells(cells, positive, unlabelled, 0.5)
    for _ in range(ROUNDS):
        model = fit_cells(cells, positive, unlabelled, class_prior(model.margins(cells), positive, unlabelled))
    return model


def learn(celled: DataFrame, labels: DataFrame, *, cell: str = "cell", key: str = "doc_id", label: str = "quality") -> PUQuality:
    """Fit on documents with their cells: those that ``labels`` marks 1 are trusted, all others unlabelled, whatever their label.

    A document that several rows label 1 counts once; repeated rows of ``celled`` count
    each. Null keys and labels are no labels. The driver gets one row a cell.
    """
    trusted = labels.where((F.col(label) == 1) & F.col(key).isNotNull()).select(F.col(key).alias("_k"), F.lit(True).alias("_good")).distinct()
    marked = celled.select(F.col(cell).alias("_cell"), F.col(key).alias("_k")).join(trusted, "_k", "left")
    # one row a cell: bounded by most_cells()
    counts = marked.groupBy("_cell").agg(F.count("_good").alias("p"), F.count_if(F.col("_good").isNull()).alias("u")).toPandas().sort_values("_cell")
    return fit(*(counts[c].to_numpy(np.int64) for c in ("_cell", "p", "u")))


def score(cell: Column, model: PUQuality) -> Column:
    """Probability (0 to 1) that a text of this cell is good: the sum of its bins' weights, as an expression."""
    z = F.lit(model.bias)
    for k, bins in enumerate(_BINS.tolist()):
        at = F.floor(cell / int(_PLACE[k])) % bins
        first = int(_FIRST[k])
        z = z + F.element_at(F.array(*[F.lit(float(x)) for x in model.weights[first : first + bins]]), (at + 1).cast("int"))
    return 1 / (1 + F.exp(-z))
