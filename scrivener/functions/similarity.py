"""Gestalt similarity (longest matching blocks) in Arrow batches, and what is built on it."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import FOLD_FROM, FOLD_TO

#: Clues with fewer letters count only where they stand letter for letter.
EXACT_ONLY_BELOW = 5
_FOLD = str.maketrans(FOLD_FROM, FOLD_TO)


def similarity(a: Column, b: Column, *, autojunk: bool = True) -> Column:
    """2 * matches / total length over longest matching blocks (not symmetric); null if either is null.

    Frequent letters of texts of 200 or more are left out of the search with ``autojunk``.
    Pairs repeat a lot in practice, so each batch scores distinct pairs once.
    """

    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        known: dict[tuple[str, str], float] = {}
        out = []
        for x, y in zip(left, right):
            if x is None or y is None:
                out.append(None)
                continue
            if (x, y) not in known:
                known[x, y] = SequenceMatcher(None, x, y, autojunk=autojunk).ratio()
            out.append(known[x, y])
        return pd.Series(out, dtype="Float64")

    run.__annotations__ = {"left": pd.Series, "right": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "double")(a, b)


def clue_score(clue: str, reading: str) -> float:
    """How well a (squashed) clue matches some part of a reading about as long."""
    if not clue or not reading:
        return 0.0
    short = len(clue) < EXACT_ONLY_BELOW
    if clue in reading:
        return 0.9 if short else 1.0
    if short:
        return 0.0
    matcher = SequenceMatcher(autojunk=False)
    matcher.set_seq2(clue)
    top = 0.0
    for width in range(max(1, len(clue) - 2), len(clue) + 3):
        for i in range(max(1, len(reading) - width + 1)):
            matcher.set_seq1(reading[i : i + width])
            if matcher.real_quick_ratio() > top and matcher.quick_ratio() > top:
                top = max(top, matcher.ratio())
    return top


def clue_scores(clues: list[str], reading: Column) -> Column:
    """Array of the scores of fixed clues against a reading (null: zeros); both squashed and folded."""
    squashed = ["".join(ch for ch in c.upper() if ch.isascii() and ch.isalnum()).translate(_FOLD) for c in clues]

    def run(texts: pd.Series) -> pd.Series:
        known: dict[str, list[float]] = {}
        for t in texts.dropna().unique():
            s = "".join(ch for ch in t.upper() if ch.isascii() and ch.isalnum()).translate(_FOLD)
            known[t] = [clue_score(c, s) for c in squashed]
        return pd.Series([known.get(t, [0.0] * len(squashed)) for t in texts])

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "array<double>")(reading)


def close_match(words: Column, names: list[str], cutoff: float) -> Column:
    """The name closest to a word with a similarity of at least ``cutoff``; null if none; ties go to the smaller name."""
    ordered = sorted(names)

    def run(texts: pd.Series) -> pd.Series:
        known: dict[str, str | None] = {}
        for t in texts.dropna().unique():
            top, found = cutoff, None
            matcher = SequenceMatcher(None, "", t)
            for n in ordered:
                matcher.set_seq1(n)
                # the cheap bounds first; a later name must be closer
                if matcher.real_quick_ratio() >= top and matcher.quick_ratio() >= top:
                    ratio = SequenceMatcher(None, t, n).ratio()
                    if ratio > top or (found is None and ratio >= top):
                        top, found = ratio, n
            known[t] = found
        return texts.map(lambda t: known.get(t)).astype(object)

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "string")(words)
