"""Periodic runs of words: branching tandem repeats from an enhanced suffix array, rotated and merged into runs.

A run is a stretch of words that repeats with a period, at least ``MIN_EXPONENT`` times
over, and that no neighbouring word continues. Texts are independent of each other, so
this is a narrow map: no shuffle, whatever the corpus holds. Of one or more texts:

1. Words become numbers. A run repeats every word of it but those of its first period
   within that period, so runs lie in stretches of words that all occurred shortly
   before; what is outside of those stretches (with a period before each) holds no run.
   This bound only leaves texts out, it finds nothing.
2. Over the stretches a suffix array is built by doubling, with its inverse ISA and the
   longest common prefixes of neighbours. An LCP interval of depth d whose suffixes i and
   i + d lie in different children is a branching tandem repeat. Suffixes of all children
   but the largest are asked for ISA[i + d] and ISA[i - d], so each word is asked for
   O(log n) times. Intervals come from the nearest smaller LCP values on either side;
   there are no tree nodes.
3. A branching repeat is the last square of its run. Turning it to the left as far as
   the words agree gives the run's start; equal stretches keep their smallest period.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A run has at least this many words and this many periods.
MIN_WORDS, MIN_EXPONENT = 6, 4
#: Words that are searched together, and suffixes asked at a time; a longer text is searched by itself.
CHUNK_WORDS, ASKED = 1 << 19, 1 << 20
FOUND = "struct<n_words: bigint, runs: array<struct<start: bigint, length: bigint, period: bigint>>, top: struct<start: bigint, length: bigint, period: bigint, exponent_milli: bigint>, collapsed: string>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_TOP = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64())])
_FAR = np.iinfo(np.int64).max // 4


def suffix_array(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Suffix array, its inverse, and for each k the ranks of the stretches of 2^k symbols that start at each place.

    ``s`` ends with a symbol that is nowhere else. Ranks are places in the array, so
    suffixes that are told apart keep theirs and only the others are sorted again.
    """
    n = len(s)
    sa = np.argsort(s, kind="stable")
    sorted_s = s[sa]
    first = np.r_[True, sorted_s[1:] != sorted_s[:-1]]
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    levels, step = [rank.astype(np.int32)], 1
    while True:
        alone = first & np.r_[first[1:], True]
        open_ = np.flatnonzero(~alone)
        if not len(open_):
            return sa, rank, levels
        at = sa[open_]
        # a suffix that is not told apart yet has at least ``step`` more symbols
        key = rank[at] * np.int64(n) + rank[at + step]
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        sa[open_] = at
        new = np.r_[True, key[1:] != key[:-1]]
        first[open_] = new
        rank[at] = np.maximum.accumulate(np.where(new, open_, 0))
        levels.append(rank.astype(np.int32))
        step *= 2


def common_prefixes(sa: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Length of the longest common prefix of each suffix and the one before it in the array; 0 for the first."""
    a, b, n = sa[:-1].copy(), sa[1:].copy(), len(sa)
    out = np.zeros(n, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        same = np.flatnonzero(levels[k][a] == levels[k][b])
        out[same + 1] += 1 << k
        a[same] += 1 << k
        b[same] += 1 << k
    return out


def _smaller(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest place before each with a smaller value (-1: none) and the nearest after it (n: none)."""
    n, values = len(lcp), lcp.tolist()
    before, after, stack = [-1] * n, [n] * n, []
    for i, v in enumerate(values):
        while stack and values[stack[-1]] > v:
            after[stack.pop()] = i
        if stack:
            top = stack[-1]
            before[i] = before[top] if values[top] == v else top
        stack.append(i)
    return np.array(before, np.int64), np.array(after, np.int64)


def branching_tandems(sa: np.ndarray, isa: np.ndarray, lcp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(start, period) of the squares whose two halves lie in different children of the LCP interval of the period's depth.

    Intervals of two suffixes are left out: a run of three periods or more has three
    suffixes that share its last period.
    """
    before, after = _smaller(lcp)
    cut = np.flatnonzero((lcp > 0) & (after - before > 2))  # where an interval's children meet
    if not len(cut):
        return
    cut = cut[np.lexsort((cut, lcp[cut], before[cut]))]
    lo, hi, depth = before[cut], after[cut], lcp[cut]
    new = np.r_[True, (lo[1:] != lo[:-1]) | (depth[1:] != depth[:-1])]
    last = np.r_[new[1:], True]
    # the children of an interval: from its start to the first cut, from each cut to the next or to the end
    left = np.r_[lo[new], cut]
    right = np.r_[cut[new], np.where(last, hi, np.r_[cut[1:], 0])]
    node = np.r_[np.flatnonzero(new), np.flatnonzero(new)[np.cumsum(new) - 1]]
    lo, hi, depth = lo[node], hi[node], depth[node]
    order = np.lexsort((left - right, node))
    largest = order[np.r_[True, node[order][1:] != node[order][:-1]]]
    small = np.ones(len(left), bool)
    small[largest] = False
    left, right, lo, hi, depth = (x[small] for x in (left, right, lo, hi, depth))
    ends = np.cumsum(right - left)
    at = 0
    while at < len(left):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + ASKED)))
        size = right[at:to] - left[at:to]
        own = np.repeat(np.arange(at, to), size)
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + left[own]
        i, d = sa[place], depth[own]
        for j, first in ((i + d, i), (i - d, i - d)):
            ok = (j >= 0) & (j < len(sa))
            there = isa[np.where(ok, j, 0)]
            ok &= (there >= lo[own]) & (there < hi[own]) & ((there < left[own]) | (there >= right[own]))
            yield first[ok], d[ok]
        at = to


def _turned(start: np.ndarray, period: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """How far each square can be turned to the left: words before it that agree with those a period later."""
    out = np.zeros(len(start), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        at = start - out - (1 << k)
        there = np.maximum(at, 0)
        out += np.where((at >= 0) & (levels[k][there] == levels[k][there + period]), 1 << k, 0)
    return out


def _stretches(back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of what may hold runs, merged: ``back`` is how far before each word its last occurrence is.

    A run with period q has max(6 - q, 3 q) words in a row that occurred within q before, so
    for q in (Q/2, Q] a stretch of at least as many within Q, and the Q words before it.
    """
    found, reach = [], 1
    while MIN_EXPONENT * (reach // 2 + 1) <= len(back):
        q = reach // 2 + 1
        near = np.r_[False, back <= reach, False]
        edge = np.flatnonzero(near[1:] != near[:-1])
        lo, hi = edge[::2], edge[1::2]
        keep = hi - lo >= max(MIN_WORDS - reach, (MIN_EXPONENT - 1) * q)
        if keep.any():
            found.append((lo[keep] - reach, hi[keep]))
        reach *= 2
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lo, hi = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.r_[True, lo[1:] > hi[:-1]]
    return np.maximum(lo[new], 0), hi[np.r_[np.flatnonzero(new)[1:] - 1, len(hi) - 1]]


def runs_of(ids: np.ndarray, doc_start: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs in the words ``ids`` of texts put together, by start and period.

    Words of different texts have different ids, so that no run crosses from one to the next.
    """
    none = (np.zeros(0, np.int64),) * 3
    lo, hi = _stretches(back)
    if not len(lo):
        return none
    # a stretch that reaches back into the text before starts with the text of its first repeated word
    repeated = np.flatnonzero(back < _FAR)
    first = repeated[np.searchsorted(repeated, lo)]
    lo = np.maximum(lo, doc_start[np.searchsorted(doc_start, first, side="right") - 1])
    size = hi - lo
    shift = np.cumsum(size + 1) - size - 1  # one separator after each stretch
    s = np.empty(int((size + 1).sum()), np.int64)
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    s[place + np.repeat(shift, size)] = ids[place + np.repeat(lo, size)]
    s[shift + size] = ids.max() + 1 + np.arange(len(size))
    s = np.unique(s, return_inverse=True)[1]
    sa, isa, levels = suffix_array(s)
    lcp = common_prefixes(sa, levels)
    kept = []
    for start, period in branching_tandems(sa, isa, lcp):
        turned = _turned(start, period, levels)
        length = 2 * period + turned
        ok = (length >= MIN_WORDS) & (length >= MIN_EXPONENT * period)
        kept.append((start[ok] - turned[ok], length[ok], period[ok]))
    start, length, period = (np.concatenate(x) for x in zip(*kept)) if kept else none
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    new = np.r_[True, (start[1:] != start[:-1]) | (length[1:] != length[:-1])] if len(start) else np.zeros(0, bool)
    start, length, period = start[new], length[new], period[new]
    own = np.searchsorted(shift, start, side="right") - 1
    start = start - shift[own] + lo[own]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of the words, no two texts sharing any, where each text starts, and how far back each word's last occurrence is."""
    ids, starts, base, n = [], [], 0, 0
    for words in texts:
        seen: dict[bytes, int] = {}
        own = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
        ids.append(own + base)
        starts.append(n)
        base += len(seen)
        n += len(words)
    flat = np.concatenate(ids)
    order = np.argsort(flat, kind="stable")
    by_word = flat[order]
    back = np.full(n, _FAR)
    same = by_word[1:] == by_word[:-1]
    back[order[1:][same]] = (order[1:] - order[:-1])[same]
    return flat, np.array(starts, np.int64), back


def _greatest(start: list[int], length: list[int], period: list[int]) -> tuple[int, int, int, int]:
    """The run with the greatest length / period (exact; ties: smallest start, then period)."""
    best = 0
    for i in range(1, len(start)):  # runs come by start and period, so only a greater one wins
        if length[i] * period[best] > length[best] * period[i]:
            best = i
    return start[best], length[best], period[best], 1000 * length[best] // period[best]


def search(texts: list[str | None]) -> list[tuple[int, tuple[list[int], list[int], list[int]], str]]:
    """(number of words, runs as starts, lengths and periods, collapsed text) of each text."""
    split = [t.encode("utf-8", "replace").split() if t else [] for t in texts]
    filled = [i for i, words in enumerate(split) if len(words) >= MIN_WORDS]
    runs: dict[int, tuple[np.ndarray, ...]] = {}
    if filled:
        ids, starts, back = _numbered([split[i] for i in filled])
        start, length, period = runs_of(ids, starts, back)
        edge = np.searchsorted(start, np.r_[starts, len(ids)])
        for k, i in enumerate(filled):
            if edge[k] < edge[k + 1]:
                own = slice(edge[k], edge[k + 1])
                runs[i] = (start[own] - starts[k], length[own], period[own])
    out = []
    for i, words in enumerate(split):
        if i in runs:
            start, length, period = runs[i]
            change = np.zeros(len(words) + 1, np.int64)
            np.add.at(change, start + period, 1)
            np.add.at(change, start + length, -1)
            kept = np.flatnonzero(np.cumsum(change)[:-1] == 0).tolist()
            out.append((len(words), (start.tolist(), length.tolist(), period.tolist()), b" ".join([words[j] for j in kept]).decode("utf-8", "replace")))
        else:
            out.append((len(words), ([], [], []), b" ".join(words).decode("utf-8", "replace")))
    return out


def _portions(texts: pa.Array) -> Iterator[list[str | None]]:
    """The texts in order, about ``CHUNK_WORDS`` words at a time."""
    held, size = [], 0
    for t in texts:
        held.append(t.as_py())
        size += len(held[-1] or "") // 6
        if size >= CHUNK_WORDS:
            yield held
            held, size = [], 0
    if held:
        yield held


def periodic_runs(text: Column) -> Column:
    """Struct ``(n_words, runs, top, collapsed)`` of a whole text.

    ``runs`` are ``(start, length, period)`` by start, then period, in words numbered from
    0; runs of different periods may overlap. ``top`` is the one with the greatest length
    over period (ties: smallest start, then smallest period) with
    ``exponent_milli`` = floor(1000 * length / period); null without a run. ``collapsed``
    is what is left, joined by single spaces, when every run keeps its first period only. A null
    text has no words. Rows are independent: repeated rows get equal results, an empty table none.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            n_words, offsets, flat, tops, collapsed = [], [0], ([], [], []), [], []
            for texts in _portions(batch):
                for n, runs, rest in search(texts):
                    n_words.append(n)
                    for held, new in zip(flat, runs):
                        held.extend(new)
                    offsets.append(len(flat[0]))
                    tops.append(dict(zip(("start", "length", "period", "exponent_milli"), _greatest(*runs))) if runs[0] else None)
                    collapsed.append(rest)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in flat], fields=list(_RUN)))
            yield pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), lists, pa.array(tops, _TOP), pa.array(collapsed, pa.string())], names=["n_words", "runs", "top", "collapsed"])

    return F.arrow_udf(run, FOUND)(text)


def runs_text(runs: Column) -> Column:
    """Every run as ``start,length,period`` with a line feed after it."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
