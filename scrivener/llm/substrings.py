"""Repeated-substring removal: anchors bring equal strings together, a Burrows-Wheeler transform tells them apart.

A byte goes if it lies in a string of ``length`` bytes that also starts earlier (smaller
id, or same document and earlier start). The work is dealt out by content:

1. Every window of ``length`` bytes has an anchor: its smallest hashed gram of ``GRAM``
   bytes, leftmost of equals. Neighbouring windows share anchors, so a text becomes runs of
   windows. Equal windows have equal anchors at equal offsets.
2. Runs are grouped by anchor. A run whose whole content occurred before is a repeat as it
   is. Anchors with one content only are done. What remains are runs that share an anchor
   but differ somewhere.
3. The bytes of those runs are fetched. All windows with an anchor at about the same
   offset share most of their bytes; where no other run has those, the windows are done.
   Over the rest, group by group, a Burrows-Wheeler transform is searched breadth-first by
   backward extension; the search gives common prefixes by increasing length and stops at
   ``length``, where the suffixes not yet told apart are the equal windows. An anchor whose
   differing runs have more than ``GROUP_BYTES`` is never gathered: its windows are dealt
   out one by one, by two 64-bit hashes of their bytes.
4. Each document gets its repeated windows and drops the bytes they cover.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import numbered
from .common import release, staged

LENGTH, GRAM = 100, 24
#: Bytes of runs in one transform, and anchors that a task holds before it combines and sends them.
BLOCK_BYTES, HELD_RUNS = 1 << 17, 1_000_000
#: An anchor with more bytes of differing runs than this is dealt out window by window.
GROUP_BYTES = 1 << 19
#: Windows are sifted by anchor offset in ranges of this many.
OFFSETS = 20
#: Documents in the sample that finds frequent anchors, how many must have one, and how many anchors are kept at most.
#: These save a round for the commonest anchors; GROUP_BYTES holds for every anchor.
SAMPLE_DOCS, FREQUENT, MAX_FREQUENT = 4000, 20, 5000

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE2 = np.random.default_rng(20240311).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = [np.uint64(x) for x in (_rng.integers(1, 2**62, 8, dtype=np.uint64) * 8 + 5).tolist()]
_BASE = int(_STEP[7])
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def _power(which: str, n: int) -> np.ndarray:
    """Powers 0 to n of the base, or of its inverse, modulo 2 to the 64."""
    have = _powers[which]
    while len(have) <= n:
        factor = np.uint64(pow(_BASE if which == "up" else _INVERSE, len(have), 1 << 64))
        have = np.concatenate([have, have * factor])
    _powers[which] = have
    return have


def _doubled(parts: dict[int, np.ndarray], step: int, mult: np.uint64) -> None:
    h = parts[step]
    parts[2 * step] = h[:-step] * mult + h[step:] if len(h) > step else h[:0]


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of each run of 24 bytes."""
    parts = {1: _BYTE[raw]}
    for i, step in enumerate((1, 2, 4, 8)):
        _doubled(parts, step, _STEP[i])
    n = len(raw) - GRAM + 1
    return _mix(parts[16][:n] * _STEP[4] + parts[8][16 : 16 + n])


def sliding_argmin(h: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest value in each window, leftmost of equals (by the upper 32 bits)."""
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    n, step = len(h) - width + 1, 1
    while 2 * step <= width:
        key = np.minimum(key[:-step], key[step:])
        step *= 2
    return (np.minimum(key[:n], key[width - step : width - step + n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, salt: np.ndarray, values: np.ndarray = _BYTE) -> np.ndarray:
    """Hash of the bytes from each start to each end, wherever they lie, with a salt; never 0. Other ``values`` of bytes give another hash."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[raw] * _power("up", len(raw))[: len(raw)])])
    h = (sums[end] - sums[start]) * _power("down", len(raw))[start]
    h = _mix(h + _mix(salt.astype(np.uint64) * np.uint64(512) + (end - start).astype(np.uint64)))
    return np.where(h == 0, np.uint64(1), h)


def window_hashes(raw: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each window that starts at ``at``, from different values of its bytes."""
    salt = np.full(len(at), 511)
    return span_hashes(raw, at, at + length, salt), span_hashes(raw, at, at + length, salt, _BYTE2)


def _spread(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All positions of the ranges, one range after the other."""
    count = hi - lo + 1
    return np.repeat(lo - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())


def runs_of(raw: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(first window, last window, anchor position, anchor hash, content hash) of each run of windows."""
    h = gram_hashes(raw)
    at = sliding_argmin(h, length - GRAM + 1)
    lo = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    hi = np.r_[lo[1:], len(at)] - 1
    a = at[lo]
    return lo, hi, a, h[a], span_hashes(raw, lo, hi + length, a - lo)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64) if x.dtype != np.int64 else x)


RUNS = "k long, content long, doc long, span long"
_RUN_NAMES = ["k", "content", "doc", "span"]


def _batch(names: list[str], columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([_signed(c) for c in columns], names=names)


def _joined(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges sorted and merged where one document's touch or overlap."""
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order], hi[order]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (lo[1:] > hi[:-1] + 1)] if len(doc) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return (doc[first], lo[first], np.maximum.reduceat(hi, first)) if len(doc) else (doc, lo, hi)


def _without_copies(*columns: np.ndarray) -> list[np.ndarray]:
    """Sorted ``columns`` without the rows that equal the one before: a document given twice is no earlier than itself."""
    same = np.logical_and.reduce([x[1:] == x[:-1] for x in columns])
    keep = np.r_[True, ~same] if len(columns[0]) else np.zeros(0, bool)
    return [x[keep] for x in columns]


def emit_runs(length: int, frequent: np.ndarray):
    """Function of batches (doc, text) giving ``RUNS`` rows.

    A run has its anchor's hash as ``k``; a run with a frequent anchor is given window by
    window with the window's two hashes as ``k`` and ``content``, so that no key gathers
    unlike texts by the thousand. ``span`` packs first window, extent and anchor offset. Of equal contents only
    the first of the task goes on; the others are repeats already, given with ``content`` 0
    and ``span`` packing first and last window.
    """

    def combined(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        k, c, doc, span = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((span, doc, c, k))
        k, c, doc, span = _without_copies(k[order], c[order], doc[order], span[order])
        again = np.r_[False, (k[1:] == k[:-1]) & (c[1:] == c[:-1])]
        yield _batch(_RUN_NAMES, [x[~again] for x in (k, c, doc, span)])
        if again.any():
            lo = span[again] >> 16
            d, lo, hi = _joined(doc[again], lo, lo + (span[again] >> 8 & 255))
            yield _batch(_RUN_NAMES, [d, np.zeros_like(d), d, lo << 32 | hi])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8) if text else np.zeros(0, np.uint8)
                if doc is None or len(raw) < length:
                    continue
                lo, hi, a, k, c = runs_of(raw, length)
                hot = np.isin(k, frequent) if len(frequent) else np.zeros(len(k), bool)
                span = lo << 16 | (hi - lo) << 8 | (a - lo)
                if hot.any():
                    at = _spread(lo[hot], hi[hot])
                    w, w2 = window_hashes(raw, at, length)
                    k, c, span = np.r_[k[~hot], w], np.r_[c[~hot], w2], np.r_[span[~hot], at << 16]
                held.append((k, c, np.full(len(k), doc, np.int64), span))
                n += len(k)
                if n >= HELD_RUNS:
                    yield from combined(held)
                    held, n = [], 0
        if held:
            yield from combined(held)

    return run


FOUND = "doc long, lo long, hi long, k long, a long"
_FOUND_NAMES = ["doc", "lo", "hi", "k", "a"]


#: ``a`` of runs whose windows are to be dealt out one by one.
DEALT = -1


def settle_runs(length: int, group_bytes: int):
    """Function of ``RUNS`` batches of whole keys, sorted by all columns, giving ``FOUND`` rows.

    These are repeats (k null) and runs whose bytes are wanted (k set). Rows stream through:
    what is held is a batch and the first runs of one key, up to ``group_bytes`` of text.
    A key with more has all its runs given with ``a`` = ``DEALT``.
    """

    def batch(parts: list[tuple[np.ndarray, ...]], wanted: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        d, lo, hi = _joined(*(np.concatenate(x) for x in zip(*parts))) if parts else (np.zeros(0, np.int64),) * 3
        more = [np.concatenate(x) for x in zip(*wanted)] if wanted else [np.zeros(0, np.int64)] * 5
        columns = [pa.array(np.r_[x, y]) for x, y in zip((d, lo, hi), more)]
        columns += [pa.concat_arrays([pa.nulls(len(d), pa.int64()), pa.array(x)]) for x in more[3:]]
        return pa.RecordBatch.from_arrays(columns, names=_FOUND_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[np.ndarray] = [np.zeros(0, np.int64)] * 4
        open_: list[np.ndarray] = [np.zeros(0, np.int64)] * 4
        dealt = np.zeros(0, np.int64)  # the open key, if its runs are dealt out

        def closed(rows: list[np.ndarray], final: bool) -> list[tuple[np.ndarray, ...]]:
            """Wanted runs of the keys that end in ``rows`` (first runs of each content); the last key stays open."""
            nonlocal open_, dealt
            k, _, doc, span = rows
            if not len(k):
                return []
            lo, hi = span >> 16, (span >> 16) + (span >> 8 & 255)
            own = np.cumsum(np.r_[0, k[1:] != k[:-1]])
            contents, size = np.bincount(own), np.bincount(own, hi - lo + length)
            over = (size > group_bytes) | np.isin(k[np.flatnonzero(np.r_[True, own[1:] != own[:-1]])], dealt)
            ends = np.ones(len(contents), bool)
            ends[-1] = final or over[-1]
            dealt = k[-1:] if over[-1] else np.zeros(0, np.int64)
            keep = ~ends[own]
            open_ = [x[keep] for x in rows]
            use = (ends & (over | (contents > 1)))[own]
            a = np.where(over[own], DEALT, lo + (span & 255))
            return [(doc[use], lo[use], hi[use], k[use], a[use])]

        for each in batches:
            k, c, doc, span = (each.column(x).to_numpy() for x in _RUN_NAMES)
            settled = c == 0
            parts = [(doc[settled], span[settled] >> 32, span[settled] & 0xFFFFFFFF)]
            rows = [np.r_[x, y[~settled]] for x, y in zip(last, (k, c, doc, span))]
            if not len(rows[0]):
                yield batch(parts, [])
                continue
            same_run = np.r_[not len(last[0]), (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])]
            copy = np.r_[bool(len(last[0])), np.logical_and.reduce([x[1:] == x[:-1] for x in rows])]
            again = ~same_run & ~copy
            lo = rows[3] >> 16
            parts.append((rows[2][again], lo[again], (lo + (rows[3] >> 8 & 255))[again]))
            first = same_run & ~copy
            last = [x[-1:] for x in rows]
            yield batch(parts, closed([np.r_[x, y[first]] for x, y in zip(open_, rows)], False))
        yield batch([], closed(open_, True))

    return run


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first ``depth`` symbols or more (prefix doubling)."""
    rank, step = np.unique(symbols, return_inverse=True)[1].astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while step < depth:
        nxt = np.zeros(len(rank), np.int64)
        nxt[:-step] = rank[step:] + 1
        key = rank * (len(rank) + 2) + nxt
        order = np.argsort(key, kind="stable")
        s = key[order]
        rank = np.empty(len(rank), np.int64)
        rank[order] = np.cumsum(np.r_[0, s[1:] != s[:-1]])
        if rank[order[-1]] == len(rank) - 1:
            break
        step *= 2
    return order


def equal_prefixes(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of the concatenated texts, and for each place whether its prefix of ``length`` differs from the one before.

    Texts end in separators that equal nothing. Starting from the intervals of single
    symbols, each round extends every interval to the left by every byte that its part of
    the transform holds. The interval of a string of l + 1 bytes ends where the common
    prefix with the next suffix is l at most, and exactly l if no shorter string ended
    there: places are settled by increasing common prefix, and an interval that settles
    none is dropped. The search stops at ``length``; places not settled share that many.
    """
    m = len(texts)
    sizes = np.array([len(t) for t in texts])
    raw = np.frombuffer(b"".join(t + b"\0" for t in texts), np.uint8)
    ends = np.cumsum(sizes + 1) - 1
    symbols = raw.astype(np.int64) + m
    symbols[ends] = np.arange(m)
    order = suffix_order(symbols, length)
    n = len(raw)
    before = symbols[order - 1] - m  # negative: a separator (the first text has the last one before it)
    alphabet = np.unique(symbols[symbols >= m]) - m
    occ = np.zeros((n + 1, len(alphabet)), np.int32)
    for i, c in enumerate(alphabet):
        np.cumsum(before == c, out=occ[1:, i])
    counts = np.array([(symbols == c + m).sum() for c in alphabet])
    base = m + np.r_[0, np.cumsum(counts)[:-1]].astype(np.int64) if len(alphabet) else np.zeros(0, np.int64)
    settled = np.zeros(n + 1, bool)
    settled[0] = settled[n] = True
    lo, hi = np.r_[np.arange(m), base], np.r_[np.arange(m) + 1, base + counts]
    settled[hi] = True
    for _ in range(1, length):
        found_lo, found_hi = [], []
        for at in range(0, len(lo), 1 << 14):
            left, right = occ[lo[at : at + (1 << 14)]], occ[hi[at : at + (1 << 14)]]
            i, c = np.nonzero(right > left)
            new_hi = base[c] + right[i, c]
            fresh = ~settled[new_hi]
            found_lo.append((base[c] + left[i, c])[fresh])
            found_hi.append(new_hi[fresh])
        lo, hi = np.concatenate(found_lo), np.concatenate(found_hi)
        if not len(lo):
            break
        settled[hi] = True
    return order, settled[:n]


def repeated_windows(snippets: list[tuple[int, int, int, bytes]], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc, window) of each window of the snippets (doc, first, last, bytes) that is not the earliest of its kind."""
    order, new = equal_prefixes([s[3] for s in snippets], length)
    sizes = np.array([len(s[3]) + 1 for s in snippets])
    own = np.repeat(np.arange(len(snippets)), sizes)
    inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    first, last, doc = (np.array([s[i] for s in snippets], np.int64) for i in (1, 2, 0))
    at, d = inside + first[own], doc[own]
    kind = np.empty(len(order), np.int64)
    kind[order] = np.cumsum(new)
    valid = at <= last[own]
    kind, at, d = kind[valid], at[valid], d[valid]
    by = np.lexsort((at, d, kind))
    kind, d, at = _without_copies(kind[by], d[by], at[by])
    again = np.r_[False, kind[1:] == kind[:-1]]
    return d[again], at[again]


def sift(group: list[tuple[int, int, int, int, bytes]], length: int) -> Iterator[tuple[int, int, int, bytes]]:
    """Parts (doc, first, last, bytes) of the runs (doc, first, last, anchor, bytes) of one anchor that may repeat.

    All windows whose anchor lies ``x`` to ``x + OFFSETS - 1`` bytes in have the bytes in
    common that those offsets leave; if only one run of the group has just these, none of
    its windows there is a repeat.
    """
    ranges = range(0, length - GRAM + 1, OFFSETS)
    cores: list[list[bytes | None]] = []
    for _, lo, hi, a, raw in group:
        cores.append([raw[a - lo - x : a - lo - (x + OFFSETS - 1) + length] if a - hi < x + OFFSETS and a - lo >= x else None for x in ranges])
    counts = [Counter(c[j] for c in cores) for j in range(len(ranges))]
    for (doc, lo, hi, a, raw), core in zip(group, cores):
        open_lo = open_hi = None
        for x, c, count in zip(reversed(ranges), reversed(core), reversed(counts)):
            if c is None or count[c] < 2:
                continue
            first, last = max(lo, a - x - OFFSETS + 1), min(hi, a - x)
            if open_hi is not None and first > open_hi + 1:
                yield doc, open_lo, open_hi, raw[open_lo - lo : open_hi - lo + length]
                open_lo = None
            open_lo, open_hi = first if open_lo is None else open_lo, last
        if open_lo is not None:
            yield doc, open_lo, open_hi, raw[open_lo - lo : open_hi - lo + length]


_CUT_NAMES = ["k", "doc", "lo", "hi", "a", "raw"]
_CUT = "k long, doc long, lo long, hi long, a long, raw binary"


def _repeats(length: int, block_bytes: int):
    """Function of cut rows, sorted by k, a, doc and lo, giving the repeated windows (doc, lo, hi).

    Rows without bytes are single windows with their hashes as ``k`` and ``a``: of equals all
    but the first are repeats. Runs of one ``k`` are sifted and go to a transform together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size, key, group = [], 0, None, []
        before: list[np.ndarray] = [np.zeros(0, np.int64)] * 4

        def close() -> None:
            nonlocal size
            for part in sift(group, length):
                block.append(part)
                size += len(part[3])
            group.clear()

        for batch in batches:
            single = batch.column("raw").is_null().to_numpy(zero_copy_only=False)
            if single.any():
                k, a, doc, at = rows = [np.r_[x, batch.column(c).to_numpy()[single]] for x, c in zip(before, ("k", "a", "doc", "lo"))]
                new = np.r_[True, (k[1:] != k[:-1]) | (a[1:] != a[:-1])]
                first = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))
                again = (doc != doc[first]) | (at != at[first])
                before = [x[first[-1:]] for x in rows]
                yield _batch(["doc", "lo", "hi"], list(_joined(doc[again], at[again], at[again])))
                batch = batch.filter(pa.array(~single))
            for k, *row in zip(*(batch.column(c).to_pylist() for c in _CUT_NAMES)):
                if k != key:
                    close()
                    if size >= block_bytes:
                        yield found(block)
                        block, size = [], 0
                key = k
                group.append(row)
        close()
        if block:
            yield found(block)

    def found(block: list) -> pa.RecordBatch:
        d, at = repeated_windows(block, length)
        d, lo, hi = _joined(d, at, at)
        return _batch(["doc", "lo", "hi"], [d, lo, hi])

    return run


def _cut(length: int):
    """Bytes of the wanted runs of each document; runs to be dealt out give their windows' hashes instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [], [])
            for doc, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("doc", "text", "wanted"))):
                raw = text.encode("utf-8", "replace")
                dealt = [(w["lo"], w["hi"]) for w in wanted if w["a"] == DEALT]
                if dealt:
                    at = _spread(*np.array(dealt, np.int64).T)
                    k, k2 = window_hashes(np.frombuffer(raw, np.uint8), at, length)
                    nulls = pa.nulls(len(at), pa.binary())
                    yield pa.RecordBatch.from_arrays([*(_signed(x) for x in (k, np.full(len(at), doc, np.int64), at, at, k2)), nulls], names=_CUT_NAMES)
                for w in wanted:
                    if w["a"] == DEALT:
                        continue
                    for column, x in zip(rows, (w["k"], doc, w["lo"], w["hi"], w["a"], raw[w["lo"] : w["hi"] + length])):
                        column.append(x)
            kinds = [pa.int64()] * 5 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(rows, kinds)], names=_CUT_NAMES)

    return run


def _frequent(docs: DataFrame, length: int) -> np.ndarray:
    """Anchors that many documents of a sample have; they only decide how runs are dealt out."""
    total = docs.count()
    share = min(1.0, SAMPLE_DOCS / max(total, 1))
    some = docs.where(F.pmod(F.xxhash64(F.lit(3), "doc"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    top = some.mapInArrow(emit_runs(length, np.zeros(0, np.uint64)), RUNS).where("content <> 0").groupBy("k").agg(F.count_distinct("content").alias("n"))
    rows = top.where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "k").limit(MAX_FREQUENT).collect()
    return np.array([r["k"] for r in rows], np.int64).view(np.uint64)


def repeats(docs: DataFrame, *, text: str = "text", key: str = "doc_id", length: int = LENGTH, block_bytes: int = BLOCK_BYTES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Rows ``doc, lo, hi``: windows of ``length`` bytes, by start, that also start earlier. Ranges may touch.

    ``length`` is at least ``GRAM``. Keys are integers; rows with a null key take no part,
    and rows that share a key count as one document: a window is no repeat of the one at
    the same start of the same key, so rows that repeat in key and text get the same
    ranges, those of one of them. Texts that differ need keys that differ, since ranges
    name a key only. Documents are matched as UTF-8 bytes.
    """
    own = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    frequent = _frequent(own, length)
    runs = own.mapInArrow(emit_runs(length, frequent), RUNS)
    found = staged(runs.repartition("k").sortWithinPartitions(*_RUN_NAMES).mapInArrow(settle_runs(length, group_bytes), FOUND), "repeats")
    release(docs.sparkSession)
    wanted = found.where("k is not null").groupBy("doc").agg(F.collect_list(F.struct("k", "lo", "hi", "a")).alias("wanted"))
    cut = own.where(F.octet_length("text") >= length).join(wanted, "doc").mapInArrow(_cut(length), _CUT)
    told = staged(cut.repartition("k").sortWithinPartitions("k", "a", "doc", "lo").mapInArrow(_repeats(length, block_bytes), "doc long, lo long, hi long"), "repeats")
    release(docs.sparkSession)
    return found.where("k is null").select("doc", "lo", "hi").unionByName(told)


def remove_repeats(docs: DataFrame, *, text: str = "text", key: str = "doc_id", length: int = LENGTH, with_kept: bool = False, **how) -> DataFrame:
    """Per row of ``docs``: key, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` (and ``kept``, the bytes left).

    Null and empty texts have no bytes; texts shorter than ``length`` lose none. Rows that
    repeat in key and text have equal results, each as if it were there once. Keys that
    are no integers are numbered in their order first. Rows with a null key keep all.
    """
    own = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    if own.schema["_key"].dataType.typeName() in ("byte", "short", "integer", "long"):
        own = own.withColumn("_doc", F.col("_key").cast("long"))
    else:
        own = own.join(numbered(own.select("_key").where("_key is not null").distinct(), [F.col("_key")], "_doc").withColumn("_doc", F.col("_doc").cast("long")), "_key", "left")
    ranges = repeats(own, text="_text", key="_doc", length=length, **how)
    lists = ranges.groupBy("doc").agg(F.collect_list(F.shiftleft("lo", 32).bitwiseOR(F.col("hi"))).alias("_windows"))
    joined = own.join(lists, F.col("_doc") == F.col("doc"), "left")

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, windows in batches:
            out = []
            for t, packed in zip(texts, windows):
                raw = t.encode("utf-8", "replace") if t else b""
                removed = spans = 0
                kept = raw
                if packed is not None and len(packed):
                    p = np.asarray(packed, np.int64)
                    edge = np.zeros(len(raw) + 1, np.int64)
                    np.add.at(edge, np.minimum(p >> 32, len(raw)), 1)
                    np.add.at(edge, np.minimum((p & 0xFFFFFFFF) + length, len(raw)), -1)
                    gone = np.cumsum(edge)[:-1] > 0
                    removed = int(gone.sum())
                    spans = int((gone & ~np.r_[False, gone[:-1]]).sum())
                    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                out.append((len(raw), removed, spans, hashlib.sha256(kept).hexdigest(), kept if with_kept else None))
            yield pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    kind = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    done = joined.select(F.col("_key").alias(key), F.pandas_udf(run, kind)("_text", "_windows").alias("_r"))
    return done.select(key, "_r.n_bytes", "_r.n_removed", "_r.n_spans", "_r.kept_sha256", *(["_r.kept"] if with_kept else []))
