"""Benchmark passages in documents: SimHash of item-sized windows, Hamming blocks, exact check."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, unused

SHINGLE, SIMILARITY = 5, 0.8
#: Fingerprints have 256 bits. Windows as alike as SIMILARITY differ in 39 of them, with a deviation of 6; unlike ones in 128.
PRINT_WORDS, RADIUS, BLOCKS = 4, 63, 8
#: Two fingerprints within RADIUS differ in at most this many bits of some block of 32, and there in at most this many of some byte.
IN_BLOCK, IN_BYTE = RADIUS // BLOCKS, RADIUS // BLOCKS // 4
#: Where more than this share of a window's or an item's shingles are repeats, fingerprints say little; such pairs are compared as they are.
MAX_REPEATED = 0.02
#: The benchmark is matched in parts of at most about this many characters, one after the other, which bounds what each task holds.
BLOCK_CHARS = 4_000_000
#: Pairs of windows and items looked at together.
PAIRS = 1 << 18
_PLAIN = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def plain_words(text: str | None) -> list[bytes]:
    """Lower-case words of letters and digits; other ASCII signs count as white space."""
    return text.lower().encode("utf-8", "replace").translate(_PLAIN).split() if text else []


def shingles(words: list[bytes], k: int) -> np.ndarray:
    """64-bit hashes of the runs of k words; of the whole sequence if it is shorter."""
    k = min(k, len(words))
    if not k:
        return np.zeros(0, np.uint64)
    return np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 7) for i in range(len(words) - k + 1)), np.uint64, len(words) - k + 1)


_REMIX = np.random.default_rng(20240313).integers(0, 2**63, PRINT_WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _signs(hashes: np.ndarray) -> np.ndarray:
    """The bits of each hash and of others made from it, as 1 and -1."""
    wide = (hashes[:, None] ^ (hashes[:, None] >> np.uint64(29))) * _REMIX
    wide ^= wide >> np.uint64(32)
    return np.unpackbits(wide.view(np.uint8).reshape(len(hashes), -1), axis=1, bitorder="little").astype(np.int32) * 2 - 1


def window_prints(hashes: np.ndarray, width: int) -> np.ndarray:
    """SimHash, a row of words, of each run of ``width`` shingles, each weighed by how often it occurs there."""
    signs = _signs(hashes)
    sums = np.vstack([np.zeros((1, signs.shape[1]), np.int32), np.cumsum(signs, axis=0, dtype=np.int32)])
    return np.packbits(sums[width:] - sums[:-width] > 0, axis=1, bitorder="little").view(np.uint64)


def repeated(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` shingles whether more than ``MAX_REPEATED`` of them stand in the ``width`` before them, too."""
    order = np.argsort(hashes, kind="stable")
    before = np.full(len(hashes), -(1 << 40))
    same = hashes[order[1:]] == hashes[order[:-1]]
    before[order[1:][same]] = order[:-1][same]
    again = np.cumsum(np.r_[0, np.arange(len(hashes)) - before < width])
    return again[width:] - again[:-width] > MAX_REPEATED * width


def weighted_similarity(a: Counter, b: Counter) -> float:
    """Sum of the lesser over sum of the greater counts of the shingles."""
    common = sum(min(n, b[h]) for h, n in a.items() if h in b)
    return common / (sum(a.values()) + sum(b.values()) - common)


class ItemIndex:
    """Benchmark items by their number of words, with tables over the blocks of their fingerprints."""

    def __init__(self, items: list[tuple[object, str | None]], shingle: int, similarity: float):
        self.shingle, self.similarity = shingle, similarity
        first: dict[tuple[bytes, ...], object] = {}
        for item, text in items:
            words = tuple(plain_words(text))
            if words and item is not None and (words not in first or item < first[words]):
                first[words] = item
        self.vocabulary = {w: i + 1 for i, w in enumerate(sorted({w for ws in first for w in ws}))}
        self.by_size: dict[int, list] = {}
        for words, item in sorted(first.items(), key=lambda x: x[1]):
            h = shingles(list(words), shingle)
            self.by_size.setdefault(len(words), []).append((item, Counter(h.tolist()), window_prints(h, len(h))[0], bool(repeated(h, len(h))[0])))
        rng = np.random.default_rng(5)
        self.codes = rng.integers(1, 2**63, (shingle, len(self.vocabulary) + 1), dtype=np.uint64)
        known: dict[int, dict[int, set[int]]] = {}
        for words in first:
            k = min(shingle, len(words))
            for c in self._codes(self._ids(list(words)), k).tolist():
                known.setdefault(k, {}).setdefault(c, set()).add(len(words))
        self.known = {k: (np.array(sorted(d), np.uint64), d) for k, d in known.items()}
        self.prints = {m: np.array([x[2] for x in found], np.uint64) for m, found in self.by_size.items()}
        self.plain = {m: np.flatnonzero([x[3] for x in found]) for m, found in self.by_size.items()}
        near = np.bitwise_count(np.arange(256)[:, None] ^ np.arange(256)[None, :]) <= IN_BYTE
        #: near[m][byte][value] has a bit for each item that has at most IN_BYTE other bits in that byte.
        self.near = {m: [np.packbits(near[:, v], axis=1) for v in p.view(np.uint8).reshape(len(p), -1).T] for m, p in self.prints.items()}

    def candidates(self, m: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of all pairs within ``RADIUS``, and of few others: tables over bytes, then blocks of four bytes."""
        n, own = len(self.prints[m]), self.prints[m].view(np.uint32)
        values, blocks, found = prints.view(np.uint8).reshape(len(prints), -1), prints.view(np.uint32), []
        for b in range(BLOCKS):
            some = self.near[m][4 * b][values[:, 4 * b]]
            for j in range(4 * b + 1, 4 * b + 4):
                some = some | self.near[m][j][values[:, j]]
            w, i = np.nonzero(np.unpackbits(some, axis=1, count=n))
            ok = np.bitwise_count(blocks[w, b] ^ own[i, b]) <= IN_BLOCK
            found.append(w[ok] * n + i[ok])
        pairs = np.unique(np.concatenate(found))
        return pairs // n, pairs % n

    def _ids(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int64, len(words))

    def _codes(self, ids: np.ndarray, k: int) -> np.ndarray:
        n = len(ids) - k + 1
        return sum((self.codes[j][ids[j : j + n]] for j in range(k)), np.zeros(n, np.uint64))

    def _starts(self, ids: np.ndarray) -> dict[int, np.ndarray]:
        """By window size, starts of the windows that share a shingle with an item of that size.

        A window that shares none has similarity 0, so this leaves out nothing.
        """
        n, marks = len(ids), {}
        for k, (codes, sizes) in self.known.items():
            if n < k:
                continue
            inside = np.lib.stride_tricks.sliding_window_view(ids > 0, k).all(axis=1)
            at = np.flatnonzero(inside)
            if not len(at):
                continue
            c = sum((self.codes[j][ids[at + j]] for j in range(k)), np.zeros(len(at), np.uint64))
            hit = codes[np.minimum(np.searchsorted(codes, c), len(codes) - 1)] == c
            for p, code in zip(at[hit].tolist(), c[hit].tolist()):
                for m in sizes[code]:
                    size = min(m, n)
                    mark = marks.setdefault(m, np.zeros(n - size + 2, np.int32))
                    mark[max(0, p + k - size)] += 1
                    mark[min(p, n - size) + 1] -= 1
        return {m: np.flatnonzero(np.cumsum(mark)[:-1] > 0) for m, mark in marks.items()}

    def _pairs(self, m: int, prints: np.ndarray, heavy: np.ndarray, short: bool) -> tuple[np.ndarray, np.ndarray]:
        """Pairs to compare: those within the radius, and all of windows and items that repeat themselves; all of a text shorter than the item."""
        n = len(self.prints[m])
        if short:
            return np.divmod(np.arange(len(prints) * n), n)
        w, i = self.candidates(m, prints)
        close = np.bitwise_count(prints[w] ^ self.prints[m][i]).sum(axis=1, dtype=np.int64) <= RADIUS
        plain = np.zeros((len(prints), n), bool)
        plain[heavy] = True
        plain[:, self.plain[m]] = True
        plain[w[close], i[close]] = True
        return np.nonzero(plain)

    def search(self, text: str | None) -> list[tuple]:
        """(item, similarity, start, words, distance) of each item's best window, as similar as asked for."""
        words = plain_words(text)
        if not words:
            return []
        best: dict[object, tuple] = {}
        for m, starts in self._starts(self._ids(words)).items():
            size = min(m, len(words))
            k = min(self.shingle, size)
            width = size - k + 1
            for run in np.split(starts, np.flatnonzero(np.diff(starts) > size) + 1):
                if not len(run):
                    continue
                h = shingles(words[run[0] : run[-1] + size], k)
                prints, heavy = window_prints(h, width)[run - run[0]], repeated(h, width)[run - run[0]]
                part = max(1, PAIRS // len(self.prints[m]))
                for at in range(0, len(run), part):
                    w, i = self._pairs(m, prints[at : at + part], heavy[at : at + part], size < m)
                    for x, y in zip((w + at).tolist(), i.tolist()):
                        item, counts = self.by_size[m][y][:2]
                        start = int(run[x])
                        s = weighted_similarity(Counter(h[start - run[0] : start - run[0] + width].tolist()), counts)
                        if s >= self.similarity and (item not in best or (-s, start) < (-best[item][1], best[item][2])):
                            best[item] = (item, s, start, size, int(np.bitwise_count(prints[x] ^ self.prints[m][y]).sum()))
        return [best[i] for i in sorted(best)]


def blocks_of(benchmark: DataFrame, *, item: str = "item_id", text: str = "text", chars: int = BLOCK_CHARS) -> Iterator[list[tuple]]:
    """The benchmark in hash blocks of about ``chars`` characters, one after the other."""
    total = benchmark.agg(F.sum(F.length(text))).first()[0] or 0
    n = 1 + total // chars
    for b in range(n):
        part = benchmark if n == 1 else benchmark.where(F.pmod(F.xxhash64(item), F.lit(n)) == b)
        yield [tuple(r) for r in part.select(item, text).collect()]


def with_hits(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", shingle: int = SHINGLE, similarity: float = SIMILARITY, out: str = "_hits", chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` with ``out``: an array of (item, similarity, start, words, distance), one for each item found.

    An item is found if a window of as many words as it has (the whole document if that
    is shorter) reaches ``similarity``: the sum of lesser over the sum of greater counts
    of shingles of ``shingle`` words. Windows that share a shingle with an item of their
    size (others have similarity 0) get a SimHash; tables over blocks of its bits give
    every item within ``RADIUS`` bits, and the exact similarity decides. Windows and items
    that repeat themselves, and texts shorter than an item, are compared without
    fingerprints. Items with equal words count as their smallest id; null or empty texts,
    and items without words, match nothing. Documents are never shuffled where the
    benchmark is one part; the parts of a larger one are matched one after the other, each
    in a job of its own, and what they found is joined by a row number. ``out`` must be no
    column of ``docs``.
    """
    if out.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"documents have a column {out}")
    kind = f"array<struct<item: {benchmark.schema[item].dataType.simpleString()}, similarity: double, start: int, words: int, distance: int>>"
    parts = blocks_of(benchmark, item=item, text=text, chars=chars)
    first, more = next(parts), next(parts, None)
    if more is None:
        return docs.withColumn(out, _hits(docs.sparkSession, F.col(text), first, kind, shingle, similarity))
    (row,) = unused(docs, "_row")
    held = staged(docs.withColumn(row, F.monotonically_increasing_id()), "documents")
    found = None
    for items in chain((first, more), parts):
        one = held.select(row, _hits(docs.sparkSession, F.col(text), items, kind, shingle, similarity).alias(out)).where(F.size(out) > 0)
        one = staged(one, "hits")
        found = one if found is None else found.union(one)
    lists = found.groupBy(row).agg(F.flatten(F.collect_list(out)).alias(out))
    return held.join(lists, row, "left").select(*docs.columns, F.coalesce(F.sort_array(out), F.array().cast(kind)).alias(out))


def _hits(spark, text: Column, items: list[tuple], kind: str, shingle: int, similarity: float) -> Column:
    # bounded by BLOCK_CHARS
    sent = spark.sparkContext.broadcast(items)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = ItemIndex(sent.value, shingle, similarity)
        for batch in batches:
            yield pd.Series([[dict(zip(("item", "similarity", "start", "words", "distance"), x)) for x in index.search(t)] for t in batch])

    return F.pandas_udf(run, kind)(text)
