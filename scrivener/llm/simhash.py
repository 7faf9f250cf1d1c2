"""SimHash near-duplicates with a Gray-order hierarchical Hamming index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, unused
from .graph import connected_components

BITS, RADIUS, FAN = 64, 2, 16
#: Groups of the upper index nodes beyond this size are split by the next level of nodes.
SPLIT = 2000


def simhash(hashes: np.ndarray) -> int:
    """Bit i is set if over half of the 64-bit ``hashes`` have it; 0 for none. Unsigned."""
    ones, n = np.zeros(BITS, np.int64), len(hashes)
    for at in range(0, n, 1 << 16):
        part = np.ascontiguousarray(hashes[at : at + (1 << 16)]).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: Column, *, shingle: int = 3) -> Column:
    """SimHash (as a signed long) of the word shingles of a whole text, A-Z lower-cased.

    Shingles are ``shingle`` words joined by one space, repeats included; with fewer
    words the whole sequence is one; a null text or one without words gives 0.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hash64 = xxhash.xxh64_intdigest
        for batch in batches:
            out = np.zeros(len(batch), np.uint64)
            for i, t in enumerate(batch):
                # bytes.lower() and bytes.split() know ASCII only, which is what is wanted
                words = t.encode("utf-8", "replace").lower().split() if t else []
                if len(words) > shingle:
                    join = b" ".join
                    grams = map(join, zip(*(words[k:] for k in range(shingle))))
                    h = np.fromiter((hash64(g, 42) for g in grams), np.uint64, len(words) - shingle + 1)
                    out[i] = simhash(h)
                elif words:
                    out[i] = hash64(b" ".join(words), 42)
            yield pd.Series(out.view(np.int64))

    return F.pandas_udf(run, "long")(text)


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in Gray order (prefix XOR); a row of 64-bit words, the first the highest, is a code."""
    rank = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    for j in range(1, rank.shape[1]):
        rank[:, j] ^= np.uint64(0) - (rank[:, j - 1] & np.uint64(1))
    return rank


class GrayIndex:
    """Hierarchical Hamming index over groups of codes, each a row of 64-bit words.

    Codes are sorted by (group, Gray rank), so that neighbours share most bits. Every
    ``FAN`` neighbours get an upper node holding the bits on which all below agree as
    (mask, pattern), and so on up to one root a group. A search goes down from the root:
    a node adds the differences on the bits that its mask has beyond its parent's, and
    as soon as the sum passes the radius everything below it is pruned.
    """

    def __init__(self, group: np.ndarray, codes: np.ndarray):
        order = np.lexsort((*gray_rank(codes).T[::-1], group))
        self.order, self.codes = order, codes[order]
        group = group[order]
        full = np.full(codes.shape, ~np.uint64(0))
        self.levels = [(full, self.codes, None, None)]  # mask, pattern, first child, number of children
        if not len(codes):
            return
        while True:
            starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            sizes = np.diff(np.r_[starts, len(group)])
            if sizes.max() == 1 and len(self.levels) > 1:
                break
            rank = np.arange(len(group)) - np.repeat(starts, sizes)
            first = np.flatnonzero(rank % FAN == 0)
            count = np.diff(np.r_[first, len(group)])
            mask, pattern = self.levels[-1][:2]
            agree = np.bitwise_and.reduceat(mask, first, axis=0) & ~np.bitwise_or.reduceat(pattern ^ np.repeat(pattern[first], count, axis=0), first, axis=0)
            self.levels.append((agree, pattern[first] & agree, first, count))
            group = group[first]
        self.root = np.repeat(np.arange(len(starts)), self._below())

    def _below(self) -> np.ndarray:
        """Number of codes under each root."""
        count = np.ones(len(self.codes), np.int64)
        for _, _, first, _ in self.levels[1:]:
            count = np.add.reduceat(count, first)
        return count

    def near(self, queries: np.ndarray, radius: int, chunk: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (i, j) of positions in sorted order within ``radius`` bits and one group, i from ``queries``."""
        for at in range(0, len(queries), chunk):
            q = queries[at : at + chunk]
            node, top = self.root[q], self.levels[-1]
            acc = np.bitwise_count((self.codes[q] ^ top[1][node]) & top[0][node]).sum(axis=1, dtype=np.int64)
            for upper, lower in zip(self.levels[:0:-1], self.levels[-2::-1]):
                mask, _, first, count = upper
                n = count[node]
                child = np.repeat(first[node] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                q, acc, seen = np.repeat(q, n), np.repeat(acc, n), np.repeat(mask[node], n, axis=0)
                acc = acc + np.bitwise_count((self.codes[q] ^ lower[1][child]) & lower[0][child] & ~seen).sum(axis=1, dtype=np.int64)
                keep = acc <= radius
                q, node, acc = q[keep], child[keep], acc[keep]
            yield q, node

    def pairs(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs (i, j), i < j, within ``radius`` bits and one group."""
        for q, node in self.near(np.arange(len(self.codes)), radius):
            later = q < node
            yield q[later], node[later]


def _roots(parent: np.ndarray, at: np.ndarray) -> np.ndarray:
    while True:
        up = parent[at]
        if (up == at).all():
            return at
        at = up


def spanning_edges(group: np.ndarray, codes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (code, code of its class that comes first) that join all 64-bit codes linked within a group."""
    index = GrayIndex(group, codes[:, None])
    parent = np.arange(len(codes))
    for a, b in index.pairs(radius):
        while len(a):
            a, b = _roots(parent, a), _roots(parent, b)
            differ = a != b
            a, b = np.minimum(a, b)[differ], np.maximum(a, b)[differ]
            np.minimum.at(parent, b, a)
    root = _roots(parent, parent)
    moved = root != np.arange(len(root))
    found = index.codes[:, 0]
    return found[moved], found[root[moved]]


def _split_masks(depth: int, parts: int) -> list[list[int]]:
    """Masks of the index's upper nodes, by level; path p has the children parts * p + k.

    A level cuts the bits that its parent leaves free into ``parts`` runs. Codes within
    parts - 1 bits agree on at least one run at every level, so no link is lost.
    """
    levels = [[0]]
    for _ in range(depth):
        masks = []
        for m in levels[-1]:
            free = [b for b in range(BITS) if not m >> b & 1]
            masks += [m | sum(1 << b for b in run.tolist()) for run in np.array_split(free, parts)]
        levels.append(masks)
    return levels


def _signed(m: int) -> int:
    return m - (1 << BITS) if m >> (BITS - 1) else m


def linked_edges(codes: DataFrame, *, radius: int = RADIUS, split: int = SPLIT, depth: int = 3) -> DataFrame:
    """Edges ``(a, b)`` spanning the classes of ``codes`` (distinct ``fp``) within ``radius`` bits.

    The index's upper nodes are spread over the cluster: a code goes to one node for
    each of radius + 1 runs of its bits, where it meets all codes that agree there. Nodes
    with one code are dropped; nodes over ``split`` codes are split by a further level of
    masks (to ``depth``), so a hot pattern is dealt out; after three levels at most 20 bits
    are free, so no node has more than 2**20 codes. Below, each partition searches
    its nodes by :class:`GrayIndex` and returns at most one edge a code, never pairs.
    """
    masks = _split_masks(depth, radius + 1)

    def keyed(df: DataFrame, level: int) -> DataFrame:
        wide = len(masks[level]) // len(masks[level - 1])
        lits = F.array(*[F.lit(_signed(m)) for m in masks[level]])
        paths = F.sequence(F.col("path") * wide, F.col("path") * wide + wide - 1)
        out = df.select("fp", F.explode(paths).alias("path")).withColumn("key", F.col("fp").bitwiseAND(F.element_at(lits, (F.col("path") + 1).cast("int"))))
        sizes = out.groupBy("path", "key").count().where("count > 1")
        return out.join(sizes, ["path", "key"])

    todo, ready = codes.withColumn("path", F.lit(0).cast("int")), []
    for level in range(1, depth + 1):
        found = staged(keyed(todo, level), "nodes")
        ready.append(found.where(F.col("count") <= split) if level < depth else found)
        todo = found.where(F.col("count") > split)
        if level < depth and todo.isEmpty():
            break

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if held is None or not held.num_rows:
            return
        path, key, fp = (held.column(c).to_numpy() for c in ("path", "key", "fp"))
        order = np.lexsort((key, path))
        new = np.r_[False, (path[order][1:] != path[order][:-1]) | (key[order][1:] != key[order][:-1])]
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new)
        ends = spanning_edges(group, fp.view(np.uint64), radius)
        yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in ends], names=["a", "b"])

    edges = None
    for df in ready:
        part = df.select("path", "key", "fp").repartition("path", "key").mapInArrow(search, "a long, b long")
        edges = part if edges is None else edges.union(part)
    return edges


def near_duplicates(docs: DataFrame, *, text: str = "text", key: str = "doc_id", shingle: int = 3, radius: int = RADIUS, split: int = SPLIT, carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows ``(key, fp, component_id)`` and the columns of ``carry``, one for each row of ``docs``.

    ``component_id`` is the smallest key reachable over links of fingerprints that differ
    in ``radius`` or fewer bits, the row's own included. The nodes are the fingerprints
    themselves, so copies cost one row each and no pairs, and fingerprints that only rows
    with a null key have link others all the same. Keys are of any type that has an
    order. Rows with a null key get the component of their fingerprint but name none (null
    if all keys of the component are null); null and empty texts have fingerprint 0 and
    link like any other.
    """
    prints = staged(docs.select(F.col(key).alias("_key"), *carry, fingerprint(F.col(text), shingle=shingle).alias("fp")), "prints")
    nodes = staged(prints.groupBy("fp").agg(F.min("_key").alias("least")), "codes")
    edges = staged(linked_edges(nodes.select("fp"), radius=radius, split=split), "edges")
    labels = connected_components(edges).withColumnRenamed("node", "fp")
    classes = staged(nodes.join(labels, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "classes")
    named = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(classes.join(named, "root").select("fp", "component_id"), "fp").select(F.col("_key").alias(key), "fp", "component_id", *carry)


def keep_one(docs: DataFrame, *, text: str = "text", key: str = "doc_id", find=near_duplicates, **how) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: the one with the smallest key.

    Of rows that repeat in key and text one stays. Groups in which every key is null have
    no smallest; of their rows those with different texts stay. Texts are shuffled once,
    by a hash of key and text. ``find`` names the groups, as :func:`near_duplicates` does.
    Other columns, of any name, stay as they are.
    """
    mark, place = unused(docs, "_mark", "_place")
    marked = docs.withColumn(mark, F.xxhash64(F.col(key), F.col(text)))
    found = find(marked, text=text, key=key, carry=(mark,), **how)
    kept = found.where(F.col(key).eqNullSafe(F.col("component_id"))).select(mark).distinct()
    first = F.row_number().over(Window.partitionBy(mark).orderBy(F.col(key)))
    return marked.join(kept, mark, "left_semi").withColumn(place, first).where(F.col(place) == 1).select(*docs.columns)


def hex_print(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
