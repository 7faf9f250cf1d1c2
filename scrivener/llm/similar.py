"""SimHash near-duplicates at a wide radius: texts as alike as 4/5 of their word shingles.

At that similarity fingerprints differ in 15 % of their bits, so no run of a 64-bit
fingerprint both selects and is sure to agree. Fingerprints have 256 bits here, and the
upper nodes of the Gray-order index are keyed by min-hash bands of the shingle set instead
of masked bits; below them the index is searched as in :mod:`.simhash`, and pairs within the
radius are decided on the shingle sets themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, staged
from .graph import connected_components
from .simhash import GrayIndex, simhash

#: Words of a shingle; texts are linked if their sets have 4/5 of their union in common.
SHINGLE = 5
#: 64-bit words of a fingerprint, and differing bits allowed: at 4/5 they are 39 of 256, with a deviation of 6.
PRINT_WORDS, PRINT_RADIUS = 4, 72
#: Bands and hashes a band: two sets at 4/5 share none with probability 3e-7.
BANDS, BAND_HASHES = 21, 3
#: The partners of one text are compared in as many tasks.
SALTS = 16
#: Bands of more sets than this are split: by chance where sets ask for their centre only, else by a second band.
HOT_BAND = 2000

_rng = np.random.default_rng(20240307)
_XOR = _rng.integers(0, 2**63, BANDS * BAND_HASHES, dtype=np.uint64)
_ODD = _rng.integers(0, 2**63, BANDS * BAND_HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD = _rng.integers(0, 2**63, BAND_HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles, A-Z lower-cased; with fewer words all are one shingle."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)))) if len(words) > shingle else [b" ".join(words)] if words else []
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), np.uint64))


def wide_print(hashes: np.ndarray) -> np.ndarray:
    """SimHash of ``PRINT_WORDS`` words; the first is the plain SimHash of the hashes."""
    return np.array([simhash(hashes if i == 0 else (hashes ^ (hashes >> np.uint64(29))) * _ODD[i] ^ (hashes >> np.uint64(17))) for i in range(PRINT_WORDS)], np.uint64)


def bands(hashes: np.ndarray) -> np.ndarray:
    """A hash for each band: of the least ones of ``BAND_HASHES`` orders of the set."""
    least = np.full(len(_XOR), ~np.uint64(0))
    for at in range(0, len(hashes), 2048):
        least = np.minimum(least, ((hashes[None, at : at + 2048] ^ _XOR[:, None]) * _ODD[:, None]).min(axis=1))
    h = (least.reshape(BANDS, BAND_HASHES) * _FOLD).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
    return (h ^ (h >> np.uint64(32))) * _FOLD[0]


def described(text: Column) -> Column:
    """Struct of ``sig`` (hash of the shingle set, 0 for none), ``n``, ``fp``, ``odd`` and ``bands`` (none for 0 shingles).

    ``odd`` has a bit for each of 512 classes of hashes, set where the count is odd: sets
    differ in as many hashes as bits, or more.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for t in batch:
                s = shingle_set(t)
                odd = np.packbits(np.bincount((s & np.uint64(511)).astype(np.int64), minlength=512) & 1 > 0)
                sig = (xxhash.xxh64_intdigest(s.tobytes()) or 1) if len(s) else 0
                rows.append((np.uint64(sig).astype(np.int64), len(s), wide_print(s).view(np.int64), odd.view(np.int64), (bands(s) if len(s) else s).view(np.int64)))
            yield pd.DataFrame(rows, columns=["sig", "n", "fp", "odd", "bands"])

    return F.pandas_udf(run, "sig long, n long, fp array<long>, odd array<long>, bands array<long>")(text)


def _table(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray] | None:
    """Columns of a partition, sorted by (h, sig), without the groups of one row."""
    held = list(batches)
    if not held or not (t := pa.Table.from_batches(held)).num_rows:
        return None
    cols = {}
    for name in t.column_names:
        c = t.column(name).combine_chunks()
        cols[name] = c.flatten().to_numpy().view(np.uint64).reshape(len(c), -1) if pa.types.is_list(c.type) else c.to_numpy()
    order = np.lexsort((cols["sig"], cols["h"]))
    h = cols["h"][order]
    alone = np.r_[True, h[1:] != h[:-1]] & np.r_[h[1:] != h[:-1], True]
    return {c: x[order[~alone]] for c, x in cols.items()}


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, sig) of bands that several sets have."""
    if (cols := _table(batches)) is not None:
        yield pa.RecordBatch.from_arrays([pa.array(cols[c]) for c in ("h", "sig")], names=["h", "sig"])


def _centres(group: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Of each group (sorted) the place of the code that is nearest to the bits that most of its codes have."""
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    out = starts.copy()
    for i, (lo, hi) in enumerate(zip(starts.tolist(), [*starts[1:].tolist(), len(group)])):
        if hi - lo > 2:
            ones = np.zeros(codes.shape[1] * 64, np.int64)
            for at in range(lo, hi, 1 << 14):
                ones += np.unpackbits(codes[at : min(at + (1 << 14), hi)].view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
            most = np.packbits(2 * ones > hi - lo).view(np.uint64)
            out[i] = lo + int(np.bitwise_count(codes[lo:hi] ^ most).sum(axis=1, dtype=np.int64).argmin())
    return out


def _pairs(star: bool):
    """Pairs (a, b, bits apart) of a band's sets within the radius that sizes and odd bits allow and that have unlike roots.

    With ``star`` ``a`` is the set in the middle of its band, else any. Without it, sets of
    a band's most common root ask for nothing, since in each pair of unlike roots at least
    one set has another.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (cols := _table(batches)) is None or not len(cols["h"]):
            return
        group = np.cumsum(np.r_[0, cols["h"][1:] != cols["h"][:-1]])
        root, size = np.unique(np.stack([group, cols["root"]]), axis=1, return_inverse=True, return_counts=True)[1:]
        root = root.ravel()
        roots = np.bincount(group[np.unique(root, return_index=True)[1]], minlength=group[-1] + 1)
        mixed = roots[group] > 1  # bands of one root have nothing to tell
        if not mixed.any():
            return
        cols, group, root = {c: x[mixed] for c, x in cols.items()}, group[mixed], root[mixed]
        if star:
            asks = np.zeros(len(group), bool)
            asks[_centres(group, cols["fp"])] = True
        else:
            most = np.zeros(group[-1] + 1, np.int64)
            np.maximum.at(most, group, size[root])
            top = np.full(len(most), len(size))
            np.minimum.at(top, group, np.where(size[root] == most[group], root, len(size)))
            asks = root != top[group]
        index = GrayIndex(group, cols["fp"])
        at = {c: x[index.order] for c, x in cols.items()}
        sig, n, odd, root = (at[c] for c in ("sig", "n", "odd", "root"))
        out, held = [], 0

        def batch() -> pa.RecordBatch:
            a, b, d = np.unique(np.concatenate(out, axis=1), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(d)], names=["a", "b", "d"])

        for i, j in index.near(np.flatnonzero(asks[index.order]), PRINT_RADIUS, 64):
            ok = (sig[i] != sig[j]) & (root[i] != root[j]) & (5 * np.minimum(n[i], n[j]) >= 4 * np.maximum(n[i], n[j]))
            i, j = i[ok], j[ok]
            ok = 9 * np.bitwise_count(odd[i] ^ odd[j]).sum(axis=1, dtype=np.int64) <= n[i] + n[j]
            i, j = i[ok], j[ok]
            a, b = sig[i], sig[j]
            if not star:
                a, b = np.minimum(a, b), np.maximum(a, b)
            out.append(np.stack([a, b, np.bitwise_count(index.codes[i] ^ index.codes[j]).sum(axis=1, dtype=np.int64)]))
            held += len(a)
            if held > 500_000:
                yield batch()
                out, held = [], 0
        if held:
            yield batch()

    return run


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) that are as alike as asked, from rows sorted by (a, salt): first the text of ``a`` (null ``b``), then those of its partners."""
    key, own = None, None
    for batch in batches:
        found: tuple[list[int], list[int]] = ([], [])
        for a, salt, b, text in zip(*(batch.column(c).to_pylist() for c in ("a", "salt", "b", "text"))):
            s = shingle_set(text)
            if b is None:
                key, own = (a, salt), s
            elif key == (a, salt):
                common = len(np.intersect1d(own, s, assume_unique=True))
                if 9 * common >= 4 * (len(own) + len(s)):
                    found[0].append(a), found[1].append(b)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["a", "b"])


def near_duplicates(docs: DataFrame, *, text: str, key: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows ``(key, component_id)`` and ``carry``, one for each row of ``docs``: the smallest key reachable over similar texts.

    Two texts are linked if they have 4/5 of the union of their shingle sets in common.
    Texts with equal sets are one node; null, empty and wordless texts are one node of
    their own. Each set is first compared with the nearest of the sets in the middle of its
    bands, then, unless linked already, with the others of these, then with whatever else
    shares a band and is not linked yet, so a group of many near copies makes few pairs. Every pair within the radius that shares a band is
    decided on its sets: links are never wrong, and one in a million at most is lost. A band of over
    ``HOT_BAND`` sets that are not linked yet is split by a second band, so no task compares all of it; of pairs
    at 4/5 that share such a band, seven in a million share no second one.
    Rows with a null key get the component of their text but name none.
    """
    spark = docs.sparkSession
    seen = staged(docs.select(F.col(key).alias("_key"), *carry, F.xxhash64(text).alias("_of"), described(F.col(text)).alias("d")).select("_key", *carry, "_of", "d.*"), "described")
    one = staged(seen.groupBy("sig").agg(F.min("_key").alias("node"), F.min(F.struct("_of", "n", "fp", "odd", "bands")).alias("d")).select("sig", "node", "d.*"), "sets")
    rows = staged(one.select("sig", F.explode("bands").alias("h")).select("h", "sig").repartition("h").mapInArrow(_shared, "h long, sig long"), "shared")
    members = staged(one.select("sig", "_of", "n", "fp", "odd").join(rows.select("sig").distinct(), "sig", "left_semi"), "members")
    release(spark)

    crowded = staged(rows.groupBy("h").agg(F.count("*").alias("size")).where(F.col("size") > HOT_BAND), "crowded")

    def by_chance() -> DataFrame:
        """Bands, crowded ones in parts of about ``HOT_BAND`` sets; which sets come together differs from band to band."""
        part = F.pmod(F.xxhash64("sig", "h"), F.ceil(F.col("size") / HOT_BAND))
        return rows.join(crowded, "h", "left").select(F.when(F.col("size").isNotNull(), F.xxhash64("h", part)).otherwise(F.col("h")).alias("h"), "sig")

    def by_second_band(roots: DataFrame) -> DataFrame:
        """Bands that hold unlike roots, crowded ones split by each other band that their sets have."""
        rooted = rows.join(roots, "sig", "left").withColumn("root", F.coalesce("root", "sig"))
        mixed = rooted.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("h")
        open_ = staged(rows.join(mixed, "h", "left_semi"), "mixed")
        hot = open_.join(crowded.select("h"), "h", "left_semi").join(one.select("sig", F.explode("bands").alias("_other")), "sig").where("h <> _other")
        # a band of two crowded bands is the same from either side
        split = hot.select(F.xxhash64(F.least("h", "_other"), F.greatest("h", "_other")).alias("h"), "sig").distinct()
        return open_.join(crowded.select("h"), "h", "left_anti").union(split)

    def candidates(roots: DataFrame, star: bool) -> DataFrame:
        labelled = members.drop("_of").join(roots, "sig", "left").withColumn("root", F.coalesce("root", "sig"))
        wide = (by_chance() if star else by_second_band(roots)).join(labelled, "sig").select("h", "sig", "n", "fp", "odd", "root")
        return wide.repartition("h").mapInArrow(_pairs(star), "a long, b long, d long").distinct()

    def linked(pairs: DataFrame) -> DataFrame:
        # one text of each set in a pair; any other of equal set would do as well
        ends = pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct()
        named = members.select("sig", "_of").join(ends, "sig", "left_semi")
        own = docs.select(F.col(text).alias("_text")).withColumn("_of", F.xxhash64("_text"))
        texts = staged(own.join(named, "_of").groupBy("sig").agg(F.min("_text").alias("text")), "texts")
        release(spark)
        dealt = pairs.withColumn("salt", F.pmod("b", F.lit(SALTS)).cast("int"))
        firsts = dealt.select("a", "salt").distinct().join(texts.withColumnRenamed("sig", "a"), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "text")
        others = dealt.join(texts.withColumnRenamed("sig", "b"), "b").select("a", "salt", "b", "text")
        by = firsts.union(others).repartition("a", "salt").sortWithinPartitions("a", "salt", F.asc_nulls_first("b"))
        edges = staged(by.mapInArrow(_alike, "a long, b long"), "edges")
        release(spark)
        return edges

    def told(pairs: DataFrame, before: DataFrame | None) -> DataFrame:
        """Distinct pairs, the smaller first, without those compared before."""
        both = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        return staged(both if before is None else both.join(before, ["a", "b"], "left_anti"), "pairs")

    none = members.select("sig", F.col("sig").alias("root")).where("false")
    nearest = candidates(none, True).groupBy("b").agg(F.min_by("a", F.struct("d", "a")).alias("a"))
    compared, labels, near = None, none, None
    for pairs in (lambda: nearest, lambda: candidates(labels, True), lambda: candidates(labels, False)):
        new = told(pairs(), compared)
        found = linked(new)
        compared, near = (new, found) if near is None else (compared.union(new), near.union(found))
        labels = connected_components(near).withColumnRenamed("node", "sig")
    classes = staged(one.select("sig", "node").join(labels, "sig", "left").withColumn("root", F.coalesce("root", "sig")), "classes")
    least = classes.groupBy("root").agg(F.min("node").alias("component_id"))
    return seen.join(classes.join(least, "root").select("sig", "component_id"), "sig").select(F.col("_key").alias(key), "component_id", *carry)
