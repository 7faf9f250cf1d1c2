"""Spelling variants: near words by a variable-length gram index, each word led to its commonest form.

1. Words are counted over whole texts, combined in each task before the shuffle.
2. A dictionary of grams of ``QMIN`` to ``QMAX`` code points is built from the words' own
   grams: a gram stays if the gram without its last code point is a frequent one, so rare
   grams stay short and frequent ones are told apart by what follows. Its size is bounded
   by the alphabet, not by the words.
3. A word is decomposed into positional grams: at each place the longest gram of the
   dictionary, unless an earlier one covers it.
4. For each place of an edit the grams that it cannot affect are known from the word
   alone: those before it that were chosen without looking at it, and those behind it that no
   gram from before could cover. Near words share all of those for the place where they
   differ, so the lists of these grams are merged: one equi-join on the merged gram lists.
   A word has at least one such gram for every place (:func:`affected_bound`), and few
   distinct lists.
5. Lists with more than ``LONG_LIST`` words are merged again with all code points outside
   the edit, which leaves a word at most as many partners a place as the alphabet has letters.
6. Candidates are verified by edit distance.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

QMIN, QMAX = 2, 3
#: A gram is extended if more than this share of the words have it (counting repeats in a word).
FREQUENT_SHARE = 0.001
#: Merged lists with more words than this are merged again with the rest of the word.
LONG_LIST = 64
#: Distinct words that a task counts before it sends them on.
HELD_WORDS = 400_000
#: A form occurs at least this many times as often as the word that it stands for.
FORM_RATIO = 5
START, END = "\x02", "\x03"
#: One byte a code point: letters of Latin-1 (A-Z in lower case), all else as white space.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def runs(text: str) -> list[bytes]:
    """The maximal runs ``[A-Za-z\\u00C0-\\u00FF]+`` of a text, A-Z in lower case, in Latin-1."""
    return text.encode("latin-1", "replace").translate(LETTERS).split()


def count_words(docs: DataFrame, *, text: str = "text", key: str = "doc_id", min_length: int = 6, misspell: int = 0) -> DataFrame:
    """Partial counts ``(word, n)`` of the letter runs of at least ``min_length`` code points of whole texts; a word has a row a task or more.

    With ``misspell`` = m the crc32 h of ``key:run`` (UTF-8) decides which runs lose a code
    point: where m divides h, the one at h modulo the run's length. Runs of a row with a null key lose none. Null
    texts have no words.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc, t in zip(batch.column(0), batch.column(1)):
                if (found := t.as_py()) is None:
                    continue
                own = doc.as_py()
                salt = zlib.crc32(f"{own}:".encode()) if misspell and own is not None else None
                for w, n in Counter(runs(found)).items():
                    if len(w) < min_length:
                        continue
                    if salt is not None:
                        h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), salt)
                        if h % misspell == 0:
                            k = h % len(w)
                            w = w[:k] + w[k + 1 :]
                            if len(w) < min_length:
                                continue
                    held[w] += n
                if len(held) >= HELD_WORDS:
                    yield sent()
                    held.clear()
        if held:
            yield sent()

    return docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")).mapInArrow(count, "word string, n long")


def gram_dictionary(words: DataFrame, *, word: str = "word", qmin: int = QMIN, qmax: int = QMAX, share: float = FREQUENT_SHARE) -> frozenset[str]:
    """Grams of ``qmin`` to ``qmax`` code points, those beyond ``qmin`` only where the gram without their last code point is frequent.

    Frequent are grams with more than ``share`` occurrences a word, counted over all words with
    a mark at either end, so there are at most (mean length / share) of them and the
    dictionary, which the driver gets, has at most as many times the alphabet entries.
    """
    marked = words.select(F.concat(F.lit(START), word, F.lit(END)).alias("p"))
    every = F.flatten(F.transform(F.sequence(F.lit(qmin), F.lit(qmax)), lambda q: F.transform(F.sequence(F.lit(1), F.greatest(F.length("p") - q + 1, F.lit(1))), lambda i: F.substr("p", i, q))))
    counts = staged(marked.select(F.explode(every).alias("gram")).groupBy("gram").count(), "grams")
    many = share * words.count()
    kept = counts.where(F.length("gram") == qmin).select("gram", "count")
    chosen = {r["gram"] for r in kept.select("gram").toLocalIterator()}
    for q in range(qmin + 1, qmax + 1):
        # at most (mean length / share) frequent grams
        stems = kept.where(F.col("count") > many).select(F.col("gram").alias("_stem"))
        kept = counts.where(F.length("gram") == q).join(F.broadcast(stems), F.expr(f"substr(gram, 1, {q - 1})") == F.col("_stem"), "left_semi")
        chosen |= {r["gram"] for r in kept.select("gram").toLocalIterator()}
    return frozenset(chosen)


def decompose(p: str, grams: frozenset[str], qmin: int = QMIN, qmax: int = QMAX) -> list[tuple[int, int, int]]:
    """(first, last, seen) of the positional grams of a marked word.

    ``seen`` is the last place that was looked at to choose this gram and all before it.
    """
    out, seen, covered = [], -1, -1
    for at in range(len(p) - qmin + 1):
        end = at + qmin
        while end < at + qmax and end < len(p) and p[at : end + 1] in grams:
            end += 1
        seen = max(seen, min(end, at + qmax - 1, len(p) - 1))
        if end - 1 > covered:
            covered = end - 1
            out.append((at, covered, seen))
    return out


def unaffected(word: str, grams: frozenset[str], qmin: int = QMIN, qmax: int = QMAX) -> list[tuple[str, int, int, tuple]]:
    """(role, first place, last place, merged list) for each distinct set of grams that an edit leaves as they are.

    Roles: ``m`` the code point at the place is replaced or missing, ``i`` one is inserted
    before it. A word and its near word have an equal list for the place where they differ: of words of
    one length each has it under ``m``, else the longer one under ``m`` and the shorter under ``i``.
    """
    p = START + word + END
    size, found = len(p), decompose(p, grams, qmin, qmax)
    left = [0] * (size + 1)  # grams chosen without looking at place i or beyond
    for i in range(1, size + 1):
        left[i] = left[i - 1]
        while left[i] < len(found) and found[left[i]][2] < i:
            left[i] += 1
    out = []
    for role, stop, shift in (("m", size - 1, 0), ("i", size, 1)):
        longer, right, before = size + shift, 0, None
        for i in range(1, stop):
            # behind the edit, and ending where no gram from before it can reach
            while right < len(found) and (found[right][0] < i + 1 - shift or found[right][1] <= i + qmax - 1 - shift):
                right += 1
            if (left[i], right) == before:
                out[-1][2] = i
                continue
            before = (left[i], right)
            merged = (longer, tuple((a, p[a : e + 1]) for a, e, _ in found[: left[i]]), tuple((size - a, p[a : e + 1]) for a, e, _ in found[right:]))
            out.append([role, i, i, merged])
    return [tuple(x) for x in out]


def affected_bound(word: str, grams: frozenset[str], qmin: int = QMIN, qmax: int = QMAX) -> tuple[int, int]:
    """(number of grams of a word, how many of them one edit affects at most); near words share at least the difference."""
    n = len(decompose(START + word + END, grams, qmin, qmax))
    return n, max(n - len(m[1]) - len(m[2]) for _, _, _, m in unaffected(word, grams, qmin, qmax))


def _lists(words: DataFrame, grams: frozenset[str]) -> DataFrame:
    """The merged lists: a row for each word and list, ``(list, role, lo, hi, word)``; ``list`` is a 64-bit hash, as equal ones are verified."""
    names = ["list", "role", "lo", "hi", "word"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                out = [(xxhash.xxh64_intdigest(repr(merged)) - (1 << 63), role, lo, hi, w) for w in batch.column(0)[at : at + 2000].to_pylist() for role, lo, hi, merged in unaffected(w, grams)]
                columns = zip(*out) if out else ([],) * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string()))], names=names)

    # a task gets as many words as another, however few files they lie in
    spread = words.select("word").repartition(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), "word")
    return spread.mapInArrow(run, "list long, role string, lo int, hi int, word string")


def near_pairs(words: DataFrame, grams: frozenset[str]) -> DataFrame:
    """All pairs ``(a, b)``, once each, of distinct ``words`` that one inserted, deleted or replaced code point tells apart."""
    lists = staged(_lists(words, grams), "lists")
    long_ = lists.groupBy("list").count().where(F.col("count") > LONG_LIST).select("list")
    short = lists.join(long_, "list", "left_anti").select("list", "role", "word")
    at = lists.join(long_, "list", "left_semi").select("list", "role", "word", F.explode(F.sequence("lo", "hi")).alias("at"))
    behind = F.col("at") + F.when(F.col("role") == "i", 0).otherwise(1)
    split = at.select(F.xxhash64("list", "at", F.substr("word", F.lit(1), F.col("at") - 1), F.lit("|"), F.substr("word", behind)).alias("list"), "role", "word")
    merged = staged(short.union(split), "merged")
    one = merged.where("role = 'm'").select("list", F.col("word").alias("a"))
    other = merged.select("list", "role", F.col("word").alias("b"))
    fits = (F.col("role") == "i") | (F.col("a") < F.col("b"))
    return one.join(other, "list").where(fits & (F.levenshtein("a", "b", 1) == 1)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def last_forms(forms: DataFrame) -> DataFrame:
    """``(word, root)`` for each row ``(word, form)``: where following forms ends. Forms grow by a factor, so chains are short."""
    roots = staged(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        jumped = staged(roots.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        roots = jumped.select("word", "root")
        if jumped.where("_moved").isEmpty():
            return roots


def group_variants(counts: DataFrame, *, word: str = "word", n: str = "n", min_count: int = 5, ratio: int = FORM_RATIO) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` for each distinct word of ``counts`` with at least ``min_count`` occurrences.

    Counts of repeated words are added up; null words are left out. ``n_near`` counts the words at one
    edit; ``form`` is the one of largest n (ties: smallest in code-point order) if its n is
    at least ``ratio`` times the word's, else null; ``root`` is where following forms ends,
    the word itself if it has none. An empty table gives an empty table.
    """
    total = counts.where(F.col(word).isNotNull()).groupBy(F.col(word).alias("word")).agg(F.sum(n).cast("long").alias("n"))
    words = staged(total.where(F.col("n") >= min_count), "words")
    pairs = staged(near_pairs(words, gram_dictionary(words)), "pairs")
    both = pairs.union(pairs.select("b", "a"))
    near = both.join(words.select(F.col("word").alias("b"), F.col("n").alias("m")), "b").groupBy(F.col("a").alias("word"))
    best = near.agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "b")).alias("_best"))
    found = words.join(best, "word", "left")
    is_form = -F.col("_best.m") >= ratio * F.col("n")
    found = staged(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("_best.b")).alias("form"), F.when(is_form, -F.col("_best.m")).alias("form_n")), "forms")
    roots = last_forms(found.where("form is not null").select("word", "form"))
    return found.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def oracle(misspell: int = 199, min_length: int = 6, min_count: int = 5, ratio: int = FORM_RATIO) -> str:
    """The same over ``documents`` in DuckDB SQL: crc32 bit by bit, near words by the words without one code point."""
    bits = "flatten(list_transform(range(0, octet_length(encode(s))), lambda i: [('0x' || substr(hex(encode(s)), 2 * i + 1, 2))::BIGINT, 0, 0, 0, 0, 0, 0, 0]))"
    step = "lambda c, b: xor(xor(c, b) >> 1, (xor(c, b) & 1) * 3988292384)"
    return f"""
WITH RECURSIVE runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS r FROM documents),
 own AS (SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r, count(*) AS n FROM runs WHERE length(r) >= {min_length} GROUP BY ALL),
 h AS (SELECT r, n, xor(list_reduce(list_prepend(4294967295::BIGINT, {bits}), {step}), 4294967295::BIGINT) AS h FROM (SELECT r, n, doc_id || ':' || r AS s FROM own)),
 cut AS (SELECT CASE WHEN h % {misspell} = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, n FROM h),
 words AS (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= {min_length} GROUP BY 1 HAVING sum(n) >= {min_count}),
 less AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM words, unnest(range(1, length(word) + 1)) u(i)),
 pairs AS (SELECT a.word AS a, b.word AS b, b.n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
   UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
 near AS (SELECT a AS word, count(*) AS n_near, max(n) AS m FROM pairs GROUP BY 1),
 best AS (SELECT a AS word, min(b) AS b FROM pairs JOIN near ON a = near.word AND pairs.n = m GROUP BY 1),
 found AS (SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= {ratio} * n THEN b END AS form, CASE WHEN m >= {ratio} * n THEN m END AS form_n
   FROM words LEFT JOIN near USING (word) LEFT JOIN best USING (word)),
 walk AS (SELECT word, form AS root FROM found WHERE form IS NOT NULL UNION ALL SELECT walk.word, form FROM walk JOIN found ON walk.root = found.word WHERE form IS NOT NULL),
 ends AS (SELECT walk.word, root FROM walk JOIN found ON root = found.word WHERE form IS NULL)
SELECT found.*, coalesce(root, word) AS root FROM found LEFT JOIN ends USING (word)"""
