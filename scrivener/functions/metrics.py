"""Measures of readings against truths, and safe arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as a double, null if whole is 0."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def percent(part: Column, whole: Column) -> Column:
    return ratio(100 * part, whole)


def f1(precision: Column, recall: Column) -> Column:
    """Null if either is null, 0 if either is 0."""
    return F.when((precision == 0) | (recall == 0), F.lit(0.0)).otherwise(2 * precision * recall / (precision + recall))


def word_distance(a: Column, b: Column) -> Column:
    """Edit distance over two arrays of words: each word is written as one symbol, then Levenshtein."""
    vocabulary = F.array_distinct(F.concat(a, b))
    wide = lambda w: F.decode(F.unhex(F.lpad(F.hex(F.array_position(vocabulary, w) + 0x4E00), 4, "0")), "UTF-16BE")
    write = lambda ws: F.array_join(F.transform(ws, wide), "")
    return F.levenshtein(write(a), write(b))


def words(c: Column) -> Column:
    return F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")


def cer(truth: Column, reading: Column) -> Column:
    """Character error rate; null for an empty truth."""
    return ratio(F.levenshtein(truth, reading), F.length(truth))


def wer(truth: Column, reading: Column) -> Column:
    """Word error rate; null for a truth without words."""
    return ratio(word_distance(words(truth), words(reading)), F.size(words(truth)))


def accuracy_percent(error_rate: Column) -> Column:
    """100 less the error rate, kept between 0 and 100; null for none."""
    return F.when(error_rate.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 * (1 - error_rate))))


def char_accuracy(truth: Column, reading: Column) -> Column:
    """Character accuracy %; an empty truth scores 100 for an empty reading, else 0."""
    return F.when(truth == "", F.when(reading == "", 100.0).otherwise(0.0)).otherwise(accuracy_percent(cer(truth, reading)))


def piece_similarity(truth: Column, reading: Column, min_length: int = 8) -> Column:
    """Best 100 * (1 - CER) of the reading against any stretch of the truth of its length; null if it is shorter than ``min_length``."""
    n, m = F.length(truth), F.length(reading)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), n - m + 1))
    best = F.array_max(F.transform(starts, lambda i: accuracy_percent(ratio(F.levenshtein(F.substring(truth, i, m), reading), F.least(n, m)))))
    return F.when(m >= min_length, best)


def sus(answers: Column) -> Column:
    """System usability score of ten answers 1 to 5: odd ones less 1, even ones from 5, times 2.5."""
    points = F.transform(answers, lambda x, i: F.when(i % 2 == 0, x - 1).otherwise(5 - x))
    return F.aggregate(points, F.lit(0.0), lambda a, x: a + x) * 2.5
