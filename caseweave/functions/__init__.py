"""Scalar column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance on a sphere of 6371 km."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return F.lit(2 * 6371.0) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def categorical_match(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b).cast("double")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 for two empty ones; nulls count as empty."""
    empty = F.array().cast("array<string>")
    a, b = F.coalesce(a, empty), F.coalesce(b, empty)
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.nullif(union, F.lit(0)))


def jaccard_of_sets(a: Column, b: Column) -> Column:
    """``jaccard`` of arrays that are not null and have no repeats: their sizes and one intersection are enough."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union == 0, 0.0).otherwise(common / F.nullif(union, F.lit(0)))


def as_set(a: Column) -> Column:
    """The array without repeats; empty for null."""
    return F.coalesce(F.array_distinct(a), F.array().cast("array<string>"))


def proximity(a: Column, b: Column, span: float) -> Column:
    return 1 - F.least(F.abs(a - b) / F.lit(float(span)), F.lit(1.0))


def day_gap(first: Column, second: Column) -> Column:
    """Whole days between two times, floored before the sign goes: 36 hours back are 2 days, forward 1."""
    return F.abs(F.floor((F.unix_timestamp(second) - F.unix_timestamp(first)) / 86400))


def word_overlap(a: Column, b: Column, stop_words: list[str]) -> Column:
    words = lambda c: F.array_distinct(F.array_except(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""), F.array(*[F.lit(w) for w in stop_words])))
    return jaccard(words(a), words(b))


def sorted_tokens(name: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(F.lower(F.trim(name)), r"\s+"), lambda w: w != "")), " ")


def token_sort_ratio(a: Column, b: Column) -> Column:
    """2 * longest common subsequence / total length of the names with their tokens sorted; 1 for two empty ones. JVM only; meant for blocked pairs.

    The row of the LCS table is folded over the letters of ``a``: an array of lengths, one for each prefix of ``b``.
    """
    x, y = sorted_tokens(a), sorted_tokens(b)
    letters = lambda s: F.filter(F.split(s, ""), lambda c: c != "")
    zero = F.transform(F.sequence(F.lit(0), F.length(y)), lambda _: F.lit(0))

    def row(above: Column, letter: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), F.greatest(F.length(y), F.lit(1))),
            F.array(F.lit(0)),
            lambda now, j: F.concat(now, F.array(F.when(F.substring(y, j, F.lit(1)) == letter, F.coalesce(F.get(above, j - 1), F.lit(0)) + 1).otherwise(F.greatest(F.coalesce(F.get(above, j), F.lit(0)), F.element_at(now, -1))))),
        )

    common = F.when(F.length(y) == 0, 0).otherwise(F.element_at(F.aggregate(letters(x), zero, row), -1))
    total = F.length(x) + F.length(y)
    return F.when(total == 0, 1.0).otherwise(2.0 * common / F.nullif(total, F.lit(0)))


def band(score: Column) -> Column:
    """CRITICAL from 80, HIGH from 60, MEDIUM from 40, LOW from 20, else MINIMAL."""
    return F.when(score >= 80, "CRITICAL").when(score >= 60, "HIGH").when(score >= 40, "MEDIUM").when(score >= 20, "LOW").otherwise("MINIMAL")
