"""Number, hash and text-similarity functions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def hash_bucket(c: Column, buckets: int = 10) -> Column:
    """First eight hex digits of the SHA-256 as a number, modulo buckets: the same in every engine."""
    return F.conv(F.substring(F.sha2(c, 256), 1, 8), 16, 10).cast("long") % buckets


def bucket_split(c: Column) -> Column:
    b = hash_bucket(c)
    return F.when(b == 0, F.lit("test")).when(b == 1, F.lit("validation")).otherwise(F.lit("train"))


def shuffle_key(seed: int | Column, *parts: Column) -> Column:
    s = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.sha2(F.concat_ws(":", s, *parts), 256)


def share(part: Column, whole: Column, digits: int = 4) -> Column:
    """Half-even rounded share; 0 where there is nothing."""
    return F.bround(F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0)), digits)


def round_away(c: Column, digits: int = 4) -> Column:
    """Rounded half away from zero; share() rounds half to even."""
    return F.round(c, digits)


def sublinear_tf(n: Column) -> Column:
    return 1 + F.log(n)


def smooth_idf(docs: Column, df: Column) -> Column:
    return F.log((1 + docs) / (1 + df)) + 1


def trigrams(c: Column) -> Column:
    """All character triples of a text; a shorter text is its own gram."""
    n = F.length(c)
    return F.when(n < 3, F.array(c)).otherwise(F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substring(c, i, 3)))


def multiset_overlap(a: Column, b: Column) -> Column:
    """Size of the intersection of two arrays as multisets."""
    count = lambda xs, v: F.size(F.filter(xs, lambda x: x == v))
    return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda acc, v: acc + F.least(count(a, v), count(b, v)))


def chrf(reference: Column, candidate: Column) -> Column:
    """F1 of character triples."""
    a, b = trigrams(reference), trigrams(candidate)
    both = multiset_overlap(a, b)
    p, r = both / F.size(b), both / F.size(a)
    return F.when((p + r) > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def sequence_ratio(a: Column, b: Column) -> Column:
    """Ratio of matching blocks; no built-in computes it."""

    @F.pandas_udf(T.DoubleType())
    def ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        import difflib

        for x, y in batches:
            yield pd.Series([None if p is None or q is None else difflib.SequenceMatcher(None, p, q).ratio() for p, q in zip(x, y)], dtype="float64")

    return ratio(a, b)


def confidence(p: Column) -> Column:
    return F.format_string("confidence=%.2f", p)
