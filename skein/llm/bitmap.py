"""Bitmaps of fixed size: they keep rows out of a shuffle and never lose one that is needed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.runtime import ship

#: The bitmaps have 2**BITS bits (2 MB).
BITS = 24


def slot(c: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(c), 64 - BITS)


def bitmap(slots: DataFrame) -> np.ndarray:
    """Bitmap of a column `slot`: at most 2**BITS / 64 words come to the driver, whatever the size of the data."""
    word = slots.groupBy(F.shiftright("slot", 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("slot").bitwiseAND(F.lit(63)).cast("int"))).alias("b"))
    rows = word.toPandas()
    out = np.zeros(1 << (BITS - 6), np.int64)
    out[rows["w"].to_numpy(np.int64)] = rows["b"].to_numpy(np.int64)
    return out.view(np.uint64)


def in_bitmap(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Whether each slot's bit is set."""
    s = slots.astype(np.int64)
    return (bits[s >> 6] >> (s & 63).astype(np.uint64)) & np.uint64(1) == 1


def rows_with(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among ids (distinct); the bitmap keeps most of the others out of the shuffle."""
    load = ship(rows.sparkSession, bitmap(ids.select(slot(F.col(key)).alias("slot"))))

    @F.pandas_udf(T.BooleanType())
    def held(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bits = load()
        for s in batches:
            yield pd.Series(in_bitmap(bits, s.to_numpy(np.int64)))

    return rows.where(held(slot(F.col(key)))).join(ids, key, "left_semi")
