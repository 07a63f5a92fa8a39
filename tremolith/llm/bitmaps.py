"""Bitmaps of fixed size over 64-bit keys: which keys may be in a set.

They save shuffling and fix an order; a false hit never decides a result.  A
bitmap takes 8 MB whatever the input, packed by zstandard while it is sent; when
it fills up, only work is lost.
"""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialise

#: log2 of the bits, and of those in one row that the driver reads.
BITS, ROW_BITS = 26, 15


def bitmap_of(keys: DataFrame, column: str = "key") -> bytes:
    """The bits that the low BITS bits of each key name; at most 2 ** (BITS - ROW_BITS)
    rows of 4 KB go by the driver."""
    h = F.col(column).bitwiseAND(F.lit((1 << BITS) - 1))
    rows = keys.groupBy(F.shiftright(h, ROW_BITS).alias("w")).agg(F.bitmap_construct_agg(h.bitwiseAND(F.lit((1 << ROW_BITS) - 1))).alias("bits"))
    return assembled(rows)


def assembled(rows: DataFrame) -> bytes:
    """The bitmap out of its rows ``w, bits``."""
    whole = np.zeros(1 << (BITS - 3), np.uint8)
    step = 1 << (ROW_BITS - 3)
    for row in rows.select("w", "bits").collect():  # one job, where an iterator takes one a partition
        whole[row["w"] * step : row["w"] * step + len(row["bits"])] = np.frombuffer(row["bits"], np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(whole)


def unpacked(bits: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(bits), np.uint8)


def hits(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of some uint64 keys have their bit set."""
    at = (keys & np.uint64((1 << BITS) - 1)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def marked(df: DataFrame, key: Column, keys: DataFrame, column: str = "key") -> DataFrame:
    """``df`` with ``near``: whether its key's bit is one of those of ``keys``.  In SQL,
    by the words of the bitmap: at most 2 ** (BITS - ROW_BITS) rows of 4 KB."""
    bit = lambda h: h.bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    word = lambda h: F.shiftright(h.bitwiseAND(F.lit((1 << BITS) - 1)), ROW_BITS)
    words = materialise(keys.groupBy(word(F.col(column)).alias("_word")).agg(F.bitmap_construct_agg(bit(F.col(column))).alias("_bits")), "bitmap")
    met = df.withColumn("_key", key).join(F.broadcast(words), word(F.col("_key")) == F.col("_word"), "left").withColumn("_bit", bit(F.col("_key")))
    near = F.expr("coalesce(getbit(cast(conv(hex(substring(_bits, cast(_bit div 8 as int) + 1, 1)), 16, 10) as int), cast(_bit % 8 as int)) = 1, false)")
    return met.withColumn("near", near).drop("_key", "_bit", "_word", "_bits")
