"""Bitmaps of fixed size over 64-bit keys: what a map may drop before an exchange, never what decides."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 26       #: log2 of the bits: 8 MB, whatever the table


def bitmap(df: DataFrame, key: Column, bits: int = BITS) -> np.ndarray:
    """Bytes of a bitmap with the bits ``key mod 2**bits`` set."""
    at = F.pmod(key, F.lit(1 << bits)) + 1
    rows = (df.select(F.bitmap_bucket_number(at).alias("b"), F.bitmap_bit_position(at).alias("p"))
            .groupBy("b").agg(F.bitmap_construct_agg("p").alias("m")).collect())
    out = np.zeros(max(1 << (bits - 3), 4096), np.uint8)
    for r in rows:
        out[(r["b"] - 1) * 4096:r["b"] * 4096] = np.frombuffer(r["m"], np.uint8)
    return out


def in_bitmap(sieve: np.ndarray, keys: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Which of the unsigned keys have their bit set."""
    at = keys & np.uint64((1 << bits) - 1)
    return (sieve[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1
