"""Hash functions for placement, as column expressions and, where 64 bits have to wrap, in numpy.

FNV-1a and the murmur3 finaliser are public algorithms; their constants are fixed values.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

FNV32_OFFSET, FNV32_PRIME = 2166136261, 16777619
FNV64_OFFSET, FNV64_PRIME = 14695981039346656037, 1099511628211
MURMUR_MIX = (2246822507, 3266489909)
MASK32 = 4294967295


def fnv1a32(key: Column) -> Column:
    """32-bit FNV-1a over the UTF-8 bytes of a string, as a long; null stays null."""
    digits = F.hex(F.encode(key, "UTF-8"))
    positions = F.when(F.octet_length(key) > 0, F.sequence(F.lit(1), F.octet_length(key))).otherwise(F.array().cast("array<int>"))
    byte = lambda i: F.conv(F.substring(digits, 2 * i - 1, F.lit(2)), 16, 10).cast("long")
    step = lambda h, i: (h.bitwiseXOR(byte(i)) * FNV32_PRIME).bitwiseAND(F.lit(MASK32))
    return F.when(key.isNotNull(), F.aggregate(positions, F.lit(FNV32_OFFSET), step))


def times32(h: Column, factor: int) -> Column:
    """Low 32 bits of a product, by halves so that no 64-bit product overflows."""
    low, high = h.bitwiseAND(F.lit(65535)), F.shiftright(h, 16)
    return (low * factor + (high * factor).bitwiseAND(F.lit(65535)) * 65536).bitwiseAND(F.lit(MASK32))


def mix32(h: Column) -> Column:
    """The murmur3 finaliser on a 32-bit value held in a long."""
    h = h.bitwiseXOR(F.shiftright(h, 16))
    h = times32(h, MURMUR_MIX[0])
    h = h.bitwiseXOR(F.shiftright(h, 13))
    h = times32(h, MURMUR_MIX[1])
    return h.bitwiseXOR(F.shiftright(h, 16))


def ring_hash(key: Column) -> Column:
    """Position of a key on a hash ring."""
    return mix32(fnv1a32(key))


def fnv1a64(keys: list[bytes]) -> np.ndarray:
    """64-bit FNV-1a of many byte strings, one step per byte position for all of them."""
    out = np.full(len(keys), FNV64_OFFSET, np.uint64)
    sizes = np.array([len(k) for k in keys], np.int64)
    if len(keys) and sizes.max(initial=0):
        data = np.zeros((len(keys), sizes.max()), np.uint64)
        for row, k in zip(data, keys):
            row[: len(k)] = np.frombuffer(k, np.uint8)
        with np.errstate(over="ignore"):
            for i in range(data.shape[1]):
                out = np.where(sizes > i, (out ^ data[:, i]) * np.uint64(FNV64_PRIME), out)
    return out


@F.pandas_udf(T.LongType())
def fnv64_signed(keys: pd.Series) -> pd.Series:
    """64-bit FNV-1a of strings, as the signed long of the same bits."""
    return pd.Series(fnv1a64([k.encode() for k in keys.fillna("")]).view(np.int64))
