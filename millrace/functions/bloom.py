"""Bloom filters over string keys: partial filters per task, merged by OR, probed in Arrow batches.

For joins Spark builds its own runtime filters; this one is for filters that are stored beside data files.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.hashing import fnv1a64

BITS_PER_KEY, PROBES = 10, 7


def filter_bits(keys: int, bits_per_key: int = BITS_PER_KEY) -> int:
    """Size of a filter in bits, a multiple of 64."""
    return max(64, -(-keys * bits_per_key // 64) * 64)


def positions(keys: list[bytes], bits: int, probes: int = PROBES) -> np.ndarray:
    """Bit positions of each key by double hashing: its 64-bit hash, and that hash turned by 31 bits as the step."""
    h = fnv1a64(keys)
    step = (h >> np.uint64(33)) | (h << np.uint64(31))
    with np.errstate(over="ignore"):
        return (h[:, None] + np.arange(probes, dtype=np.uint64)[None, :] * step[:, None]) % np.uint64(bits)


def build(keys: DataFrame, key_col: str, expected: int) -> bytes:
    """A filter of all keys. Its size is fixed by `expected`, so partial filters of that size are all that moves."""
    bits = filter_bits(expected)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros(bits, bool)
        for frame in frames:
            out[positions([k.encode() for k in frame[key_col].dropna()], bits).ravel()] = True
        at = np.flatnonzero(np.packbits(out, bitorder="little"))
        yield pd.DataFrame({"at": at, "byte": np.packbits(out, bitorder="little")[at].astype(np.int32)})

    merged = keys.select(key_col).mapInPandas(run, "at long, byte int").groupBy("at").agg(F.bit_or("byte").alias("byte"))
    packed = np.zeros(bits // 8, np.uint8)
    for r in merged.toLocalIterator():
        packed[r["at"]] = r["byte"]
    return packed.tobytes()


def may_contain(bloom: bytes, key: Column) -> Column:
    """Whether a key may be among those of the filter; never false for one that is."""

    @F.pandas_udf("boolean")
    def probe(keys: pd.Series) -> pd.Series:
        bits = np.unpackbits(np.frombuffer(bloom, np.uint8), bitorder="little").astype(bool)
        return pd.Series(bits[positions([k.encode() for k in keys.fillna("")], len(bits))].all(1)) & keys.notna()

    return probe(key)
