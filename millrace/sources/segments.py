"""Readers of key-value stores' own files: record logs (segments and write-ahead logs) and sorted tables.

Fixed values, all numbers little-endian:
record log: CRC-32 of what follows (4 bytes), type (1: 0 put, 1 delete), key length (4), value length (4), key, value;
sorted table: data records (key length, key, value length, value, type; lengths as base-128 varints), an index, a
Bloom filter, and a footer of 48 bytes: the magic, then index offset, index length, filter offset, filter length, count.

A file is one task's work; stores keep their files to some MB. Spark lists and reads them, so they may lie anywhere.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER, HEADER_SIZE = "<IBII", 13
MOST_KEY, MOST_VALUE = 1 << 16, 1 << 30
MAGIC = b"DIALSM01"
FOOTER, FOOTER_SIZE = "<8sQQQQQ", 48
RECORDS = "file string, offset long, key binary, value binary, is_delete boolean"


class CorruptFile(ValueError):
    """Damage that isn't the torn end of the newest log."""


def encode_record(key: bytes, value: bytes | None) -> bytes:
    """A log record; no value is a delete."""
    body = struct.pack(HEADER, 0, value is None, len(key), len(value or b""))[4:] + key + (value or b"")
    return struct.pack("<I", zlib.crc32(body)) + body


def decode_log(data: bytes, newest: bool) -> Iterator[tuple[int, bytes, bytes | None, bool]]:
    """(offset, key, value, is_delete) of each record. A torn record ends the newest log and is an error in another; a
    record whose frame is whole and whose sum is wrong is an error in any."""
    at = 0
    while at < len(data):
        whole = at + HEADER_SIZE <= len(data)
        crc, kind, n_key, n_value = struct.unpack_from(HEADER, data, at) if whole else (0, 0, 0, 0)
        end = at + HEADER_SIZE + n_key + n_value
        if not whole or n_key > MOST_KEY or n_value > MOST_VALUE or end > len(data):
            if newest:
                return
            raise CorruptFile(f"torn record at {at} in a sealed log")
        if zlib.crc32(data[at + 4 : end]) != crc or kind > 1:
            raise CorruptFile(f"damaged record at {at}")
        split = at + HEADER_SIZE + n_key
        yield at, data[at + HEADER_SIZE : split], None if kind else data[split:end], bool(kind)
        at = end


def read_log(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Records of all logs under `path` whose names fit: file, offset, key, value, is_delete.

    Names order the logs, the last is the newest. With `live(records, "key", ["file", "offset"])` this recovers a store.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    newest = files.agg(F.max("path")).first()[0]

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, data in zip(frame.path, frame.content):
                rows = [(file, *r) for r in decode_log(data, file == newest)]
                yield pd.DataFrame(rows, columns=["file", "offset", "key", "value", "is_delete"])

    return files.select("path", "content").mapInPandas(run, RECORDS)


def varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        if at >= len(data):
            raise CorruptFile("a number runs past the end")
        b = data[at]
        n |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return n, at


def encode_varint(n: int) -> bytes:
    out = bytearray()
    while n >= 128:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def decode_table(data: bytes) -> Iterator[tuple[int, bytes, bytes | None, bool]]:
    """(offset, key, value, is_delete) of a sorted table, in key order."""
    if len(data) < FOOTER_SIZE:
        raise CorruptFile("no footer")
    magic, index_at, _, _, _, count = struct.unpack_from(FOOTER, data, len(data) - FOOTER_SIZE)
    if magic != MAGIC or index_at > len(data):
        raise CorruptFile("not a sorted table")
    at = n = 0
    while at < index_at:
        start = at
        size, at = varint(data, at)
        key, at = data[at : at + size], at + size
        size, at = varint(data, at)
        value, at = data[at : at + size], at + size
        if at >= index_at:
            raise CorruptFile(f"a record at {start} runs past the data")
        gone = data[at] == 1
        at, n = at + 1, n + 1
        yield start, key, None if gone else value, gone
    if n != count:
        raise CorruptFile(f"{n} records where the footer says {count}")


def read_tables(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Records of all sorted tables under `path` whose names fit: file, offset, key, value, is_delete."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, data in zip(frame.path, frame.content):
                yield pd.DataFrame([(file, *r) for r in decode_table(data)], columns=["file", "offset", "key", "value", "is_delete"])

    return files.select("path", "content").mapInPandas(run, RECORDS)
