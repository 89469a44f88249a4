"""Near-duplicate documents by SimHash and covering locality-sensitive hashing.

Each of the 64 bit positions has a non-zero vector of 4 bits, and each of the 15 non-zero vectors v of 4 bits gives a
table whose mask holds the positions with an odd product with v. Up to 3 positions span a space of at most 3
dimensions, so some v is orthogonal to all of theirs: fingerprints that differ in 3 bits or fewer agree under that mask
and share a bucket. No pair is missed.

Buckets are over distinct fingerprints, so copies cost nothing. One of up to `most_in_bucket` fingerprints is searched
by comparing all, giving a forest of links rather than all pairs. In a larger one each fingerprint names the points
within 2 bits of it among the positions outside the mask; a point links every fingerprint that named it to the
least within 1 bit of it. Two fingerprints at distance 3 or less share such a point, and two that share one are at
distance 3 or less, so this is exact too, and its cost grows in proportion to the fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.components import connected_components
from millrace.llm.scratch import few
from millrace.session import checkpoint_dir

BITS, RADIUS, SHINGLE_WORDS, SEED = 64, 3, 3, 42
MOST_IN_BUCKET, PLAIN_RUN = 8192, 32
SLICE_ROWS = 256

#: Position's vector: 1 to 15, in turn. MASKS[v - 1]: table v's positions.
VECTORS = [1 + i % (2 ** (RADIUS + 1) - 1) for i in range(BITS)]
MASKS = [sum(1 << i for i, m in enumerate(VECTORS) if bin(m & v).count("1") % 2) for v in range(1, 2 ** (RADIUS + 1))]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: bytes | None) -> int:
    """SimHash of the 3-word shingles of a text, repeats included, as an unsigned number."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(words, words[1:], words[2:])) if len(words) >= SHINGLE_WORDS else [b" ".join(words)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)
    n, step = len(hashes), 255  # sums of 255 bits fit a byte
    padded = np.zeros(-(-n // step) * step, np.uint64)
    padded[:n] = hashes
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(padded), step * 256):
        bits = np.unpackbits(padded[at : at + step * 256].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.reshape(-1, step, BITS).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, versions: bool = False) -> DataFrame:
    """(id, fp): a row per row of `docs`; fp is the fingerprint as a signed number. With `versions` also the text's hash."""
    version = [F.xxhash64(F.col(text_col).cast("string")).alias("version")] if versions else []
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"), *version)
    schema = T.StructType([T.StructField("id", source.schema["id"].dataType), T.StructField("fp", T.LongType()), *source.schema.fields[2:]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [signed(fingerprint(text)) for at in range(0, batch.num_rows, SLICE_ROWS) for text in batch.column(1).slice(at, SLICE_ROWS).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64()), *batch.columns[2:]], schema.fieldNames())

    return source.mapInArrow(run, schema)


def close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= RADIUS


def forest(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that connect what links of RADIUS bits or fewer connect, at most one for each fingerprint."""
    rest, out_a, out_b = fps, [], []
    while len(rest) > 1:
        root, frontier, rest = rest[0], rest[:1], rest[1:]
        while len(frontier) and len(rest):
            part, frontier = frontier[:64], frontier[64:]
            met = close(part[:, None], rest[None, :]).any(0)
            frontier = np.concatenate([frontier, rest[met]])
            out_a.append(rest[met])
            out_b.append(np.full(int(met.sum()), root))
            rest = rest[~met]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *out_a]), np.concatenate([none, *out_b])


def links_in_runs(table: np.ndarray, key: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within the buckets of rows that are sorted by table and key."""
    starts = np.flatnonzero(np.r_[True, (table[1:] != table[:-1]) | (key[1:] != key[:-1])])
    sizes = np.diff(np.r_[starts, len(fps)])
    left = np.repeat(starts + sizes, sizes) - np.arange(len(fps))  # rows to the end of the bucket, itself included
    plain = np.repeat(sizes <= PLAIN_RUN, sizes)
    out_a, out_b = [], []
    for gap in range(1, PLAIN_RUN):
        at = np.flatnonzero(plain & (left > gap))
        if not len(at):
            break
        at = at[close(fps[at], fps[at + gap])]
        out_a.append(fps[at])
        out_b.append(fps[at + gap])
    for s, n in zip(starts[sizes > PLAIN_RUN], sizes[sizes > PLAIN_RUN]):
        a, b = forest(fps[s : s + n])
        out_a.append(a)
        out_b.append(b)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *out_a]), np.concatenate([none, *out_b])


def near_links(distinct: DataFrame, most_in_bucket: int = MOST_IN_BUCKET) -> DataFrame:
    """(a, b): links between the distinct fingerprints `fp` that connect all that differ in RADIUS bits or fewer."""
    tables = F.array(*[F.struct(F.lit(v).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for v, m in enumerate(MASKS)])
    masked = distinct.select("fp", F.explode(tables).alias("x")).select("x.t", "x.key", "fp")
    shared = masked.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    bucketed = masked.join(shared, ["t", "key"])
    schema = "a long, b long"

    def by_runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.zeros(0, np.int64)] * 3
        done = False
        batches = iter(batches)
        while not done:
            batch = next(batches, None)
            done = batch is None
            if not done:
                held = [np.concatenate([h, batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64)]) for i, h in enumerate(held)]
            t, key, fps = held
            if not len(t):
                continue
            # The last bucket may go on in the next batch.
            other = np.flatnonzero((t != t[-1]) | (key != key[-1]))
            cut = len(t) if done else int(other[-1]) + 1 if len(other) else 0
            a, b = links_in_runs(t[:cut], key[:cut], fps[:cut]) if cut else (np.zeros(0, np.int64),) * 2
            held = [x[cut:] for x in held]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    small = bucketed.where(F.col("n") <= most_in_bucket).select("t", "key", "fp").repartition("t", "key").sortWithinPartitions("t", "key").mapInArrow(by_runs, schema)

    free = [[1 << i for i in range(BITS) if not m >> i & 1] for m in MASKS]

    def points(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = []
        for bits in free:
            patterns = [0, *bits, *[x | y for x, y in combinations(bits, 2)]]
            flips.append((np.array([signed(p) for p in patterns], np.int64), np.arange(len(patterns)) <= len(bits)))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                for v in np.unique(part.column(0).to_numpy()):
                    fps = part.column(1).to_numpy()[part.column(0).to_numpy() == v]
                    masks, near = flips[v]
                    n = len(masks)
                    arrays = [np.full(len(fps) * n, v, np.int32), (fps[:, None] ^ masks[None, :]).ravel(), np.repeat(fps, n), np.tile(near, len(fps))]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["t", "point", "fp", "near"])

    named = bucketed.where(F.col("n") > most_in_bucket).select("t", "fp").mapInArrow(points, "t int, point long, fp long, near boolean")
    lead = named.groupBy("t", "point").agg(F.min(F.when(F.col("near"), F.col("fp"))).alias("lead"), F.count(F.lit(1)).alias("n")).where("lead is not null and n > 1")
    large = named.join(lead, ["t", "point"]).where("fp <> lead").select(F.col("fp").alias("a"), F.col("lead").alias("b")).distinct()
    return small.union(large)


def near_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_in_bucket: int = MOST_IN_BUCKET) -> DataFrame:
    """One row per row of `docs`: `id_col`, fp (fingerprint as a signed number), component_id.

    Fingerprints are of the whole text's 3-word shingles in lower case (A-Z); a text without words, or a null one, has
    0. Documents whose fingerprints differ in 3 bits or fewer are linked; component_id is the smallest id that can be
    reached. Repeated rows are a group of their own; a null id is never a component's id unless all its ids are null.
    An empty table gives an empty table; other columns are left out.
    """
    return rooted_documents(docs, id_col, text_col, most_in_bucket).select(F.col("id").alias(id_col), "fp", "component_id")


def rooted_documents(docs: DataFrame, id_col: str, text_col: str, most_in_bucket: int = MOST_IN_BUCKET, versions: bool = False) -> DataFrame:
    """(id, fp, root, component_id) and with `versions` the text's hash: a row per row of `docs`; root is the component's own."""
    checkpoint_dir(docs.sparkSession)
    known = fingerprints(docs, id_col, text_col, versions).checkpoint()
    distinct = known.groupBy("fp").agg(F.min("id").alias("least"))
    roots = connected_components(near_links(distinct.select("fp"), most_in_bucket))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "root", "component_id")
    return known.join(named, "fp")


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component of near documents the row with the smallest id, with all its columns.

    A null id counts as the largest. Of rows of a component that share that id one stays, the one whose text has the
    least hash. Components that share an id, or have none, each keep a row of their own.
    """
    found = rooted_documents(docs, id_col, text_col, versions=True)
    own = found.groupBy("root", "id", "version").agg(F.count(F.lit(1)).alias("n")).checkpoint()
    least = own.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "version", "n")).alias("s")).checkpoint()
    stays = F.col("id").eqNullSafe(F.col("s.id")) & (F.col("version") == F.col("s.version"))
    goes = few(own.join(least, "root").where(~stays).select("id", "version"))
    version = F.xxhash64(F.col(f"d.`{text_col}`").cast("string"))
    same = F.col(f"d.`{id_col}`").eqNullSafe(F.col("s.id")) & (version == F.col("s.version"))
    kept = docs.alias("d").join(goes.alias("s"), same, "left_anti")
    again = few(least.select("s.*").where("n > 1").select("id", "version"))
    if again.isEmpty():
        return kept
    name = next(n for i in range(len(docs.columns) + 1) if (n := f"version_{i}") not in docs.columns)
    once = kept.alias("d").join(again.alias("s"), same, "left_anti")
    copies = kept.alias("d").join(again.alias("s"), same, "left_semi").withColumn(name, version)
    return once.union(copies.dropDuplicates([id_col, name]).drop(name))
