"""Exact top-k inner-product search by no-random-access aggregation.

Vectors and queries are dealt into blocks by hash; each pair of blocks is one task's work, of bounded memory. Within a
block every dimension is a list sorted by value, which a query reads from the top where its component is positive and
from the bottom where it is negative. At a common depth the entries seen so far give each vector a lower bound (unseen
entries at the list's far end) and an upper bound (unseen entries at the last value read). Reading goes deeper until no
outsider's upper bound reaches a query's k-th best lower bound but for a short list, whose scores are then resolved.
All queries of a block share the lists, so the bounds of all of them at one depth are two matrix products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

VECTORS_A_BLOCK, QUERIES_A_BLOCK = 8192, 2048
SHORT_LIST = 256
#: Shares of the lists after which bounds are taken.
DEPTHS = (0.5, 0.6, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 1.0)


def nra_topk(queries: np.ndarray, vectors: np.ndarray, own: np.ndarray, names: np.ndarray, k: int, stops: list[float] | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query row, vector rows, scores) of the k best vectors of each query, ties to the smaller name.

    own: each query's own name, which takes no part. All values are whole numbers. stops: gets the share of the lists
    that was read for each query; 1 means that the bounds never settled it and all was read.
    """
    n, d = vectors.shape
    if not n or not len(queries):
        return
    reach = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * max(d, 1)
    kind = np.float32 if reach < 2**24 else np.float64 if reach < 2**53 else np.int64
    q, x = queries.astype(kind), vectors.astype(kind)
    order = np.argsort(-x, axis=0, kind="stable")
    rank = np.empty((n, d), np.int64)
    np.put_along_axis(rank, order, np.arange(n)[:, None].repeat(d, 1), 0)
    high, low = x.max(0), x.min(0)
    split = np.concatenate([np.maximum(q, 0), np.minimum(q, 0)], 1)
    open_rows = np.arange(len(q))
    for share in DEPTHS:
        depth = min(n, max(min(n, 2 * k), int(n * share)))
        down, up = rank < depth, rank >= n - depth
        last_down, last_up = np.take_along_axis(x, order[depth - 1 : depth], 0), np.take_along_axis(x, order[n - depth : n - depth + 1], 0)
        mine = split[open_rows]
        lower = mine @ np.concatenate([np.where(down, x, low), np.where(up, x, high)], 1).T
        itself = names[None, :] == own[open_rows][:, None]
        lower[itself] = np.iinfo(np.int64).min if kind is np.int64 else -np.inf
        if depth < n:
            upper = mine @ np.concatenate([np.where(down, x, last_down), np.where(up, x, last_up)], 1).T
        else:
            upper = lower
        cut = np.partition(lower, n - k, 1)[:, n - k] if n > k else lower.min(1)
        may = (upper >= cut[:, None]) & ~itself
        done = (may.sum(1) <= SHORT_LIST) | (depth == n)
        for i in np.flatnonzero(done):
            rows = np.flatnonzero(may[i])
            scores = ((x[rows] @ q[open_rows[i]]) if depth < n else lower[i, rows]).astype(np.int64)
            best = np.lexsort((names[rows], -scores))[:k]
            if stops is not None:
                stops.append(share)
            yield int(open_rows[i]), rows[best], scores[best]
        open_rows = open_rows[~done]
        if not len(open_rows):
            return


def whole(vector: Column) -> Column:
    """floor(256 * x) of every component, x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * 256))


def search_topk(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", vectors_a_block: int = VECTORS_A_BLOCK, queries_a_block: int = QUERIES_A_BLOCK) -> DataFrame:
    """query_id, rank (from 1), `id_col`, score: each query's k best other rows by inner product of `whole` vectors.

    Queries are the rows that fulfil `is_query`, candidates all rows of another id and the same number of components.
    Rows with a null id or vector, or with null or non-finite components, take no part; a repeated query row is
    answered once, a repeated candidate counts each time. Fewer than k candidates give all; ties go to the smaller id.
    Scores are exact within 64 bits. An empty table gives an empty table; other columns are left out.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    infinite = float("inf")
    usable = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & usable)
    rows = rows.select("vec_id", "asks", whole(F.col("v")).alias("v"))
    total, asking = rows.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    nv, nq = max(1, -(-total // vectors_a_block)), max(1, -(-asking // queries_a_block))
    deal = lambda n, *by: F.pmod(F.xxhash64(F.lit(n), *by), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.where("asks").dropDuplicates(["vec_id", "v"]).select(F.size("v").alias("d"), deal(nq, "vec_id", "v").alias("qb"), every(nv).alias("vb"), F.col("vec_id").alias("query_id"), F.xxhash64("v").alias("version"), "v")
    placed = rows.withColumn("row", F.monotonically_increasing_id())  # a repeated id fills no block alone
    right = placed.select(F.size("v").alias("d"), every(nq).alias("qb"), deal(nv, "row").alias("vb"), "vec_id", "v")
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("query_id", "version", "vec_id", "score")])

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        column = column.combine_chunks()
        return column.flatten().to_numpy().reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)

    def run(asked: pa.Table, known: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(4)]
        if asked.num_rows and known.num_rows:
            own, version, names = (t[c].to_numpy() for t, c in ((asked, "query_id"), (asked, "version"), (known, "vec_id")))
            for i, best, scores in nra_topk(matrix(asked["v"]), matrix(known["v"]), own, names, k):
                for column, value in zip(out, (np.full(len(best), own[i]), np.full(len(best), version[i]), names[best], scores)):
                    column.append(value)
        return pa.table([pa.array(np.concatenate(c), pa.int64()) for c in out], schema.fieldNames())

    met = left.groupBy("d", "qb", "vb").cogroup(right.groupBy("d", "qb", "vb")).applyInArrow(run, schema)
    order = Window.partitionBy("query_id", "version").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("vec_id").alias(id_col), "score")
