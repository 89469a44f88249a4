import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from millrace.llm.queries import op3_topk_search
from millrace.llm.topk_search import nra_topk, search_topk
from millrace.sources.tables import table

from .conftest import SMALL


def brute(rows, k=5, asks=lambda i: i % 50 == 0):
    fit = [(i, np.floor(np.array(v, np.float32).astype(float) * 256).astype(np.int64)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for i, q in fit:
        if asks(i):
            best = sorted((-int(q @ v), j) for j, v in fit if j != i and len(v) == len(q))[:k]
            out |= {(i, r, j, -s) for r, (s, j) in enumerate(best, 1)}
    return out


def test_query_agrees_with_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in table(spark, SMALL, "embeddings").collect()]
    assert {tuple(r) for r in op3_topk_search(spark, SMALL).collect()} == brute(rows)


def test_small_blocks_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4) / 64]) for i in range(300)]
    rows += [(300, None), (350, [1.0, None, 0.0, 0.0]), (400, [float("nan")] * 4), (450, [float("inf"), 0.0, 0.0, 0.0]), (None, [0.5] * 4), (500, [0.5, 0.5]), (501, [0.1, 0.2]), (550, [])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit("clash"))
    got = search_topk(vectors, F.col("vec_id") % 50 == 0, vectors_a_block=40, queries_a_block=3)
    assert {tuple(r) for r in got.collect()} == brute(rows)
    assert search_topk(vectors.limit(0), F.col("vec_id") % 50 == 0).collect() == []


def test_bounds_stop_before_the_end_and_stay_exact():
    rng = np.random.default_rng(5)
    for spread in (3, 300, 10**9):
        x = rng.integers(-spread, spread + 1, (3000, 6))
        q = rng.integers(-spread, spread + 1, (20, 6))
        names = rng.permutation(3000)
        for i, rows, scores in nra_topk(q, x, np.full(20, -1), names, 5):
            full = x @ q[i]
            best = np.lexsort((names, -full))[:5]
            assert rows.tolist() == best.tolist() and scores.tolist() == full[best].tolist()


def test_bounds_settle_the_queries_of_the_table_before_all_is_read():
    table = pq.read_table("/root/testdata/sf0.1/embeddings.parquet")
    names = table["vec_id"].to_numpy()
    vectors = np.floor(np.array(table["embedding"].to_pylist(), np.float32).astype(float) * 256).astype(np.int64)
    stops = []
    found = list(nra_topk(vectors[names % 50 == 0], vectors, names[names % 50 == 0], names, 5, stops))
    assert len(stops) == len(found) == (names % 50 == 0).sum()
    assert max(stops) <= 0.9
