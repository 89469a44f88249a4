import pytest
from pyspark.sql import functions as F

from millrace.functions.bloom import build, filter_bits, may_contain
from millrace.functions.hashing import fnv1a32, fnv1a64, fnv64_signed, mix32, ring_hash
from millrace.operators import placement as P

FIVE = ["n1", "n2", "n3", "n4", "n5"]


def plain_fnv(data, bits):
    h, p = (2166136261, 16777619) if bits == 32 else (14695981039346656037, 1099511628211)
    for b in data:
        h = (h ^ b) * p % 2**bits
    return h


def test_hashes(spark):
    words = ["", "a", "key-1", "é", "漢字", "\U0001f600 x" * 20]
    rows = spark.createDataFrame([(w,) for w in [*words, None]], "w string").select("w", fnv1a32(F.col("w")).alias("h"), ring_hash(F.col("w")).alias("m"), fnv64_signed("w").alias("h64")).collect()
    for r in rows[:-1]:
        assert r.h == plain_fnv(r.w.encode(), 32) and 0 <= r.m < 2**32
        assert r.h64 % 2**64 == plain_fnv(r.w.encode(), 64) == int(fnv1a64([r.w.encode()])[0])
    assert rows[-1].h is None
    assert spark.range(1).select(mix32(F.lit(1).cast("long")).alias("m")).first().m == 0x514E28B7


def located(spark, keys, nodes, vnodes, out):
    return P.ring_locate(keys, "h", P.ring_points(spark, nodes, vnodes), out)


def test_published_key_movement(spark):
    keys = P.sample_keys(spark, 20000).withColumn("h", ring_hash(F.col("key")))
    modulo = keys.select(P.modulo_node(F.col("h"), FIVE[:3]).alias("a"), P.modulo_node(F.col("h"), FIVE[:4]).alias("b"))
    assert P.movement(modulo, "a", "b").first().moved == 14990
    ring = located(spark, located(spark, keys, FIVE[:3], 160, "a"), FIVE[:4], 160, "b")
    assert P.movement(ring, "a", "b").first().moved == 4642


def test_published_imbalance(spark):
    keys = P.sample_keys(spark, 50000).withColumn("h", ring_hash(F.col("key")))
    nodes = spark.createDataFrame([(n,) for n in FIVE], "node string")
    for vnodes, want in ((1, 1.4943), (256, 1.0852)):
        placed = located(spark, keys, FIVE, vnodes, "node")
        assert P.load_imbalance(P.distribution(placed, nodes)).first().imbalance == pytest.approx(want, abs=5e-5)
    assert P.load_imbalance(P.distribution(keys.limit(0).withColumn("node", F.lit("x")), nodes)).first().imbalance == 0


def test_published_shards(spark):
    keys = P.sample_keys(spark, 300, width=4).withColumn("h", ring_hash(F.col("key")))
    placed = located(spark, keys, ["shard-0", "shard-1", "shard-2"], 64, "node")
    assert sorted(r["keys"] for r in P.keys_by_node(placed, "key").collect()) == [87, 106, 107]


def test_a_node_that_leaves_moves_only_its_own_keys(spark):
    keys = P.sample_keys(spark, 5000).withColumn("h", ring_hash(F.col("key")))
    ring = P.ring_points(spark, FIVE, 64)
    both = P.ring_locate(P.ring_locate(keys, "h", ring, "a"), "h", P.remove_node(ring, "n2"), "b")
    assert both.where("a <> b and a <> 'n2'").isEmpty() and both.where("b = 'n2'").isEmpty()
    assert P.ring_locate(keys.limit(3), "h", ring.limit(0)).where("node is not null").isEmpty()


def test_both_ring_lookups_agree(spark):
    keys = P.sample_keys(spark, 500).withColumn("h", ring_hash(F.col("key")))
    ring = P.ring_points(spark, FIVE, 4)
    a = {(r.key, r.node) for r in P.ring_locate(keys, "h", ring).collect()}
    assert a == {(r.key, r.node) for r in P.ring_locate_sql(keys, "key", "h", ring).collect()}


def rows(frame):
    return sorted(tuple(r) for r in frame.select("start", "end", "node").collect())


def test_ranges_split_and_merge(spark):
    two = P.even_ranges(spark, 2, ["n1", "n2"], 100000)
    assert rows(two) == [("", "k50000", "n1"), ("k50000", "", "n2")]
    three = P.split_range(two, "k02500", "n3")
    assert rows(three) == [("", "k02500", "n1"), ("k02500", "k50000", "n3"), ("k50000", "", "n2")]
    assert rows(P.split_range(three, "k02500", "n9")) == rows(three)
    assert rows(P.merge_range(three, "")) == [("", "k50000", "n1"), ("k50000", "", "n2")]
    assert rows(P.merge_range(three, "k50000")) == rows(three)
    keys = spark.createDataFrame([("k00000",), ("k02500",), ("k99999",), ("zzz",)], "key string")
    assert {r.key: r.node for r in P.range_locate(keys, "key", three).collect()} == {"k00000": "n1", "k02500": "n3", "k99999": "n2", "zzz": "n2"}


def test_rebalancing():
    ranges = [(str(i), str(i + 1), f"n{i % 3 + 1}") for i in range(12)]
    out, moves = P.rebalance(ranges, FIVE[:4])
    assert moves == 3 and sorted(sum(r[2] == n for r in out) for n in FIVE[:4]) == [3, 3, 3, 3]
    out, moves = P.rebalance(ranges[:9], ["n1", "n2"])
    assert [sum(r[2] == n for r in out) for n in ("n1", "n2")] == [5, 4] and moves == 3
    assert P.rebalance(ranges, []) == (ranges, 0) and P.rebalance(out, ["n1", "n2"])[1] == 0


def test_bloom_has_the_published_rate_and_misses_nothing(spark):
    present = P.sample_keys(spark, 20000, "present-", 6)
    bloom = build(present, "key", 20000)
    assert len(bloom) * 8 == filter_bits(20000) == 200000
    assert present.where(~may_contain(bloom, F.col("key"))).isEmpty()
    false = P.sample_keys(spark, 20000, "absent-", 6).where(may_contain(bloom, F.col("key"))).count()
    assert round(false / 20000, 4) == 0.0077
    assert filter_bits(0) == 64
