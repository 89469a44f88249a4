"""Queries of key placement."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.bloom import build, may_contain
from millrace.functions.hashing import fnv64_signed, ring_hash
from millrace.operators import placement as P
from millrace.plans.logs import fnv_sql
from millrace.sources.tables import table

THREE, FOUR, VNODES = ["node-0", "node-1", "node-2"], ["node-0", "node-1", "node-2", "node-3"], 160


def keys(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("key")).withColumn("h", ring_hash(F.col("key")))


def modulo_placement(spark, d):
    return keys(spark, d).select("key", P.modulo_node(F.col("h"), THREE).alias("node"))


def modulo_movement(spark, d):
    placed = keys(spark, d).select(P.modulo_node(F.col("h"), THREE).alias("a"), P.modulo_node(F.col("h"), FOUR).alias("b"))
    return P.movement(placed, "a", "b")


def ring_points(spark, d):
    return P.ring_points(spark, THREE, 8)


def ring_locate(spark, d):
    return P.ring_locate(keys(spark, d), "h", P.ring_points(spark, THREE, VNODES)).select("key", "node")


def ring_locate_joined(spark, d):
    return P.ring_locate_sql(keys(spark, d), "key", "h", P.ring_points(spark, THREE, 8)).select("key", "node")


def ring_movement(spark, d):
    placed = P.ring_locate(keys(spark, d), "h", P.ring_points(spark, THREE, VNODES), "a")
    return P.movement(P.ring_locate(placed, "h", P.ring_points(spark, FOUR, VNODES), "b"), "a", "b")


def ring_after_leave(spark, d):
    """Keys of a node that leaves go to others; all other keys stay."""
    left = P.remove_node(P.ring_points(spark, FOUR, VNODES), "node-1")
    return P.ring_locate(keys(spark, d), "h", left).select("key", "node")


def shard_keys(spark, d):
    return P.keys_by_node(ring_locate(spark, d), "key")


def nodes(spark, names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def key_distribution(spark, d):
    """Keys by node, with one node that holds none."""
    return P.distribution(modulo_placement(spark, d), nodes(spark, [*THREE, "idle"]))


def load_imbalance(spark, d):
    return P.load_imbalance(key_distribution(spark, d)).select(F.round("imbalance", 9).alias("imbalance"))


def ranges(spark):
    return P.even_ranges(spark, 12, THREE, 1500)


def padded(spark, d):
    return table(spark, d, "customer").select(F.format_string("k%05d", "c_custkey").alias("key"))


def even_ranges(spark, d):
    return ranges(spark)


def range_locate(spark, d):
    return P.range_locate(padded(spark, d), "key", ranges(spark)).select("key", "node")


def range_split_merge(spark, d):
    """A range cut at k00600, and the ranges from k00125 on merged with their successor."""
    return P.merge_range(P.split_range(ranges(spark), "k00600", "node-9"), "k00125")


def range_rebalance(spark, d):
    """Twelve ranges from three nodes to four."""
    rows = [(r["start"], r["end"], r["node"]) for r in ranges(spark).orderBy("start").collect()]
    out, moves = P.rebalance(rows, FOUR)
    return spark.createDataFrame(out, "start string, end string, node string").groupBy("node").agg(F.count(F.lit(1)).alias("ranges")).withColumn("moves", F.lit(moves).cast("long"))


def bloom_probe(spark, d):
    """Of all orders, those whose customer may have an order over 400000: no such customer is left out."""
    rich = table(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").cast("string").alias("key"))
    bloom = build(rich.distinct(), "key", 2000)
    found = table(spark, d, "orders").withColumn("may", may_contain(bloom, F.col("o_custkey").cast("string")))
    truly = found.join(rich.distinct().withColumn("hit", F.lit(True)), F.col("o_custkey").cast("string") == F.col("key"), "left")
    return truly.agg(F.count_if(F.col("hit") & ~F.col("may")).alias("missed"), F.count_if(F.col("hit")).alias("hits"))


def fnv64_hashes(spark, d):
    return table(spark, d, "nation").select("n_name", fnv64_signed("n_name").alias("h"))


QUERIES = {f.__name__: f for f in (modulo_placement, modulo_movement, ring_points, ring_locate, ring_locate_joined, ring_movement, ring_after_leave, shard_keys, key_distribution, load_imbalance, even_ranges, range_locate, range_split_merge, range_rebalance, bloom_probe, fnv64_hashes)}


def ring_sql(name: str, key: str, source: str, keep: str) -> str:
    """CTEs that end in `name`: `keep` and h, the ring position of `key`. Factors are taken modulo 2^32 in HUGEINT."""
    return f"""{name}0 AS (SELECT {keep}, {fnv_sql(key)} AS a FROM {source}),
{name}1 AS (SELECT * EXCLUDE a, CAST((CAST(xor(a, a >> 16) AS HUGEINT) * 2246822507) % 4294967296 AS BIGINT) AS a FROM {name}0),
{name}2 AS (SELECT * EXCLUDE a, CAST((CAST(xor(a, a >> 13) AS HUGEINT) * 3266489909) % 4294967296 AS BIGINT) AS a FROM {name}1),
{name} AS (SELECT * EXCLUDE a, xor(a, a >> 16) AS h FROM {name}2)"""


KEYS = ring_sql("keys", "CAST(c_custkey AS VARCHAR)", "customer", "CAST(c_custkey AS VARCHAR) AS key")


def points_sql(name: str, n: int, vnodes: int, without: str = "none") -> str:
    source = f"(SELECT 'node-' || i AS node, 'node-' || i || '#' || v AS place FROM range({n}) t(i), range({vnodes}) u(v))"
    return ring_sql(f"{name}p", "place", source, "node") + f", {name} AS (SELECT h AS point, min(node) AS node FROM {name}p GROUP BY h HAVING min(node) <> '{without}')"


def located_sql(out: str, points: str) -> str:
    return f"{out} AS (SELECT k.key, coalesce(p.node, (SELECT arg_min(node, point) FROM {points})) AS node FROM keys k ASOF LEFT JOIN {points} p ON p.point >= k.h)"


MODULO = "'node-' || (h % {n})"
RANGES = "ranges AS (SELECT CASE WHEN i > 0 THEN printf('k%05d', i * 125) ELSE '' END AS start, CASE WHEN i < 11 THEN printf('k%05d', (i + 1) * 125) ELSE '' END AS \"end\", 'node-' || (i % 3) AS node FROM range(12) t(i))"
MOVED = "count(*) AS keys, count(*) FILTER (a <> b) AS moved, count(*) FILTER (a <> b) / count(*) AS share"
ORACLES = {
    "modulo_placement": f"WITH {KEYS} SELECT key, {MODULO.format(n=3)} AS node FROM keys",
    "modulo_movement": f"WITH {KEYS} SELECT {MOVED} FROM (SELECT {MODULO.format(n=3)} AS a, {MODULO.format(n=4)} AS b FROM keys)",
    "ring_points": f"WITH {points_sql('ring', 3, 8)} SELECT * FROM ring",
    "ring_locate": f"WITH {KEYS}, {points_sql('ring', 3, VNODES)}, {located_sql('x', 'ring')} SELECT * FROM x",
    "ring_locate_joined": f"WITH {KEYS}, {points_sql('ring', 3, 8)}, {located_sql('x', 'ring')} SELECT * FROM x",
    "ring_movement": f"WITH {KEYS}, {points_sql('r3', 3, VNODES)}, {points_sql('r4', 4, VNODES)}, {located_sql('x', 'r3')}, {located_sql('y', 'r4')} SELECT {MOVED} FROM (SELECT x.node AS a, y.node AS b FROM x JOIN y USING (key))",
    "ring_after_leave": f"WITH {KEYS}, {points_sql('ring', 4, VNODES, 'node-1')}, {located_sql('x', 'ring')} SELECT * FROM x",
    "shard_keys": f"WITH {KEYS}, {points_sql('ring', 3, VNODES)}, {located_sql('x', 'ring')} SELECT node, count(*) AS keys, min(key) AS first, max(key) AS last FROM x GROUP BY node",
    "key_distribution": f"WITH {KEYS} SELECT {MODULO.format(n=3)} AS node, count(*) AS keys FROM keys GROUP BY 1 UNION ALL SELECT 'idle', 0",
    "load_imbalance": f"WITH {KEYS} SELECT round(max(n) / (sum(n) / 4), 9) AS imbalance FROM (SELECT h % 3, count(*) AS n FROM keys GROUP BY 1)",
    "even_ranges": f"WITH {RANGES} SELECT * FROM ranges",
    "range_locate": f"WITH {RANGES} SELECT printf('k%05d', c_custkey) AS key, node FROM customer JOIN ranges ON printf('k%05d', c_custkey) >= start AND (\"end\" = '' OR printf('k%05d', c_custkey) < \"end\")",
    "range_split_merge": f"""WITH {RANGES} SELECT start, "end", node FROM ranges WHERE start NOT IN ('k00125', 'k00250', 'k00500')
UNION ALL VALUES ('k00125', 'k00375', 'node-1'), ('k00500', 'k00600', 'node-1'), ('k00600', 'k00625', 'node-9')""",
    "range_rebalance": "SELECT 'node-' || i AS node, CAST(3 AS BIGINT) AS ranges, CAST(3 AS BIGINT) AS moves FROM range(4) t(i)",
    "fnv64_hashes": """WITH h AS (SELECT n_name, list_reduce(list_prepend(CAST(14695981039346656037 AS HUGEINT), list_transform(string_split(n_name, ''), lambda x: CAST(ord(x) AS HUGEINT))), lambda h, x: (xor(h, x) * 1099511628211) % 18446744073709551616) AS h FROM nation)
SELECT n_name, CAST(CASE WHEN h >= 9223372036854775808 THEN h - 18446744073709551616 ELSE h END AS BIGINT) AS h FROM h""",
    "bloom_probe": "SELECT CAST(0 AS BIGINT) AS missed, count(*) AS hits FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)",
}
