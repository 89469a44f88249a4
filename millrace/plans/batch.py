"""Queries of batch jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import batch as B
from millrace.sources.tables import table

ROUNDS = 10


def wordcount(spark, d):
    return B.word_count(table(spark, d, "documents"))


def word_skew(spark, d):
    words = table(spark, d, "documents").select(F.explode(B.tokens(F.col("text"))).alias("word"))
    return B.skewed_keys(words, "word")


def shuffle_stats(spark, d):
    return B.shuffle_stats(table(spark, d, "events"), F.col("user_id"), F.col("event_type"), F.col("user_id") % 4)


def reduce_side_join(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("l"))
    return B.reduce_side_join(orders, table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("r")), "k", "l", "r")


def join_key_extract(spark, d):
    encoded = table(spark, d, "orders").select("o_orderkey", B.encode_join_input(F.col("o_orderkey"), F.col("o_custkey")).alias("encoded"))
    return encoded.withColumn("join_key", B.extract_join_key(F.col("encoded")))


def broadcast_join(spark, d):
    """Catalyst broadcasts the sides whose size it knows to be small, and shuffles them where they aren't."""
    supplier = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    met = table(spark, d, "lineitem").join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return met.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).cast("bigint").alias("cents"))


def edges(spark, d, shift: int = 0):
    count = table(spark, d, "supplier").count()
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.pmod("l_partkey", F.lit(count)) + shift).alias("dst")).distinct()


def pagerank(spark, d):
    return B.pagerank(edges(spark, d), ROUNDS).select("id", F.round("rank", 6).alias("rank"))


def pagerank_dangling(spark, d):
    """With destinations one higher there is a node without edges out, whose rank leaks."""
    return B.pagerank(edges(spark, d, 1), ROUNDS).select("id", F.round("rank", 6).alias("rank"))


def pagerank_sql(shift: int) -> str:
    steps = ",\n".join(
        f"r{i + 1} AS (SELECT n.id, 0.15 / t.n + 0.85 * coalesce(s.got, 0) AS rank FROM nodes n CROSS JOIN total t LEFT JOIN (SELECT e.dst AS id, sum(r.rank / g.deg) AS got FROM edges e JOIN deg g USING (src) JOIN r{i} r ON r.id = e.src GROUP BY e.dst) s USING (id))"
        for i in range(ROUNDS)
    )
    return f"""WITH edges AS (SELECT DISTINCT l_suppkey AS src, l_partkey % (SELECT count(*) FROM supplier) + {shift} AS dst FROM lineitem),
nodes AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges), total AS (SELECT count(*) AS n FROM nodes), deg AS (SELECT src, count(*) AS deg FROM edges GROUP BY src),
r0 AS (SELECT id, 1.0 / t.n AS rank FROM nodes CROSS JOIN total t),
{steps}
SELECT id, round(rank, 6) AS rank FROM r{ROUNDS}"""


def input_splits(spark, d):
    """Rows per split of an even deal; sizes differ by their hashes only."""
    n = 4
    return table(spark, d, "orders").groupBy(F.pmod("o_orderkey", F.lit(n)).cast("int").alias("split")).agg(F.count(F.lit(1)).alias("rows"))


QUERIES = {f.__name__: f for f in (wordcount, word_skew, shuffle_stats, reduce_side_join, join_key_extract, broadcast_join, pagerank, pagerank_dangling, input_splits)}

ORACLES = {
    "wordcount": "SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM documents) GROUP BY word",
    "word_skew": "SELECT word AS key, count(*) AS n, word || '(' || count(*) || ')' AS label FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM documents) GROUP BY word HAVING count(*) > 100",
    "shuffle_stats": """WITH p AS (SELECT user_id % 4 AS part, count(*) AS rows, sum(strlen(CAST(user_id AS VARCHAR)) + strlen(event_type)) AS bytes FROM events GROUP BY 1)
SELECT CAST(sum(rows) AS BIGINT) AS pairs, CAST(sum(bytes) AS BIGINT) AS bytes, string_agg(CAST(rows AS VARCHAR), ' ' ORDER BY part) AS partitions, max(rows) / sum(rows) AS max_share FROM p""",
    "reduce_side_join": "SELECT o_custkey AS k, CAST(o_orderkey AS VARCHAR) || '+' || c_name AS joined FROM orders JOIN customer ON o_custkey = c_custkey",
    "join_key_extract": "SELECT o_orderkey, o_orderkey || '#' || o_custkey AS encoded, regexp_extract(o_orderkey || '#' || o_custkey, '[^#]*$') AS join_key FROM orders",
    "broadcast_join": "SELECT n_name, count(*) AS n, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name",
    "pagerank": pagerank_sql(0),
    "pagerank_dangling": pagerank_sql(1),
    "input_splits": "SELECT CAST(o_orderkey % 4 AS INTEGER) AS split, count(*) AS rows FROM orders GROUP BY 1",
}
