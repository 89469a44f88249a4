"""Distributed union-find: connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import checkpoint_dir

#: Orders that rounds take in turn: a new one for each would make Spark compile all code anew each time.
ORDERS = 3


def connected_components(edges: DataFrame, most_rounds: int = 100, most_collected: int = 0) -> DataFrame:
    """(node, root) of every node of `edges` (a, b: long); root is one node of the component, the same for all of it.

    Each round orders nodes at random by a hash, lets each node point at the first of itself and its neighbours,
    follows the pointers one step further, and contracts the graph along them, which leaves a fraction of the nodes;
    it ends when no edge is left. The pointers of all rounds, one after another, lead to the roots. Least values are
    found by partial sums, so a node with any number of neighbours is no hot key. Graph and pointers are checkpointed,
    never collected, but for a graph that rounds have left with `most_collected` edges or fewer: the driver finishes it,
    as the last rounds cost many small jobs. Null ends and loops are left out; an empty graph has no nodes.
    """
    checkpoint_dir(edges.sparkSession)
    graph = tidy(edges).checkpoint()
    roots = None
    for i in range(most_rounds):
        if graph.isEmpty():
            return roots if roots is not None else graph.select(F.col("a").alias("node"), F.col("b").alias("root"))
        if most_collected and graph.count() <= most_collected:
            points = edges.sparkSession.createDataFrame(joined([tuple(r) for r in graph.collect()]), "node long, root long")
            return (points if roots is None else follow(roots, points)).checkpoint()
        order = lambda c, i=i % ORDERS: F.xxhash64(F.lit(i), c)
        both = graph.select(F.col("a").alias("node"), F.col("b").alias("other")).union(graph.select("b", "a"))
        best = both.groupBy("node").agg(F.min_by("other", order("other")).alias("best"))
        points = best.select("node", F.when(order(F.col("best")) < order(F.col("node")), F.col("best")).otherwise(F.col("node")).alias("root"))
        points = follow(points, points).checkpoint()
        ends = graph.join(points.withColumnRenamed("node", "a"), "a").select(F.col("root").alias("x"), "b").join(points.withColumnRenamed("node", "b"), "b")
        graph = tidy(ends.select(F.col("x").alias("a"), F.col("root").alias("b"))).checkpoint()
        roots = points if roots is None else follow(roots, points).checkpoint()
    raise RuntimeError(f"edges are left after {most_rounds} rounds")


def tidy(edges: DataFrame) -> DataFrame:
    """Each edge once, whatever its direction; no loops."""
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def follow(roots: DataFrame, points: DataFrame) -> DataFrame:
    """Each root replaced by what it points at, if it does."""
    up = points.select(F.col("node").alias("root"), F.col("root").alias("above"))
    return roots.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"))


def joined(edges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(node, root) of every node of a few edges, by union-find."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        up[find(a)] = find(b)
    return [(x, find(x)) for x in list(up)]
