"""Connected components of a link table by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.llm.common import chunks_for, stash

#: Edges that one task handles; fewer tasks than partitions are used where few edges are left.
EDGES_PER_TASK = 200_000


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def _star(edges: DataFrame, large: bool, tasks: int) -> DataFrame:
    """One contraction: each node ties its larger (or its smaller) neighbours to the least node it sees.

    The least neighbour is a map-side combined minimum, stashed so that the join with the edges of a
    hub can be split by adaptive execution; the neighbours of a node are never gathered.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = stash(both.groupBy("a").agg(F.min("b").alias("m")).coalesce(tasks))
    joined = both.join(least, "a")
    low = F.least("a", "m")
    if large:
        moved = joined.filter("b > a").select(F.col("b").alias("a"), low.alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return stash(moved.filter("a > b").distinct().coalesce(tasks))


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of longs to ``(node, component)``, component being the least node reachable.

    Self links and repeats are allowed; nodes without a link to another node are not returned.
    Every round costs a few shuffles of the remaining edges and ends in the shared folder, so memory
    is bounded and lost executors only repeat a round. Rounds grow with the logarithm of the size.
    """
    edges = stash(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct())
    before = _digest(edges)
    while before[0]:
        tasks = chunks_for(before[0], EDGES_PER_TASK)
        edges = _star(_star(edges, True, tasks), False, tasks)
        after = _digest(edges)
        if after == before:
            break
        before = after
    own = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(own)
