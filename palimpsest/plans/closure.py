"""Transitive closures of edge tables.

Semi-naive: a round joins only the pairs found in the round before with the edges, and takes out
what is known.  Each round is written to the shared folder, so that lineage stays short and a lost
executor costs a round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import stored


def closure(edges: DataFrame, min_depth: int = 1, max_depth: int | None = None, step: str | None = None) -> DataFrame:
    """Distinct pairs (s, o) with a path of ``min_depth`` to ``max_depth`` edges from s to o.

    ``min_depth`` 0 adds each node of the edges with itself.  ``step`` names a column with the length
    of the shortest path (for a pair that is on a cycle of itself, that of the cycle).  Cycles end.
    """
    e = stored(edges.select("s", "o").filter("s is not null and o is not null").distinct(), "closure-edges")
    found = e.withColumn("n", F.lit(1))
    frontier, depth = found, 1
    while max_depth is None or depth < max_depth:
        depth += 1
        hop = e.select(F.col("s").alias("o"), F.col("o").alias("next"))
        new = frontier.select("s", "o").join(hop, "o").select("s", F.col("next").alias("o")).distinct()
        new = stored(new.join(found, ["s", "o"], "left_anti").withColumn("n", F.lit(depth)), "closure-step")
        if not new.head(1):
            break
        found, frontier = found.unionByName(new), new
    if min_depth > 1:
        found = found.filter(F.col("n") >= min_depth)
    if min_depth == 0:
        nodes = e.select("s").union(e.select("o")).distinct().select("s", F.col("s").alias("o"), F.lit(0).alias("n"))
        found = nodes.unionByName(found.filter("s <> o"))
    return found.select("s", "o", F.col("n").alias(step)) if step else found.select("s", "o")


def ancestors_by_interval(nodes: DataFrame, tree: str = "tree_id") -> DataFrame:
    """(tree, gid, ancestor) from post-order numbers, without recursion: a is an ancestor of d when leftmost(a) <= d < a."""
    from ..operators.ranges import points_in

    a = nodes.select(tree, F.col("gid").alias("ancestor"), "leftmost", (F.col("gid") - 1).alias("last"))
    return points_in(a, nodes.select(tree, "gid"), [tree], "leftmost", "last", "gid").select(tree, "gid", "ancestor")
