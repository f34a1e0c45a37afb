"""Connected components of a link table, in rounds of stars; no task needs more than its share of links."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .batches import column, lean
from .shared import ship, stored

#: Links that a task contracts at once.
STRETCH = 1 << 21


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component among these links), for nodes that aren't the smallest."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    top = np.arange(len(nodes))
    while True:
        x, y = top[a], top[b]
        if (x == y).all():
            break
        np.minimum.at(top, np.maximum(x, y), np.minimum(x, y))
        while (top[top] != top).any():
            top = top[top]
    below = np.flatnonzero(top != np.arange(len(nodes)))
    return nodes[below], nodes[top[below]]


@lean
def _contract(batches):
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        held.append((column(batch, "u").to_numpy(), column(batch, "v").to_numpy()))
        size += len(held[-1][0])
        if size > STRETCH:
            held = [forest(*map(np.concatenate, zip(*held)))]
            size = 0
            if len(held[0][0]) > STRETCH // 2:  # it doesn't shrink: pass it on
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names=["u", "v"])
                held = []
    if held:
        u, v = forest(*map(np.concatenate, zip(*held)))
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    # A node that is the smallest of its links keeps them, which needs no join.
    kept = both.filter("v > u").join(stored(least.filter("m < u"), "links-least"), "u", "left")
    return kept.select(F.col("v").alias("u"), F.coalesce("m", "u").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = stored(down.groupBy("u").agg(F.min("v").alias("m")), "links-least")
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def _is_done(e: DataFrame) -> bool:
    """Every node has one link, or it is where others' links end; then those are the roots."""
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(e.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    ends = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return not ends.filter((F.col("out") + F.col("into") > 1)).head(1)


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (u, v) that isn't the smallest of its component.

    Links of a node with itself don't count.  First every task contracts what it has; then large and
    small stars alternate, each round contracted within its tasks and written to the shared folder,
    until every node's only link is to its root.
    """
    ship(links.sparkSession)
    e = links.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).filter("u <> v")
    contracted = lambda x: stored(x.mapInArrow(_contract, "u long, v long"), "links")
    e = contracted(e)
    while not _is_done(e):
        e = contracted(_small_star(stored(_large_star(e).distinct(), "links")).distinct())
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
