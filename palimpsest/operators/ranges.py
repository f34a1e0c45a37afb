"""Joins and windows over ranges [so, eo] within a file."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import ident


def points_in(ranges: DataFrame, points: DataFrame, key: list[str], lo: str, hi: str, point: str) -> DataFrame:
    """Ranges [lo, hi] joined with the points of the same key that lie in them.  Both sides keep their columns, which must differ but for the key.

    A range goes to the one or two cells that it meets of a grid as wide as its length, rounded up to
    a power of two; a point to its cell of each grid in use (one for each bit of the longest length).
    So the join is on key, grid and cell, and a file's pairs are never all made.
    """
    length = F.greatest(F.col(hi) - F.col(lo), F.lit(1)).cast("long")
    r = ranges.filter(F.col(lo) <= F.col(hi)).withColumn("grid_", F.ceil(F.log2(length)).cast("int"))
    wide = lambda c: F.call_function("shiftright", F.col(c).cast("long"), F.col("grid_"))
    grids = sorted(x["grid_"] for x in r.select("grid_").distinct().collect())  # 64 at most
    r = r.withColumn("cell_", F.explode(F.sequence(wide(lo), wide(hi))))
    p = points.withColumn("grid_", F.explode(F.array(*map(F.lit, grids)) if grids else F.expr("cast(array() as array<int>)"))).withColumn("cell_", wide(point))
    return r.join(p, [*key, "grid_", "cell_"]).filter(F.col(point).between(F.col(lo), F.col(hi))).drop("grid_", "cell_")


def _second(ranges: DataFrame, key: str) -> DataFrame:
    return ranges.select(F.col(key), *(F.col(c).alias(f"{c}2") for c in ranges.columns if c != key))


def containment_join(outer: DataFrame, inner: DataFrame, key: str = "fid", strict: bool = False) -> DataFrame:
    """Pairs of ranges of one file of which the first holds the second.  The right columns get the suffix 2."""
    out = points_in(outer, _second(inner, key), [key], "so", "eo", "so2").filter(ident.contains(F.col("so"), F.col("eo"), F.col("so2"), F.col("eo2")))
    return out.filter("so <> so2 or eo <> eo2") if strict else out


def overlap_join(left: DataFrame, right: DataFrame, key: str = "fid") -> DataFrame:
    """Pairs of ranges of one file that share something, with what they share as (mso, meo): one begins in the other.

    A range that ends before it begins meets those that hold both its ends, as so <= eo2 and so2 <= eo have it.
    """
    b = _second(right, key)
    found = points_in(left, b, [key], "so", "eo", "so2")
    found = found.unionByName(points_in(b, left, [key], "so2", "eo2", "so").filter("so > so2 or so > eo"))
    found = found.filter(ident.overlaps(F.col("so"), F.col("eo"), F.col("so2"), F.col("eo2")))
    return found.withColumn("mso", F.greatest("so", "so2")).withColumn("meo", F.least("eo", "eo2"))


def outermost(ranges: DataFrame, key: str = "fid") -> DataFrame:
    """Ranges that no other range of the file strictly holds: one window, no self-join.  One without a file or an end holds none and is held by none."""
    # In the order of starts (longest first) a range is held by an earlier one that reaches as far.
    earlier = W.partitionBy(key).orderBy("so", F.desc("eo")).rowsBetween(W.unboundedPreceding, -1)
    held = ranges.select(key, "so", "eo").dropna().distinct().withColumn("reach_", F.max("eo").over(earlier)).filter("reach_ >= eo")
    return ranges.join(held.drop("reach_"), [key, "so", "eo"], "left_anti")


def islands(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """Runs of consecutive integers: (key, lo, hi, n)."""
    d = rows.select(*key, value).distinct()
    d = d.withColumn("g", F.col(value) - F.row_number().over(W.partitionBy(*key).orderBy(value)))
    return d.groupBy(*key, "g").agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(F.lit(1)).alias("n")).drop("g")


def fragments(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """The same as a text a key, such as ``3;5-9``."""
    i = islands(rows, key, value).withColumn("part", F.when(F.col("lo") == F.col("hi"), F.col("lo").cast("string")).otherwise(F.concat_ws("-", "lo", "hi")))
    ordered = F.array_sort(F.collect_list(F.struct("lo", "part")))
    return i.groupBy(*key).agg(F.array_join(F.transform(ordered, lambda x: x["part"]), ";").alias("fragment"), F.sum("n").alias("n"))


def from_fragment(df: DataFrame, fragment: str, value: str) -> DataFrame:
    """One row for each integer of a fragment's text."""
    part = F.explode(F.split(fragment, ";"))
    d = df.filter(F.col(fragment) != "").withColumn("part_", part)
    ends = F.split("part_", "-")
    lo, hi = ends[0].cast("long"), F.coalesce(F.get(ends, F.lit(1)), ends[0]).cast("long")
    return d.withColumn(value, F.explode(F.sequence(lo, hi))).drop("part_")


def merged(ranges: DataFrame, key: list[str], touching: int = 1) -> DataFrame:
    """Ranges that overlap or touch become one: (key, so, eo, n).  Those without a start come last, and belong to the last one."""
    w = W.partitionBy(*key).orderBy(F.asc_nulls_last("so"), F.asc_nulls_last("eo"))
    reach = F.max("eo").over(w.rowsBetween(W.unboundedPreceding, -1))
    d = ranges.withColumn("new_", F.when(reach.isNull() | (F.col("so") > reach + touching), 1).otherwise(0))
    d = d.withColumn("g_", F.sum("new_").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return d.groupBy(*key, "g_").agg(F.min("so").alias("so"), F.max("eo").alias("eo"), F.count(F.lit(1)).alias("n")).drop("g_")


def without(ranges: DataFrame, holes: DataFrame, key: list[str]) -> DataFrame:
    """What is left of each range (key, so, eo) when the holes of its key are cut out."""
    h = merged(holes.select(*key, "so", "eo"), key).select(*key, F.col("so").alias("hso"), F.col("eo").alias("heo"))
    cut = ranges.join(h, key, "left").filter("hso is null or (hso <= eo and heo >= so)")
    cut = cut.unionByName(ranges.join(cut.select(*key, "so", "eo").distinct(), [*key, "so", "eo"], "left_anti"), allowMissingColumns=True)
    w = W.partitionBy(*key, "so", "eo").orderBy("hso")
    d = cut.withColumn("from_", F.greatest("so", F.coalesce(F.lag("heo").over(w) + 1, F.col("so")))).withColumn("to_", F.least("eo", F.coalesce(F.col("hso") - 1, F.col("eo"))))
    d = d.withColumn("last_", F.lead("hso").over(w).isNull() & F.col("hso").isNotNull())
    head = d.select(*key, F.col("from_").alias("so"), F.col("to_").alias("eo"))
    tail = d.filter("last_").select(*key, F.greatest(F.col("heo") + 1, F.col("so")).alias("so"), "eo")
    return head.unionByName(tail).filter("so <= eo")
