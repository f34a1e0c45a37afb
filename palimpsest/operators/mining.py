"""Mining of pattern instances over version pairs.

An instance is a row (pattern, v0, v1, fid0, fid1, e0, e1, grp, key).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F


def consecutive(versions: DataFrame, order: str = "idx", name: str = "version") -> DataFrame:
    """(v0, v1, idx) for each version and its next one.  The list of versions is short: one window over it."""
    w = W.orderBy(order)
    return versions.select(F.col(name).alias("v0"), F.lead(name).over(w).alias("v1"), F.col(order).alias("idx")).filter("v1 is not null")


def counts(instances: DataFrame, by: list[str]) -> DataFrame:
    """Number and percentage of instances, the most frequent first."""
    n = instances.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    share = F.round(100.0 * F.col("n") / F.sum("n").over(W.partitionBy()), 6)
    return n.withColumn("percent", share).orderBy(F.desc("n"), *by)


def lifetimes(entities: DataFrame, entity: str = "entity", version: str = "version", idx: str = "idx") -> DataFrame:
    """First and last version of each entity."""
    return entities.groupBy(entity).agg(F.min_by(version, idx).alias("first"), F.max_by(version, idx).alias("last"), F.count_distinct(version).alias("n"))


def with_enough(instances: DataFrame, extras: DataFrame, least: int) -> DataFrame:
    """Instances with at least ``least`` rows of extras (e0, e1); rows count, not distinct ones."""
    n = extras.groupBy("e0", "e1").agg(F.count(F.lit(1)).alias("n_extra"))
    return instances.join(n, ["e0", "e1"], "left").withColumn("n_extra", F.coalesce("n_extra", F.lit(0))).filter(F.col("n_extra") >= least)


def coverage(changes: DataFrame) -> DataFrame:
    """Identified and all changes by file pair, version pair and in all: rollup of (v0, v1, fid0, fid1, identified)."""
    d = changes.rollup("v0", "v1", "fid0", "fid1").agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("total"), F.sum(F.col("identified").cast("long")).alias("identified"))
    return d.filter("level in (0, 3, 15)").withColumn("coverage", F.round(F.try_divide("identified", "total"), 6))


def first_seen(instances: DataFrame, order: list[str], parts: int = 1, one_to_one: list[bool] | None = None) -> DataFrame:
    """Instances whose key wasn't seen by an earlier one of their version pair, in this order.

    ``parts`` > 1: keys are arrays, and what was seen is kept by position; that depends on what was
    skipped before, and so runs in order within a version pair.  ``one_to_one`` gives the mode: an
    instance is skipped if all of its elements were seen (none true, the default), if any was (all
    true), or if all at the positions that aren't one-to-one were (mixed; positions that it lacks are not one-to-one).
    """
    if parts == 1:
        r = F.row_number().over(W.partitionBy("v0", "v1", "key").orderBy(*order))
        return instances.withColumn("r_", r).filter("r_ = 1").drop("r_")
    flags = list(one_to_one or [])
    any_mode = bool(flags) and all(flags)
    counted = [i for i in range(parts) if any_mode or not (i < len(flags) and flags[i])]
    skip = any if any_mode else all

    def run(d: pd.DataFrame) -> pd.DataFrame:
        seen: list[set] = [set() for _ in range(parts)]
        keep = []
        d = d.sort_values(order)
        for k, key in enumerate(d["key"]):
            ok = k == 0 or not skip(key[i] in seen[i] for i in counted)
            keep.append(ok)
            if ok:
                for x, s in zip(key, seen):
                    s.add(x)
        return d[keep]

    return instances.groupBy("v0", "v1").applyInPandas(run, instances.schema)


def essentials(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """Distinct values of each key, in order."""
    return rows.groupBy(*key).agg(F.array_sort(F.collect_set(value)).alias("items"), F.count(F.lit(1)).alias("n"))


def sampled(instances: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """At most n instances of each version pair, the same ones in each run: those with the least hashes."""
    drawn = F.xxhash64(F.lit(seed), *instances.columns)
    r = F.row_number().over(W.partitionBy("v0", "v1").orderBy(drawn, *instances.columns))
    return instances.withColumn("r_", r).filter(F.col("r_") <= n).drop("r_")


def grouped(instances: DataFrame) -> DataFrame:
    """Instances that share a group of a version pair, as one row with its patterns."""
    return instances.groupBy("v0", "v1", "grp").agg(F.array_join(F.array_sort(F.collect_set("pattern")), ";").alias("patterns"), F.count(F.lit(1)).alias("n"))


def primitive(changes: DataFrame) -> DataFrame:
    """Changes by version pair and file pair, without whole files and without aggregates."""
    d = changes.filter("category <> 'File' and change <> 'modified'")
    return d.groupBy("v0", "v1", "fid0", "fid1").agg(F.count(F.lit(1)).alias("n"))
