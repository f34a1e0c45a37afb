"""Pairing the files of two versions: unmodified, moved, renamed, copied, glued, modified, added, removed.

Passes are equi-joins by content digest, by path and by name; what a pass has paired leaves the pool
by an anti-join.  Groups are counted before they are joined: no pass joins all copies of a content with
each other.  Only the files of one name that no earlier pass has paired are all compared.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from ..functions.text import path_key
from ..session import ship, stored
from .alignments import dissimilarity

#: Columns of a version's files.
FILE = ["path", "dir", "name", "digest"]
PAIR = ["class", "path1", "path2"]


def _side(files: DataFrame, n: int, *more) -> DataFrame:
    return files.select(*(F.col(c).alias(f"{c}{n}") for c in FILE), *more)


def _counted(files: DataFrame, key: list[str], n: int) -> DataFrame:
    return files.withColumn(f"n{n}", F.count(F.lit(1)).over(W.partitionBy(*key)))


def _pairs(df: DataFrame, cls) -> DataFrame:
    return df.select((F.lit(cls) if isinstance(cls, str) else cls).alias("class"), "path1", "path2")


def _rest(files: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    used = pairs.select(F.col(f"path{n}").alias("path")).filter("path is not null").distinct()
    return files.join(used, "path", "left_anti")


def by_digest(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of equal content.

    One file on each side: unmodified, moved or renamed.  Else, by shared name within the digest:
    equal paths are unmodified; then of what is left over, files on the right alone are copied from
    the first left one, on the left alone glued onto the first right one, and one each is moved.
    """
    a = _side(_counted(left, ["digest"], 1), 1, "n1").withColumn("digest", F.col("digest1"))
    b = _side(_counted(right, ["digest"], 2), 2, "n2").withColumn("digest", F.col("digest2"))
    ones = a.filter("n1 = 1").join(b.filter("n2 = 1"), "digest")
    cls = F.when(F.col("name1") != F.col("name2"), "renamed").when(F.col("path1") == F.col("path2"), "unmodified").otherwise("moved")
    found = _pairs(ones, cls)
    in_left, in_right = left.select("digest").distinct(), right.select("digest").distinct()
    many = left.select("digest").join(in_right, "digest", "left_semi").groupBy("digest").count().join(
        right.select(F.col("digest")).join(in_left, "digest", "left_semi").groupBy("digest").count().withColumnRenamed("count", "count2"), "digest"
    ).filter("not (count = 1 and count2 = 1)").select("digest")
    l, r = left.join(many, "digest", "left_semi"), right.join(many, "digest", "left_semi")
    key = ["digest", "name"]
    shared = l.select(*key).distinct().join(r.select(*key).distinct(), key)
    l, r = l.join(shared, key, "left_semi"), r.join(shared, key, "left_semi")
    same = l.select("digest", "name", "path").join(r.select("digest", "name", "path"), ["digest", "name", "path"])
    found = found.unionByName(same.select(F.lit("unmodified").alias("class"), F.col("path").alias("path1"), F.col("path").alias("path2")))
    first_l = l.groupBy(*key).agg(F.min("path").alias("first1"))
    first_r = r.groupBy(*key).agg(F.min("path").alias("first2"))
    l, r = (x.join(same, ["digest", "name", "path"], "left_anti") for x in (l, r))
    n = shared.join(l.groupBy(*key).agg(F.count(F.lit(1)).alias("k1"), F.min("path").alias("one1")), key, "left").join(r.groupBy(*key).agg(F.count(F.lit(1)).alias("k2"), F.min("path").alias("one2")), key, "left").na.fill(0, ["k1", "k2"])
    copied = r.join(n.filter("k1 = 0 and k2 > 0").select(*key), key).join(first_l, key)
    glued = l.join(n.filter("k2 = 0 and k1 > 0").select(*key), key).join(first_r, key)
    moved = n.filter("k1 = 1 and k2 = 1")
    return (
        found.unionByName(copied.select(F.lit("copied").alias("class"), F.col("first1").alias("path1"), F.col("path").alias("path2")))
        .unionByName(glued.select(F.lit("glued").alias("class"), F.col("path").alias("path1"), F.col("first2").alias("path2")))
        .unionByName(moved.select(F.lit("moved").alias("class"), F.col("one1").alias("path1"), F.col("one2").alias("path2")))
    )


def by_path(left: DataFrame, right: DataFrame) -> DataFrame:
    """Equal paths (case, and ``-`` against ``/``, aside) with other contents, one file on each side: modified."""
    a = _counted(left.withColumn("key", path_key("path")), ["key"], 1).filter("n1 = 1")
    b = _counted(right.withColumn("key", path_key("path")), ["key"], 2).filter("n2 = 1")
    return _pairs(_side(a, 1, "key").join(_side(b, 2, "key"), "key").filter("digest1 <> digest2"), "modified")


@F.pandas_udf(T.DoubleType())
def _dissimilarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([dissimilarity(x.encode(), y.encode()) for x, y in zip(a, b)], dtype="float64")


def by_name(left: DataFrame, right: DataFrame) -> DataFrame:
    """Equal names (case aside) with other contents: modified.

    One file on each side is a pair.  Of several, those are whose paths are the least dissimilar for
    both sides (of equal ones, the first path), and then what is left over, if it is one on each side.
    All paths of such a name are compared: that work grows with the product of its files.
    """
    ship(left.sparkSession)
    a = _side(_counted(left.withColumn("key", F.lower("name")), ["key"], 1), 1, "key", "n1")
    b = _side(_counted(right.withColumn("key", F.lower("name")), ["key"], 2), 2, "key", "n2")
    differ = F.col("digest1") != F.col("digest2")
    ones = a.filter("n1 = 1").join(b.filter("n2 = 1"), "key").filter(differ)
    c = a.join(b, "key").filter("n1 > 1 or n2 > 1").repartition("path1", "path2")
    c = stored(c.select("key", "path1", "path2", "digest1", "digest2", _dissimilarity("path1", "path2").alias("score")), "names")
    best1 = c.groupBy("path1").agg(F.min(F.struct("score", "path2")).alias("m")).select("path1", F.col("m.path2").alias("path2"))
    best2 = c.groupBy("path2").agg(F.min(F.struct("score", "path1")).alias("m")).select("path2", F.col("m.path1").alias("path1"))
    mutual = stored(c.filter(differ).select("key", "path1", "path2").join(best1, ["path1", "path2"]).join(best2, ["path1", "path2"]), "names")
    rest = c.join(mutual.select("path1"), "path1", "left_anti").join(mutual.select("path2"), "path2", "left_anti")
    one = rest.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.min("path1").alias("path1"), F.min("path2").alias("path2"), F.min("digest1").alias("digest1"), F.min("digest2").alias("digest2")).filter("k = 1").filter(differ)
    return _pairs(ones, "modified").unionByName(_pairs(mutual, "modified")).unionByName(_pairs(one, "modified"))


def rename_patterns(pairs: DataFrame, most_parts: int = 64) -> DataFrame:
    """(old, new, n): substitutions of one path component that occur more than once among pairs (path1, path2)."""
    p, q = F.split("path1", "/"), F.split("path2", "/")
    z = pairs.filter(F.size(p) == F.size(q)).select(F.arrays_zip(p.alias("a"), q.alias("b")).alias("z"))
    d = z.select(F.filter("z", lambda x: x["a"] != x["b"]).alias("d")).filter(F.size("d") == 1)
    return d.select(F.col("d")[0]["a"].alias("old"), F.col("d")[0]["b"].alias("new")).groupBy("old", "new").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def by_rename_pattern(left: DataFrame, right: DataFrame, patterns: DataFrame) -> DataFrame:
    """Removed files whose name, with a pattern applied, is that of one added file: modified."""
    rest = patterns.select("old", "new")
    a = left.select("path", "dir", "name", F.explode(F.split("name", r"\.")).alias("old")).join(rest, "old")
    a = a.select(F.col("path").alias("path1"), F.replace("name", F.col("old"), F.col("new")).alias("name")).distinct()
    b = _counted(right, ["name"], 2).filter("n2 = 1").select(F.col("path").alias("path2"), "name")
    hit = a.join(b, "name").withColumn("k", F.count(F.lit(1)).over(W.partitionBy("path2")))
    return _pairs(hit.withColumn("r", F.row_number().over(W.partitionBy("path1").orderBy("path2"))).filter("k = 1 and r = 1"), "modified")


def pair_files(left: DataFrame, right: DataFrame, patterns: bool = False) -> DataFrame:
    """(class, path1, path2) for two versions' files (path, dir, name, digest; paths are unique).

    Classes overlap: a modified pair in another directory is moved too, one with another name renamed.
    removed and added are what no pass has paired; copied and glued sides count as paired.
    """
    left, right = (stored(x.select(*FILE), "files") for x in (left, right))  # contents are read and hashed once
    digest = stored(by_digest(left, right), "pairs")
    l, r = _rest(left, digest, 1), _rest(right, digest, 2)
    path = stored(by_path(l, r), "pairs")
    l, r = _rest(l, path, 1), _rest(r, path, 2)
    name = stored(by_name(l, r), "pairs")
    l, r = _rest(l, name, 1), _rest(r, name, 2)
    found = digest.unionByName(path).unionByName(name)
    if patterns:
        renamed = stored(by_rename_pattern(l, r, rename_patterns(found.filter("path1 <> path2"))), "pairs")
        found = found.unionByName(renamed)
        l, r = _rest(l, renamed, 1), _rest(r, renamed, 2)
    parent = lambda c: F.regexp_extract(c, "^(.*)/[^/]*$", 1)
    base = lambda c: F.regexp_extract(c, "([^/]*)$", 1)
    modified = found.filter("class = 'modified'")
    also = modified.filter(parent("path1") != parent("path2")).withColumn("class", F.lit("moved")).unionByName(modified.filter(base("path1") != base("path2")).withColumn("class", F.lit("renamed")))
    nothing = F.lit(None).cast("string")
    removed = l.select(F.lit("removed").alias("class"), F.col("path").alias("path1"), nothing.alias("path2"))
    added = r.select(F.lit("added").alias("class"), nothing.alias("path1"), F.col("path").alias("path2"))
    return found.unionByName(also).unionByName(removed).unionByName(added)


def class_counts(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("class").agg(F.count(F.lit(1)).alias("n"))
