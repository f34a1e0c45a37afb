"""Source trees, version control listings and syntax trees in XML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import digest


def read_tree(spark: SparkSession, root: str, version: str, how: str = "GIT", glob: str | None = None) -> DataFrame:
    """(version, path, dir, name, content, digest, bytes) of the files below a folder."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    d = r.load(root)
    base = F.regexp_replace(F.lit(root), r"^[a-z]+://[^/]*|^[a-z]+:|/+$", "")
    full = F.regexp_replace("path", r"^[a-z]+:/*", "/")
    path = F.substring(full, F.length(F.regexp_replace(base, "/+$", "")) + 2, F.length(full))
    d = d.select(F.lit(version).alias("version"), path.alias("path"), F.col("content"), F.col("length").alias("bytes"))
    return d.select("version", "path", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("dir"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "content", digest("content", how).alias("digest"), "bytes")


AUXILIARY = [".orig", ".rej", ".bak", "~", ".swp"]


def without_auxiliary(files: DataFrame, suffixes: list[str] | None = None) -> DataFrame:
    keep = F.lit(True)
    for s in suffixes or AUXILIARY:
        keep &= ~F.col("name").endswith(s)
    return files.filter(keep)


def selected(files: DataFrame, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """Files below one of the included paths (all, if none is given) and below none of the excluded ones."""
    below = lambda paths: F.coalesce(*(F.when(F.col("path").startswith(p), F.lit(True)) for p in paths), F.lit(False))
    return files.filter((below(include) if include else F.lit(True)) & ~(below(exclude) if exclude else F.lit(False)))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Commits of a listing "hash<TAB>parents<TAB>seconds<TAB>offset<TAB>author<TAB>subject", one a line."""
    return spark.read.csv(path, sep="\t", quote="", schema="commit string, parents string, seconds long, offset int, author string, subject string").withColumn("parents", F.split("parents", " "))


def read_listing(spark: SparkSession, path: str) -> DataFrame:
    """Tree entries of a listing "commit<TAB>mode<SPACE>kind<SPACE>object<TAB>path"."""
    d = spark.read.csv(path, sep="\t", quote="", schema="commit string, entry string, path string")
    e = F.split("entry", " ")
    return d.select("commit", e[0].alias("mode"), e[1].alias("kind"), e[2].alias("object"), "path")


def read_ast_xml(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).load(path)


def work_left(pairs: DataFrame, results: DataFrame) -> DataFrame:
    """Pairs (digest1, digest2) without a result yet: what a cache of results leaves to do."""
    return pairs.join(results.select("digest1", "digest2"), ["digest1", "digest2"], "left_anti")
