"""Text reports of differs, pair lists, and result sinks."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

#: Counters of a statistics text, by the label in front of them (fixed values).
COUNTERS = {"nodes": r"nodes: (\d+) and (\d+)", "deletes": r"deletes\s*:\s*(\d+)", "inserts": r"inserts\s*:\s*(\d+)", "relabels": r"relabels\s*:\s*(\d+)", "moves": r"moves?\s*:\s*(\d+)", "mapping": r"mapping size\s*:\s*(\d+)"}


def read_statistics(spark: SparkSession, path: str) -> DataFrame:
    """One row a file: its counters; null where one isn't there."""
    d = spark.read.text(path, wholetext=True).withColumn("file", F.col("_metadata.file_path"))
    number = lambda pattern, i=1: F.nullif(F.regexp_extract("value", pattern, i), F.lit("")).try_cast("long")
    return d.select("file", number(COUNTERS["nodes"]).alias("n1"), number(COUNTERS["nodes"], 2).alias("n2"), *(number(p).alias(n) for n, p in COUNTERS.items() if n != "nodes"))


def read_edits(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no is not kept) op, label, gid, range of DELETE and INSERT lines."""
    line = r"^(DELETE|INSERT)\s+(\S+)\s+(\d+)(?:\s+\[([\d-]+)\])?"
    d = spark.read.text(path).withColumn("file", F.col("_metadata.file_path")).filter(F.col("value").rlike(line))
    return d.select("file", F.regexp_extract("value", line, 1).alias("op"), F.regexp_extract("value", line, 2).alias("label"), F.regexp_extract("value", line, 3).cast("int").alias("gid"), F.nullif(F.regexp_extract("value", line, 4), F.lit("")).alias("range"))


def named_or_large(edits: DataFrame, size: str = "size", least: int = 5) -> DataFrame:
    """Edits of nodes with a name, or of subtrees of at least ``least`` nodes."""
    return edits.filter((F.col("label") != "") | (F.col(size) >= least))


def read_pairs(spark: SparkSession, path: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """(file1, file2) of a CSV list: its first and last columns, or those that are named."""
    d = spark.read.csv(path, header=True)
    return d.select(F.col(first or d.columns[0]).alias("file1"), F.col(last or d.columns[-1]).alias("file2"))


def write_classes(pairs: DataFrame, path: str) -> None:
    """CSV files in a folder for each file class."""
    pairs.write.partitionBy("class").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def _report(lines: DataFrame, order: list, path: str) -> None:
    """One text file; a report is small."""
    lines.repartitionByRange(1, *order).sortWithinPartitions(*order).select("value").write.text(path)


def dot_lines(edges: DataFrame, source: str, target: str, label: str | None = None, name: str = "g") -> DataFrame:
    """(section, value): lines of a DOT graph of the distinct edges."""
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.replace(F.col(c).cast("string"), F.lit("\\"), F.lit("\\\\")), '"', '\\\\"'), F.lit('"'))
    mark = F.concat(F.lit(" [label="), quoted(label), F.lit("]")) if label else F.lit("")
    body = edges.select(F.lit(1).alias("section"), F.concat(F.lit("  "), quoted(source), F.lit(" -> "), quoted(target), mark, F.lit(";")).alias("value")).distinct()
    ends = edges.sparkSession.createDataFrame([(0, f"digraph {name} {{"), (2, "}")], "section int, value string")
    return body.unionByName(ends)


def write_dot(edges: DataFrame, path: str, source: str, target: str, label: str | None = None, name: str = "g") -> None:
    _report(dot_lines(edges, source, target, label, name), ["section", "value"], path)


def html_lines(df: DataFrame, title: str, order: list[str]) -> DataFrame:
    """(section, place, value): lines of a page with a table of all rows, in this order."""
    escaped = lambda c: F.replace(F.replace(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    cells = F.concat(*(F.concat(F.lit("<td>"), escaped(F.col(c)), F.lit("</td>")) for c in df.columns))
    body = df.select(F.lit(1).alias("section"), F.row_number().over(W.orderBy(*order)).alias("place"), F.concat(F.lit("<tr>"), cells, F.lit("</tr>")).alias("value"))
    head = "".join(f"<th>{escape(c)}</th>" for c in df.columns)
    ends = [(0, 0, f"<!DOCTYPE html><html><head><meta charset=\"utf-8\"><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1><table>"), (0, 1, f"<tr>{head}</tr>"), (2, 0, "</table></body></html>")]
    return body.unionByName(df.sparkSession.createDataFrame(ends, "section int, place int, value string"))


def write_html(df: DataFrame, path: str, title: str, order: list[str]) -> None:
    _report(html_lines(df, title, order), ["section", "place"], path)
