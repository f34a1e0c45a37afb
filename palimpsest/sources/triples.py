"""Triple files: one line a triple (gzip or not), Turtle-like predicates aside; and rotation, merging, bulk load, dump."""

from __future__ import annotations

import gzip
import os
import uuid
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import escape_literal, unescape_literal
from ..plans.store import FactStore
from ..session import qualified, ship

#: Facts a file, as the fact tools write them by default.
FACTS_A_FILE = 1000
LINE = r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(?:<([^>]*)>|(_:\S+)|"((?:[^"\\]|\\.)*)"(?:\^\^<([^>]*)>|@(\S+))?)\s*\.\s*$'


def read_triples(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(s, p, o, literal, datatype) of all lines of all files under a path; comments and broken lines are left out (``broken_lines`` has the latter).

    literal: whether o is a literal.  Files are found recursively; ``.gz`` ones are unpacked.
    """
    r = spark.read.option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    g = lambda i: F.regexp_extract("value", LINE, i)
    d = r.text(path).filter(F.col("value").rlike(LINE))
    subject = F.regexp_replace(g(1), r"^<(.*)>$", "$1")
    resource = F.concat(g(3), g(4))
    literal = (resource == "") & F.col("value").rlike(r'"\S*\s*\.\s*$|@\S+\s*\.\s*$')
    return d.select(subject.alias("s"), g(2).alias("p"), F.when(literal, unescape_literal(g(5))).otherwise(resource).alias("o"), literal.alias("literal"), F.nullif(g(6), F.lit("")).alias("datatype"))


def triple_line(literal: str = "literal", datatype: str = "datatype"):
    """A line for columns s, p, o, and whether o is a literal and of what type."""
    subject = F.when(F.col("s").startswith("_:"), F.col("s")).otherwise(F.concat(F.lit("<"), "s", F.lit(">")))
    typed = F.when(F.col(datatype).isNotNull(), F.concat(F.lit("^^<"), datatype, F.lit(">"))).otherwise("")
    text = F.concat(F.lit('"'), escape_literal("o"), F.lit('"'), typed)
    node = F.when(F.col("o").startswith("_:"), F.col("o")).otherwise(F.concat(F.lit("<"), "o", F.lit(">")))
    return F.concat(subject, F.lit(" <"), "p", F.lit("> "), F.when(F.col(literal), text).otherwise(node), F.lit(" ."))


def write_triples(facts: DataFrame, path: str, facts_a_file: int = FACTS_A_FILE, compression: str = "gzip", by: list[str] | None = None) -> None:
    """Files of at most ``facts_a_file`` lines; ``by``: folders by version or cache name.  A null in s, p or o (a ghost) drops the triple."""
    d = facts.dropna(subset=["s", "p", "o"]).select(triple_line().alias("value"), *(by or []))
    if not by and compression in _PACK and (folder := qualified(facts.sparkSession, path)).startswith("file:"):
        return _write_folder(d, unquote(urlsplit(folder).path), facts_a_file, compression)
    w = d.write.mode("append").option("maxRecordsPerFile", facts_a_file).option("compression", compression)
    (w.partitionBy(*by) if by else w).text(path)


#: How a file is packed, and how its name ends.
_PACK = {"gzip": (lambda text: gzip.compress(text, 6, mtime=0), ".txt.gz"), "none": (bytes, ".txt")}


def _write_folder(lines: DataFrame, folder: str, lines_a_file: int, compression: str) -> None:
    """Many small files in a folder that all executors see as theirs.  Without its native library Hadoop starts a process for each file there, and it writes a checksum file too.

    A task's files have hidden names until all are written; their names and number are the same in each attempt.
    """
    ship(lines.sparkSession)
    run, (pack, suffix) = uuid.uuid4().hex, _PACK[compression]

    def write(batches):
        task = TaskContext.get()
        named: list[tuple[str, str]] = []

        def flush(some: list[str]) -> None:
            name = f"part-{task.partitionId():05d}-{run}-c{len(named):06d}{suffix}"
            named.append((os.path.join(folder, f".{name}.{task.taskAttemptId()}"), os.path.join(folder, name)))
            with open(named[-1][0], "wb") as f:
                f.write(pack(("\n".join(some) + "\n").encode()))

        held: list[str] = []
        try:
            for batch in batches:
                held += batch.column(0).to_pylist()
                while len(held) >= lines_a_file:
                    flush(held[:lines_a_file])
                    del held[:lines_a_file]
            if held:
                flush(held)
        except BaseException:
            for hidden, _ in named:
                os.path.exists(hidden) and os.remove(hidden)
            raise
        for hidden, name in named:
            os.replace(hidden, name)
        yield pa.RecordBatch.from_pydict({"files": pa.array([len(named)], pa.int64())})

    lines.mapInArrow(write, "files long").agg(F.sum("files")).collect()


def merge(spark: SparkSession, paths: list[str], out: str, files: int) -> None:
    """The distinct lines of many fact folders, in a given number of files."""
    spark.read.option("recursiveFileLookup", "true").text(paths).distinct().repartition(files).write.option("compression", "gzip").text(out)


def load(spark: SparkSession, path: str, store: FactStore, glob: str | None = None) -> int:
    """Bulk load into a store, all files in one job; loading again adds nothing."""
    return store.insert(read_triples(spark, path, glob).select("s", "p", "o"))


def broken_lines(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(file, line) of the lines that read_triples leaves out, but for empty ones and comments."""
    r = spark.read.option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    d = r.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
    return d.filter(~F.col("line").rlike(LINE) & ~F.col("line").rlike(r"^\s*(#.*)?$"))


def dump(store: FactStore, path: str, facts_a_file: int = FACTS_A_FILE) -> None:
    """All facts of a store as triple files; predicates and nodes are written as they are named, and objects that no fact is about as literals."""
    facts = store.facts()
    nodes = facts.select(F.col("s").alias("o")).distinct().withColumn("known_", F.lit(True))
    d = facts.join(nodes, "o", "left").select("s", "p", "o", F.col("known_").isNull().alias("literal"), F.lit(None).cast("string").alias("datatype"))
    write_triples(d, path, facts_a_file)
