"""Git and Subversion histories as tables.

Git is read with its own command, from a repository (bare or not) on storage that all executors
reach; commits, pairs and files are dealt to tasks, and each task starts the command for its rows.

    python -m palimpsest.sources.git REPOSITORY log|tree|cat|diff|blame ...
"""

from __future__ import annotations

import argparse
import subprocess
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import ship

COMMIT = "commit string, parents array<string>, seconds long, offset int, author string, subject string"
ENTRY = "commit string, mode string, kind string, object string, bytes long, path string"
CHANGE = "commit1 string, commit2 string, status string, score int, object1 string, object2 string, path1 string, path2 string"
BLAME = "commit string, path string, line int, since string, author string, seconds long, text string"


def run_git(repository: str, *arguments: str, given: bytes | None = None) -> bytes:
    done = subprocess.run(["git", "-C", repository, *arguments], input=given, capture_output=True)
    if done.returncode:
        raise RuntimeError(f"git {' '.join(arguments[:2])}: {done.stderr.decode('utf-8', 'replace').strip()}")
    return done.stdout


def _text(raw: bytes) -> str:
    return raw.decode("utf-8", "replace")


def _records(raw: bytes) -> list[str]:
    return [_text(x) for x in raw.split(b"\0") if x]


def parse_log(raw: bytes) -> list[tuple]:
    out = []
    for record in _records(raw):
        commit, parents, seconds, date, author, subject = record.lstrip("\n").split("\x1f", 5)
        zone = date.rsplit(" ", 1)[1]
        offset = (int(zone[1:3]) * 60 + int(zone[3:])) * (-1 if zone[0] == "-" else 1)
        out.append((commit, parents.split(), int(seconds), offset, author, subject))
    return out


def parse_changes(raw: bytes) -> list[tuple]:
    """(status, score, object1, object2, path1, path2) of a raw difference; a file that isn't on a side has no path there."""
    parts, out, i = _records(raw), [], 0
    while i < len(parts):
        _, _, object1, object2, status = parts[i].lstrip(":").split(" ")
        kind, score = status[0], int(status[1:]) if status[1:] else None
        first, second = (parts[i + 1], parts[i + 2]) if kind in "RC" else (parts[i + 1], parts[i + 1])
        i += 3 if kind in "RC" else 2
        out.append((kind, score, object1, object2, None if kind == "A" else first, None if kind == "D" else second))
    return out


def parse_blame(raw: bytes) -> list[tuple]:
    """(line, since, author, seconds, text) of lines with full headers."""
    out, head = [], {}
    for line in raw.split(b"\n"):
        if line[:1] == b"\t":
            out.append((head["line"], head["since"], head.get("author"), head.get("seconds"), _text(line[1:])))
            head = {}
        elif not head and line:
            words = line.split()
            head = {"since": _text(words[0]), "line": int(words[2])}
        elif line.startswith(b"author "):
            head["author"] = _text(line[7:])
        elif line.startswith(b"author-time "):
            head["seconds"] = int(line[12:])
    return out


def commits(spark: SparkSession, repository: str, revisions: str = "HEAD", *options: str) -> DataFrame:
    """Commits that a revision or a range (a..b) reaches; options are those of ``git log``, such as --since or a path."""
    form = "--format=%H%x1f%P%x1f%at%x1f%ad%x1f%an%x1f%s"
    return spark.createDataFrame(parse_log(run_git(repository, "log", "-z", "--date=iso", form, revisions, *options)), COMMIT)


def _each(df: DataFrame, columns: list[str], schema: str, rows: Callable[..., list[tuple]]) -> DataFrame:
    ship(df.sparkSession)
    names = [x.split()[0] for x in schema.replace("array<string>", "array").split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for key in zip(*(f[c] for c in columns)):
                yield pd.DataFrame([(*key, *r) for r in rows(*key)], columns=names)

    return df.select(*columns).mapInPandas(run, schema)


def entries(of: DataFrame, repository: str) -> DataFrame:
    """Files of the trees of commits (commit)."""

    def listed(commit: str) -> list[tuple]:
        out = []
        for record in _records(run_git(repository, "ls-tree", "-r", "-l", "-z", commit)):
            head, path = record.split("\t", 1)
            mode, kind, name, size = head.split()
            out.append((mode, kind, name, None if size == "-" else int(size), path))
        return out

    return _each(of, ["commit"], ENTRY, listed)


def search(files: DataFrame, pattern: str) -> DataFrame:
    """Entries whose path fits a pattern."""
    return files.filter(F.col("path").rlike(pattern))


def blobs(files: DataFrame, repository: str) -> DataFrame:
    """(object, content) of the distinct objects of entries; each batch is one call."""
    ship(files.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            raw, at, out = run_git(repository, "cat-file", "--batch", given="\n".join(f["object"]).encode() + b"\n"), 0, []
            for name in f["object"]:
                end = raw.index(b"\n", at)
                size = int(raw[at:end].split()[2])
                out.append((name, raw[end + 1 : end + 1 + size]))
                at = end + 2 + size
            yield pd.DataFrame(out, columns=["object", "content"])

    return files.filter("kind = 'blob'").select("object").distinct().mapInPandas(run, "object string, content binary")


def changes(pairs: DataFrame, repository: str) -> DataFrame:
    """Files that differ between the commits of pairs (commit1, commit2), renames found by git."""
    return _each(pairs, ["commit1", "commit2"], CHANGE, lambda a, b: parse_changes(run_git(repository, "diff-tree", "-r", "-M", "-z", "--no-commit-id", a, b)))


def blame(files: DataFrame, repository: str) -> DataFrame:
    """Lines of files (commit, path) with the commit that they come from."""
    return _each(files, ["commit", "path"], BLAME, lambda commit, path: parse_blame(run_git(repository, "blame", "--line-porcelain", commit, "--", path)))


def read_svn_log(spark: SparkSession, path: str) -> DataFrame:
    """(revision, author, date, message, action, copied_from, path) of the changed paths of histories as Subversion prints them in XML, with its option for paths."""
    schema = "_revision long, author string, date string, msg string, paths struct<path array<struct<_VALUE string, _action string, `_copyfrom-path` string>>>"
    d = spark.read.format("xml").option("rowTag", "logentry").schema(schema).load(path)
    d = d.select(F.col("_revision").alias("revision"), "author", "date", F.col("msg").alias("message"), F.explode_outer("paths.path").alias("p"))
    return d.select("revision", "author", "date", "message", F.col("p._action").alias("action"), F.col("p.`_copyfrom-path`").alias("copied_from"), F.col("p._VALUE").alias("path"))


def read_svn_listing(spark: SparkSession, path: str) -> DataFrame:
    """(kind, name, size, revision) of listings as Subversion prints them in XML."""
    schema = "_kind string, name string, size long, commit struct<_revision long>"
    d = spark.read.format("xml").option("rowTag", "entry").schema(schema).load(path)
    return d.select(F.col("_kind").alias("kind"), "name", "size", F.col("commit._revision").alias("revision"))


def main(arguments: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    p.add_argument("repository")
    commands = p.add_subparsers(dest="command", required=True)
    for name, more in (("log", ["revisions"]), ("tree", ["commit"]), ("cat", ["object"]), ("diff", ["commit1", "commit2"]), ("blame", ["commit", "path"])):
        c = commands.add_parser(name)
        for x in more:
            c.add_argument(x)
    a = p.parse_args(arguments)
    if a.command == "log":
        for commit, _, seconds, _, author, subject in parse_log(run_git(a.repository, "log", "-z", "--date=iso", "--format=%H%x1f%P%x1f%at%x1f%ad%x1f%an%x1f%s", a.revisions)):
            print(commit, seconds, author, subject, sep="\t")
    elif a.command == "tree":
        print("\n".join(_records(run_git(a.repository, "ls-tree", "-r", "-z", a.commit))))
    elif a.command == "cat":
        print(_text(run_git(a.repository, "cat-file", "-p", a.object)), end="")
    elif a.command == "diff":
        for row in parse_changes(run_git(a.repository, "diff-tree", "-r", "-M", "-z", "--no-commit-id", a.commit1, a.commit2)):
            print(*("" if x is None else x for x in row), sep="\t")
    else:
        for row in parse_blame(run_git(a.repository, "blame", "--line-porcelain", a.commit, "--", a.path)):
            print(*row, sep="\t")


if __name__ == "__main__":
    main()
