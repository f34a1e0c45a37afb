"""Facts as a table of subject, predicate and object, laid out by predicate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import scratch, stored
from .infer import Ontology

TYPE = "a"
ANY = "*"
#: A predicate's facts go to so many tasks at most when they are written anew.
FILES_A_PREDICATE = 64


class FactStore:
    """A set of facts (s, p, o).  Files are partitioned by predicate, so that a pattern reads its own only.

    Objects are strings; numbers are written in decimal and cast where they are compared.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, ontology: Ontology | None = None):
        self.spark, self.path, self.ontology = spark, path or scratch(spark, "facts"), ontology or Ontology()
        self.schema = "s string, o string, p string"
        self.empty = spark.createDataFrame([], self.schema)
        self.written = path is not None
        #: Whether all facts came by way of this object, so that changed has all predicates.
        self.own = path is None
        #: Predicates read since reads was last emptied, and the step at which each last got facts.
        self.reads: set[str] = set()
        self.changed: dict[str, int] = {}
        self.step = 0
        self._read: DataFrame | None = None

    @classmethod
    def of(cls, facts: DataFrame, ontology: Ontology | None = None) -> "FactStore":
        store = cls(facts.sparkSession, ontology=ontology)
        store.insert(facts)
        return store

    def facts(self) -> DataFrame:
        self.reads.add(ANY)
        return self._facts()

    def _facts(self) -> DataFrame:
        """Files are listed once for all scans between two changes."""
        if not self.written:
            return self.empty
        if self._read is None:
            self._read = self.spark.read.schema(self.schema).parquet(self.path)
        return self._read

    def scan(self, prop: str, infer: bool = True) -> DataFrame:
        """(s, o) of a predicate and, with ``infer``, of all narrower ones."""
        return self.numbered(self.ontology.narrower(prop) if infer else [prop]).select("s", "o")

    def numbered(self, names: list[str]) -> DataFrame:
        """(s, p, o) of some predicates."""
        self.reads.update(names)
        return self._facts().filter(F.col("p").isin(names))

    def typed(self, cls: str, infer: bool = True) -> DataFrame:
        """(s) of the members of a class and, with ``infer``, of all narrower ones."""
        names = self.ontology.members(cls) if infer else [cls]
        out = self.numbered([TYPE]).filter(F.col("o").isin(names)).select("s")
        return out.distinct() if len(names) > 1 else out

    def new(self, facts: DataFrame, predicates: list[str] | None = None, distinct: bool = False) -> DataFrame:
        """Those of the facts that aren't in the store: distinct, without nulls (a template with an unbound variable gives none).

        ``predicates``: those that the facts can have, if that is known; then only their files are read, and
        nothing where the store never got any.  ``distinct``: whether the facts are so already.
        """
        f = facts.select("s", "p", "o").dropna()
        f = f if distinct else f.distinct()
        if predicates is not None and self.own and not self.changed.keys() & set(predicates):
            return f
        known = self._facts()
        if predicates is not None:
            known = known.filter(F.col("p").isin(predicates))
        return f.join(known, ["s", "p", "o"], "left_anti")

    def insert(self, facts: DataFrame, predicates: list[str] | None = None) -> int:
        """Add facts; the store stays a set.  Returns how many are new; where there are none, nothing is written."""
        out = self.new(facts, predicates) if self.written else facts.select("s", "p", "o").dropna().distinct()
        out = stored(out, "new-facts")
        counts = {r["p"]: r["count"] for r in out.groupBy("p").count().collect()}  # one row a predicate
        if counts or not self.written:
            out.select("s", "o", "p").repartition("p").write.mode("append").option("compression", "zstd").partitionBy("p").parquet(self.path)
            self.written, self._read = True, None
        self.step += 1
        self.changed |= dict.fromkeys(counts, self.step)
        return sum(counts.values())

    def changed_since(self, step: int, predicates: set[str]) -> bool:
        """Whether any of these predicates (ANY: any at all) got facts after a step."""
        return any(n > step and (ANY in predicates or p in predicates) for p, n in self.changed.items())

    def compact(self) -> None:
        """Write the facts anew, a file or a few for each predicate."""
        path = scratch(self.spark, "facts")
        self._facts().repartition("p", F.pmod(F.xxhash64("s"), F.lit(FILES_A_PREDICATE))).write.option("compression", "zstd").partitionBy("p").parquet(path)
        self.path, self._read = path, None

    def count(self) -> int:
        return self._facts().count()

    def clear(self, prop: str) -> None:
        """Drop a predicate's facts: the others are written anew under another path."""
        rest = self._facts().filter(F.col("p") != prop)
        self.step += 1
        self.changed[prop] = self.step
        path = scratch(self.spark, "facts")
        rest.write.option("compression", "zstd").partitionBy("p").parquet(path)
        self.path, self._read = path, None

    def views(self, prefix: str = "") -> list[str]:
        """Register a temporary view (s, o) for each predicate, for ad-hoc SQL; returns their names."""
        names = [r["p"] for r in self.facts().select("p").distinct().orderBy("p").collect()]
        for p in names:
            self.scan(p, infer=False).createOrReplaceTempView(f"{prefix}{p}")
        return names

    def query(self, sql: str) -> DataFrame:
        """SQL over the predicates' views."""
        self.views()
        return self.spark.sql(sql)


def guarded(facts: DataFrame, version: str = "version") -> DataFrame:
    """Facts that hold in a version only, as (s, p, o, version) rows: no blank nodes are needed."""
    return facts.select("s", "p", "o", F.col(version).alias("version")).dropna().distinct()
