"""Graph patterns over a fact store, as DataFrame joins on shared variables.

A pattern is "subject path object".  Terms that begin with ``?`` are variables; others are
constants.  Paths: ``p`` (with narrower predicates), ``p!`` (that one only), ``p/q``, ``p|q``, ``^p``,
``p+`` and ``p*``; ``a`` is class membership, ``a!`` without inference.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from .closure import closure
from .store import TYPE, FactStore


#: Solutions with one value of a variable are dealt to so many tasks where both sides are multiplied.
SLICES = 16


class Paths:
    """(s, o) tables of path expressions; closures are kept for the store's present facts."""

    def __init__(self, store: FactStore):
        self.store = store
        self.kept: dict[str, DataFrame] = {}

    def table(self, path: str) -> DataFrame:
        path = path.strip()
        if "|" in path:
            parts = [self.table(p) for p in path.split("|")]
            out = parts[0]
            for p in parts[1:]:
                out = out.unionByName(p)
            return out
        if "/" in path:
            head, _, rest = path.partition("/")
            left, right = self.table(head), self.table(rest)
            return left.select("s", F.col("o").alias("m")).join(right.select(F.col("s").alias("m"), "o"), "m").select("s", "o")
        if path[0] == "^":
            return self.table(path[1:]).select(F.col("o").alias("s"), F.col("s").alias("o"))
        if path[-1] in "+*":
            if path not in self.kept:
                inner = path[:-1].strip("()").replace("~", "|")
                found = closure(self.table(inner), 1)
                if path[-1] == "*":  # no step at all: every subject reaches itself, whether it has such edges or not
                    nodes = self.store.facts().select("s").union(found.select("o")).distinct()
                    found = found.filter("s <> o").unionByName(nodes.select("s", F.col("s").alias("o")))
                self.kept[path] = found
            return self.kept[path]
        if path.rstrip("!") == TYPE:
            return self.store.scan(TYPE, infer=False)
        return self.store.scan(path.rstrip("!"), infer=not path.endswith("!"))


class Bindings:
    """Solutions of a conjunction of patterns: one column a variable."""

    def __init__(self, paths: Paths, rows: DataFrame | None = None):
        self.paths, self.rows = paths, rows

    def _solve(self, pattern: str) -> DataFrame:
        s, path, o = pattern.split()
        if path.rstrip("!") == TYPE and o[0] != "?":
            df = self.paths.store.typed(o, infer=not path.endswith("!")).withColumn("o", F.lit(o))
        else:
            df = self.paths.table(path)
        for end, term in (("s", s), ("o", o)):
            if term[0] != "?":
                df = df.filter(F.col(end) == term)
        names = {"s": s, "o": o}
        if s == o:
            df = df.filter("s = o")
        columns = {t[1:]: F.col(e) for e, t in names.items() if t[0] == "?"}
        return df.select(*(c.alias(n) for n, c in columns.items())) if columns else df.select(F.lit(True).alias("_"))

    def _with(self, rows: DataFrame) -> "Bindings":
        return Bindings(self.paths, rows)

    def _join(self, other: DataFrame, how: str = "inner") -> "Bindings":
        if self.rows is None:
            return self._with(other)
        shared = [c for c in self.rows.columns if c in other.columns]
        if not shared:
            raise ValueError("a pattern shares no variable with those before it")
        return self._with(self.rows.join(other, shared, how))

    def match(self, *patterns: str) -> "Bindings":
        """Conjunction.  A pattern waits for one that shares a variable with what is bound."""
        out, left = self, list(patterns)
        while left:
            bound = set() if out.rows is None else set(out.rows.columns)
            ready = next((p for p in left if not bound or bound & {t[1:] for t in p.split()[::2] if t[0] == "?"}), left[0])
            left.remove(ready)
            out = out._join(out._solve(ready))
        return out

    def group(self, *patterns: str) -> DataFrame:
        return Bindings(self.paths).match(*patterns).rows

    def optional(self, *patterns: str) -> "Bindings":
        return self._join(self.group(*patterns), "left")

    def unless(self, *patterns: str) -> "Bindings":
        """NOT EXISTS: no solution of all these patterns together."""
        other = self.group(*patterns)
        return self._join(other.select(*[c for c in other.columns if c in self.rows.columns]).distinct(), "left_anti")

    def where_exists(self, *patterns: str) -> "Bindings":
        other = self.group(*patterns)
        return self._join(other.select(*[c for c in other.columns if c in self.rows.columns]).distinct(), "left_semi")

    def flag(self, name: str, *patterns: str) -> "Bindings":
        """A boolean column: whether a solution exists (for EXISTS under OR)."""
        other = self.group(*patterns)
        shared = [c for c in other.columns if c in self.rows.columns]
        marked = other.select(*shared).distinct().withColumn(name, F.lit(True))
        return self._with(self.rows.join(marked, shared, "left").withColumn(name, F.coalesce(name, F.lit(False))))

    def either(self, *groups: Iterable[str]) -> "Bindings":
        """UNION of groups, joined with what is bound; variables that a group lacks stay unbound."""
        tables = [self.group(*([g] if isinstance(g, str) else g)) for g in groups]
        out = tables[0]
        for t in tables[1:]:
            out = out.unionByName(t, allowMissingColumns=True)
        return self._join(out)

    def values(self, var: str, items: Iterable) -> "Bindings":
        """Inline relation: a variable that is bound is filtered, and else crossed with the fixed list."""
        items = list(items)
        if self.rows is not None and var in self.rows.columns:
            return self._with(self.rows.filter(F.col(var).isin(items)))
        return self._with(self.rows.withColumn(var, F.explode(F.array(*map(F.lit, items)))))

    def where(self, condition: str | Column) -> "Bindings":
        return self._with(self.rows.filter(condition))

    def bind(self, var: str, value: str | Column) -> "Bindings":
        return self._with(self.rows.withColumn(var, F.expr(value) if isinstance(value, str) else value))

    def each(self, var: str, values: list[str]) -> "Bindings":
        """A solution for each of these expressions' values."""
        return self._with(self.rows.withColumn(var, F.explode(F.array(*map(F.expr, values)))))

    def distinct(self, *variables: str) -> "Bindings":
        return self._with(self.rows.select(*variables).distinct())

    def fresh(self) -> "Bindings":
        """Without patterns so far, over the same facts."""
        return Bindings(self.paths)

    def join(self, other: "Bindings", how: str = "inner") -> "Bindings":
        """Natural join; ``how``: inner, left, left_anti."""
        return self._join(other.rows, how)

    def through(self, other: "Bindings", var: str) -> "Bindings":
        """Distinct solutions of a join on ``var``, their only shared variable, without it.

        What either side binds ``var`` to is gathered first, and of the values that two share only the least makes a
        row: so the rows, as many as the product of both sides, needn't be dealt to be distinct.
        """
        mine, theirs = ([c for c in b.rows.columns if c != var] for b in (self, other))
        if set(mine) & set(theirs):
            raise ValueError("the sides share more than one variable")

        def gathered(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
            d = rows.dropna(subset=[var]).groupBy(*keys).agg(F.collect_set(var).alias(name))
            return d.select(*keys, F.when(F.size(name) > 1, F.col(name)).alias(name), F.explode(name).alias(var))

        a = gathered(self.rows, mine, "a_").withColumn("slice_", F.pmod(F.xxhash64(*mine), F.lit(SLICES)).cast("int"))
        b = gathered(other.rows, theirs, "b_").withColumn("slice_", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))
        least = F.col("a_").isNull() | F.col("b_").isNull() | (F.array_min(F.array_intersect("a_", "b_")) == F.col(var))
        return self._with(a.join(b, [var, "slice_"]).filter(least).select(*mine, *theirs))

    def plus(self, other: "Bindings") -> "Bindings":
        """Solutions of either; both bind the same variables."""
        return self._with(self.rows.unionByName(other.rows))

    def steps(self, pattern: str, var: str) -> "Bindings":
        """Closure of a path, with the length of the shortest way."""
        s, path, o = pattern.split()
        found = closure(self.paths.table(path), 1, step=var)
        return self._join(found.withColumnRenamed("s", s[1:]).withColumnRenamed("o", o[1:]))

    def numbered(self, pattern: str, var: str, numbers: Iterable[int]) -> "Bindings":
        """Predicates that end in a number, such as child3; the number is bound too."""
        s, prop, o = pattern.split()
        found = self.paths.store.numbered([f"{prop}{n}" for n in numbers])
        number = F.substring("p", len(prop) + 1, 9).cast("int")
        return self._join(found.select(F.col("s").alias(s[1:]), number.alias(var), F.col("o").alias(o[1:])))

    def classes(self, var: str, names: dict[str, str], name: str) -> "Bindings":
        """Members of classes, narrower ones included, with a value for each class."""
        rows = None
        for cls, value in names.items():
            one = self.paths.store.typed(cls).select(F.col("s").alias(var), F.lit(value).alias(name))
            rows = one if rows is None else rows.unionByName(one)
        return self._join(rows)

    def only_one(self, keys: list[str], var: str) -> "Bindings":
        """Of keys with a single value of a variable: keys and value."""
        one = self.rows.groupBy(*keys).agg(F.count_distinct(var).alias("k_"), F.min(var).alias(var)).filter("k_ = 1")
        return self._with(one.select(*keys, var))


def construct(b: Bindings, template: str) -> DataFrame:
    """Facts of a template "subject predicate object"; ``?x`` and quoted SQL-free constants are allowed in all places."""
    terms = [F.col(t[1:]).cast("string") if t[0] == "?" else F.lit(t) for t in re.split(r"\s+", template.strip())]
    return b.rows.select(*(t.alias(n) for t, n in zip(terms, "spo")))
