"""Graph patterns as SQL text: the same steps as ``plans.pattern.Bindings``, over a table t(s, p, o) in DuckDB.

A rule's body asks for its steps by name, so that it can be run on either; what is compared is how
Spark and DuckDB carry the steps out, closures, inference and anti-joins included.
"""

from __future__ import annotations

from collections.abc import Iterable

from ..plans.infer import Ontology
from ..plans.rules import Rule
from ..plans.store import TYPE

DEEPEST = 30


def _quoted(x) -> str:
    return "'" + str(x).replace("'", "''") + "'" if isinstance(x, str) else str(x)


class Sql:
    """Solutions as the text of a query and its columns."""

    def __init__(self, ontology: Ontology, text: str | None = None, columns: tuple[str, ...] = ()):
        self.ontology, self.text, self.columns = ontology, text, columns

    # --- paths ---

    def _scan(self, names: Iterable[str]) -> str:
        return f"SELECT s, o FROM t WHERE p IN ({', '.join(map(_quoted, names))})"

    def _typed(self, cls: str, infer: bool = True) -> str:
        names = self.ontology.members(cls) if infer else [cls]
        return f"SELECT DISTINCT s FROM t WHERE p = 'a' AND o IN ({', '.join(map(_quoted, names))})"

    def _closure(self, inner: str) -> str:
        return f"SELECT * FROM (WITH RECURSIVE c(s, o) AS (SELECT s, o FROM ({inner}) UNION SELECT c.s, e.o FROM c JOIN ({inner}) e ON c.o = e.s) SELECT s, o FROM c)"

    def table(self, path: str) -> str:
        if "|" in path:
            return " UNION ALL ".join(f"SELECT s, o FROM ({self.table(p)})" for p in path.split("|"))
        if "/" in path:
            head, _, rest = path.partition("/")
            return f"SELECT a.s, b.o FROM ({self.table(head)}) a JOIN ({self.table(rest)}) b ON a.o = b.s"
        if path[0] == "^":
            return f"SELECT o AS s, s AS o FROM ({self.table(path[1:])})"
        if path[-1] in "+*":
            found = self._closure(self.table(path[:-1].strip("()").replace("~", "|")))
            if path[-1] == "+":
                return found
            return f"SELECT s, o FROM ({found}) WHERE s <> o UNION ALL SELECT s, s FROM (SELECT s FROM t UNION SELECT o FROM ({found})) n(s)"
        if path.rstrip("!") == TYPE:
            return self._scan([TYPE])
        return self._scan([path[:-1]] if path.endswith("!") else self.ontology.narrower(path))

    def _solve(self, pattern: str) -> "Sql":
        s, path, o = pattern.split()
        if path.rstrip("!") == TYPE and o[0] != "?":
            text = f"SELECT s, {_quoted(o)} AS o FROM ({self._typed(o, not path.endswith('!'))})"
        else:
            text = self.table(path)
        tests = [f"{end} = {_quoted(term)}" for end, term in (("s", s), ("o", o)) if term[0] != "?"] + (["s = o"] if s == o else [])
        named = {t[1:]: end for end, t in (("s", s), ("o", o)) if t[0] == "?"}
        where = f" WHERE {' AND '.join(tests)}" if tests else ""
        return self._with(f"SELECT {', '.join(f'{e} AS {n}' for n, e in named.items()) or 'true AS _'} FROM ({text}){where}", tuple(named) or ("_",))

    # --- steps ---

    def _with(self, text: str, columns: Iterable[str] | None = None) -> "Sql":
        return Sql(self.ontology, text, tuple(columns or self.columns))

    def join(self, other: "Sql", how: str = "inner") -> "Sql":
        if self.text is None:
            return other
        shared = [c for c in self.columns if c in other.columns]
        if not shared:
            raise ValueError("a pattern shares no variable with those before it")
        kind = {"inner": "JOIN", "left": "LEFT JOIN", "left_anti": "ANTI JOIN", "left_semi": "SEMI JOIN"}[how]
        more = () if how in ("left_anti", "left_semi") else tuple(c for c in other.columns if c not in self.columns)
        columns = [f"a.{c}" for c in self.columns] + [f"b.{c}" for c in more]
        on = " AND ".join(f"a.{c} = b.{c}" for c in shared)
        return self._with(f"SELECT {', '.join(columns)} FROM ({self.text}) a {kind} ({other.text}) b ON {on}", self.columns + more)

    def match(self, *patterns: str) -> "Sql":
        out, left = self, list(patterns)
        while left:
            ready = next((p for p in left if not out.columns or {t[1:] for t in p.split()[::2] if t[0] == "?"} & set(out.columns)), left[0])
            left.remove(ready)
            out = out.join(out._solve(ready))
        return out

    def fresh(self) -> "Sql":
        return Sql(self.ontology)

    def group(self, *patterns: str) -> "Sql":
        return self.fresh().match(*patterns)

    def optional(self, *patterns: str) -> "Sql":
        return self.join(self.group(*patterns), "left")

    def unless(self, *patterns: str) -> "Sql":
        return self.join(self.group(*patterns), "left_anti")

    def where_exists(self, *patterns: str) -> "Sql":
        return self.join(self.group(*patterns), "left_semi")

    def flag(self, name: str, *patterns: str) -> "Sql":
        other = self.group(*patterns)
        on = " AND ".join(f"a.{c} = b.{c}" for c in other.columns if c in self.columns)
        return self._with(f"SELECT a.*, EXISTS (SELECT 1 FROM ({other.text}) b WHERE {on}) AS {name} FROM ({self.text}) a", (*self.columns, name))

    def either(self, *groups) -> "Sql":
        tables = [self.group(*([g] if isinstance(g, str) else g)) for g in groups]
        columns = tuple(dict.fromkeys(c for t in tables for c in t.columns))
        parts = [f"SELECT {', '.join(c if c in t.columns else f'NULL AS {c}' for c in columns)} FROM ({t.text})" for t in tables]
        return self.join(self._with(" UNION ALL ".join(parts), columns))

    def plus(self, other: "Sql") -> "Sql":
        return self._with(f"SELECT {', '.join(self.columns)} FROM ({self.text}) UNION ALL SELECT {', '.join(self.columns)} FROM ({other.text})")

    def values(self, var: str, items: Iterable) -> "Sql":
        items = ", ".join(map(_quoted, items))
        if var in self.columns:
            return self.where(f"{var} IN ({items})")
        return self._with(f"SELECT *, unnest([{items}]) AS {var} FROM ({self.text})", (*self.columns, var))

    def where(self, condition: str) -> "Sql":
        return self._with(f"SELECT * FROM ({self.text}) WHERE {condition}")

    def bind(self, var: str, value: str) -> "Sql":
        others = tuple(c for c in self.columns if c != var)
        return self._with(f"SELECT {', '.join([*others, f'{value} AS {var}'])} FROM ({self.text})", (*others, var))

    def each(self, var: str, values: list[str]) -> "Sql":
        return self.bind(var, f"unnest([{', '.join(values)}])")

    def distinct(self, *variables: str) -> "Sql":
        return self._with(f"SELECT DISTINCT {', '.join(variables)} FROM ({self.text})", variables)

    def steps(self, pattern: str, var: str) -> "Sql":
        s, path, o = pattern.split()
        e = self.table(path)
        text = f"WITH RECURSIVE c(s, o, n) AS (SELECT s, o, 1 FROM ({e}) UNION SELECT c.s, e.o, c.n + 1 FROM c JOIN ({e}) e ON c.o = e.s WHERE c.n < {DEEPEST}) SELECT s AS {s[1:]}, o AS {o[1:]}, min(n) AS {var} FROM c GROUP BY s, o"
        return self.join(self._with(f"SELECT * FROM ({text})", (s[1:], o[1:], var)))

    def numbered(self, pattern: str, var: str, numbers: Iterable[int]) -> "Sql":
        s, prop, o = pattern.split()
        names = ", ".join(_quoted(f"{prop}{n}") for n in numbers)
        text = f"SELECT s AS {s[1:]}, CAST(substr(p, {len(prop) + 1}) AS INTEGER) AS {var}, o AS {o[1:]} FROM t WHERE p IN ({names})"
        return self.join(self._with(text, (s[1:], var, o[1:])))

    def classes(self, var: str, names: dict[str, str], name: str) -> "Sql":
        parts = [f"SELECT s AS {var}, {_quoted(value)} AS {name} FROM ({self._typed(cls)})" for cls, value in names.items()]
        return self.join(self._with(" UNION ALL ".join(parts), (var, name)))

    def only_one(self, keys: list[str], var: str) -> "Sql":
        k = ", ".join(keys)
        return self._with(f"SELECT {k}, min({var}) AS {var} FROM ({self.text}) GROUP BY {k} HAVING count(DISTINCT {var}) = 1", (*keys, var))


def rule_sql(rule: Rule, ontology: Ontology, facts: str) -> str:
    """The facts (s, p, o) that a rule adds to the table t, which ``facts`` defines as common table expressions."""
    solved = rule.body(Sql(ontology))
    parts = []
    for template in rule.templates:
        terms = [f"CAST({x[1:]} AS VARCHAR)" if x[0] == "?" else _quoted(x) for x in template.split()]
        parts.append("SELECT " + ", ".join(f"{x} AS {c}" for x, c in zip(terms, "spo")) + " FROM solved")
    return f"WITH {facts}, solved AS ({solved.text}) SELECT s, p, o FROM ({' UNION '.join(parts)}) WHERE s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL EXCEPT SELECT s, p, o FROM t"
