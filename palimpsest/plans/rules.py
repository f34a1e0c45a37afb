"""Rules that derive facts, and their materialisation in rounds."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from .pattern import Bindings, Paths, construct
from .store import FactStore


@dataclass(frozen=True)
class Rule:
    """body: from empty bindings to solutions; templates: the facts that each solution gives."""

    name: str
    templates: tuple[str, ...]
    body: Callable[[Bindings], Bindings]

    def facts(self, store: FactStore, paths: Paths | None = None) -> DataFrame:
        solved = self.body(Bindings(paths or Paths(store)))
        out = construct(solved, self.templates[0])
        for t in self.templates[1:]:
            out = out.unionByName(construct(solved, t))
        return out


    def predicates(self) -> list[str] | None:
        """Those of its facts, if its templates say so."""
        names = [t.split()[1] for t in self.templates]
        return None if any(n[0] == "?" for n in names) else sorted(set(names))


class Agenda:
    """Runs rules, but none again before a predicate that it has read got new facts."""

    def __init__(self, store: FactStore):
        self.store = store
        self.last: dict[str, tuple[int, set[str]]] = {}  # rule: (step before it was run, what it read)

    def run(self, rule: Rule) -> int:
        step, reads = self.last.get(rule.name, (0, None))
        if reads is not None and not self.store.changed_since(step, reads):
            return 0
        self.store.reads = set()
        step, facts = self.store.step, rule.facts(self.store)
        self.last[rule.name] = step, self.store.reads
        return self.store.insert(facts, rule.predicates())


def materialize(store: FactStore, rules: list[Rule], rounds: int = 1, agenda: Agenda | None = None) -> int:
    """Runs the rules in order, ``rounds`` times; later rules see the facts of earlier ones.  Returns how many facts are new."""
    agenda = agenda or Agenda(store)
    return sum(agenda.run(r) for _ in range(rounds) for r in rules)


def fixpoint(store: FactStore, rules: list[Rule], most: int = 100) -> int:
    """Rounds until one adds nothing; returns their number.  In each, only rules run whose predicates got facts."""
    agenda = Agenda(store)
    for n in range(1, most + 1):
        if not materialize(store, rules, 1, agenda):
            return n
    raise RuntimeError("the rules don't come to an end")
