"""Class and property hierarchies.

Vocabularies are small, so that their closures are made on the driver; a pattern then asks for the
members of a class or property with an IN list that reaches the scan.
"""

from __future__ import annotations

from dataclasses import dataclass, field

#: Sub-properties and super-properties that every fact store knows (fixed values).
PROPERTIES = """
subClassOf subTypeOf
subInterfaceOf subTypeOf
child0 child
child1 child
child2 child
child3 child
child4 child
child5 child
inFile containedIn
inSourceTree containedIn
mappedEqTo mappedTo
mappedNeqTo mappedTo
mappedTo correspondsTo
modified correspondsTo
copiedTo correspondsTo
gluedTo correspondsTo
deletedFrom deletedOrPruned
prunedFrom deletedOrPruned
deletedOrPruned removal
insertedInto insertedOrGrafted
graftedOnto insertedOrGrafted
insertedOrGrafted addition
renamed relabeled
changedTo relabeled
abstractedTo relabeled
foldedInto relabeled
relabeled mappingChange
movRelabeled movedTo
movRelabeled relabeled
"""


def pairs(text: str) -> list[tuple[str, str]]:
    return [tuple(line.split()) for line in text.strip().splitlines()]


def reach(edges: list[tuple[str, str]]) -> dict[str, set[str]]:
    """For each upper name, all names below it and itself."""
    below: dict[str, set[str]] = {}
    for lower, upper in edges:
        below.setdefault(upper, set()).add(lower)
    out = {}
    for top in below:
        seen, todo = {top}, [top]
        while todo:
            for x in below.get(todo.pop(), ()):
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        out[top] = seen
    return out


@dataclass
class Ontology:
    """Declared sub-class and sub-property edges."""

    classes: list[tuple[str, str]] = field(default_factory=list)
    properties: list[tuple[str, str]] = field(default_factory=lambda: pairs(PROPERTIES))

    def __post_init__(self) -> None:
        self._classes, self._properties = reach(self.classes), reach(self.properties)

    def members(self, cls: str) -> list[str]:
        return sorted(self._classes.get(cls, {cls}))

    def narrower(self, prop: str) -> list[str]:
        return sorted(self._properties.get(prop, {prop}))
