"""Shapes compiled to rule rows, which ``rules.violations`` checks by joins.

A shape with target classes yields a row for each of its constraints:

* a value's bounds on a path (``minInclusive``, ``minExclusive``, ``maxInclusive``, ``maxExclusive``);
* how many nodes on a path must or may conform to a qualified shape (``qualifiedMinCount``, ``qualifiedMaxCount``), which asks for
  a class, or for a label (``hasValue``, ``in``);
* ``node``: each node on a path has a class, or (``not``) has it not;
* ``or`` of a shape that denies a class and one that bounds a value: the bound holds for nodes of that class.

Shapes without targets only serve others. What is not known is an error, so that no constraint is dropped without a word.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import SparkSession

from ..sources.turtle import TYPE, Name, Statement, read_turtle

_SHACL = "http://www.w3.org/ns/shacl#"
_BOUNDS = {"minInclusive": "min", "minExclusive": "above", "maxInclusive": "max", "maxExclusive": "below"}
_SAID = {"message", "severity", "name", "description", "path"}

# Properties of nodes, and the columns that hold them; doors have theirs in millimetres.
_COLUMNS = {"hasArea": "area_m2", "hasShortSide": "short_side_m", "clearWidth": "clear_width_m"}


def column_of(path: str, targets: list[str]) -> str:
    if path == "hasShortSide" and all(t.endswith("Door") for t in targets):
        return "door_width_mm"
    return _COLUMNS.get(path, path)


class Compiled(NamedTuple):
    """Rows as in ``rules.RULES``, and the message of each rule."""

    rules: list[tuple]
    messages: dict[str, str]


class _Shapes:
    def __init__(self, found: list[Statement]) -> None:
        self.of: dict[Name, list[tuple[str, object]]] = {}
        for s, p, o in found:
            self.of.setdefault(s, []).append((p.removeprefix(_SHACL) if p.startswith(_SHACL) else "a" if p == TYPE else str(p), o))

    def values(self, node, key: str) -> list:
        return [o for k, o in self.of.get(node, []) if k == key]

    def one(self, node, key: str):
        found = self.values(node, key)
        if len(found) != 1:
            raise ValueError(f"{node}: {len(found)} values of {key}")
        return found[0]

    def only(self, node, allowed: set[str]) -> None:
        if more := {k for k, _ in self.of.get(node, [])} - allowed:
            raise ValueError(f"{node}: {', '.join(sorted(more))} is not known here")

    def asked(self, node) -> tuple[str, list[str]]:
        """What a qualified shape asks for: ("type", classes) or ("label", values)."""
        if self.values(node, "class"):
            self.only(node, {"class", "a"})
            return "type", [self.one(node, "class").local]
        inner = self.one(node, "property")
        self.only(node, {"property", "a"})
        self.only(inner, {"path", "hasValue", "in"})
        if self.one(inner, "path").local != "label":
            raise ValueError(f"{inner}: only labels can be asked for")
        return "label", list(self.one(inner, "in")) if self.values(inner, "in") else [self.one(inner, "hasValue")]

    def denied(self, node) -> list[str] | None:
        """The classes that a shape denies, if that is all it does."""
        found = self.values(node, "not")
        if not found:
            return None
        self.only(node, {"not", "a"})
        self.only(found[0], {"class", "a"})
        return [self.one(found[0], "class").local]

    def bounds(self, node, targets: list[str]) -> list[tuple[str, str, float]]:
        path = column_of(self.one(node, "path").local, targets)
        return [(_BOUNDS[k], path, float(v)) for k, v in self.of[node] if k in _BOUNDS]

    def constraints(self, node, targets: list[str]) -> list[tuple[str, str, list[str], float | None]]:
        """(kind, path, among, threshold) of a property shape's constraints."""
        self.only(node, {*_BOUNDS, *_SAID, "qualifiedValueShape", "qualifiedMinCount", "qualifiedMaxCount", "node", "a"})
        out: list = [(kind, path, [], value) for kind, path, value in self.bounds(node, targets)]
        path = self.one(node, "path").local
        for shape in self.values(node, "qualifiedValueShape"):
            what, among = self.asked(shape)
            for n in self.values(node, "qualifiedMinCount"):
                if n > 0:
                    out.append((f"some_{what}", path, among, None if n == 1 else float(n)))
            out += [(f"few_{what}", path, among, float(n)) for n in self.values(node, "qualifiedMaxCount")]
        for shape in self.values(node, "node"):
            denied = self.denied(shape)
            if denied is None:
                self.only(shape, {"class", "a"})
            out.append(("none_type", path, denied, None) if denied else ("all_type", path, [self.one(shape, "class").local], None))
        if not out:
            raise ValueError(f"{node}: a property without a constraint")
        return out

    def alternatives(self, node, items: tuple, targets: list[str]) -> list[tuple[str, str, list[str], float]]:
        denying = [d for x in items if (d := self.denied(x))]
        bounding = [x for x in items if self.denied(x) is None]
        if len(items) != 2 or len(denying) != 1:
            raise ValueError(f"{node}: an or of other than a denied class and a bound is not known")
        self.only(bounding[0], {"property", "a"})
        inner = self.one(bounding[0], "property")
        self.only(inner, {*_BOUNDS, *_SAID})
        return [(f"{kind}_if", path, denying[0], value) for kind, path, value in self.bounds(inner, targets)]


def compile_shapes(found: list[Statement], level: str, name: Callable[[str, int], str] | None = None) -> Compiled:
    """Rules of all shapes with targets, in order; ``name`` makes a rule's id of its shape's name and its place in it."""
    shapes = _Shapes(found)
    name = name or (lambda shape, k: f"{shape}.{k}")
    rules, messages = [], {}
    for node in shapes.of:
        targets = [t.local for t in shapes.values(node, "targetClass")]
        if not targets:
            continue
        shapes.only(node, {"targetClass", "property", "or", "a", *_SAID})
        place = 0
        for key, value in shapes.of[node]:
            made = shapes.constraints(value, targets) if key == "property" else shapes.alternatives(node, value, targets) if key == "or" else []
            for kind, path, among, threshold in made:
                place += 1
                rule = name(node.local, place)
                rules.append((rule, level, targets, kind, path, among, threshold))
                if said := shapes.values(value, "message") if key == "property" else shapes.values(node, "message"):
                    messages[rule] = said[0]
    return Compiled(rules, messages)


def read_shapes(spark: SparkSession, path: str) -> Compiled:
    """The rules of all Turtle files under the path; a file's name is its rules' level and begins their ids."""
    out = Compiled([], {})
    for level, found in read_turtle(spark, path).items():
        rules, messages = compile_shapes(found, level, lambda shape, k, level=level: f"{level}:{shape}.{k}")
        out.rules.extend(rules)
        out.messages.update(messages)
    return out
