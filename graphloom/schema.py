"""Adapter schemas: kinds, attributes, edges, tree views, operations and capabilities."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from .diagnostics import LoomError

TAGS = ("string", "number", "boolean", "bigint", "null")
_NAME = re.compile(r"^[A-Za-z][A-Za-z0-9_-]*::[A-Za-z_][A-Za-z0-9_.-]*$")


def namespaced(name: str) -> str:
    if not isinstance(name, str) or not _NAME.match(name):
        raise ValueError(f"not a namespaced name: {name!r}")
    return name


@dataclass(frozen=True)
class Attribute:
    """Declared type of an attribute: scalar tags, one or many, required or optional."""

    tags: frozenset[str]
    many: bool = False
    required: bool = True

    def __post_init__(self):
        if not self.tags or not self.tags <= set(TAGS):
            raise ValueError(f"unknown scalar types {sorted(self.tags)}")

    def merged(self, other: Attribute) -> Attribute:
        return Attribute(self.tags | other.tags, self.many or other.many, self.required and other.required)


def attr(*tags: str, many: bool = False, required: bool = True) -> Attribute:
    return Attribute(frozenset(tags), many, required)


@dataclass(frozen=True)
class Edge:
    name: str
    role: str
    sources: tuple[str, ...]
    targets: tuple[str, ...]
    ordering: str = "stable"


@dataclass(frozen=True)
class View:
    name: str
    edges: tuple[str, ...]
    default: bool = False


@dataclass(frozen=True)
class AdapterSchema:
    namespace: str
    kinds: dict[str, dict[str, Attribute]]
    edges: dict[str, Edge] = field(default_factory=dict)
    views: dict[str, View] = field(default_factory=dict)
    operations: tuple[str, ...] = ()
    ordering: str = "stable"
    pushdown: tuple[str, ...] = ()
    transactions: str = "none"
    dynamic: bool = False

    def __post_init__(self):
        for kind in self.kinds:
            if namespaced(kind).split("::")[0] != self.namespace and not self.dynamic:
                raise ValueError(f"kind {kind} is outside the namespace {self.namespace}")
        for e in self.edges.values():
            namespaced(e.name)
            if e.role not in ("child", "reference"):
                raise ValueError(f"edge {e.name} has the unknown role {e.role}")
            for k in (*e.sources, *e.targets):
                if k not in self.kinds and not self.dynamic:
                    raise ValueError(f"edge {e.name} names the unknown kind {k}")
        if sum(v.default for v in self.views.values()) > 1:
            raise ValueError("more than one default tree view")
        for v in self.views.values():
            for name in v.edges:
                if name not in self.edges:
                    raise ValueError(f"view {v.name} names the unknown edge {name}")
        for op in self.operations:
            namespaced(op)

    def attribute(self, name: str, kind: str | None = None) -> Attribute | None:
        """Declared type of an attribute in one kind, or the union over all that have it."""
        found = None
        for k, attrs in self.kinds.items():
            if (kind is None or k == kind) and name in attrs:
                found = attrs[name] if found is None else found.merged(attrs[name])
        return found

    def all_attributes(self) -> dict[str, Attribute]:
        names = dict.fromkeys(n for attrs in self.kinds.values() for n in attrs)
        return {n: self.attribute(n) for n in names}

    def child_edges(self, view: str | None = None) -> tuple[str, ...]:
        """Edges that a child step follows: those of the view, else of the default view, else all of role child."""
        if view is not None:
            if view not in self.views:
                raise LoomError("dsl.unknown-tree-view", f"unknown tree view {view}")
            return self.views[view].edges
        for v in self.views.values():
            if v.default:
                return v.edges
        return tuple(e.name for e in self.edges.values() if e.role == "child")

    def composite(self, other: AdapterSchema) -> AdapterSchema:
        """Schema of this graph with another one mounted in it."""
        edges = {**self.edges, **other.edges}
        view = View("composite::tree", tuple(dict.fromkeys([*self.child_edges(), *other.child_edges()])), True)
        return replace(
            self,
            kinds={**self.kinds, **other.kinds},
            edges=edges,
            views={**{n: replace(v, default=False) for n, v in {**self.views, **other.views}.items()}, view.name: view},
            operations=(*self.operations, *other.operations),
            ordering="stable" if self.ordering == other.ordering == "stable" else "unknown",
            pushdown=(),
            transactions="none",
            dynamic=True,
        )


def check_schema(schema: AdapterSchema) -> AdapterSchema:
    """Contract check for schemas from outside: raises ValueError on the first fault."""
    if not isinstance(schema, AdapterSchema):
        raise ValueError("not an AdapterSchema")
    schema.__post_init__()
    return schema
