"""In-memory fixtures: nodes and edges given as Python values, their schema inferred."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from ..functions import values as V
from ..operators.shapes import Scalar
from ..schema import AdapterSchema, Attribute, Edge, View, namespaced
from .graph import EdgeListGraph


@dataclass(frozen=True)
class NodeSpec:
    local: str
    kind: str
    attributes: dict = field(default_factory=dict)
    uri: str | None = None
    revision: str | None = None


@dataclass(frozen=True)
class EdgeSpec:
    name: str
    role: str
    source: str
    target: str
    ordinal: float | None = None


def inferred_schema(namespace: str, nodes: list[NodeSpec], edges: list[EdgeSpec], ordering: str) -> AdapterSchema:
    kinds: dict[str, list[NodeSpec]] = {}
    for n in nodes:
        kinds.setdefault(namespaced(n.kind), []).append(n)
    made = {}
    for kind, members in kinds.items():
        attrs = {}
        for name in dict.fromkeys(a for n in members for a in n.attributes):
            have = [n.attributes[name] for n in members if name in n.attributes]
            many = any(isinstance(x, (list, tuple)) for x in have)
            tags = {V.tag_of(i) for x in have for i in (x if isinstance(x, (list, tuple)) else [x])} or {"null"}
            attrs[name] = Attribute(frozenset(tags), many, len(have) == len(members))
        made[kind] = attrs
    kind_of = {n.local: n.kind for n in nodes}
    by_name: dict[str, list[EdgeSpec]] = {}
    for e in edges:
        by_name.setdefault(namespaced(e.name), []).append(e)
    declared = {}
    for name, own in by_name.items():
        if len({e.role for e in own}) > 1:
            raise ValueError(f"edge {name} has more than one role")
        declared[name] = Edge(name, own[0].role, tuple(dict.fromkeys(kind_of[e.source] for e in own)), tuple(dict.fromkeys(kind_of[e.target] for e in own)), ordering)
    children = tuple(n for n, e in declared.items() if e.role == "child")
    views = {f"{namespace}::default": View(f"{namespace}::default", children, True)} if children else {}
    return AdapterSchema(namespace, made, declared, views, ordering=ordering, dynamic=True)


def representation(a: Attribute) -> Scalar:
    """Native column for one scalar type, tagged struct for a union, null or mixed cardinality."""
    tags = set(a.tags)
    if len(tags) == 1 and tags <= set(V.SQL_TYPE):
        return Scalar("", next(iter(tags)), a.many, "missing")
    return Scalar("", None, a.many, "missing")


def column_type(s: Scalar) -> str:
    if s.tag is None:
        return V.TAGGED
    return f"array<{V.SQL_TYPE[s.tag]}>" if s.many else V.SQL_TYPE[s.tag]


def column_value(s: Scalar, x):
    if s.tag is None:
        return V.tagged_row(x)
    one = {"number": float, "bigint": lambda v: V.Decimal(int(v))}.get(s.tag, lambda v: v)
    if s.many:
        return [one(i) for i in (x if isinstance(x, (list, tuple)) else [x])]
    return one(x)


def in_memory(spark: SparkSession, namespace: str, nodes: list[NodeSpec], edges: list[EdgeSpec] = (), roots: list[str] = (), resource: str = "memory:fixture", ordering: str = "stable", schema: AdapterSchema | None = None) -> EdgeListGraph:
    """A graph over fixtures; unknown or repeated members raise ValueError."""
    nodes, edges, roots = list(nodes), list(edges), list(roots)
    seen = {n.local for n in nodes}
    if len(seen) != len(nodes):
        raise ValueError("two nodes share a local identifier")
    for e in edges:
        if e.source not in seen or e.target not in seen:
            raise ValueError(f"edge {e.name} has an unknown end")
    for r in roots:
        if r not in seen:
            raise ValueError(f"unknown root {r}")
    schema = schema or inferred_schema(namespace, nodes, edges, ordering)
    attrs = {n: representation(a) for n, a in schema.all_attributes().items()}
    columns = "adapter string, resource string, local string, kind string, uri string, revision string" + "".join(f", `@{n}` {column_type(s)}" for n, s in attrs.items())
    rows = [(namespace, resource, n.local, n.kind, n.uri, n.revision, *[column_value(s, n.attributes[a]) if a in n.attributes else None for a, s in attrs.items()]) for n in nodes]
    positions: dict[tuple, int] = {}
    edge_rows = []
    for e in sorted(edges, key=lambda x: x.ordinal or 0):
        at = positions[e.source] = positions.get(e.source, -1) + 1
        edge_rows.append((e.name, e.role, resource, e.source, resource, e.target, at))
    graph = EdgeListGraph(
        spark,
        schema,
        spark.createDataFrame(rows, columns),
        spark.createDataFrame(edge_rows, "name string, role string, from_resource string, from_local string, to_resource string, to_local string, pos long"),
        spark.createDataFrame([(resource, r, i) for i, r in enumerate(roots)], "resource string, local string, position long"),
        attrs,
    )
    graph.heights = _Heights(edges)
    return graph


class _Heights(dict):
    """Longest walk along a set of edges; None where there is a cycle."""

    def __init__(self, edges):
        super().__init__()
        self.edges = edges

    def get(self, key, default=None):
        if key not in self:
            names, direction = key
            self[key] = self._longest(names, direction)
        return self[key]

    def _longest(self, names, direction):
        if direction == "both":
            return None if any(e.name in names for e in self.edges) else 0
        out: dict[str, list[str]] = {}
        incoming: dict[str, int] = {}
        for e in self.edges:
            if e.name in names:
                a, b = (e.source, e.target) if direction == "forward" else (e.target, e.source)
                out.setdefault(a, []).append(b)
                incoming[b] = incoming.get(b, 0) + 1
                incoming.setdefault(a, incoming.get(a, 0))
        level = {n: 0 for n, k in incoming.items() if k == 0}
        ready, done = list(level), 0
        while ready:
            n = ready.pop()
            done += 1
            for m in out.get(n, []):
                level[m] = max(level.get(m, 0), level[n] + 1)
                incoming[m] -= 1
                if incoming[m] == 0:
                    ready.append(m)
        return max(level.values(), default=0) if done == len(incoming) else None
