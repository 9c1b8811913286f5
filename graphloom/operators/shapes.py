"""Shapes: which columns of a DataFrame hold a query's value and captures."""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import MISSING, Value, native

_count = itertools.count(1)


def fresh(name: str = "x") -> str:
    """A column name that no other column has."""
    return f"_{next(_count)}_{''.join(c if c.isalnum() else '_' for c in name)}"


@dataclass(frozen=True)
class Scalar:
    name: str
    tag: str | None
    many: bool = False
    null_is: str = "missing"

    def value(self) -> Value:
        return Value(F.col(self.name), self.tag, self.many, self.null_is)

    def columns(self):
        return [self.name]

    def renamed(self, m):
        return replace(self, name=m.get(self.name, self.name))


@dataclass(frozen=True)
class Absent:
    """A value that is missing in every row."""

    def value(self) -> Value:
        return MISSING

    def columns(self):
        return []

    def renamed(self, m):
        return self


#: Where a node stands in its text, in UTF-16 units; lines and columns count from 0.
PLACES = ("start", "end", "startLine", "startColumn", "endLine", "endColumn")
ROLES = ("adapter", "resource", "local", "kind", "uri", "revision", *PLACES)


@dataclass(frozen=True)
class Node:
    """A node: its columns by role, its attributes by name, its graph."""

    cols: dict
    attrs: dict
    graph: object = field(compare=False)
    keys: dict = field(default_factory=dict)
    kind_name: str | None = None  # known when the plan is made, for tables of one kind

    def attr(self, name: str) -> Value:
        a = self.attrs.get(name)
        return a.value() if a is not None else MISSING

    def part(self, role: str) -> Value:
        name = self.cols.get(role)
        if name is None:
            return MISSING
        return native(F.col(name), "number" if role in PLACES else "string", null_is="never" if role in ("adapter", "resource", "local", "kind") else "missing")

    def kind(self) -> Column:
        return F.col(self.cols["kind"])

    def key(self, name: str) -> Column:
        return F.col(self.keys[name])

    def columns(self):
        return [*self.cols.values(), *(c for a in self.attrs.values() for c in a.columns()), *self.keys.values()]

    def renamed(self, m):
        sub = lambda d: {k: m.get(v, v) for k, v in d.items()}
        return replace(self, cols=sub(self.cols), attrs={k: a.renamed(m) for k, a in self.attrs.items()}, keys=sub(self.keys))


@dataclass(frozen=True)
class Record:
    fields: dict

    def columns(self):
        return [c for f in self.fields.values() for c in f.columns()]

    def renamed(self, m):
        return Record({k: f.renamed(m) for k, f in self.fields.items()})


@dataclass(frozen=True)
class Pair:
    left: object
    right: object

    def columns(self):
        return [*self.left.columns(), *self.right.columns()]

    def renamed(self, m):
        return Pair(self.left.renamed(m), self.right.renamed(m))


@dataclass(frozen=True)
class Grouped:
    """A key and the array of the values that share it."""

    key: object
    name: str
    element: str | None

    def columns(self):
        return [*self.key.columns(), self.name]

    def renamed(self, m):
        return replace(self, key=self.key.renamed(m), name=m.get(self.name, self.name))


@dataclass(frozen=True)
class Many:
    """An array of values of one shape, each packed in a struct."""

    name: str
    element: object

    def columns(self):
        return [self.name]

    def renamed(self, m):
        return replace(self, name=m.get(self.name, self.name))


def infer(df: DataFrame, name: str) -> Scalar:
    """Type of a computed column in the terms of the model."""
    kind = df.schema[name].dataType
    many = isinstance(kind, T.ArrayType)
    return Scalar(name, _tag(kind.elementType if many else kind), many)


def _tag(kind) -> str | None:
    if isinstance(kind, T.StringType):
        return "string"
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, T.DecimalType):
        return "bigint" if kind.scale == 0 and kind.precision == 38 else "number"
    if isinstance(kind, T.NumericType):
        return "number"
    if isinstance(kind, T.NullType):
        return "null"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "string"
    return None


def path_value(shape, path: list[str]) -> Value:
    """Scalar at a path of attribute or field names; missing where there is none."""
    if not path:
        return shape.value() if isinstance(shape, (Scalar, Absent)) else MISSING
    head, rest = path[0], path[1:]
    if isinstance(shape, Node):
        if head == "origin":
            return shape.part(rest[0]) if len(rest) == 1 and rest[0] in ("uri", "revision") else _struct_identity(shape, rest)
        if head == "id":
            return shape.part(rest[0]) if len(rest) == 1 and rest[0] in ("adapter", "resource", "local") else _struct_identity(shape, rest)
        return shape.attr(head) if not rest else MISSING
    if isinstance(shape, Record):
        inner = shape.fields.get(head)
        return path_value(inner, rest) if inner is not None else MISSING
    if isinstance(shape, Grouped) and head == "key":
        return path_value(shape.key, rest)
    return MISSING


def _struct_identity(shape, rest) -> Value:
    """Whole ``id`` or ``origin``: objects, which equal nothing in keys."""
    return MISSING


def sub_shape(shape, path: list[str]):
    """Shape at a path, for projections that keep structure."""
    if not path:
        return shape
    if isinstance(shape, Record) and path[0] in shape.fields:
        return sub_shape(shape.fields[path[0]], path[1:])
    if isinstance(shape, Node) and path == ["id"]:
        return Record({r: Scalar(shape.cols[r], "string", null_is="never") for r in ("adapter", "resource", "local")})
    if isinstance(shape, Node) and path == ["origin"]:
        have = {r: shape.cols[r] for r in ("uri", "revision") if r in shape.cols}
        return Record({r: Scalar(c, "string") for r, c in have.items()})
    return None
