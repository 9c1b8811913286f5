"""Fluent queries: an immutable plan, a DataFrame and the shape of its rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import values as V
from ..functions.values import Value
from ..plans.plan import PlanNode
from .shapes import PLACES, Absent, Grouped, Many, Node, Pair, Record, Scalar, fresh, infer, path_value, sub_shape

ORD = "_ord"


def then(*parts: Column) -> Column:
    """Order key of rows that come in the order of the present one, and then of ``parts``.

    Structs compare field by field, so a key never needs to be dense or global.
    """
    return F.struct(F.col(ORD).alias("a"), *[p.alias(f"b{i}") for i, p in enumerate(parts)])


class RowView:
    """What callbacks see: typed values of the current row and its captures."""

    def __init__(self, shape, captures):
        self.shape, self.captures = shape, captures

    def __getitem__(self, path: str) -> Value:
        return path_value(self.shape, path.split("."))

    def capture(self, name: str) -> RowView:
        if name not in self.captures:
            raise KeyError(f"unknown capture {name}")
        return RowView(self.captures[name], self.captures)

    @property
    def value(self) -> Value:
        return path_value(self.shape, [])

    @property
    def col(self) -> Column:
        return self.value.col

    @property
    def kind(self) -> Column:
        return self.shape.kind()

    @property
    def local(self) -> Value:
        return self.shape.part("local")

    @property
    def left(self) -> RowView:
        return RowView(self.shape.left, self.captures)

    @property
    def right(self) -> RowView:
        return RowView(self.shape.right, self.captures)

    @property
    def key(self) -> Value:
        return path_value(self.shape, ["key"])


def natural(n, what: str) -> int:
    if isinstance(n, bool) or not isinstance(n, int) or n < 0:
        raise TypeError(f"{what} must be a natural number")
    return n


class Query:
    """A lazy sequence of values.  Rows are bags; ``ordering`` says whether their order means anything."""

    def __init__(self, df: DataFrame, shape, plan: PlanNode, captures: dict | None = None):
        self.df, self.shape, self.plan, self.captures = df, shape, plan, dict(captures or {})

    #: The graph whose roots, all of them, these rows are.
    forest = None

    # -- introspection ----------------------------------------------------
    @property
    def ordering(self) -> str:
        return self.plan.ordering

    @property
    def view(self) -> RowView:
        return RowView(self.shape, self.captures)

    def explain(self) -> dict:
        return self.plan.explain()

    def carried(self) -> list[str]:
        """Columns that a step to other nodes keeps: the order key and what captures hold."""
        captured = {c for s in self.captures.values() for c in s.columns()}
        own = set(self.shape.columns()) - captured
        return [c for c in self.df.columns if c not in own]

    def _next(self, operator: str, df=None, shape=None, captures=None, ordering=None, details=None, inputs=None) -> Query:
        plan = PlanNode(operator, ordering or self.ordering, details or {}, inputs or (self.plan,))
        return Query(self.df if df is None else df, self.shape if shape is None else shape, plan, self.captures if captures is None else captures)

    def relabelled(self, plan: PlanNode) -> Query:
        return Query(self.df, self.shape, plan, self.captures)

    # -- the operators ----------------------------------------------------
    def filter(self, test: Callable[[RowView], Column] | Column, label: str = "") -> Query:
        cond = test(self.view) if callable(test) and not isinstance(test, Column) else test
        return self._next("filter", self.df.where(V.keeping(cond)), details={"label": label} if label else {})

    def project(self, make: Callable[[RowView], object], label: str = "") -> Query:
        df, shape = bound(self.df, make(self.view))
        return self._next("project", df, shape, details={"label": label} if label else {})

    def flat_map(self, make: Callable[[RowView], object], label: str = "") -> Query:
        """Zero or more values for each row, from an array column, a many-valued value or a list of values."""
        out = make(self.view)
        if isinstance(out, (list, tuple)):
            out = F.array(*[V.lift(x).col for x in out])
        elif isinstance(out, Value):
            out = out.col if out.tag is not None else out.col["m"]
        pos, name = fresh("pos"), fresh("item")
        df = self.df.select("*", F.posexplode(out).alias(pos, name)).withColumn(ORD, then(F.col(pos)))
        return self._next("flat-map", df, infer(df, name), details={"label": label} if label else {})

    def distinct(self, key: Callable[[RowView], Value] | None = None) -> Query:
        """The first row of each key; by default of each node or scalar.  Records never equal one another."""
        if key is not None:
            cols = [V.same_value_key(V.lift(key(self.view)))]
        elif isinstance(self.shape, Node):
            cols = [F.col(self.shape.cols[r]) for r in ("adapter", "resource", "local")]
        elif isinstance(self.shape, (Scalar, Absent)):
            cols = [V.same_value_key(self.view.value)] if isinstance(self.shape, Scalar) else [F.lit(0)]
        else:
            return self._next("distinct", details={"key": "identity"})
        n = fresh("n")
        df = self.df.withColumn(n, F.row_number().over(Window.partitionBy(*cols).orderBy(ORD))).where(F.col(n) == 1).drop(n)
        return self._next("distinct", df, details={"key": "identity" if key is None else "key"})

    def take(self, n: int) -> Query:
        natural(n, "take")
        df = self.df.orderBy(ORD).limit(n) if self.ordering == "stable" else self.df.limit(n)
        return self._next("take", df, details={"count": n})

    def count(self) -> Query:
        name = fresh("count")
        df = self.df.agg(F.count(F.lit(1)).alias(name)).withColumn(ORD, F.array(F.lit(0).cast("bigint")))
        return self._next("count", df, Scalar(name, "number", null_is="never"), {}, "stable")

    def group_by(self, key: Callable[[RowView], Value]) -> Query:
        """Groups in order of first appearance, their values in order."""
        k = V.lift(key(self.view))
        name, values = fresh("key"), fresh("values")
        element = self._element()
        df = self.df.withColumn(name, V.same_value_key(k))
        df = df.groupBy(name).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(ORD).alias("o"), element.alias("v")))), lambda x: x["v"]).alias(values), F.min(ORD).alias(ORD))
        shape = Grouped(Scalar(name, k.tag if k.tag in V.SQL_TYPE else None, null_is=k.null_is), values, None)
        return self._next("group", df, shape, {}, "stable" if self.ordering == "stable" else "unknown")

    def _element(self) -> Column:
        if isinstance(self.shape, Scalar):
            return F.col(self.shape.name)
        if isinstance(self.shape, Node):
            return F.struct(*[F.col(c).alias(r) for r, c in self.shape.cols.items()], *[F.col(a.name).alias(f"@{n}") for n, a in self.shape.attrs.items()])
        return F.struct(*[F.col(c) for c in self.shape.columns()])

    def sort(self, *keys: Callable[[RowView], Value] | Column, label: str = "") -> Query:
        """Stable ascending sort; a callback may give a Column (``.desc()`` and the like) or a value."""
        made = [k(self.view) if callable(k) and not isinstance(k, Column) else k for k in keys]
        details = {"label": label} if label else {}
        if all(isinstance(m, Value) for m in made):
            parts = [p for m in made for p in V.order_parts(m)]
            key = F.struct(*[p.alias(f"k{i}") for i, p in enumerate(parts)], F.col(ORD).alias("a"))
            return self._next("sort", self.df.withColumn(ORD, key), ordering="stable", details=details)
        # a sort expression with a direction of its own: rows are sorted over all tasks and numbered where they lie
        cols = [c for m in made for c in ([p.asc() for p in V.order_parts(m)] if isinstance(m, Value) else [m])]
        return self._next("sort", self.df.orderBy(*cols, ORD).withColumn(ORD, F.monotonically_increasing_id()), ordering="stable", details=details)

    def capture(self, name: str) -> Query:
        if not name or not isinstance(name, str):
            raise TypeError("a capture needs a name")
        if name in self.captures:
            raise TypeError(f"duplicate capture {name}")
        return self._next("capture", captures={**self.captures, name: self.shape}, details={"name": name})

    def join(self, right: Query, left_key: Callable[[RowView], Value], right_key: Callable[[RowView], Value], label: str = "") -> Query:
        """Inner join on equal keys; nulls, missing values and NaN equal themselves, types never mix."""
        shared = self.captures.keys() & right.captures.keys()
        if shared:
            raise TypeError(f"captures on both sides: {sorted(shared)}")
        return self._join(right.detached(self.df), left_key, right_key, label)

    def _join(self, right: Query, left_key, right_key, label) -> Query:
        lk, rk = left_key(self.view), right_key(right.view)
        other = fresh("ord")
        df = self.df.join(right.df.withColumnRenamed(ORD, other), V.same_value(V.lift(lk), V.lift(rk)))
        df = df.withColumn(ORD, then(F.col(other))).drop(other)
        ordering = "stable" if self.ordering == right.ordering == "stable" else "unknown"
        return self._next("join", df, Pair(self.shape, right.shape), {**self.captures, **right.captures}, ordering, {"label": label} if label else {}, (self.plan, right.plan))

    def detached(self, from_df: DataFrame | None = None) -> Query:
        """The same rows under new column names, for joins of a query with itself."""
        names = [c for c in self.df.columns if c != ORD]
        taken = set(from_df.columns) if from_df is not None else set(names)
        m = {c: fresh(c.lstrip("_0123456789") or "c") for c in names if c in taken}
        df = self.df.select(ORD, *[F.col(c).alias(m.get(c, c)) for c in names])
        return Query(df, self.shape.renamed(m), self.plan, {k: s.renamed(m) for k, s in self.captures.items()})

    def traverse(self, edges=None, roles=None, direction: str = "forward", max_depth: int = 1, include_self: bool = False) -> Query:
        """Every path of up to ``max_depth`` edges, in pre-order; a node reached twice appears twice."""
        natural(max_depth, "max_depth")
        if not isinstance(self.shape, Node):
            raise TypeError("only nodes can be traversed")
        out = self.shape.graph.traverse(self, edges, roles, direction, max_depth, include_self)
        details = {"direction": direction, "maxDepth": max_depth, "includeSelf": include_self}
        if edges is not None:
            details["edges"] = list(edges)
        if roles is not None:
            details["roles"] = list(roles)
        return self._next("traverse", out.df, out.shape, details=details)

    # -- results ----------------------------------------------------------
    def ordered(self) -> DataFrame:
        """The DataFrame in the order of the query, if it has one."""
        return self.df.orderBy(ORD) if self.ordering == "stable" else self.df

    def dataframe(self, **fields) -> DataFrame:
        """Flat columns of a record (or of ``fields``: name to callback), without order; missing becomes NULL."""
        if fields:
            df, cols = self.df, []
            for n, make in fields.items():
                made = make(self.view)
                cols.append((made.col if isinstance(made, Value) else made).alias(n))
            return df.select(*cols)
        return self.df.select(*flat_columns(self.shape, ""))

    def ranked(self, name: str = "rank", **fields) -> DataFrame:
        """:meth:`dataframe` with the place of each row in the order of the query, from 1."""
        q = self._next("filter", self.df.withColumn("_rank", F.row_number().over(Window.orderBy(ORD))))
        return q.dataframe(**{name: lambda _: F.col("_rank")}, **(fields or {n: (lambda r, n=n: r[n]) for n in getattr(self.shape, "fields", {})}))

    def collect(self) -> list:
        """Python values in order: nodes and records as dictionaries, missing fields left out."""
        cols = list(dict.fromkeys([*self.shape.columns(), *(c for s in self.captures.values() for c in s.columns())]))
        df = self.ordered().select(*cols) if cols else self.ordered().select(F.lit(1).alias("_"))
        return [reading(self.shape, r) for r in df.collect()]

    def collect_with_captures(self) -> list[tuple]:
        cols = list(dict.fromkeys([*self.shape.columns(), *(c for s in self.captures.values() for c in s.columns())]))
        return [(reading(self.shape, r), {k: reading(s, r) for k, s in self.captures.items()}) for r in self.ordered().select(*cols).collect()]

    def iterate(self):
        cols = list(dict.fromkeys(self.shape.columns()))
        for r in self.ordered().select(*cols).toLocalIterator():
            yield reading(self.shape, r)


_GONE = object()


def reading(shape, row):
    out = _read(shape, row)
    return None if out is _GONE else out


def _plain(x, tag):
    if tag == "number" and x is not None and not isinstance(x, (int, float)):
        return float(x)
    if tag == "bigint" and x is not None:
        return V.BigInt(int(x))
    return x


def _untag(x):
    if x["t"] == "many":
        return [_untag({**i.asDict(), "m": None}) for i in x["m"]]
    got = next((x[p] for p in "snbi" if x[p] is not None), None)
    return _plain(got, x["t"])


def _read(shape, row):
    if isinstance(shape, Absent):
        return _GONE
    if isinstance(shape, Scalar):
        x = row[shape.name]
        if x is None:
            return None if shape.null_is == "null" or shape.tag == "null" else _GONE
        if shape.many and shape.tag is not None:
            return [_plain(i, shape.tag) for i in x]
        if isinstance(x, (list,)):
            return [_tree(i) for i in x]
        return _plain(x, shape.tag) if shape.tag is not None else (_untag(x) if hasattr(x, "t") or "t" in getattr(x, "__fields__", ()) else _tree(x))
    if isinstance(shape, Node):
        part = lambda r: row[shape.cols[r]] if r in shape.cols else None
        attributes = {k: _read(a, row) for k, a in shape.attrs.items()}
        out = {"id": {r: part(r) for r in ("adapter", "resource", "local")}, "kind": part("kind"), "attributes": {k: v for k, v in attributes.items() if v is not _GONE}}
        if part("uri") is not None:
            out["origin"] = {"uri": part("uri"), **({"revision": part("revision")} if part("revision") is not None else {})}
            if part("start") is not None:
                out["origin"]["range"] = {r: part(r) for r in PLACES if part(r) is not None}
        return out
    if isinstance(shape, Record):
        got = {k: _read(f, row) for k, f in shape.fields.items()}
        return {k: v for k, v in got.items() if v is not _GONE}
    if isinstance(shape, Pair):
        return [reading(shape.left, row), reading(shape.right, row)]
    if isinstance(shape, Grouped):
        return {"key": reading(shape.key, row), "values": [_tree(x) for x in row[shape.name]]}
    if isinstance(shape, Many):
        return [reading(shape.element, x) for x in row[shape.name]]
    raise TypeError(shape)


def _tree(x):
    """A collected column as Python values."""
    if hasattr(x, "asDict"):
        f = x.__fields__
        if set("tsnbi") <= set(f):
            return _untag({**{p: x[p] for p in "tsnbi"}, "m": x["m"] if "m" in f else None})
        return {k: _tree(x[k]) for k in f}
    return [_tree(i) for i in x] if isinstance(x, list) else x


def flat_columns(shape, prefix: str) -> list[Column]:
    if isinstance(shape, Scalar):
        return [F.col(shape.name).alias(prefix or "value")]
    if isinstance(shape, Record):
        return [c for k, f in shape.fields.items() for c in flat_columns(f, f"{prefix}_{k}" if prefix else k)]
    if isinstance(shape, Pair):
        return [*flat_columns(shape.left, prefix + "left"), *flat_columns(shape.right, prefix + "right")]
    if isinstance(shape, Node):
        return [F.col(c).alias(f"{prefix}_{r}" if prefix else r) for r, c in shape.cols.items()] + [F.col(a.name).alias(f"{prefix}_{n}" if prefix else n) for n, a in shape.attrs.items()]
    if isinstance(shape, Many):
        return [F.col(shape.name).alias(prefix or "values")]
    if isinstance(shape, Grouped):
        return [*flat_columns(shape.key, prefix + "key"), F.col(shape.name).alias(prefix + "values")]
    return [F.lit(None).cast("string").alias(prefix or "value")]


def bound(df: DataFrame, made):
    """(df with the columns of ``made``, shape): made is a value, a column, a view or a dictionary of such."""
    if isinstance(made, dict):
        fields = {}
        for k, v in made.items():
            df, fields[k] = bound(df, v)
        return df, Record(fields)
    if isinstance(made, RowView):
        return df, made.shape
    if isinstance(made, (Node, Record, Pair, Grouped, Scalar, Absent, Many)):
        return df, made
    if isinstance(made, Value):
        if made.tag == "missing":
            return df, Absent()
        name = fresh("p")
        if made.tag == "null":
            return df.withColumn(name, F.lit(None).cast("string")), Scalar(name, "null", null_is="null")
        return df.withColumn(name, made.col), Scalar(name, made.tag, made.many, "never" if made.literal else made.null_is)
    if isinstance(made, Column):
        name = fresh("p")
        df = df.withColumn(name, made)
        return df, infer(df, name)
    return bound(df, V.literal(made))


def from_dataframe(df: DataFrame, order: list[str] | None = None, label: str = "values", details: dict | None = None) -> Query:
    """A query over the rows of a DataFrame: a record of its columns, or a scalar if it has one; ``order`` makes it stable."""
    m = {c: fresh(c) for c in df.columns}
    out = df.select(*[F.col(f"`{c}`").alias(m[c]) for c in df.columns])
    fields = {c: replace(infer(out, m[c]), null_is="null") for c in df.columns}
    for c in df.columns:
        if fields[c].tag == "string" and not isinstance(out.schema[m[c]].dataType, T.StringType):
            out = out.withColumn(m[c], F.date_format(m[c], "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    ord_ = F.array(*[F.col(m[c]).cast("bigint") for c in order]) if order else F.array(F.monotonically_increasing_id())
    shape = Record(fields) if len(fields) > 1 else next(iter(fields.values()))
    return Query(out.withColumn(ORD, ord_), shape, PlanNode("source", "stable" if order else "unknown", {"label": label, **(details or {})}))


class Deferred(Query):
    """A source whose rows are made when they are first needed; ``take`` on it makes no more than it takes.

    make(limit) gives the query of the first ``limit`` rows, or of all.
    """

    def __init__(self, make, plan: PlanNode, limit: int | None = None):
        self._make, self.plan, self._limit, self._made = make, plan, limit, None

    def _real(self) -> Query:
        if self._made is None:
            self._made = self._make(self._limit)
        return self._made

    df = property(lambda self: self._real().df)
    shape = property(lambda self: self._real().shape)
    captures = property(lambda self: self._real().captures)

    def take(self, n: int) -> Query:
        natural(n, "take")
        limit = n if self._limit is None else min(n, self._limit)
        return Deferred(self._make, PlanNode("take", self.ordering, {"count": n}, (self.plan,)), limit)


def from_values(spark: SparkSession, values, ordering: str = "stable", label: str = "values", details: dict | None = None) -> Query:
    """A query over Python scalars, in their order; a callable is called when rows are needed.

    ``take`` right after it draws no further value, so that the source may be endless.
    """
    if callable(values):
        plan = PlanNode("source", ordering, {"label": label, **(details or {})})
        return Deferred(lambda limit: from_values(spark, list(islice(values(), limit)), ordering, label, details), plan)
    items = list(values)
    tags = {V.tag_of(x) for x in items} or {"number"}
    name = fresh("value")
    if len(tags) == 1 and tags <= set(V.SQL_TYPE):
        tag = next(iter(tags))
        rows = [([i], {"number": float, "bigint": lambda v: V.Decimal(int(v))}.get(tag, lambda v: v)(x)) for i, x in enumerate(items)]
        df = spark.createDataFrame(rows, f"{ORD} array<bigint>, {name} {V.SQL_TYPE[tag]}")
        shape = Scalar(name, tag, null_is="never")
    else:
        rows = [([i], V.tagged_row(x)) for i, x in enumerate(items)]
        df = spark.createDataFrame(rows, f"{ORD} array<bigint>, {name} {V.TAGGED}")
        shape = Scalar(name, None)
    return Query(df, shape, PlanNode("source", ordering, {"label": label, **(details or {})}))


# free-function twins of the methods
def filter(q, test, label=""):  # noqa: A001
    return q.filter(test, label)


def project(q, make, label=""):
    return q.project(make, label)


def flat_map(q, make, label=""):
    return q.flat_map(make, label)


def distinct(q, key=None):
    return q.distinct(key)


def take(q, n):
    return q.take(n)


def count(q):
    return q.count()


def group_by(q, key):
    return q.group_by(key)


def sort(q, *keys, label=""):
    return q.sort(*keys, label=label)


def capture(q, name):
    return q.capture(name)


def join(left, right, left_key, right_key, label=""):
    return left.join(right, left_key, right_key, label)


def traverse(q, **how):
    return q.traverse(**how)


__all__ = ["Query", "RowView", "bound", "from_dataframe", "from_values", "sub_shape"]
