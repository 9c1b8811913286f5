"""SQL catalogs as graphs, and declarative row queries over their tables.

A row query becomes one DataFrame: Catalyst and the data source push its parts
down.  Values are literals of the plan and parameters of the shown text, never
pasted into SQL.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.query import ORD, Query
from ..operators.shapes import Node, Scalar, fresh
from ..plans.plan import PlanNode
from .memory import EdgeSpec, NodeSpec, in_memory

SCALARS = ("string", "number", "boolean")
OPERATORS = ("=", "!=", "<", "<=", ">", ">=", "like")
FUNCTIONS = ("count", "sum", "min", "max", "avg")


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    scalar: str
    nullable: bool = False


@dataclass(frozen=True)
class TableSpec:
    name: str
    columns: tuple[ColumnSpec, ...]
    primary_key: tuple[str, ...] = ()
    revision: str | None = None
    estimated_rows: int | None = None

    def column(self, name: str) -> ColumnSpec | None:
        return next((c for c in self.columns if c.name == name), None)


@dataclass(frozen=True)
class Relation:
    name: str
    source: tuple[str, str, str]  # schema, table, column
    target: tuple[str, str, str]


@dataclass(frozen=True)
class Catalog:
    server: str
    database: str
    version: str
    schemas: dict[str, tuple[TableSpec, ...]]
    relations: tuple[Relation, ...] = ()

    def __post_init__(self):
        for name, tables in self.schemas.items():
            if len({t.name for t in tables}) != len(tables):
                raise TypeError(f"schema {name} has a table twice")
            for t in tables:
                if not t.columns or len({c.name for c in t.columns}) != len(t.columns):
                    raise TypeError(f"table {t.name} needs columns with different names")
                for c in t.columns:
                    if c.scalar not in SCALARS:
                        raise TypeError(f"column {c.name} has the unknown type {c.scalar}")
                for k in (*t.primary_key, *([t.revision] if t.revision else [])):
                    if t.column(k) is None:
                        raise TypeError(f"table {t.name} has no column {k}")
        for r in self.relations:
            for schema, table, column in (r.source, r.target):
                if self.table(schema, table).column(column) is None:
                    raise TypeError(f"relation {r.name} names an unknown column")

    def table(self, schema: str, name: str) -> TableSpec:
        found = next((t for t in self.schemas.get(schema, ()) if t.name == name), None)
        if found is None:
            raise TypeError(f"unknown table {schema}.{name}")
        return found


def catalog_of(spark: SparkSession, tables: dict[str, DataFrame], keys: dict[str, tuple] | None = None, relations=(), database: str = "tables", schema: str = "public", version: str = "1") -> Catalog:
    """A catalog from DataFrames: their columns of the model's types."""
    specs = []
    for name, df in tables.items():
        cols = []
        for c, kind in df.dtypes:
            scalar = "string" if kind == "string" or kind.startswith(("timestamp", "date")) else "boolean" if kind == "boolean" else "number" if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal") else None
            if scalar:
                cols.append(ColumnSpec(c, scalar, False))
        specs.append(TableSpec(name, tuple(cols), tuple((keys or {}).get(name, ()))))
    return Catalog("local", database, version, {schema: tuple(specs)}, tuple(relations))


# -- predicates ---------------------------------------------------------------------


@dataclass(frozen=True)
class Compare:
    column: object
    operator: str
    value: object


@dataclass(frozen=True)
class In:
    column: object
    values: tuple


@dataclass(frozen=True)
class IsNull:
    column: object
    negated: bool = False


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


@dataclass(frozen=True)
class Not:
    part: object


@dataclass(frozen=True)
class Join:
    table: tuple[str, str]
    left: str
    right: str
    kind: str = "inner"


@dataclass(frozen=True)
class Aggregate:
    function: str
    name: str
    column: object = None


@dataclass(frozen=True)
class RowQuery:
    """Rows of a table: projection, predicate, star joins, one aggregate, order, limit and offset."""

    table: tuple[str, str]
    select: tuple = ()
    where: object = None
    joins: tuple[Join, ...] = ()
    order_by: tuple[tuple[object, str], ...] = ()
    aggregate: Aggregate | None = None
    limit: int | None = None
    offset: int | None = None
    runtime: Callable | None = None


@dataclass(frozen=True)
class _Bound:
    schema: str
    spec: TableSpec

    @property
    def alias(self) -> str:
        return self.spec.name


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _value(v):
    if isinstance(v, float) and not math.isfinite(v):
        raise TypeError("SQL numbers are finite")
    if v is not None and not isinstance(v, (str, bool, int, float)):
        raise TypeError(f"not a SQL value: {v!r}")
    return v


@dataclass
class Compiled:
    """A checked row query: its DataFrame, and the parameterised text that says the same."""

    df: DataFrame
    text: str
    parameters: list
    columns: list[ColumnSpec]
    base: _Bound
    pushdown: str
    fallback: str
    ordering: str
    source: RowQuery


class SqlTables:
    """A catalog with its tables as DataFrames, keyed by table name or (schema, name)."""

    def __init__(self, spark: SparkSession, catalog: Catalog, tables: dict, uri: str = "sql:local"):
        if not uri:
            raise TypeError("a catalog needs a URI")
        self.spark, self.catalog, self.tables, self.uri = spark, catalog, dict(tables), uri

    def frame(self, schema: str, name: str) -> DataFrame:
        return self.tables[(schema, name)] if (schema, name) in self.tables else self.tables[name]

    def graph(self):
        """server > database > schema > table > column, and relations; no rows are read."""
        c = self.catalog
        nodes = [NodeSpec("server", "sql::server", {"name": c.server}, self.uri, c.version), NodeSpec("database", "sql::database", {"name": c.database}, self.uri, c.version)]
        edges = [EdgeSpec("sql::children", "child", "server", "database", 0)]
        for i, (schema, tables) in enumerate(c.schemas.items()):
            nodes.append(NodeSpec(f"schema:{schema}", "sql::schema", {"name": schema}, self.uri, c.version))
            edges.append(EdgeSpec("sql::children", "child", "database", f"schema:{schema}", i))
            for j, t in enumerate(tables):
                at = f"table:{schema}.{t.name}"
                nodes.append(NodeSpec(at, "sql::table", {"name": t.name, "schema": schema, **({} if t.estimated_rows is None else {"estimatedRows": t.estimated_rows})}, self.uri, c.version))
                edges.append(EdgeSpec("sql::children", "child", f"schema:{schema}", at, j))
                for k, col in enumerate(t.columns):
                    own = f"column:{schema}.{t.name}.{col.name}"
                    nodes.append(NodeSpec(own, "sql::column", {"name": col.name, "schema": schema, "table": t.name, "scalar": col.scalar, "nullable": col.nullable}, self.uri, c.version))
                    edges.append(EdgeSpec("sql::children", "child", at, own, k))
        for i, r in enumerate(c.relations):
            nodes.append(NodeSpec(f"relation:{r.name}", "sql::relation", {"name": r.name}, self.uri, c.version))
            edges.append(EdgeSpec("sql::children", "child", "database", f"relation:{r.name}", len(c.schemas) + i))
            edges.append(EdgeSpec("sql::from", "reference", f"relation:{r.name}", f"table:{r.source[0]}.{r.source[1]}", 0))
            edges.append(EdgeSpec("sql::to", "reference", f"relation:{r.name}", f"table:{r.target[0]}.{r.target[1]}", 0))
        return in_memory(self.spark, "sql", nodes, edges, ["server"], resource=c.database)

    # -- compilation ------------------------------------------------------
    def compile(self, q: RowQuery) -> Compiled:
        for what, n in (("limit", q.limit), ("offset", q.offset)):
            if n is not None and (isinstance(n, bool) or not isinstance(n, int) or n < 0):
                raise TypeError(f"{what} must be a natural number")
        if q.runtime is not None and q.aggregate is not None:
            raise TypeError("a runtime predicate cannot follow an aggregate")
        if q.runtime is not None and q.offset is not None:
            raise TypeError("a runtime predicate cannot go with an offset")
        base = _Bound(q.table[0], self.catalog.table(*q.table))
        bound = [base]
        for j in q.joins:
            if j.kind != "inner":
                raise TypeError(f"unsupported join {j.kind}")
            spec = self.catalog.table(*j.table)
            if any(b.alias == spec.name for b in bound):
                raise TypeError(f"table {spec.name} occurs twice")
            bound.append(_Bound(j.table[0], spec))

        def find(sel) -> tuple[_Bound, ColumnSpec]:
            table, name = sel if isinstance(sel, tuple) else (None, sel)
            hits = [(b, c) for b in bound for c in b.spec.columns if c.name == name and (table is None or b.alias == table)]
            if len(hits) != 1:
                raise TypeError(f"{'ambiguous' if hits else 'unknown'} column {sel}")
            return hits[0]

        def col(sel) -> Column:
            b, c = find(sel)
            return F.col(f"`{b.alias}|{c.name}`")

        def name(sel) -> str:
            b, c = find(sel)
            return f"{quoted(b.alias)}.{quoted(c.name)}"

        parameters: list = []

        def param(v) -> str:
            parameters.append(_value(v))
            return f"${len(parameters)}"

        def frame(b: _Bound) -> DataFrame:
            return self.frame(b.schema, b.spec.name).select(*[F.col(f"`{c.name}`").alias(f"{b.alias}|{c.name}") for c in b.spec.columns])

        df, clauses = frame(base), []
        for j, b in zip(q.joins, bound[1:]):
            if base.spec.column(j.left) is None or b.spec.column(j.right) is None:
                raise TypeError("a join names an unknown column")
            df = df.join(frame(b), F.col(f"`{base.alias}|{j.left}`") == F.col(f"`{b.alias}|{j.right}`"))
            clauses.append(f"INNER JOIN {quoted(b.schema)}.{quoted(b.spec.name)} AS {quoted(b.alias)} ON {quoted(base.alias)}.{quoted(j.left)} = {quoted(b.alias)}.{quoted(j.right)}")
        if q.where is not None:
            cond, text = self._predicate(q.where, col, name, param)
            df = df.where(cond)
            clauses.append(f"WHERE {text}")
        chosen = [find(s) for s in (q.select or [c.name for c in base.spec.columns])]
        names = [c.name for _, c in chosen]
        if len(set(names)) != len(names):
            raise TypeError("projected columns need different names")
        hidden = [(base, base.spec.column(k)) for k in (*base.spec.primary_key, *([base.spec.revision] if base.spec.revision else [])) if k not in names]
        columns = [c for _, c in chosen]
        if q.aggregate is not None:
            a = q.aggregate
            if a.function not in FUNCTIONS:
                raise TypeError(f"unknown aggregate {a.function}")
            if not a.name or (a.function != "count" and a.column is None):
                raise TypeError("an aggregate needs a name, and all but count a column")
            target = F.lit(1) if a.column is None else col(a.column)
            df = df.agg(getattr(F, a.function)(target).alias("value"))
            projection = f"{a.function.upper()}({'*' if a.column is None else name(a.column)}) AS {quoted(a.name)}"
        else:
            projection = ", ".join(f"{quoted(b.alias)}.{quoted(c.name)} AS {quoted(c.name)}" for b, c in [*chosen, *hidden])
        order = []
        for sel, way in q.order_by:
            if way not in ("asc", "desc"):
                raise TypeError(f"unknown direction {way}")
            if q.aggregate is None:
                order.append(col(sel).asc_nulls_last() if way == "asc" else col(sel).desc_nulls_last())
        if q.order_by:
            clauses.append("ORDER BY " + ", ".join(f"{name(s)} {w.upper()}" for s, w in q.order_by))
        if order:
            df = df.orderBy(*order)
        if q.offset is not None:
            df = df.offset(q.offset)
        if q.limit is not None and q.runtime is None:
            df = df.limit(q.limit)
            clauses.append(f"LIMIT {param(q.limit)}")
        if q.offset is not None:
            clauses.append(f"OFFSET {param(q.offset)}")
        if q.aggregate is None:
            # the order columns go along for the order key; unused, they are pruned
            sorts = [F.col(f"`{find(s)[0].alias}|{find(s)[1].name}`").alias(f"order|{i}") for i, (s, _) in enumerate(q.order_by)]
            df = df.select(*[F.col(f"`{b.alias}|{c.name}`").alias(c.name) for b, c in [*chosen, *hidden]], *sorts)
        text = " ".join([f"SELECT {projection}", f"FROM {quoted(base.schema)}.{quoted(base.spec.name)} AS {quoted(base.alias)}", *clauses])
        pushed = {"predicate": q.where is not None, "projection": bool(q.select), "sort": bool(q.order_by), "aggregation": q.aggregate is not None, "join": bool(q.joins), "offset": q.offset is not None, "limit": q.limit is not None and q.runtime is None}
        fallback = {"predicate": q.runtime is not None, "limit": q.runtime is not None and q.limit is not None}
        listed = lambda d: ",".join(k for k, v in d.items() if v)
        return Compiled(df, text, parameters, columns, base, listed(pushed), listed(fallback), "stable" if q.order_by else "unknown", q)

    def _predicate(self, p, col, name, param) -> tuple[Column, str]:
        if isinstance(p, Compare):
            if p.operator not in OPERATORS:
                raise TypeError(f"unknown operator {p.operator}")
            c, v = col(p.column), F.lit(_value(p.value))
            made = {"=": c == v, "!=": c != v, "<": c < v, "<=": c <= v, ">": c > v, ">=": c >= v}.get(p.operator)
            if made is None:
                made = c.like(p.value)
            return made, f"{name(p.column)} {p.operator.upper()} {param(p.value)}"
        if isinstance(p, In):
            if not p.values:
                return F.lit(False), "FALSE"
            return col(p.column).isin([_value(v) for v in p.values]), f"{name(p.column)} IN ({', '.join(param(v) for v in p.values)})"
        if isinstance(p, IsNull):
            c = col(p.column)
            return (c.isNotNull() if p.negated else c.isNull()), f"{name(p.column)} IS {'NOT ' if p.negated else ''}NULL"
        if isinstance(p, Not):
            cond, text = self._predicate(p.part, col, name, param)
            return ~cond, f"NOT ({text})"
        if isinstance(p, (And, Or)):
            if not p.parts:
                raise TypeError("AND and OR need a part")
            made = [self._predicate(x, col, name, param) for x in p.parts]
            out = made[0][0]
            for c, _ in made[1:]:
                out = out & c if isinstance(p, And) else out | c
            return out, "(" + f" {type(p).__name__.upper()} ".join(t for _, t in made) + ")"
        raise TypeError(f"not a predicate: {p!r}")

    # -- rows -------------------------------------------------------------
    def rows(self, q: RowQuery) -> Query:
        """The rows (or the one aggregate) of a row query as nodes."""
        c = self.compile(q)
        digest = hashlib.sha256(f"{c.text}\0{json.dumps(c.parameters)}".encode()).hexdigest()[:16]
        base = f"{c.base.schema}.{c.base.spec.name}"
        roles = {r: fresh(r) for r in ("adapter", "resource", "local", "kind", "uri", "revision")}
        attrs: dict[str, Scalar] = {}
        made: dict[str, Column] = {}
        df, key, revision = c.df, c.base.spec.primary_key, c.base.spec.revision
        if q.aggregate is not None:
            local, ordinal = F.lit(f"aggregate:{digest}:0"), F.lit(0).cast("bigint")
            column = q.aggregate.column
            values = {"function": (F.lit(q.aggregate.function), "string", "never"), "value": (F.col("value"), "number", "null")}
            values["column"] = (F.lit(column[1] if isinstance(column, tuple) else column).cast("string"), "string", "null")
            kind = dict(df.dtypes)["value"]
            values["value"] = (F.col("value"), "string" if kind == "string" else "boolean" if kind == "boolean" else "number", "null")
        else:
            ordinal = F.monotonically_increasing_id()
            if key:
                items = [F.regexp_replace(F.to_json(F.array(F.col(f"`{k}`"))), r"^\[|\]$", "") for k in key]
                local = F.concat(F.lit(f"row:{base}:["), F.concat_ws(",", *items), F.lit("]"))
            else:
                local = F.concat(F.lit(f"row:{digest}:"), ordinal.cast("string"))
            values = {x.name: (F.col(f"`{x.name}`"), x.scalar, "null" if x.nullable else "never") for x in c.columns}
            values["_table"] = (F.lit(base), "string", "never")
            values["_identity"] = (F.lit("primary-key" if key else "query-ordinal"), "string", "never")
            if revision:
                values["_revision"] = (F.col(f"`{revision}`"), c.base.spec.column(revision).scalar, "never")
        for n, (expr, tag, null_is) in values.items():
            if tag == "string" and not n.startswith("_") and n in dict(df.dtypes) and dict(df.dtypes)[n].startswith(("timestamp", "date")):
                expr = F.date_format(expr, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
            attrs[n] = Scalar(fresh(n), tag, False, null_is)
            made[attrs[n].name] = expr
        made[roles["adapter"]] = F.lit("sql")
        made[roles["resource"]] = F.lit(self.catalog.database)
        made[roles["local"]] = local
        made[roles["kind"]] = F.lit("sql::aggregate" if q.aggregate is not None else "sql::row")
        made[roles["uri"]] = F.lit(f"{self.uri}#{base}")
        made[roles["revision"]] = F.col(f"`{revision}`").cast("string") if revision and q.aggregate is None else F.lit(self.catalog.version)
        # rows of an ordered query take their order from its columns, others from their place
        parts = [ordinal]
        if q.order_by and q.aggregate is None:
            rank = [F.col(f"`order|{i}`") for i in range(len(q.order_by))]
            if all(w == "asc" for _, w in q.order_by):
                parts = [p for x in rank for p in (x.isNull().cast("int"), x)] + [ordinal]
        key_col = F.struct(*[p.alias(f"a{i}") for i, p in enumerate(parts)]).alias(ORD)
        out = df.select(key_col, *[e.alias(n) for n, e in made.items()])
        graph = _RowGraph(self)
        details = {"label": "sql", "sql": c.text, "parameters": list(c.parameters), "pushdown": c.pushdown, "fallback": c.fallback}
        query = Query(out, Node(roles, attrs, graph), PlanNode("source", c.ordering, details))
        if q.runtime is not None:
            query = query.filter(q.runtime, "runtime predicate")
            if q.limit is not None:
                query = query.take(q.limit)
        return query

    # -- changes as new tables ------------------------------------------------
    def updated(self, table: tuple[str, str], values: dict, where) -> DataFrame:
        """The table after setting ``values`` where the predicate holds; the revision column counts up."""
        spec, df, cond = self._target(table, where)
        for name in values:
            if spec.column(name) is None or name in spec.primary_key or name == spec.revision:
                raise TypeError(f"column {name} cannot be set")
        hit = F.coalesce(cond, F.lit(False))
        out = []
        for c in df.columns:
            if c in values:
                out.append(F.when(hit, F.lit(_value(values[c]))).otherwise(F.col(f"`{c}`")).cast(df.schema[c].dataType).alias(c))
            elif c == spec.revision:
                out.append(F.when(hit, F.col(f"`{c}`") + 1).otherwise(F.col(f"`{c}`")).cast(df.schema[c].dataType).alias(c))
            else:
                out.append(F.col(f"`{c}`"))
        return df.select(*out)

    def deleted(self, table: tuple[str, str], where) -> DataFrame:
        """The table without the rows for which the predicate holds."""
        _, df, cond = self._target(table, where)
        return df.where(~F.coalesce(cond, F.lit(False)))

    def _target(self, table, where):
        spec = self.catalog.table(*table)

        def col(sel):
            n = sel[1] if isinstance(sel, tuple) else sel
            if spec.column(n) is None:
                raise TypeError(f"unknown column {sel}")
            return F.col(f"`{n}`")

        cond, _ = self._predicate(where, col, lambda s: str(s), lambda v: "?")
        return spec, self.frame(*table), cond


@dataclass
class _RowGraph:
    """Rows have no edges."""

    tables: SqlTables
    view: str | None = None
    heights: dict = field(default_factory=dict)

    @property
    def schema(self):
        from ..schema import AdapterSchema, attr

        columns: dict = {}
        for specs in self.tables.catalog.schemas.values():
            for t in specs:
                for c in t.columns:
                    a = attr(*([c.scalar, "null"] if c.nullable else [c.scalar]), required=False)
                    columns[c.name] = columns[c.name].merged(a) if c.name in columns else a
        columns |= {"_table": attr("string"), "_identity": attr("string"), "_revision": attr("string", "number", "null", required=False)}
        return AdapterSchema("sql", {"sql::row": columns, "sql::aggregate": {"function": attr("string"), "column": attr("string", "null"), "value": attr("string", "number", "boolean", "null")}}, ordering="unknown", pushdown=("predicate", "projection", "sort", "aggregation", "join", "offset", "limit"), dynamic=True)

    def descend(self, q, include_self, max_depth=None):
        return q

    def child_names(self):
        return ()
