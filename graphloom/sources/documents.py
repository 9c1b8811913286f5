"""Document graphs and mounts: parsed texts as range-encoded trees."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from operator import attrgetter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..operators.query import ORD, Query, then
from ..operators.shapes import Scalar, fresh
from ..plans.plan import PlanNode
from ..schema import AdapterSchema, Edge, View, attr
from ..scratch import stored
from . import parsers as P
from .graph import Graph, TreeGraph

_BLOCKS = ("frontmatter", "heading", "paragraph", "list", "code-block")
_MD = {
    "markdown::document": ("encoding", "finalNewline"),
    "markdown::frontmatter": ("format", "content"),
    "markdown::heading": ("level", "title"),
    "markdown::section": ("level", "title"),
    "markdown::paragraph": ("text", "html"),
    "markdown::list": ("ordered", "size"),
    "markdown::list-item": ("text", "index"),
    "markdown::link": ("text", "destination", "reference"),
    "markdown::code-block": ("language", "content", "closed"),
}
_JSON = {"json::root": ("encoding", "finalNewline"), "json::object": ("size",), "json::property": ("name",), "json::array": ("size",), "json::index": ("index",), "json::scalar": ("valueType", "value")}
_TS = {"ts::source-file": ("language", "declaration"), "ts::function": ("name",), "ts::class": ("name",), "ts::variable": ("name",), "ts::call": ("callee",), "ts::identifier": ("name", "declaration"), "ts::import": ("module",), "ts::node": ("syntaxKind",)}


def _kinds(spec, types, **special):
    return {k: {a: special.get(a) or attr(types[a]) for a in names} for k, names in spec.items()}


JSON_SCHEMA = AdapterSchema(
    "json",
    _kinds(_JSON, P.JSON_ATTRS, value=attr("string", "number", "boolean", "null")),
    {
        "json::mount": Edge("json::mount", "child", (), ("json::root",)),
        "json::children": Edge("json::children", "child", tuple(k for k in _JSON if k != "json::scalar"), tuple(k for k in _JSON if k != "json::root")),
        "json::container": Edge("json::container", "reference", ("json::root",), ()),
    },
    {"json::document-tree": View("json::document-tree", ("json::mount", "json::children"), True)},
    tuple(f"json::{o}" for o in ("replace-value", "insert-property", "remove-property", "insert-array-item", "remove-array-item")),
    transactions="local",
)
MARKDOWN_SCHEMA = AdapterSchema(
    "markdown",
    _kinds(_MD, P.MARKDOWN_ATTRS),
    {
        "markdown::mount": Edge("markdown::mount", "child", (), ("markdown::document",)),
        "markdown::children": Edge("markdown::children", "child", ("markdown::document", "markdown::heading", "markdown::paragraph", "markdown::list", "markdown::list-item"), tuple(f"markdown::{b}" for b in (*_BLOCKS, "list-item", "link"))),
        "markdown::sections": Edge("markdown::sections", "child", ("markdown::document", "markdown::section"), ("markdown::section", *(f"markdown::{b}" for b in _BLOCKS))),
        "markdown::container": Edge("markdown::container", "reference", ("markdown::document",), ()),
    },
    {
        "markdown::syntax-tree": View("markdown::syntax-tree", ("markdown::mount", "markdown::children"), True),
        "markdown::section-tree": View("markdown::section-tree", ("markdown::mount", "markdown::sections")),
    },
    ("markdown::set-heading", "markdown::replace-section"),
    transactions="local",
)
TS_SCHEMA = AdapterSchema(
    "ts",
    _kinds(_TS, P.TS_ATTRS),
    {
        "ts::mount": Edge("ts::mount", "child", (), ("ts::source-file",)),
        "ts::children": Edge("ts::children", "child", tuple(_TS), tuple(_TS)),
        "ts::symbol": Edge("ts::symbol", "reference", ("ts::identifier",), tuple(_TS)),
        "ts::container": Edge("ts::container", "reference", ("ts::source-file",), ()),
    },
    {"ts::syntax-tree": View("ts::syntax-tree", ("ts::mount", "ts::children"), True)},
    ("ts::rename-symbol", "ts::replace-call"),
    transactions="local",
)
SCHEMAS = {"json": JSON_SCHEMA, "markdown": MARKDOWN_SCHEMA, "ts": TS_SCHEMA}
_ARROW = {"string": pa.string(), "number": pa.float64(), "boolean": pa.bool_()}
_ITEM = pa.struct([("t", pa.string()), ("s", pa.string()), ("n", pa.float64()), ("b", pa.bool_()), ("i", pa.decimal128(38, 0))])
_TAGGED = pa.struct([*_ITEM, ("m", pa.list_(_ITEM))])
_PLACES = ("startLine", "startColumn", "endLine", "endColumn")
_LONGS = ("pre", "last", "parent", "sib", "depth", "start", "end", *_PLACES)
_HEAD = ("resource", "uri", "revision")
_COLUMNS = (*_HEAD, "local", "kind", "edge", *_LONGS, "code", "message")
#: Nodes that a task holds before it sends them on, besides those of one document, and documents that it reads at once.
ROWS, DOCS = 10_000, 256


def lines_of(text: str):
    """Function from an offset in UTF-16 units to (line, column), both from 0."""
    unit = P.utf16(text) or (lambda k: k)
    breaks = [unit(m.start()) for m in re.finditer("\n", text)]

    def at(offset: int) -> tuple[int, int]:
        line = bisect_left(breaks, offset)
        return line, offset - (breaks[line - 1] + 1 if line else 0)

    return at


def parsed(docs: DataFrame, language: str, view: str | None = None, on_error: str = "skip", columns=None) -> DataFrame:
    """Node rows of ``docs`` (resource, uri, revision, text), with a row of kind NULL for each diagnostic.

    A narrow stage: every document is parsed where it lies, and rows leave the task by
    the thousand, however many documents it was given at once.  A null text is no
    document; with on_error "throw" a fault ends the query, else it is a diagnostic.
    ``columns`` names those to make, all by default: without ``kind`` there are no
    nodes, without ``code`` no diagnostics.
    """
    parse, attrs = P.PARSERS[language]
    types = {**{f: "string" for f in ("resource", "uri", "revision", "local", "kind", "edge")}, **{c: "long" for c in _LONGS}, **{f"@{a}": (V.TAGGED if t == "tagged" else V.SQL_TYPE[t]) for a, t in attrs.items()}, "code": "string", "message": "string"}
    kinds = {f: pa.string() for f in types} | {c: pa.int64() for c in _LONGS} | {f"@{a}": _TAGGED if t == "tagged" else _ARROW[t] for a, t in attrs.items()}
    fields = [f for f in types if columns is None or f in columns]
    nodes, notes, placed = "kind" in fields, "code" in fields, any(c in fields for c in _PLACES)

    def run(batches):
        # nodes, and the documents and places they are of; then diagnostics and their documents
        rows, heads, places, faults = [], [], [], []

        def made():
            cols = {}
            for f in fields:
                if f in _HEAD:
                    k = _HEAD.index(f)
                    own = [h[k] for h in heads]
                elif f in _PLACES:
                    k = _PLACES.index(f)
                    own = [x[k] for x in places]
                elif f in ("code", "message"):
                    own = [None] * len(rows)
                elif f[0] != "@":
                    own = list(map(attrgetter(f), rows))
                elif attrs[f[1:]] == "tagged":
                    own = [P.tagged(r.attrs[f[1:]]) if f[1:] in r.attrs else None for r in rows]
                else:
                    own = [r.attrs.get(f[1:]) for r in rows]
                at = _HEAD.index(f) if f in _HEAD else {"code": 3, "message": 4}.get(f)
                cols[f] = own + [None if at is None else x[at] for x in faults]
            out = pa.RecordBatch.from_arrays([pa.array(cols[f], kinds[f]) for f in fields], fields)
            for x in (rows, heads, places, faults):
                x.clear()
            return out

        for batch in batches:
            for resource, uri, revision, text in (x for k in range(0, batch.num_rows, DOCS) for x in zip(*(c.to_pylist() for c in batch.slice(k, DOCS).columns))):
                if text is None:
                    continue
                head = (resource, uri, revision)
                try:
                    tree = parse(text, view) if language == "markdown" and view else parse(text)
                except P.SyntaxFault as e:
                    if on_error == "throw":
                        raise ValueError(f"{language}.invalid-syntax in {uri}: {e}") from e
                    if notes:
                        faults.append((*head, f"{language}.invalid-syntax", str(e)))
                    continue
                at = lines_of(text.removeprefix("\ufeff")) if nodes and placed else None
                for k in range(0, len(tree.rows) if nodes else 0, ROWS):
                    part = tree.rows[k : k + ROWS]
                    rows += part
                    heads += [head] * len(part)
                    if at:
                        places += [(*at(r.start), *at(r.end)) for r in part]
                    if len(rows) >= ROWS:
                        yield made()
                if notes:
                    faults += [(*head, code, message) for code, message, _, _ in tree.notes]
                    if len(faults) >= ROWS:
                        yield made()
        yield made()

    return docs.select("resource", "uri", "revision", "text").mapInArrow(run, ", ".join(f"`{f}` {types[f]}" for f in fields))


@dataclass
class DocumentGraph(TreeGraph):
    """Parsed documents; ``diagnostics`` are the faults found in them.

    A query that reads the nodes once parses as it reads.  The second use writes the
    nodes to the shared folder; with ``keep`` the first one does, as below a mount,
    where every step is a use.
    """

    diagnostics: DataFrame | None = None
    text: DataFrame | None = None
    keep: bool = False
    make: Callable | None = None  # nodes with the named columns only, parsed anew
    _uses: list = field(default_factory=list)

    def table(self):
        if len(self._uses) < 2 and (self.keep or self._uses):
            self.nodes = stored(self.nodes, "nodes")
            self._uses[:] = [1, 1]
        self._uses.append(1)
        return super().table()

    def all(self, where=None):
        q = super().all(where)
        return q if where is not None or len(self._uses) > 1 or self.make is None else Parsing(q, self)


class Parsing(Query):
    """Every node, parsed as it is read; flat columns right after it make no others in the task."""

    def __init__(self, q: Query, graph: DocumentGraph):
        super().__init__(q.df, q.shape, q.plan, q.captures)
        self.graph = graph

    def dataframe(self, **fields):
        out = super().dataframe(**fields)
        read, it = set(), out._jdf.queryExecution().analyzed().references().iterator()
        while it.hasNext():
            read.add(it.next().name())
        if ORD in read:
            return out
        s = self.shape
        names = {**s.cols, **s.keys, **{f"@{a}": x.name for a, x in s.attrs.items()}}
        wanted = {c: n for c, n in names.items() if n in read}
        df = self.graph.make(wanted.keys()).select(*[F.col(f"`{c}`").alias(n) for c, n in wanted.items()])
        return Query(df, s, self.plan).dataframe(**fields)


def documents(spark: SparkSession, docs: DataFrame, language: str, view: str | None = None, on_error: str = "skip", keep: bool = False) -> DocumentGraph:
    """The graph of ``docs`` (resource, uri, revision, text); resources must be unique."""
    schema = SCHEMAS[language]
    if view is not None and view not in schema.views:
        from ..diagnostics import LoomError

        raise LoomError("dsl.unknown-tree-view", f"unknown tree view {view}")

    def make(columns=None):
        rows = parsed(docs, language, view, on_error, None if columns is None else {"kind", *columns})
        return rows.where("kind is not null").withColumn("adapter", F.lit(language))

    faults = parsed(docs, language, view, on_error, ("uri", "code", "message"))
    attrs = {a: Scalar("", None if t == "tagged" else t, False, "missing") for a, t in P.PARSERS[language][1].items()}
    every = make([c for c in _COLUMNS if c not in ("code", "message")] + [f"@{a}" for a in attrs])
    return DocumentGraph(spark, schema, every, attrs, view, diagnostics=faults.select("uri", "code", "message"), text=docs, keep=keep, make=make)


def texts(spark: SparkSession, items: dict[str, str]) -> DataFrame:
    """Documents from Python: {uri: text}."""
    import hashlib

    rows = [(u, u, hashlib.sha256(t.encode()).hexdigest(), t) for u, t in items.items()]
    return spark.createDataFrame(rows, "resource string, uri string, revision string, text string")


def below(q: Query, graph: TreeGraph, every: bool, holder) -> Query:
    """Nodes (all, or the root) of the document that each row holds, beside the row's captures."""
    carried = q.carried()
    base = q.df.select(*carried, holder(q).alias("_r"))
    table, shape = graph.table()
    if not every:
        table = table.where(F.col(shape.keys["parent"]) < 0)
    out = base.join(table.hint("merge"), F.col("_r") == F.col(shape.cols["resource"])).select(*carried, *shape.columns())
    return Query(out.withColumn(ORD, then(F.col(shape.keys["pre"]))), shape, q.plan, q.captures)


@dataclass
class MountedGraph(Graph):
    """A graph whose container rows also have a document as a child.

    The document table is planned on the first step that crosses the mount, so a
    query that stays among the containers never parses anything.
    """

    base: Graph
    language: str
    container: str  # kind of the rows that hold documents
    attribute: str  # their attribute with the text
    view: str | None = None
    on_error: str = "skip"
    docs: DataFrame | None = None
    _made: list = field(default_factory=list)

    @property
    def schema(self) -> AdapterSchema:
        return self.base.schema.composite(SCHEMAS[self.language])

    @property
    def spark(self):
        return self.base.spark

    def graph(self) -> DocumentGraph:
        if not self._made:
            docs = self.docs
            if docs is None:
                q = self.base.kind_query(self.container) if hasattr(self.base, "kind_query") else self.base.all()
                if self.embedded:
                    q = self.fences(q)
                docs = q.dataframe(resource=lambda r: self.holder(q), uri=lambda r: F.col(r.shape.cols["uri"]), revision=lambda r: F.lit(None).cast("string"), text=lambda r: r[self.attribute].col)
            if self.embedded:
                docs = docs.withColumn("uri", F.concat_ws("#", "uri", F.element_at(F.split("resource", "#"), -1)))
            self._made.append(documents(self.spark, docs, self.language, self.view, self.on_error, keep=True))
        return self._made[0]

    @property
    def embedded(self) -> bool:
        """Documents lie in nodes of other documents, as fenced blocks do."""
        return self.docs is None and isinstance(self.base, DocumentGraph)

    def fences(self, q: Query) -> Query:
        """The containers whose declared language, if they have one, is the mounted one."""
        rows = q.df.where(q.shape.kind() == self.container)
        declared = q.shape.attr("language")
        if declared.tag != "missing":
            rows = rows.where(declared.col == self.language)
        return Query(rows, q.shape, q.plan, q.captures)

    def holder(self, q: Query):
        """Identifier of the document that a row holds."""
        local = F.col(q.shape.cols["local"])
        return F.concat_ws("#", F.col(q.shape.cols["resource"]), local) if self.embedded else local

    def mount_edge(self) -> str:
        return f"{self.language}::mount"

    def child_names(self):
        return (*self.base.child_names(), self.mount_edge())

    def height(self, names, direction):
        return None

    def inner(self, q: Query) -> Query:
        """The row as one of the graph below."""
        return Query(q.df, replace(q.shape, graph=self.base), q.plan, q.captures)

    def outer(self, q: Query) -> Query:
        return Query(q.df, replace(q.shape, graph=self), q.plan, q.captures) if q.shape.graph is self.base else q

    def holds(self, q: Query) -> bool:
        return q.shape.kind_name in (None, self.container)

    def across(self, q: Query, every: bool) -> Query:
        rows = q if q.shape.kind_name else Query(q.df.where(q.shape.kind() == self.container), q.shape, q.plan, q.captures)
        return below(self.fences(rows) if self.embedded else rows, self.graph(), every, self.holder)

    def step(self, q, names, direction="forward"):
        out = []
        own = [n for n in names if n in self.base.schema.edges]
        if own and hasattr(self.base, "hops"):
            out += [self.outer(self.base.hop(self.inner(q), x, forward)) for x, forward in self.base.hops(q.shape.kind_name, own, direction)]
        elif own:
            got = self.base.step(self.inner(q), own, direction)
            out += [self.outer(x) for x in (got if isinstance(got, list) else [got])]
        if self.mount_edge() in names and direction == "forward" and self.holds(q):
            out.append(self.across(q, False))
        return out

    def descend(self, q, include_self, max_depth=None):
        """The row, then its document: their order keys have the same form, so they interleave as in a walk."""
        if self.embedded:
            inside = self.base.descend(self.inner(q), True, max_depth)
            own = inside if include_self else self.base.descend(self.inner(q), False, max_depth)
            held = self.across(self.outer(inside), True)
            if max_depth is not None:
                at, top = held.shape.keys["depth"], max_depth
                held = Query(held.df.where(F.col(at) < top), held.shape, held.plan, held.captures)
            return [self.outer(own), held]
        out = [Query(q.df.withColumn(ORD, then(F.lit(-1).cast("bigint"))), q.shape, q.plan, q.captures)] if include_self else []
        if self.holds(q):
            got = self.across(q, True)
            if max_depth is not None:
                got = Query(got.df.where(F.col(got.shape.keys["depth"]) < max_depth), got.shape, got.plan, got.captures)
            out.append(got)
        return out

    def traverse(self, q, edges, roles, direction, max_depth, include_self):
        from ..plans.selector import one

        names = self.names_of(edges, roles)
        if direction != "forward" or self.mount_edge() not in names:
            return self.outer(self.base.traverse(self.inner(q), edges, roles, direction, max_depth, include_self))
        return one(self.descend(q, include_self, max_depth), q)

    def roots(self):
        return self.outer(self.base.roots())

    def siblings(self, q, following):
        return self.outer(self.base.siblings(self.inner(q), following))


def mount(q: Query, language: str, attribute: str, view: str | None = None, on_error: str = "skip", docs: DataFrame | None = None) -> Query:
    """Rows of ``q`` (of one kind) with the document in ``attribute`` mounted below each.

    ``docs`` gives the documents by the rows' local identifiers where they are no
    attribute (files are read from it, and only when a step crosses the mount).
    """
    held = q.shape.kind_name or ("markdown::code-block" if isinstance(q.shape.graph, DocumentGraph) else "fs::file")
    graph = MountedGraph(q.shape.graph, language, held, attribute, view, on_error, docs)
    plan = PlanNode("source", q.ordering, {**q.plan.details, "mount": f"{q.shape.graph.schema.namespace} -> {language}"}, q.plan.inputs) if q.plan.operator == "source" else q.plan
    return Query(q.df, replace(q.shape, graph=graph), plan, q.captures)


def container_of(q: Query, containers: Query) -> Query:
    """The reference from document roots back to the rows that hold them."""
    held = containers.detached(q.df)
    df = q.df.join(held.df.drop(ORD).hint("merge"), F.col(q.shape.cols["resource"]) == F.col(held.shape.cols["local"]))
    keep = q.carried()
    return Query(df.select(*keep, *held.shape.columns()), held.shape, q.plan, q.captures)
