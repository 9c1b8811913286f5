"""Graphs as DataFrames: edge lists, range-encoded trees and relations.

Every graph answers the same calls with queries: ``roots``, ``step`` along named
edges, ``descend`` the tree, ``siblings`` and ``traverse``.  A step is a join,
never a loop over nodes.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..diagnostics import LoomError
from ..operators.query import ORD, Query, then
from ..operators.shapes import ROLES, Node, Scalar, fresh
from ..plans.plan import PlanNode
from ..schema import AdapterSchema
from ..scratch import stored

#: Unrolled steps of a walk without a depth limit; a child graph deeper than this counts as cyclic.
MAX_UNROLL = 200
#: Steps of a walk over an edge list that are planned as one; longer walks write each level.
IN_ONE_PLAN = 4


class Graph:
    """Shared behaviour; subclasses say how nodes are reached."""

    schema: AdapterSchema
    spark: SparkSession
    view: str | None = None

    def source(self, q: Query, label: str, details: dict | None = None) -> Query:
        return q.relabelled(PlanNode("source", self.schema.ordering, {"label": label, **(details or {})}))

    def names_of(self, edges, roles) -> list[str]:
        """Edge names that a traversal may follow."""
        out = [e.name for e in self.schema.edges.values() if (edges is None or e.name in edges) and (roles is None or e.role in roles)]
        return out

    def child_names(self) -> tuple[str, ...]:
        return self.schema.child_edges(self.view)

    def traverse(self, q: Query, edges, roles, direction: str, max_depth: int, include_self: bool) -> Query:
        names = self.names_of(edges, roles)
        return unrolled(self, q, names, direction, max_depth, include_self)

    def descend(self, q: Query, include_self: bool, max_depth: int | None = None) -> Query:
        raise NotImplementedError

    def step(self, q: Query, names, direction: str = "forward") -> Query:
        raise NotImplementedError

    def siblings(self, q: Query, following: bool) -> Query:
        raise NotImplementedError

    def roots(self) -> Query:
        raise NotImplementedError


def union(queries: list[Query]) -> Query:
    """Rows of queries that share their columns."""
    first = queries[0]
    df = first.df
    for q in queries[1:]:
        df = df.unionByName(q.df)
    return Query(df, first.shape, first.plan, first.captures)


def unrolled(graph: Graph, q: Query, names, direction: str, max_depth: int, include_self: bool) -> Query:
    """All paths of up to ``max_depth`` edges, one join for each level; ends early where the schema or the data end.

    In walks of more than two levels each level is written to the shared folder.

    The order key is the path of edge positions: arrays sort like a pre-order walk.
    """
    path = fresh("path")
    # captures keep their columns, the walk has its own
    own = {c: fresh(c) for c in q.shape.columns()}
    shape = q.shape.renamed(own)
    captured = {c for s in q.captures.values() for c in s.columns()}
    df = q.df.select(*[F.col(c) for c in q.df.columns if c not in own or c in captured], *[F.col(c).alias(n) for c, n in own.items()])
    start = Query(df.withColumn(path, F.array().cast("array<string>")), shape, q.plan, q.captures)
    levels, now = ([start] if include_self else []), start
    bound = graph.height(names, direction)
    depth = max_depth if bound is None else min(max_depth, bound)
    if depth > MAX_UNROLL:
        raise LoomError("query.unbounded-traversal", f"a walk of more than {MAX_UNROLL} steps")
    for level in range(depth):
        now = graph.extend(now, names, direction, path)
        if now is None:
            break
        if level and depth > 2:
            # each level is made once, from the one before, and a walk that has ended goes no further
            now = Query(stored(now.df, "level"), now.shape, now.plan, now.captures)
            if now.df.isEmpty():
                break
        levels.append(now)
    if not levels:
        out = start.df.where(F.lit(False))
        return Query(out.withColumn(ORD, then(F.col(path))), shape, q.plan, q.captures)
    out = union([aligned(x, levels[0]) for x in levels])
    return Query(out.df.withColumn(ORD, then(F.col(path))).drop(path), out.shape, q.plan, q.captures)


def aligned(q: Query, like: Query) -> Query:
    """The query under the column names of another one of the same graph."""
    m = {}
    a, b = q.shape, like.shape
    for part in ("cols", "keys"):
        for k, name in getattr(b, part).items():
            m[getattr(a, part)[k]] = name
    for k, s in b.attrs.items():
        m[a.attrs[k].name] = s.name
    keep = [c for c in like.df.columns if c not in m.values()]
    df = q.df.select(*[F.col(c) for c in keep], *[F.col(x).alias(y) for x, y in m.items()])
    return Query(df.select(*like.df.columns), b, q.plan, like.captures)


def mount_shape(df: DataFrame, roles: dict, attrs: dict, keys: dict, graph) -> tuple[DataFrame, Node]:
    """Rename the columns of a node table to fresh ones and describe them."""
    m = {c: fresh(c) for c in {*roles.values(), *(s.name for s in attrs.values()), *keys.values()}}
    df = df.select(*[F.col(f"`{c}`").alias(n) for c, n in m.items()])
    return df, Node({r: m[c] for r, c in roles.items()}, {k: replace(s, name=m[s.name]) for k, s in attrs.items()}, graph, {k: m[c] for k, c in keys.items()})


@dataclass
class EdgeListGraph(Graph):
    """Nodes and edges as two tables, of any form: bags of paths, shared children, cycles.

    nodes: resource, local, kind, uri, revision and a column for each attribute;
    edges: name, role, from_resource, from_local, to_resource, to_local, pos.
    """

    spark: SparkSession
    schema: AdapterSchema
    nodes: DataFrame
    edges: DataFrame
    roots_df: DataFrame
    attrs: dict
    heights: dict = field(default_factory=dict)
    view: str | None = None

    def _table(self, df: DataFrame) -> tuple[DataFrame, Node]:
        roles = {"adapter": "adapter", "resource": "resource", "local": "local", "kind": "kind", "uri": "uri", "revision": "revision"}
        return mount_shape(df, roles, {k: replace(s, name=f"@{k}") for k, s in self.attrs.items()}, {}, self)

    def roots(self) -> Query:
        at = {k: fresh(k) for k in ("r", "l", "p")}
        first = self.roots_df.select(F.col("resource").alias(at["r"]), F.col("local").alias(at["l"]), F.col("position").alias(at["p"]))
        df, shape = self._table(self.nodes)
        df = first.join(df.hint("merge"), (F.col(at["l"]) == F.col(shape.cols["local"])) & (F.col(at["r"]) == F.col(shape.cols["resource"])))
        df = df.select(F.struct(F.col(at["p"]).alias("a")).alias(ORD), *shape.columns())
        return self.source(Query(df, shape, PlanNode("source", self.schema.ordering)), "adapter")

    def height(self, names, direction) -> int | None:
        return self.heights.get((frozenset(names), direction))

    def _links(self, names, direction: str) -> tuple[DataFrame, dict]:
        """(r, l) to (tr, tl) at pos under fresh names, along the edges of a direction."""
        e = self.edges.where(F.col("name").isin(list(names)))
        a, b = ("from", "to") if direction == "forward" else ("to", "from")
        if direction == "both":
            flipped = e.select("name", "role", F.col("to_resource").alias("from_resource"), F.col("to_local").alias("from_local"), F.col("from_resource").alias("to_resource"), F.col("from_local").alias("to_local"), "pos")
            e, a, b = e.unionByName(flipped), "from", "to"
        m = {k: fresh(k) for k in ("r", "l", "tr", "tl", "pos")}
        return e.select(F.col(f"{a}_resource").alias(m["r"]), F.col(f"{a}_local").alias(m["l"]), F.col(f"{b}_resource").alias(m["tr"]), F.col(f"{b}_local").alias(m["tl"]), F.col("pos").alias(m["pos"])), m

    def _hop(self, q: Query, names, direction: str):
        e, m = self._links(names, direction)
        nodes, shape = self._table(self.nodes)
        here = q.shape.cols
        keep = q.carried()
        df = q.df.join(e.hint("merge"), (F.col(here["local"]) == F.col(m["l"])) & (F.col(here["resource"]) == F.col(m["r"])))
        df = df.select(*keep, m["tr"], m["tl"], m["pos"]).join(nodes.hint("merge"), (F.col(m["tl"]) == F.col(shape.cols["local"])) & (F.col(m["tr"]) == F.col(shape.cols["resource"]))).drop(m["tr"], m["tl"])
        return df, shape, m["pos"]

    def step(self, q, names, direction="forward"):
        df, shape, pos = self._hop(q, names, direction)
        return Query(df.withColumn(ORD, then(F.col(pos))).drop(pos), shape, q.plan, q.captures)

    def traverse(self, q, edges, roles, direction, max_depth, include_self):
        return self.walk(q, self.names_of(edges, roles), direction, max_depth, include_self)

    def walk(self, q: Query, names, direction: str, max_depth: int, include_self: bool) -> Query:
        """All paths of up to ``max_depth`` edges, in pre-order.

        Levels hold identities and paths only.  Edges that lead to no node are taken
        out once, so that nodes are looked up after the walk, and only if something
        reads more of them than who they are.  Up to IN_ONE_PLAN levels are one plan,
        in which Spark shares the shuffles; beyond that each level is written, and a
        walk that has ended goes no further.
        """
        bound = self.height(names, direction)
        depth = max_depth if bound is None else min(max_depth, bound)
        if depth > MAX_UNROLL:
            raise LoomError("query.unbounded-traversal", f"a walk of more than {MAX_UNROLL} steps")
        path, r, l, there, key = (fresh(x) for x in ("path", "r", "l", "there", "key"))  # noqa: E741
        nodes, shape = self._table(self.nodes)
        renamed = {shape.cols["resource"]: there, shape.cols["local"]: key}
        nodes = nodes.withColumnsRenamed(renamed)
        links, m = self._links(names, direction)
        links = links.join(nodes.select(there, key).hint("merge"), (F.col(m["tl"]) == F.col(key)) & (F.col(m["tr"]) == F.col(there)), "left_semi")
        if depth > 2:
            links = stored(links, "links")
        keep = q.carried()
        now = q.df.select(*keep, F.col(q.shape.cols["resource"]).alias(r), F.col(q.shape.cols["local"]).alias(l), F.array().cast("array<string>").alias(path))
        levels = [now if include_self else now.where(F.lit(False))]
        for _ in range(depth):
            now = now.join(links.hint("merge"), (F.col(l) == F.col(m["l"])) & (F.col(r) == F.col(m["r"])))
            now = now.select(*keep, F.col(m["tr"]).alias(r), F.col(m["tl"]).alias(l), F.concat(path, F.array(F.lpad(F.col(m["pos"]).cast("string"), 12, "0"))).alias(path))
            if depth > IN_ONE_PLAN:
                now = stored(now, "level")
                if now.isEmpty():
                    break
            levels.append(now)
        out = levels[0]
        for x in levels[1:]:
            out = out.unionByName(x)
        # one row for each identity, which lets Spark leave the join out where nothing needs it
        out = out.join(nodes.dropDuplicates([there, key]).hint("merge"), (F.col(l) == F.col(key)) & (F.col(r) == F.col(there)), "left")
        own = {shape.cols["resource"]: r, shape.cols["local"]: l}
        out = out.select(*keep, *[F.col(own.get(c, c)).alias(c) for c in shape.columns()], path)
        return Query(out.withColumn(ORD, then(F.col(path))).drop(path), shape, q.plan, q.captures)

    def descend(self, q, include_self, max_depth=None):
        names = self.child_names()
        bound = self.height(names, "forward")
        if bound is None and max_depth is None:
            raise LoomError("query.unbounded-traversal", "the child graph has a cycle")
        depth = bound if max_depth is None else max_depth
        return self.walk(q, names, "forward", depth, include_self)

    def siblings(self, q, following):
        names = list(self.child_names())
        e = self.edges.where(F.col("name").isin(names))
        m = {k: fresh(k) for k in ("r", "l", "n", "fr", "fl", "p")}
        mine = e.select(F.col("to_resource").alias(m["r"]), F.col("to_local").alias(m["l"]), F.col("name").alias(m["n"]), F.col("from_resource").alias(m["fr"]), F.col("from_local").alias(m["fl"]), F.col("pos").alias(m["p"]))
        k = {x: fresh(x) for x in ("r", "l", "n", "fr", "fl", "p")}
        other = e.select(F.col("to_resource").alias(k["r"]), F.col("to_local").alias(k["l"]), F.col("name").alias(k["n"]), F.col("from_resource").alias(k["fr"]), F.col("from_local").alias(k["fl"]), F.col("pos").alias(k["p"]), F.lag("pos").over(Window.partitionBy("name", "from_resource", "from_local").orderBy("pos")).alias("_before"))
        here = q.shape.cols
        keep = q.carried()
        same = (F.col(m["n"]) == F.col(k["n"])) & (F.col(m["fr"]) == F.col(k["fr"])) & (F.col(m["fl"]) == F.col(k["fl"]))
        after = F.col(k["p"]) > F.col(m["p"]) if following else F.col("_before") == F.col(m["p"])
        nodes, shape = self._table(self.nodes)
        df = q.df.join(mine, (F.col(here["resource"]) == F.col(m["r"])) & (F.col(here["local"]) == F.col(m["l"]))).select(*keep, m["n"], m["fr"], m["fl"], m["p"])
        df = df.join(other, same & after).select(*keep, k["r"], k["l"], m["p"], k["p"])
        df = df.join(nodes, (F.col(k["r"]) == F.col(shape.cols["resource"])) & (F.col(k["l"]) == F.col(shape.cols["local"])))
        return Query(df.withColumn(ORD, then(F.col(m["p"]), F.col(k["p"]))).drop(k["r"], k["l"], m["p"], k["p"]), shape, q.plan, q.captures)


@dataclass
class TreeGraph(Graph):
    """Nodes of many documents in one table, each document a tree encoded by ranges.

    Columns: adapter, resource, local, kind, uri, revision, start, end, edge (name of the edge from the
    parent), pre, last (range of the subtree), parent (pre of the parent, -1 for roots), sib, depth and
    a column ``@name`` for each attribute.  Descendants are an equi-join on the resource with a range.
    Steps merge sorted sides: files of nodes are so much smaller than their rows that Spark would broadcast them.
    """

    spark: SparkSession
    schema: AdapterSchema
    nodes: DataFrame
    attrs: dict
    view: str | None = None
    reverse: bool = True
    extra: DataFrame | None = None  # reference edges: name, resource, from_pre, to_pre, pos

    def table(self) -> tuple[DataFrame, Node]:
        have = set(self.nodes.columns)
        roles = {r: r for r in ROLES if r in have}
        keys = {k: k for k in ("edge", "pre", "last", "parent", "sib", "depth")}
        return mount_shape(self.nodes, roles, {k: replace(s, name=f"@{k}") for k, s in self.attrs.items()}, keys, self)

    def all(self, where: Column | None = None) -> Query:
        df, shape = self.table()
        if where is not None:
            df = df.where(where)
        ordered = df.withColumn(ORD, F.struct(F.col(shape.cols["resource"]).alias("a"), F.col(shape.keys["pre"]).alias("b")))
        return self.source(Query(ordered, shape, PlanNode("source", self.schema.ordering)), "adapter")

    def roots(self) -> Query:
        q = self.all()
        out = Query(q.df.where(F.col(q.shape.keys["parent"]) < 0), q.shape, q.plan)
        out.forest = self
        return out

    def height(self, names, direction):
        return None

    def _pair(self, q: Query, on) -> tuple[DataFrame, Node]:
        df, shape = self.table()
        keep = q.carried()
        joined = q.df.join(df.hint("merge"), (F.col(q.shape.cols["resource"]) == F.col(shape.cols["resource"])) & on(q.shape, shape))
        return joined, shape, keep

    def step(self, q, names, direction="forward"):
        names = list(names)
        k = lambda s, n: F.col(s.keys[n])
        refs = [n for n in names if n in self.schema.edges and self.schema.edges[n].role == "reference"]
        trees = [n for n in names if n not in refs]
        if refs and self.extra is not None:
            return self._reference(q, refs, direction)
        if direction == "forward":
            df, shape, keep = self._pair(q, lambda a, b: (k(a, "pre") == k(b, "parent")) & k(b, "edge").isin(trees))
            df = df.select(*keep, *shape.columns())
            return Query(df.withColumn(ORD, then(k(shape, "sib"))), shape, q.plan, q.captures)
        df, shape, keep = self._pair(q, lambda a, b: (k(a, "parent") == k(b, "pre")) & k(a, "edge").isin(trees) & F.lit(self.reverse))
        df = df.select(*keep, *shape.columns())
        return Query(df.withColumn(ORD, then(k(shape, "pre"))), shape, q.plan, q.captures)

    def _reference(self, q, names, direction):
        a, b = ("from_pre", "to_pre") if direction == "forward" else ("to_pre", "from_pre")
        m = {x: fresh(x) for x in ("res", "to", "a", "b", "pos")}
        here = there = "resource"
        if "to_resource" in self.extra.columns:
            here, there = ("resource", "to_resource") if direction == "forward" else ("to_resource", "resource")
        e = self.extra.where(F.col("name").isin(names)).select(F.col(here).alias(m["res"]), F.col(there).alias(m["to"]), F.col(a).alias(m["a"]), F.col(b).alias(m["b"]), F.col("pos").alias(m["pos"]))
        df, shape = self.table()
        keep = q.carried()
        out = q.df.join(e.hint("merge"), (F.col(q.shape.cols["resource"]) == F.col(m["res"])) & (F.col(q.shape.keys["pre"]) == F.col(m["a"])))
        out = out.select(*keep, m["to"], m["b"], m["pos"]).join(df.hint("merge"), (F.col(m["to"]) == F.col(shape.cols["resource"])) & (F.col(m["b"]) == F.col(shape.keys["pre"])))
        return Query(out.withColumn(ORD, then(F.col(m["pos"]))).select(*keep, *shape.columns()), shape, q.plan, q.captures)

    def extend(self, q, names, direction, path):
        out = self.step(q, names, direction)
        at = out.shape.keys["pre"]
        return Query(out.df.withColumn(path, F.concat(path, F.array(F.lpad(F.col(at).cast("string"), 12, "0")))), out.shape, q.plan, q.captures)

    def descend(self, q, include_self, max_depth=None):
        k = lambda s, n: F.col(s.keys[n])

        def within(a, b):
            cond = (k(b, "pre") >= k(a, "pre") if include_self else k(b, "pre") > k(a, "pre")) & (k(b, "pre") <= k(a, "last"))
            return cond if max_depth is None else cond & (k(b, "depth") <= k(a, "depth") + max_depth)

        if include_self and max_depth is None and q.plan.operator == "source" and q.forest is self:
            return self.all()  # from the roots, all nodes: no join
        df, shape, keep = self._pair(q, within)
        return Query(df.select(*keep, *shape.columns()).withColumn(ORD, then(k(shape, "pre"))), shape, q.plan, q.captures)

    def traverse(self, q, edges, roles, direction, max_depth, include_self):
        names = self.names_of(edges, roles)
        tree = set(names) >= {e.name for e in self.schema.edges.values() if e.role == "child"}
        if tree and direction == "forward" and all(self.schema.edges[n].role == "child" for n in names):
            return self.descend(q, include_self, max_depth)
        return unrolled(self, q, names, direction, max_depth, include_self)

    def siblings(self, q, following):
        k = lambda s, n: F.col(s.keys[n])
        after = (lambda a, b: k(b, "sib") > k(a, "sib")) if following else (lambda a, b: k(b, "sib") == k(a, "sib") + 1)
        df, shape, keep = self._pair(q, lambda a, b: (k(a, "parent") == k(b, "parent")) & (k(a, "parent") >= 0) & (k(a, "edge") == k(b, "edge")) & after(a, b) & F.lit(self.reverse))
        return Query(df.select(*keep, *shape.columns()).withColumn(ORD, then(k(shape, "sib"))), shape, q.plan, q.captures)


@dataclass
class Kind:
    """A kind of a relational graph: its table, key columns and attributes.

    ``attrs`` maps attribute names to (expression over the table's columns, tag);
    an expression that yields NULL makes the attribute missing, unless ``nulls``
    names it: then it is an explicit null where the second expression holds.
    """

    table: DataFrame
    key: tuple[str, ...]
    attrs: dict
    ordinal: tuple[str, ...] = ()
    optional: frozenset = frozenset()


@dataclass(frozen=True)
class Link:
    """An edge of a relational graph: target's foreign columns equal the source's key columns, or the other way round."""

    name: str
    role: str
    source: str
    target: str
    source_cols: tuple[str, ...]
    target_cols: tuple[str, ...]


@dataclass
class RelationalGraph(Graph):
    """Typed tables as a graph; steps are joins on keys, and kinds prune paths when the plan is made.

    Attributes stay native columns, so predicates and projections reach the scan.
    A query over several kinds is one query for each, as the kinds differ in columns.
    """

    spark: SparkSession
    schema: AdapterSchema
    kinds: dict[str, Kind]
    links: list[Link]
    root_kinds: tuple[str, ...]
    resource: str = "tables"
    view: str | None = None

    def kind_query(self, kind: str) -> Query:
        k = self.kinds[kind]
        df, shape = self._table(kind)
        parts = [F.col(shape.keys[c]) for c in (k.ordinal or k.key)]
        df = df.withColumn(ORD, F.struct(*[p.alias(f"a{i}") for i, p in enumerate(parts)]))
        return self.source(Query(df, shape, PlanNode("source", self.schema.ordering)), "adapter")

    def _table(self, kind: str) -> tuple[DataFrame, Node]:
        k = self.kinds[kind]
        link_cols = {c for x in self.links for side, cols in ((x.source, x.source_cols), (x.target, x.target_cols)) if side == kind for c in cols}
        keys = {c: fresh(c) for c in dict.fromkeys([*k.key, *k.ordinal, *sorted(link_cols)])}
        attrs = {a: Scalar(fresh(a), tag, False, "missing" if a in k.optional else "never") for a, (_, tag) in k.attrs.items()}
        roles = {r: fresh(r) for r in ("adapter", "resource", "local", "kind", "uri")}
        key_text = F.concat_ws(":", *[F.col(c).cast("string") for c in k.key])
        made = {
            roles["adapter"]: F.lit(self.schema.namespace),
            roles["resource"]: F.lit(self.resource),
            roles["local"]: key_text,
            roles["kind"]: F.lit(kind),
            roles["uri"]: F.concat(F.lit(f"{self.resource}#{kind}/"), key_text),
        }
        df = k.table.select(*[F.col(c).alias(n) for c, n in keys.items()], *[e.alias(attrs[a].name) for a, (e, _) in k.attrs.items()], *[e.alias(n) for n, e in made.items()])
        return df, Node(roles, attrs, self, keys, kind)

    def roots(self) -> Query:
        if len(self.root_kinds) != 1:
            raise LoomError("query.several-root-kinds", "say which kind to start from")
        return self.kind_query(self.root_kinds[0])

    def height(self, names, direction):
        return None

    def kind_of(self, q: Query) -> str:
        return q.shape.kind_name

    def hops(self, kind: str, names, direction: str) -> list[tuple[Link, bool]]:
        """(link, forward) that leave a kind."""
        out = []
        for x in self.links:
            if x.name in names and direction in ("forward", "both") and x.source == kind:
                out.append((x, True))
            if x.name in names and direction in ("reverse", "both") and x.target == kind:
                out.append((x, False))
        return out

    def hop(self, q: Query, link: Link, forward: bool = True) -> Query:
        kind = link.target if forward else link.source
        df, shape = self._table(kind)
        a, b = (link.source_cols, link.target_cols) if forward else (link.target_cols, link.source_cols)
        on = None
        for x, y in zip(a, b):
            c = F.col(q.shape.keys[x]) == F.col(shape.keys[y])
            on = c if on is None else on & c
        keep = q.carried()
        joined = q.df.join(df, on).select(*keep, *shape.columns())
        k = self.kinds[kind]
        parts = [F.col(shape.keys[c]) for c in (k.ordinal or k.key)]
        return Query(joined.withColumn(ORD, then(*parts)), shape, q.plan, q.captures)

    def paths(self, kind: str, targets, max_depth: int | None = None, names=None) -> list[list[Link]]:
        """Chains of child links from a kind to each of the target kinds (all kinds if None)."""
        names = set(self.child_names() if names is None else names)
        out, todo = [], [(kind, [])]
        while todo:
            at, path = todo.pop()
            if max_depth is not None and len(path) >= max_depth:
                continue
            for link, _ in self.hops(at, names, "forward"):
                if len(path) >= MAX_UNROLL:
                    raise LoomError("query.unbounded-traversal", "the kinds form a cycle")
                longer = [*path, link]
                if targets is None or link.target in targets:
                    out.append(longer)
                todo.append((link.target, longer))
        return out

    def traverse(self, q, edges, roles, direction, max_depth, include_self):
        """All paths of up to ``max_depth`` links, in pre-order; kinds without further links end a path when the plan is made.

        The path of a row lists its links and keys as text that sorts like them, so
        that rows of different kinds interleave as in a walk.
        """
        from ..plans.selector import one

        first, path = fresh("first"), fresh("path")
        start = q.df.select("*", F.col(ORD).alias(first), F.array().cast("array<string>").alias(path))
        names, level = set(self.names_of(edges, roles)), [Query(start, q.shape, q.plan, q.captures)]
        out = list(level) if include_self else []
        for depth in range(max_depth):
            if depth > MAX_UNROLL:
                raise LoomError("query.unbounded-traversal", f"a walk of more than {MAX_UNROLL} steps")
            level = [self._further(x, link, forward, path) for x in level for link, forward in self.hops(self.kind_of(x), names, direction)]
            if not level:
                break
            out += level
        placed = [Query(x.df.withColumn(ORD, F.struct(F.col(first).alias("a"), F.col(path).alias("b0"))).drop(first, path), x.shape, x.plan, x.captures) for x in out]
        return one(placed, q)

    def _further(self, q: Query, link: Link, forward: bool, path: str) -> Query:
        out = self.hop(q, link, forward)
        k = self.kinds[link.target if forward else link.source]
        types = dict(out.df.dtypes)
        parts = [F.lit(f"{self.links.index(link):04d}")]
        for c in (out.shape.keys[x] for x in (k.ordinal or k.key)):
            number = types[c] in ("tinyint", "smallint", "int", "bigint")
            parts.append(F.lpad((F.col(c).cast("decimal(38,0)") + F.lit(str(1 << 63)).cast("decimal(38,0)")).cast("string"), 20, "0") if number else F.col(c).cast("string"))
        return Query(out.df.withColumn(path, F.concat(path, F.array(F.concat_ws("\0", *parts)))), out.shape, out.plan, out.captures)

    def siblings_of(self, q: Query, link: Link, following: bool) -> Query:
        """Next or following children of the same parent, by the ordinal of their kind."""
        kind = link.target
        k = self.kinds[kind]
        df, shape = self._table(kind)
        order = [shape.keys[c] for c in (k.ordinal or k.key)]
        parent = [shape.keys[c] for c in link.target_cols]
        mine = [q.shape.keys[c] for c in link.target_cols]
        here = [q.shape.keys[c] for c in (k.ordinal or k.key)]
        on = None
        for x, y in zip(mine, parent):
            c = F.col(x) == F.col(y)
            on = c if on is None else on & c
        if following:
            on = on & (F.struct(*[F.col(y).alias(f"k{i}") for i, y in enumerate(order)]) > F.struct(*[F.col(x).alias(f"k{i}") for i, x in enumerate(here)]))
        else:
            w = Window.partitionBy(*parent).orderBy(*order)
            before = [fresh("before") for _ in order]
            df = df.select("*", *[F.lag(y).over(w).alias(b) for y, b in zip(order, before)])
            for b, x in zip(before, here):
                on = on & (F.col(b) == F.col(x))
        keep = q.carried()
        joined = q.df.join(df, on).select(*keep, *shape.columns())
        return Query(joined.withColumn(ORD, then(*[F.col(c) for c in order])), shape, q.plan, q.captures)
