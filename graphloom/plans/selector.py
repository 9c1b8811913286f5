"""Selectors lowered to joins: child steps, ranges, semi and anti joins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import values as V
from ..operators.query import ORD, Query
from ..operators.shapes import PLACES, Node, Scalar, fresh
from ..schema import AdapterSchema
from ..sources.graph import RelationalGraph
from . import selector_syntax as S
from .plan import PlanNode


class Lowering:
    """Applies one selector to queries; relational graphs have a query for each kind on the way."""

    def __init__(self, predicates: dict | None = None):
        self.predicates = predicates or {}

    # -- steps ------------------------------------------------------------
    def run(self, queries: list[Query], seq: S.Sequence, expand: bool) -> list[Query]:
        first = seq.steps[0].compound
        if expand:
            queries = self.descend(queries, first, True)
        queries = self.narrowed(queries, first)
        for step in seq.steps[1:]:
            queries = self.narrowed(self.step(queries, step.combinator, step.compound), step.compound)
        return queries

    def step(self, queries: list[Query], c: S.Combinator, target: S.Compound) -> list[Query]:
        if c.op == " ":
            return self.descend(queries, target, False)
        out = []
        for q in queries:
            graph = q.shape.graph
            if isinstance(graph, RelationalGraph):
                out += self._relational(q, graph, c, target)
            elif c.op in "+~":
                out.append(graph.siblings(q, c.op == "~"))
            else:
                names = graph.child_names() if c.op == ">" else [c.edge]
                out += _many(graph.step(q, names, "reverse" if c.op == "<-" else "forward"))
        return [x for x in out if _can_be(x, target.kind)]

    def _relational(self, q, graph, c, target):
        kind = graph.kind_of(q)
        fits = lambda k: target.kind is None or k == target.kind
        if c.op in "+~":
            return [graph.siblings_of(q, x, c.op == "~") for x in graph.links if x.target == kind and x.name in graph.child_names() and fits(kind)]
        names = graph.child_names() if c.op == ">" else [c.edge]
        hops = graph.hops(kind, names, "reverse" if c.op == "<-" else "forward")
        return [graph.hop(q, x, forward) for x, forward in hops if fits(x.target if forward else x.source)]

    def descend(self, queries: list[Query], target: S.Compound, include_self: bool) -> list[Query]:
        out = []
        for q in queries:
            graph = q.shape.graph
            if not isinstance(graph, RelationalGraph):
                out += [x for x in _many(graph.descend(q, include_self)) if _can_be(x, target.kind)]
                continue
            kind = graph.kind_of(q)
            if include_self and (target.kind is None or kind == target.kind):
                out.append(q)
            for path in graph.paths(kind, None if target.kind is None else {target.kind}):
                now = q
                for link in path:
                    now = graph.hop(now, link)
                out.append(now)
        return out

    # -- compounds --------------------------------------------------------
    def narrowed(self, queries: list[Query], c: S.Compound) -> list[Query]:
        out = []
        for q in queries:
            if q.shape.kind_name is not None and c.kind is not None and q.shape.kind_name != c.kind:
                continue
            q = self.filtered(q, c)
            for name, _ in c.captures:
                q = Query(q.df, q.shape, q.plan, {**q.captures, name: q.shape})
            out.append(q)
        return out

    def filtered(self, q: Query, c: S.Compound) -> Query:
        cond = self.condition(q, c)
        if cond is not None:
            q = Query(q.df.where(cond), q.shape, q.plan, q.captures)
        for p in c.pseudos:
            q = self.pseudo(q, p)
        return q

    def condition(self, q: Query, c: S.Compound) -> Column | None:
        parts = []
        if c.kind is not None and q.shape.kind_name is None:
            parts.append(q.shape.kind() == c.kind)
        parts += [self.test(q, t) for t in c.tests]
        out = None
        for p in parts:
            out = p if out is None else out & p
        return out

    def test(self, q: Query, t: S.Test) -> Column:
        a = q.shape.attr(t.attribute)
        if t.op == "exists":
            return a.present()
        if t.op == "missing":
            return a.missing()
        if a.tag == "missing":
            return F.lit(False)
        if t.op == "null":
            return a.is_null()
        if t.op == "regex":
            return V.matches_regex(a, V.java_regex(*t.operands[0]))
        if t.op == "in":
            return self._membership(a, [x.value for x in t.operands])
        x = t.operands[0]
        b = V.literal(x.value) if isinstance(x, S.Literal) else q.captures[x.capture].attr(x.attribute)
        return V.matches(t.op, a, b)

    def _membership(self, a: V.Value, values) -> Column:
        if not a.many and a.tag in V.SQL_TYPE:
            own = [v for v in values if V.tag_of(v) == a.tag]
            cond = a.col.isin(own) if own else F.lit(False)
            if None in values:
                cond = cond | a.is_null()
            return cond if a.null_is == "never" else F.coalesce(cond, F.lit(False))
        out = F.lit(False)
        for v in values:
            out = out | V.matches("=", a, V.literal(v))
        return out

    def pseudo(self, q: Query, p: S.Pseudo) -> Query:
        if p.name not in ("not", "is", "has"):
            cond = self.predicates[p.name].column(q.view, *[x.value for x in p.args])
            return Query(q.df.where(F.coalesce(cond, F.lit(False))), q.shape, q.plan, q.captures)
        plain = [self._plain(q, s) for s in p.selectors] if p.name != "has" else [None]
        if all(x is not None for x in plain):
            # single compounds without steps: one condition, no join
            either = F.lit(False)
            for x in plain:
                either = either | x
            return Query(q.df.where(~either if p.name == "not" else either), q.shape, q.plan, q.captures)
        inner, how = (p, "left_semi") if p.name == "has" else (self._only_has(q, p), "left_anti")
        if inner is not None:
            met = self._by_key(q, inner)
            if met is not None:
                return Query(q.df.join(*met, how), q.shape, q.plan, q.captures)
        row = fresh("row")
        marked = Query(q.df.withColumn(row, F.col(ORD)), q.shape, q.plan, q.captures)
        found = None
        for s in p.selectors:
            if p.name == "has":
                lead = s.leading or S.Combinator(" ", None, S.Span(0, 0))
                start = self.narrowed(self.step([marked], lead, s.steps[0].compound), s.steps[0].compound)
            else:
                start = self.narrowed([marked], s.steps[0].compound)
            for step in s.steps[1:]:
                start = self.narrowed(self.step(start, step.combinator, step.compound), step.compound)
            for x in start:
                ids = x.df.select(F.col(row).alias("_match"))
                found = ids if found is None else found.unionAll(ids)
        if found is None:
            return q if p.name == "not" else Query(q.df.where(F.lit(False)), q.shape, q.plan, q.captures)
        how = "left_anti" if p.name == "not" else "left_semi"
        return Query(q.df.join(found, F.col(ORD) == F.col("_match"), how), q.shape, q.plan, q.captures)

    @staticmethod
    def _only_has(q: Query, p: S.Pseudo) -> S.Pseudo | None:
        """The ``:has`` that is all of a ``:not``."""
        if p.name != "not" or len(p.selectors) != 1 or len(p.selectors[0].steps) != 1:
            return None
        c = p.selectors[0].steps[0].compound
        fits = c.kind is None or c.kind == q.shape.kind_name
        return c.pseudos[0] if fits and not c.tests and not c.captures and len(c.pseudos) == 1 and c.pseudos[0].name == "has" else None

    def _by_key(self, q: Query, p: S.Pseudo):
        """(keys, condition) of a ``:has`` over one link of tables: a join on the foreign key, without the rows themselves."""
        graph = q.shape.graph
        if not isinstance(graph, RelationalGraph) or q.captures or len(p.selectors) != 1:
            return None
        s = p.selectors[0]
        first = s.steps[0].compound
        if s.leading is None or s.leading.op != ">":
            return None
        hops = [(x, f) for x, f in graph.hops(graph.kind_of(q), graph.child_names(), "forward") if first.kind in (None, x.target)]
        if len(hops) != 1:
            return None
        link = hops[0][0]
        start = graph.kind_query(link.target)
        held = {c: fresh("held") for c in link.target_cols}
        start = Query(start.df.select("*", *[F.col(start.shape.keys[c]).alias(n) for c, n in held.items()]), start.shape, start.plan, start.captures)
        found = self.narrowed([start], first)
        for step in s.steps[1:]:
            found = self.narrowed(self.step(found, step.combinator, step.compound), step.compound)
        if len(found) != 1:
            return None
        on = None
        for a, b in zip(link.source_cols, link.target_cols):
            c = F.col(q.shape.keys[a]) == F.col(held[b])
            on = c if on is None else on & c
        return found[0].df.select(*held.values()), on

    def _plain(self, q: Query, s: S.Sequence) -> Column | None:
        c = s.steps[0].compound
        if len(s.steps) > 1 or c.pseudos:
            return None
        if c.kind is not None and q.shape.kind_name is not None and c.kind != q.shape.kind_name:
            return F.lit(False)
        inner = q
        for name, _ in c.captures:
            inner = Query(inner.df, inner.shape, inner.plan, {**inner.captures, name: inner.shape})
        cond = self.condition(inner, c)
        return F.lit(True) if cond is None else cond


def _can_be(q: Query, kind: str | None) -> bool:
    """Whether rows of a query can be of a kind; a mount's rows are either containers or document nodes."""
    graph = q.shape.graph
    return kind is None or kind in getattr(graph, "base", graph).schema.kinds


def _many(x) -> list[Query]:
    return x if isinstance(x, list) else [x]


def one(queries: list[Query], empty: Query) -> Query:
    """A single query of several: attributes by name, absent ones missing; the order is then unknown."""
    if not queries:
        return Query(empty.df.where(F.lit(False)), empty.shape, empty.plan, empty.captures)
    if len(queries) == 1:
        return queries[0]
    roles = list(dict.fromkeys(r for q in queries for r in q.shape.cols))
    names: dict[str, set] = {}
    for q in queries:
        for n, s in q.shape.attrs.items():
            names.setdefault(n, set()).add((s.tag, s.many))
    cols = {r: fresh(r) for r in roles}
    attrs = {n: Scalar(fresh(n), *(next(iter(kinds)) if len(kinds) == 1 else (None, False))) for n, kinds in names.items()}
    keys = {n: fresh(n) for n in dict.fromkeys(k for q in queries for k in q.shape.keys)} if len({id(q.shape.graph) for q in queries}) == 1 and not isinstance(queries[0].shape.graph, RelationalGraph) else {}
    captured = list(dict.fromkeys(c for s in queries[0].captures.values() for c in s.columns()))
    dfs = []
    alike = len({q.df.schema[ORD].dataType.simpleString() for q in queries}) == 1
    for q in queries:
        made = [F.col(ORD) if alike else F.to_json(F.struct(F.col(ORD))).alias(ORD)]
        for r, c in cols.items():
            have = q.shape.cols.get(r)
            made.append((F.col(have) if have else F.lit(None).cast("long" if r in PLACES else "string")).alias(c))
        for n, s in attrs.items():
            v = q.shape.attr(n)
            if v.tag == "missing":
                kind = V.TAGGED if s.tag is None else (f"array<{V.SQL_TYPE[s.tag]}>" if s.many else V.SQL_TYPE[s.tag])
                made.append(F.lit(None).cast(kind).alias(s.name))
            elif s.tag is None and v.tag is not None:
                item = v.item()
                made.append(F.when(item.isNotNull(), F.struct(*[item[p].alias(p) for p in "tsnbi"], F.lit(None).cast(f"array<{V.ITEM}>").alias("m"))).alias(s.name))
            else:
                made.append(v.col.cast(V.SQL_TYPE[s.tag]).alias(s.name) if s.tag is not None and not s.many else v.col.alias(s.name))
        for k, c in keys.items():
            made.append((F.col(q.shape.keys[k]) if k in q.shape.keys else F.lit(None)).alias(c))
        dfs.append(q.df.select(*made, *captured))
    df = dfs[0]
    for other in dfs[1:]:
        df = df.unionByName(other)
    shape = Node(cols, attrs, queries[0].shape.graph, keys)
    return Query(df, shape, PlanNode("source", queries[0].ordering if alike else "unknown"), queries[0].captures)


def select(source: Query, text: str, mode: str = "selection", view: str | None = None, schema: AdapterSchema | None = None, predicates: dict | None = None, captures: bool = True) -> Query:
    """Rows of ``source`` (nodes) that a selector reaches, with its captures.

    In mode "roots" the first compound is looked for in each row's whole subtree, in
    mode "selection" at the row itself.
    """
    parsed = S.parse(text)
    if not isinstance(source.shape, Node):
        raise TypeError("only nodes can be selected from")
    graph = source.shape.graph
    schema = schema or graph.schema
    S.check(parsed, schema, predicates, {k: s.kind_name if isinstance(s, Node) else None for k, s in source.captures.items()})
    if view is not None and graph.view != view:
        source = in_view(source, view)
    got = one(Lowering(predicates).run([source], parsed.sequence, mode == "roots"), source)
    return got.relabelled(explained(source.plan, parsed.sequence, mode, got.ordering))


def in_view(q: Query, view: str) -> Query:
    """The same rows, their child steps restricted to a tree view."""
    from dataclasses import replace

    graph = replace(q.shape.graph, view=view)
    graph.schema.child_edges(view)
    out = Query(q.df, replace(q.shape, graph=graph), q.plan, q.captures)
    if q.forest is not None:
        out.forest = graph
    return out


def explained(plan: PlanNode, seq: S.Sequence, mode: str, ordering: str) -> PlanNode:
    """The selector as operators of the algebra: a traversal and a filter for each step."""
    if mode == "roots":
        plan = PlanNode("traverse", plan.ordering, {"roles": ["child"], "includeSelf": True, "direction": "forward"}, (plan,))
    for i, step in enumerate(seq.steps):
        c = step.combinator
        if c is not None:
            details = {" ": {"step": "descendant"}, ">": {"step": "child"}, "+": {"step": "adjacent-sibling"}, "~": {"step": "following-sibling"}}.get(c.op) or {"step": "edge", "edges": [c.edge], "direction": "reverse" if c.op == "<-" else "forward"}
            before = seq.steps[i - 1].compound.kind
            after = step.compound.kind
            if before and after and before.split("::")[0] != after.split("::")[0]:
                details = {**details, "mount": f"{before.split('::')[0]} -> {after.split('::')[0]}"}
            plan = PlanNode("traverse", plan.ordering, details, (plan,))
        plan = PlanNode("filter", plan.ordering, {"selector": step.compound.kind or "*"}, (plan,))
        for name, _ in step.compound.captures:
            plan = PlanNode("capture", plan.ordering, {"name": name}, (plan,))
    return PlanNode(plan.operator, ordering, plan.details, plan.inputs)
