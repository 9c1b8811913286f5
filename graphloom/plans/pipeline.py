"""The pipeline language: ``from ... | mount ... | select ... | where ... | project ...`` and so on.

Text becomes steps with their offsets, steps become the same queries that the fluent
calls build, so both explain alike.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import functions as F

from ..diagnostics import LoomError
from ..functions import values as V
from ..operators.query import ORD, Query, bound
from ..operators.shapes import Absent, Many, Node, Pair, Scalar, fresh, path_value, sub_shape
from ..schema import AdapterSchema
from . import selector as sel
from . import selector_syntax as S

_ID = r"[A-Za-z][A-Za-z0-9_-]*"
_PATH = re.compile(r"^@([A-Za-z_][\w-]*(?:\.[A-Za-z_][\w-]*)*)$")
_CAPTURED = re.compile(r"^\$([A-Za-z_][\w-]*)(?:\.([A-Za-z_][\w-]*(?:\.[A-Za-z_][\w-]*)*))?$")
_COMPARISON = ("!=", "<=", ">=", "^=", "$=", "*=", "=", "<", ">")


@dataclass(frozen=True)
class Text:
    """A piece of the program with its place."""

    text: str
    start: int

    @property
    def end(self) -> int:
        return self.start + len(self.text)

    def stripped(self) -> Text:
        lead = len(self.text) - len(self.text.lstrip())
        return Text(self.text.strip(), self.start + lead)

    def after(self, n: int) -> Text:
        return Text(self.text[n:], self.start + n).stripped()


@dataclass(frozen=True)
class Pipe:
    source: Text
    steps: tuple[Text, ...]


@dataclass(frozen=True)
class Program:
    text: str
    bindings: tuple[tuple[str, Pipe, Text], ...]
    pipe: Pipe


def fail(code: str, message: str, at: Text):
    raise LoomError(f"dsl.{code}", message, at.start, at.end)


def pieces(t: Text, mark: str) -> list[Text]:
    """Parts between top-level marks; quotes and brackets shelter what is in them."""
    out, depth, begin, i, quote = [], [], 0, 0, None
    s = t.text
    while i < len(s):
        c = s[i]
        if quote:
            if c == "\\":
                i += 1
            elif c == quote:
                quote = None
        elif c in "'\"":
            quote, opened = c, i
        elif c in "([{":
            depth.append((c, i))
        elif c in ")]}":
            if not depth or "([{".index(depth[-1][0]) != ")]}".index(c):
                fail("unbalanced", f"unexpected {c}", Text(c, t.start + i))
            depth.pop()
        elif c == mark and not depth:
            out.append(Text(s[begin:i], t.start + begin).stripped())
            begin = i + 1
        i += 1
    if quote:
        fail("unterminated-string", "a string has no end", Text(s[opened:], t.start + opened))
    if depth:
        fail("unbalanced", f"{depth[-1][0]} is never closed", Text(s[depth[-1][1] :], t.start + depth[-1][1]))
    out.append(Text(s[begin:], t.start + begin).stripped())
    return out


def parse(text: str) -> Program:
    parts = [p for p in pieces(Text(text, 0), ";")]
    if not any(p.text for p in parts):
        fail("empty", "an empty program", Text("", 0))
    bindings = []
    for p in parts[:-1]:
        if not p.text:
            continue
        m = re.match(rf"let\s+({_ID})\s*=\s*", p.text)
        if not m:
            fail("invalid-binding", "expected `let name = pipeline`", p)
        bindings.append((m[1], _pipe(p.after(m.end())), p))
    if not parts[-1].text or re.match(r"let\s", parts[-1].text):
        fail("missing-result", "a program ends with a pipeline", parts[-1])
    return Program(text, tuple(bindings), _pipe(parts[-1]))


def _pipe(t: Text) -> Pipe:
    steps = pieces(t, "|")
    if not re.match(r"from\b", steps[0].text):
        fail("expected-source", "a pipeline begins with `from`", steps[0])
    for s in steps:
        if not s.text:
            fail("empty-step", "an empty step", s)
    return Pipe(steps[0], tuple(steps[1:]))


def format_program(program: Program | str) -> str:
    """The program in its one form: a binding or step a line."""
    p = parse(program) if isinstance(program, str) else program

    def pipe(x: Pipe) -> str:
        return "\n| ".join(t.text for t in (x.source, *x.steps))

    return "\n".join([*(f"let {n} = {pipe(x)};" for n, x, _ in p.bindings), pipe(p.pipe)])


# -- literals and arguments -------------------------------------------------------

_NUMBER = re.compile(r"^-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?$")


def literal(t: Text):
    s = t.text
    if s[:1] in ("'", '"'):
        return string(t)
    if s in ("true", "false"):
        return s == "true"
    if s == "null":
        return None
    if re.fullmatch(r"-?\d+n", s):
        return V.BigInt(s[:-1])
    if _NUMBER.match(s):
        return float(s) if re.search(r"[.eE]", s) else int(s)
    fail("expected-literal", f"not a literal: {s}", t)


def string(t: Text) -> str:
    s = t.text
    if len(s) < 2 or s[0] not in "'\"" or s[-1] != s[0]:
        fail("expected-string", "expected a quoted string", t)
    out, i, body = [], 0, s[1:-1]
    while i < len(body):
        c = body[i]
        if c == "\\":
            i += 1
            if i >= len(body) or body[i] not in "nrt\\'\"/":
                fail("invalid-escape", "unknown escape in a string", t)
            c = {"n": "\n", "r": "\r", "t": "\t"}.get(body[i], body[i])
        elif c == s[0]:
            fail("expected-string", "a quote within a string", t)
        out.append(c)
        i += 1
    return "".join(out)


@dataclass(frozen=True)
class Argument:
    type: str
    many: bool = False
    required: bool = False
    default: object = None
    choices: tuple = ()

    def __post_init__(self):
        if self.type not in ("string", "number", "boolean", "bigint"):
            raise LoomError("dsl.invalid-argument-schema", f"unknown argument type {self.type}")
        if self.required and self.default is not None:
            raise LoomError("dsl.invalid-argument-schema", "a required argument has no default")


def object_parts(t: Text, code: str = "expected-arguments") -> list[tuple[str, Text]]:
    if not (t.text.startswith("{") and t.text.endswith("}")):
        fail(code, "expected { name: value }", t)
    inner = Text(t.text[1:-1], t.start + 1)
    out, seen = [], set()
    if not inner.text.strip():
        return out
    for p in pieces(inner, ","):
        m = re.match(r"""([A-Za-z_][\w-]*|"[^"]*"|'[^']*')\s*:\s*""", p.text)
        if not m:
            if not p.text:
                continue
            fail("invalid-arguments" if code == "expected-arguments" else "invalid-record", "expected name: value", p)
        name = m[1].strip("'\"")
        if name in seen:
            fail("duplicate-argument" if code == "expected-arguments" else "duplicate-field", f"{name} occurs twice", p)
        seen.add(name)
        out.append((name, p.after(m.end())))
    return out


def arguments(declared: dict[str, Argument] | None, t: Text) -> dict:
    given = {n: v for n, v in object_parts(t)} if t.text else {}
    declared = declared or {}
    out = {}
    for n, v in given.items():
        a = declared.get(n)
        if a is None:
            fail("unknown-argument", f"unknown argument {n}", v)
        many = v.text.startswith("[")
        if many != a.many:
            fail("argument-cardinality", f"{n} takes {'a list' if a.many else 'one value'}", v)
        if many:
            if not v.text.endswith("]"):
                fail("invalid-arguments", "a list has no end", v)
            items = [literal(p) for p in pieces(Text(v.text[1:-1], v.start + 1), ",") if p.text]
        else:
            items = [literal(v)]
        for x in items:
            if V.tag_of(x) != a.type:
                fail("argument-type", f"{n} takes a {a.type}", v)
            if a.choices and x not in a.choices:
                fail("argument-choice", f"{n} is one of {list(a.choices)}", v)
        out[n] = items if many else items[0]
    for n, a in declared.items():
        if n not in out:
            if a.required:
                fail("missing-argument", f"missing argument {n}", t)
            if a.default is not None:
                out[n] = a.default
    return out


# -- environment --------------------------------------------------------------------


@dataclass(frozen=True)
class Source:
    open: Callable[..., Query]
    arguments: dict[str, Argument] = field(default_factory=dict)
    mode: str = "roots"
    view: Callable[[dict], str | None] | None = None


@dataclass(frozen=True)
class Mount:
    mount: Callable[..., Query]
    schema: AdapterSchema
    arguments: dict[str, Argument] = field(default_factory=dict)
    view: Callable[[dict], str | None] | None = None


@dataclass(frozen=True)
class OperationSpec:
    create: Callable
    adapter: object
    arguments: dict[str, Argument] | None = None


@dataclass(frozen=True)
class Function:
    """A scalar function: typed parameters, typed result, and how to make its column."""

    parameters: tuple[str, ...]
    result: str
    column: Callable


@dataclass
class Environment:
    sources: dict[str, Source] = field(default_factory=dict)
    mounts: dict[str, Mount] = field(default_factory=dict)
    operations: dict[str, OperationSpec] = field(default_factory=dict)
    functions: dict[str, Function] = field(default_factory=dict)
    predicates: dict = field(default_factory=dict)


@dataclass
class State:
    query: Query
    schema: AdapterSchema | None = None  # of the graph, for selectors
    attributes: AdapterSchema | None = None  # what where may name
    mode: str = "roots"
    view: str | None = None
    invocation: tuple | None = None
    planned: bool = False

    def derived(self, query: Query) -> State:
        return State(query)


@dataclass(frozen=True)
class Compiled:
    kind: str  # query or plan
    program: Program
    query: Query
    invocation: tuple | None = None

    def plan(self):
        """Operations of a transformation, one for each selected node, as a change plan."""
        from ..change import plan_operations

        spec, args = self.invocation
        return plan_operations([spec.create(node, **args) for node in self.query.collect()], spec.adapter)


class _Scope:
    """What an expression sees."""

    def __init__(self, env: Environment, state: State, captures: dict):
        self.env, self.state, self.captures = env, state, captures


def compile_program(text: str | Program, env: Environment) -> Compiled:
    program = parse(text) if isinstance(text, str) else text
    known: dict[str, State] = {}
    for name, pipe, at in program.bindings:
        if name in known:
            fail("duplicate-binding", f"binding {name} exists already", at)
        made = _compile(pipe, env, known)
        if made.invocation is not None or made.planned:
            fail("effectful-binding", "bindings are queries", at)
        known[name] = made
    state = _compile(program.pipe, env, known)
    if state.invocation is None:
        return Compiled("query", program, state.query)
    if not state.planned:
        fail("expected-plan", "a transformation ends with `plan`", program.pipe.steps[-1])
    return Compiled("plan", program, state.query, state.invocation)


def _call(t: Text, word: str, code: str) -> tuple[str, Text]:
    m = re.match(rf"{word}\s+({_ID}(?:::{_ID})?)\s*\((.*)\)\s*$", t.text, re.S)
    if not m:
        fail(code, f"expected `{word} name(...)`", t)
    return m[1], Text(m[2], t.start + m.start(2)).stripped()


def _compile(pipe: Pipe, env: Environment, known: dict) -> State:
    name, given = _call(pipe.source, "from", "invalid-source")
    source = env.sources.get(name)
    if source is None:
        fail("unknown-source", f"unknown source {name}", pipe.source)
    args = arguments(source.arguments, given)
    view = source.view(args) if source.view else None
    query = source.open(**args)
    schema = query.shape.graph.schema if isinstance(query.shape, Node) else None
    state = State(query, schema, schema, source.mode, view)
    if view is not None and schema is not None and view not in schema.views:
        fail("unknown-tree-view", f"unknown tree view {view}", pipe.source)
    for t in pipe.steps:
        word = re.match(r"[A-Za-z]+", t.text)
        if state.planned:
            fail("after-plan", "nothing follows `plan`", t)
        if state.invocation is not None and t.text != "plan":
            fail("expected-plan", "`invoke` is followed by `plan`", t)
        step = _STEPS.get(word[0] if word else "")
        if step is None:
            fail("unknown-step", f"unknown step {t.text.split()[0]}", t)
        state = step(t, state, env, known)
    return state


def _mount(t, state, env, known):
    name, given = _call(t, "mount", "invalid-mount")
    m = env.mounts.get(name)
    if m is None:
        fail("unsupported-mount", f"unknown mount {name}", t)
    if state.schema is None:
        fail("unsupported-mount", "only nodes can hold a mount", t)
    args = arguments(m.arguments, given)
    view = m.view(args) if m.view else None
    if view is not None and view not in m.schema.views:
        fail("unknown-tree-view", f"unknown tree view {view}", t)
    query = m.mount(state.query, **args)
    return State(query, query.shape.graph.schema, m.schema, "roots", None)


def _select(t, state, env, known):
    if state.schema is None or not isinstance(state.query.shape, Node):
        fail("select-after-derived", "only nodes of a graph can be selected", t)
    quoted = t.after(len("select"))
    text = string(quoted)
    try:
        query = sel.select(state.query, text, state.mode, state.view, state.schema, env.predicates)
    except LoomError as e:
        at = e.diagnostic.locations[0] if e.diagnostic.locations else {"start": 0, "end": 0}
        raise LoomError(e.code, e.diagnostic.message, quoted.start + 1 + at["start"], quoted.start + 1 + at["end"]) from e
    return replace(state, query=query, mode="roots")


def _split_comparison(t: Text):
    """(left, operator, right) at the first top-level operator."""
    s, quote, depth, i = t.text, None, 0, 0
    while i < len(s):
        c = s[i]
        if quote:
            if c == "\\":
                i += 1
            elif c == quote:
                quote = None
        elif c in "'\"":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif depth == 0:
            for op in _COMPARISON:
                if s.startswith(op, i) and not (op == "$=" and i == 0):
                    return Text(s[:i], t.start).stripped(), op, Text(s[i + len(op) :], t.start + i + len(op)).stripped()
        i += 1
    fail("invalid-where", "expected a comparison", t)


def _where(t, state, env, known):
    cond = t.after(len("where"))
    scope = _Scope(env, state, state.query.captures)
    m = re.match(r"(.*?)\s+is\s+(null|missing)$", cond.text, re.S)
    if m:
        left = Text(m[1], cond.start).stripped()
        _known_attribute(left, state, cond)
        v = value(left, state.query.shape, scope)
        return replace(state, query=state.query.filter(v.is_null() if m[2] == "null" else v.missing(), "where"))
    left, op, right = _split_comparison(cond)
    a, b = value(left, state.query.shape, scope), value(right, state.query.shape, scope)
    for side, other in ((left, b), (right, a)):
        declared = _known_attribute(side, state, cond)
        if declared is not None and other.literal and other.tag in V.SQL_TYPE and other.tag not in declared.tags:
            fail("type-mismatch", f"{side.text} is never a {other.tag}", cond)
    if op in ("^=", "$=", "*="):
        test = V.matches(op, a, b)
    else:
        test = {"=": lambda: a == b, "!=": lambda: a != b, "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b}[op]()
    return replace(state, query=state.query.filter(test, "where"))


def _known_attribute(t: Text, state: State, at: Text):
    m = _PATH.match(t.text)
    if not m or state.attributes is None or not isinstance(state.query.shape, Node):
        return None
    head = m[1].split(".")[0]
    if head in ("origin", "id"):
        return None
    declared = state.attributes.attribute(head)
    if declared is None:
        fail("unknown-attribute", f"unknown attribute {head}", at)
    return declared


def _project(t, state, env, known):
    body = t.after(len("project"))
    if not body.text.startswith("{"):
        fail("expected-projection", "expected `project { name: expression }`", t)
    df, shape = record(body, state.query.df, state.query.shape, _Scope(env, state, state.query.captures))
    q = state.query._next("project", df, shape, details={"label": "project"})
    return state.derived(q)


def _distinct(t, state, env, known):
    if t.text != "distinct":
        fail("invalid-distinct", "`distinct` takes nothing", t)
    return replace(state, query=state.query.distinct())


def _take(t, state, env, known):
    m = re.fullmatch(r"take\s+(\d+)", t.text)
    if not m:
        fail("invalid-take", "expected `take n`", t)
    return replace(state, query=state.query.take(int(m[1])))


def _count(t, state, env, known):
    if t.text != "count":
        fail("invalid-count", "`count` takes nothing", t)
    return state.derived(state.query.count())


def _sort(t, state, env, known):
    m = re.fullmatch(r"sort\s+(.+)", t.text, re.S)
    names = [p.text for p in pieces(Text(m[1], t.start), ",")] if m else []
    if not names or not all(re.fullmatch(r"[A-Za-z_][\w-]*", n) for n in names):
        fail("invalid-sort", "expected `sort field, ...`", t)
    q = state.query
    return state.derived(q.sort(*[(lambda r, n=n: path_value(q.shape, [n])) for n in names], label="sort"))


def _join(t, state, env, known):
    m = re.match(rf"join\s+({_ID})\s+on\s+(.+)$", t.text, re.S)
    if not m:
        fail("invalid-join", "expected `join binding on left = right`", t)
    other = known.get(m[1])
    if other is None:
        fail("unknown-binding", f"unknown binding {m[1]}", t)
    sides = _split_comparison(Text(m[2], t.start + m.start(2)))
    if sides[1] != "=":
        fail("invalid-join", "expected `join binding on left = right`", t)
    # keys see the values alone, not their captures
    blind = _Scope(env, state, {})
    q = state.query.join(other.query, lambda r: value(sides[0], r.shape, blind), lambda r: value(sides[2], r.shape, blind), "dsl join")
    return state.derived(q)


def _invoke(t, state, env, known):
    m = re.match(r"invoke\s+([^\s{]+)\s*", t.text)
    spec = env.operations.get(m[1]) if m else None
    if spec is None:
        fail("unsupported-operation", "unknown operation", t)
    if not hasattr(spec.adapter, "plan"):
        fail("missing-planning", "the adapter plans no operations", t)
    return replace(state, invocation=(spec, arguments(spec.arguments, t.after(m.end()))))


def _plan(t, state, env, known):
    if t.text != "plan" or state.invocation is None:
        fail("invalid-plan", "`plan` follows `invoke`", t)
    return replace(state, planned=True)


_STEPS = {"mount": _mount, "select": _select, "where": _where, "project": _project, "distinct": _distinct, "take": _take, "count": _count, "sort": _sort, "join": _join, "invoke": _invoke, "plan": _plan}


# -- expressions ----------------------------------------------------------------------


def value(t: Text, shape, scope: _Scope) -> V.Value:
    """A scalar expression as a typed value."""
    m = _PATH.match(t.text)
    if m:
        return path_value(shape, m[1].split("."))
    m = _CAPTURED.match(t.text)
    if m:
        path = m[2].split(".") if m[2] else []
        if m[1] in ("left", "right") and isinstance(shape, Pair):
            return path_value(getattr(shape, m[1]), path)
        held = scope.captures.get(m[1])
        return path_value(held, path) if held is not None else V.MISSING
    m = re.match(r"([A-Za-z][\w-]*(?:::[A-Za-z][\w-]*)?)\s*\((.*)\)$", t.text, re.S)
    if m and m[1] != "related":
        f = scope.env.functions.get(m[1])
        if f is None:
            fail("unknown-function", f"unknown function {m[1]}", t)
        inner = Text(m[2], t.start + m.start(2)).stripped()
        args = [value(p, shape, scope) for p in pieces(inner, ",")] if inner.text else []
        if len(args) != len(f.parameters) or any(a.tag is not None and a.tag != p for a, p in zip(args, f.parameters)):
            fail("function-arguments", f"{m[1]} takes {list(f.parameters)}", t)
        return V.native(f.column(*[a.col if a.tag is not None else a.col[V._PART[p]] for a, p in zip(args, f.parameters)]), f.result)
    return V.literal(literal(t))


def record(t: Text, df, shape, scope: _Scope):
    fields = {}
    for name, part in object_parts(t, "invalid-record"):
        df, fields[name] = projection(part, df, shape, scope)
    return bound(df, fields)


def projection(t: Text, df, shape, scope: _Scope):
    """(df, shape) of an expression that may be a record or a related query."""
    if t.text.startswith("{"):
        return record(t, df, shape, scope)
    m = re.match(r"related\s*\((.*)\)$", t.text, re.S)
    if m:
        return related(t, Text(m[1], t.start + m.start(1)), df, shape, scope)
    m = _PATH.match(t.text)
    if m:
        kept = sub_shape(shape, m[1].split("."))
        if kept is not None:
            return df, kept
    m = _CAPTURED.match(t.text)
    if m:
        held = getattr(shape, m[1]) if m[1] in ("left", "right") and isinstance(shape, Pair) else scope.captures.get(m[1])
        kept = sub_shape(held, m[2].split(".") if m[2] else []) if held is not None else None
        if kept is not None:
            return df, kept
    return bound(df, value(t, shape, scope))


def related(t: Text, inner: Text, df, shape, scope: _Scope):
    """A selector from each row: one join, its results gathered by row and joined back."""
    parts = pieces(inner, ",")
    if len(parts) != 3:
        fail("related-arguments", "related takes a mode, a selector and an expression", t)
    mode = literal(parts[0])
    if mode not in ("one", "many"):
        fail("related-mode", "the mode is one or many", t)
    if parts[1].text[:1] not in ("'", '"'):
        fail("related-selector", "the selector is a quoted string", t)
    if scope.state.schema is None:
        fail("related-after-derived", "only nodes of a graph have related nodes", t)
    if not isinstance(shape, Node):
        fail("related-node", "only nodes have related nodes", t)
    text = string(parts[1])
    tree = S.check(S.parse(text), scope.state.schema, scope.env.predicates)
    for c in _captures(tree.sequence):
        if c in scope.captures:
            fail("related-capture-collision", f"capture ${c} exists outside", t)
    row = fresh("row")
    start = Query(df.select(ORD, F.col(ORD).alias(row), *dict.fromkeys([*shape.columns(), *(c for s in scope.captures.values() for c in s.columns())])), shape, scope.state.query.plan, scope.captures)
    if scope.state.view is not None:
        start = sel.in_view(start, scope.state.view)
    found = sel.Lowering(scope.env.predicates).run([start], tree.sequence, True)
    if not found:
        name = fresh("related")
        return (df, Absent()) if mode == "one" else (df.withColumn(name, F.array()), Many(name, Absent()))
    q = found[0]
    if len(found) > 1:
        fail("related-selector", "the selector reaches several kinds of rows", t)
    made, element = projection(parts[2], q.df, q.shape, _Scope(scope.env, replace(scope.state, query=q), q.captures))
    cols = element.columns()
    gathered = made.groupBy(row).agg(F.array_sort(F.collect_list(F.struct(F.col(ORD).alias("o"), F.struct(*[F.col(c) for c in cols], F.lit(True).alias("_")).alias("e")))).alias("_all"))
    name, key = fresh("related"), fresh("key")
    gathered = gathered.select(F.col(row).alias(key), F.transform("_all", lambda x: x["e"]).alias(name))
    out = df.join(gathered, F.col(ORD) == F.col(key), "left").drop(key)
    if mode == "many":
        return out.withColumn(name, F.coalesce(name, F.array())), Many(name, element)
    one = F.when(F.size(name) > 1, F.raise_error(F.lit("dsl.related-cardinality: more than one related node")).cast(made.select(F.struct(*[F.col(c) for c in cols], F.lit(True).alias("_")).alias("e")).schema["e"].dataType)).otherwise(F.get(name, F.lit(0)))
    m = {c: fresh(c) for c in cols}
    picked = fresh("one")
    out = out.withColumn(picked, one).select("*", *[F.col(picked)[c].alias(n) for c, n in m.items()]).drop(name, picked)
    return out, _optional(element.renamed(m))


def _optional(shape):
    """The shape of a value that may be missing."""
    if isinstance(shape, Scalar):
        return replace(shape, null_is="missing") if shape.null_is == "never" else shape
    return shape


def _captures(seq: S.Sequence):
    for step in seq.steps:
        yield from (n for n, _ in step.compound.captures)
