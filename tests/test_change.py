import io
import json

import pytest

from graphloom import change as C
from graphloom import cli, plugin
from graphloom.diagnostics import LoomError
from graphloom.plans import pipeline as P
from graphloom.plans.selector import select
from graphloom.schema import AdapterSchema, Edge, View, attr
from graphloom.sources import documents as D
from graphloom.sources import filesystem as FS
from graphloom.sources import sql_rows as S


class Fake:
    namespace, version = "fake", "1"

    def __init__(self, broken=()):
        self.broken, self.done = broken, []

    def plan(self, op):
        return [C.Change("", "", "fake", op.target["uri"], op.name, *op.args.get("range", (None, None)))]

    def apply(self, changes):
        for c in changes:
            if c.uri in self.broken:
                raise OSError("no")
            self.done.append(c.uri)


def op(uri, id=None, after=(), **args):
    return C.Operation("fake::do", {"uri": uri}, args, id, tuple(after))


def test_order_and_faults():
    assert [n for n, _ in C.ordered([op("b", "b", ["a"]), op("a", "a")])] == ["a", "b"]
    for bad in ([op("a", "a", ["b"]), op("b", "b", ["a"])], [op("a", "a", ["z"])], [op("a", "a"), op("b", "a")]):
        with pytest.raises(ValueError):
            C.ordered(bad)


def test_overlaps(spark):
    ranges = [(0, 5), (4, 6), (5, 5), (6, 6), (6, 6), (7, 9), (None, None)]
    plan = C.plan_operations([op("x", range=r) for r in ranges], Fake())
    want = {(a.id, b.id) for a, b in C.overlaps(plan.changes)}
    assert plan.failed and ("op:0/0", "op:1/0") in want and ("op:3/0", "op:4/0") in want and ("op:1/0", "op:2/0") in want and ("op:0/0", "op:2/0") not in want
    got = {(r.a, r.b) for r in C.conflicts(C.changes_table(spark, plan)).collect()}
    assert got == want
    with pytest.raises(LoomError):
        C.apply(plan)


@pytest.mark.parametrize("policy, expected", [("stop", ["failed", "skipped-dependency", "skipped-policy"]), ("continue-independent", ["failed", "skipped-dependency", "applied"])])
def test_policies(policy, expected):
    plan = C.plan_operations([op("a", "a"), op("b", "b", ["a"]), op("c", "c")], Fake(["a"]))
    assert [r["status"] for r in C.apply(plan, policy)] == expected


def test_saved_plans():
    fake = Fake()
    plan = C.plan_operations([op("a")], fake)
    text = C.serialize(plan)
    assert C.deserialize(text, {"fake": fake}).changes == plan.changes
    for bad in (text.replace('"a"', '"b"'), "{}", "x"):
        with pytest.raises(LoomError) as e:
            C.deserialize(bad, {"fake": fake})
        assert e.value.code == "cli.invalid-plan"
    with pytest.raises(LoomError):
        C.deserialize(text, {})


def test_file_changes(spark, tmp_path):
    (tmp_path / "a.txt").write_text("old")
    (tmp_path / "b.txt").write_text("b")
    (tmp_path / "c.txt").write_text("c")
    by = {x["id"]["local"]: x for x in FS.filesystem(spark, str(tmp_path)).all().collect()}
    adapter = C.FileChanges(str(tmp_path))
    ops = [C.Operation("fs::write", by["a.txt"], {"content": "new"}), C.Operation("fs::move", by["b.txt"], {"path": "d.txt"}), C.Operation("fs::remove", by["c.txt"]), C.Operation("fs::create", by["."], {"path": "e.txt", "content": "e"})]
    plan = C.plan_operations(ops, adapter)
    assert (tmp_path / "a.txt").read_text() == "old" and not plan.failed
    assert [c.risk for c in plan.changes] == ["destructive", "safe", "destructive", "safe"]
    assert "[REDACTED]" in C.render(plan) and "+new" in C.render(plan, True)
    assert {r["status"] for r in C.apply(plan)} == {"applied"}
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.txt", "d.txt", "e.txt"] and (tmp_path / "a.txt").read_text() == "new"
    again = C.plan_operations([ops[0]], adapter)
    assert [d.code for d in again.diagnostics] == ["fs.revision-conflict"]
    outside = C.plan_operations([C.Operation("fs::move", by["."] | {"id": {"local": "a.txt"}, "origin": {}}, {"path": "../x"})], adapter)
    assert outside.failed


def edit(spark, path, language, selector, name, args, view=None):
    uri = f"file://{path}"
    with open(path, encoding="utf-8", newline="") as f:
        g = D.documents(spark, D.texts(spark, {uri: f.read()}), language, view)
    adapter = {"json": C.json_changes, "markdown": C.markdown_changes, "ts": C.typescript_changes}[language]()
    nodes = select(g.roots(), selector, "roots").collect()
    plan = C.plan_operations([C.Operation(name, n, args) for n in nodes], adapter)
    assert not plan.failed, plan.diagnostics
    assert {r["status"] for r in C.apply(plan)} == {"applied"}
    with open(path, "rb") as f:
        return f.read().decode("utf-8")


@pytest.mark.parametrize(
    "selector, name, args, expected",
    [
        ("json::property[name = 'a'] > json::scalar", "replace-value", {"value": "x"}, '﻿{\r\n  "a": "x",\r\n  "b": [1, 2]\r\n}\r\n'),
        ("json::root > json::object", "insert-property", {"name": "c", "value": None}, '﻿{\r\n  "a": 1,\r\n  "b": [1, 2],\r\n  "c": null\r\n}\r\n'),
        ("json::root > json::object", "insert-property", {"name": "c", "value": 0, "index": 0}, '﻿{\r\n  "c": 0,\r\n  "a": 1,\r\n  "b": [1, 2]\r\n}\r\n'),
        ("json::property[name = 'a']", "remove-property", {}, '﻿{\r\n  "b": [1, 2]\r\n}\r\n'),
        ("json::property[name = 'b']", "remove-property", {}, '﻿{\r\n  "a": 1\r\n}\r\n'),
        ("json::array", "insert-array-item", {"value": 3}, '﻿{\r\n  "a": 1,\r\n  "b": [1, 2, 3]\r\n}\r\n'),
        ("json::index[index = 1]", "remove-array-item", {}, '﻿{\r\n  "a": 1,\r\n  "b": [1]\r\n}\r\n'),
    ],
)
def test_json_edits_keep_the_rest(spark, tmp_path, selector, name, args, expected):
    path = tmp_path / "x.json"
    path.write_bytes('﻿{\r\n  "a": 1,\r\n  "b": [1, 2]\r\n}\r\n'.encode())
    assert edit(spark, str(path), "json", selector, f"json::{name}", args) == expected


def test_markdown_and_source_edits(spark, tmp_path):
    path = tmp_path / "x.md"
    path.write_bytes(b"# Old\r\n\r\nbody\r\n\r\n## Child\r\nkept\r\n")
    assert edit(spark, str(path), "markdown", "markdown::heading[title = 'Old']", "markdown::set-heading", {"title": "New"}) == "# New\r\n\r\nbody\r\n\r\n## Child\r\nkept\r\n"
    assert edit(spark, str(path), "markdown", "markdown::section[title = 'New']", "markdown::replace-section", {"content": "\r\nx\r\n\r\n"}, "markdown::section-tree") == "# New\r\n\r\nx\r\n\r\n## Child\r\nkept\r\n"
    path = tmp_path / "x.ts"
    path.write_text("a.old(1);\nother(2);\n")
    assert edit(spark, str(path), "ts", "ts::call[callee = 'a.old']", "ts::replace-call", {"callee": "b.fresh"}) == "b.fresh(1);\nother(2);\n"


def test_sql_changes(spark):
    catalog = S.Catalog("s", "d", "1", {"p": (S.TableSpec("t", (S.ColumnSpec("id", "number"), S.ColumnSpec("v", "string"), S.ColumnSpec("rev", "number")), ("id",), "rev"),)})
    tables = S.SqlTables(spark, catalog, {"t": spark.createDataFrame([(1, "a", 7), (2, "b", 7)], "id long, v string, rev long")})
    node = tables.rows(S.RowQuery(("p", "t"), where=S.Compare("id", "=", 1))).collect()[0]
    adapter = C.SqlChanges(tables)
    plan = C.plan_operations([C.Operation("sql::update-rows", node, {"table": ["p", "t"], "values": {"v": "x'; --"}})], adapter)
    assert plan.changes[0].risk == C.IRREVERSIBLE and tables.frame("p", "t").count() == 2
    assert C.apply(plan)[0]["status"] == "applied"
    assert sorted(map(tuple, tables.frame("p", "t").collect())) == [(1, "x'; --", 8), (2, "b", 7)]
    assert C.apply(plan)[0] == {"group": "sql:sql:local", "status": "failed", "code": "sql.revision-conflict", "message": "sql.revision-conflict: 0 rows instead of one"}


def test_command_line(spark, tmp_path):
    def run(*argv, stdin=""):
        out, err = io.StringIO(), io.StringIO()
        return cli.main(list(argv), spark, io.StringIO(stdin), out, err), out.getvalue(), err.getvalue()

    (tmp_path / "package.json").write_text('{"name":"demo","password":"hidden"}')
    (tmp_path / "code.ts").write_text("oldCall(1);\n")
    root = json.dumps(str(tmp_path))
    code, out, _ = run("query", "-e", f"from fs({{ uri: {root}, include: [\"*.json\"] }}) | mount json() | select 'json::property' | project {{ name: @name }}")
    assert code == cli.OK and [json.loads(x) for x in out.splitlines()] == [{"name": "name"}, {"name": "password"}]
    assert run("query", "-e", "from x(")[0] == cli.FAILURE
    assert run("query", "file", "-e", "x")[0] == cli.USAGE and run("nothing")[0] == cli.USAGE
    program = f"from ts({{ uri: {json.dumps(str(tmp_path / 'code.ts'))} }}) | select 'ts::call' | invoke ts::replace-call {{ callee: \"fresh\" }} | plan"
    saved = str(tmp_path / "plan.json")
    code, out, _ = run("plan", "--save", saved, stdin=program)
    assert code == cli.OK and "[REDACTED]" in out and (tmp_path / "code.ts").read_text() == "oldCall(1);\n"
    assert run("apply", "--plan", saved)[0] == cli.USAGE
    assert run("apply", "--plan", saved, "--yes")[0] == cli.OK and (tmp_path / "code.ts").read_text() == "fresh(1);\n"
    assert run("apply", "--plan", saved, "--yes")[0] == cli.APPLY_FAILED
    assert json.loads(run("schema", "json")[1])["namespace"] == "json" and run("plugins")[0] == cli.OK
    assert "logical" in run("explain", "-e", f"from fs({{ uri: {root} }}) | count")[1]
    assert cli.printable({"b": 1.0, "a": {"apiKey": "x", "n": None}}) == {"a": {"apiKey": "[REDACTED]", "n": None}, "b": 1}


def test_plugins(spark):
    schema = AdapterSchema("example", {"example::item": {"index": attr("number")}}, dynamic=True)
    from graphloom.sources.memory import NodeSpec, in_memory

    graph = in_memory(spark, "example", [NodeSpec(str(i), "example::item", {"index": i}) for i in range(2)], [], ["0", "1"])
    kinds = {"schemas": ("example",), "sources": ("example::items",), "predicates": ("example::over",), "functions": ("example::double",)}
    source = P.Source(lambda: graph.roots())
    made = plugin.Plugin(plugin.Manifest("demo", "1", namespaces=("example",), powers=("read",), aliases={"items": "example::items"}, contributes=kinds), {"example": schema}, {"example::items": source}, predicates=[plugin.Predicate("example::over", ("number",), lambda r, n: r["index"].col > n)], functions=[plugin.python_function("example::double", ("number",), "number", lambda x: 2 * x)])
    registry = plugin.Registry(plugin.Policy(("demo",), {"demo": ("read",)}))
    registry.admit(made)
    env = registry.extend(P.Environment())
    got = P.compile_program("from items() | select 'example::item:example::over(0)' | project { d: example::double(@index) }", env).query.collect()
    assert got == [{"d": 2.0}]
    with pytest.raises(LoomError) as e:
        P.compile_program("from items() | select 'example::item:example::over(\"x\")'", env)
    assert e.value.code == "selector.predicate-arguments"
    cases = {
        "duplicate": lambda: registry.admit(made),
        "not-allowlisted": lambda: plugin.Registry().admit(made),
        "unauthorized-power": lambda: plugin.Registry(plugin.Policy(("demo",))).admit(made),
        "contribution-mismatch": lambda: plugin.Registry(plugin.Policy(("d",))).admit(plugin.Plugin(plugin.Manifest("d", "1", namespaces=("e",), contributes={"rules": ("e::x",)}))),
        "incompatible-api": lambda: plugin.check_manifest(plugin.Manifest("d", "1", 2)),
        "invalid-power": lambda: plugin.check_manifest(plugin.Manifest("d", "1", powers=("fly",))),
        "foreign-namespace": lambda: plugin.check_manifest(plugin.Manifest("d", "1", contributes={"rules": ("other::x",)})),
        "reserved-alias": lambda: plugin.check_manifest(plugin.Manifest("d", "1", aliases={"take": "x"})),
        "unknown": lambda: registry.get("x"),
    }
    for code, call in cases.items():
        with pytest.raises(LoomError) as e:
            call()
        assert e.value.code == f"plugin.{code}"


def test_schema_contract():
    for bad in (
        lambda: AdapterSchema("a", {"b::c": {}}),
        lambda: AdapterSchema("a", {"a::c": {}}, {"a::e": Edge("a::e", "sideways", (), ())}),
        lambda: AdapterSchema("a", {"a::c": {}}, {"a::e": Edge("a::e", "child", ("a::x",), ())}),
        lambda: AdapterSchema("a", {"a::c": {}}, {}, {"v": View("v", ("a::e",))}),
        lambda: AdapterSchema("a", {"a::c": {}}, {}, {"v": View("v", (), True), "w": View("w", (), True)}),
        lambda: attr("date"),
    ):
        with pytest.raises(ValueError):
            bad()


def test_overlaps_against_all_pairs():
    import random

    from graphloom.change import Change, overlap, overlaps

    g = random.Random(3)
    made = []
    for i in range(120):
        a = g.randint(0, 40)
        whole = g.random() < 0.05
        made.append(Change(str(i), "o", "fs", g.choice("uvw"), "edit", None if whole else a, None if whole else a + g.choice([0, 0, 1, 4]), destination=g.choice([None, None, None, "u", "x"])))
    assert overlaps(made) == [(a, b) for i, a in enumerate(made) for b in made[i + 1 :] if overlap(a, b)]
