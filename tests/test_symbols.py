"""Symbols of source files: scopes, imports, renaming."""

import pytest

from graphloom import change as C
from graphloom.plans.selector import select
from graphloom.sources import documents as D
from graphloom.sources import symbols as S

A = 'export function greet(name: string) { return "greet " + name; }\nexport default class Box {}\n'
B = 'import Crate, { greet as hello } from "./a.js";\nimport { other } from "lib";\nconsole.log(hello("world"), new Crate(), other(1), obj.hello);\nfunction f(hello) { return hello; }\n'


def test_names_in_scope():
    text = "const x = 1;\nfunction f(y) { const x = 2; return g(x, y); }\nfunction g(a) { return x + a; }\n"
    uses, exports, rows = S.resolved(text)
    got = {(text[u.start : u.end], u.start, rows[u.to].start) for u in uses}
    inner = text.index("x = 2")
    assert ("x", text.index("x, y"), inner) in got and ("x", text.index("x + a"), text.index("x = 1")) in got
    assert not any(n in ("y", "a") for n, _, _ in got) and exports == {}
    assert any(n == "g" and b == text.index("function g") for n, _, b in got)


def test_edges_cross_files(spark):
    docs = D.texts(spark, {"file:///p/a.ts": A, "file:///p/b.ts": B, "file:///p/c.ts": "let z = 1; z;"})
    g = S.project(spark, docs)
    q = select(g.all(), "ts::identifier as $i ->ts::symbol ts::function")
    got = q.dataframe(name=lambda r: r.capture("i")["name"].col, to=lambda r: r["name"].col, uri=lambda r: r.shape.part("uri").col).collect()
    assert ("hello", "greet", "file:///p/a.ts") in {tuple(r) for r in got}
    back = select(g.all(), "ts::class <-ts::symbol ts::identifier")
    assert {r[0] for r in back.dataframe(name=lambda r: r["name"].col).collect()} == {"Box", "Crate"}


@pytest.fixture
def files(tmp_path):
    (tmp_path / "a.ts").write_text('export function greet() { return "greet"; }\n')
    (tmp_path / "b.ts").write_text('import { greet } from "./a.js"; greet(); const o = { x: o.greet };\n')
    return tmp_path


def test_rename(spark, files):
    a, b = (str(files / n) for n in ("a.ts", "b.ts"))
    g = D.documents(spark, D.texts(spark, {f"file://{a}": open(a).read()}), "ts")
    node = select(g.all(), 'ts::identifier[name = "greet"]').collect()[0]
    adapter = C.typescript_changes([a, b])
    plan = C.plan_operations([C.Operation("ts::rename-symbol", node, {"name": "welcome"}, id="rename")], adapter)
    assert [x.uri[-4:] for x in plan.changes] == ["a.ts", "b.ts", "b.ts"] and "function greet" in open(a).read()
    assert [x["status"] for x in C.apply(plan)] == ["applied", "applied"]
    assert open(a).read() == 'export function welcome() { return "greet"; }\n'
    assert open(b).read() == 'import { welcome } from "./a.js"; welcome(); const o = { x: o.greet };\n'
    bad = C.plan_operations([C.Operation("ts::rename-symbol", node, {"name": "no name"}, id="r")], adapter)
    assert bad.failed
