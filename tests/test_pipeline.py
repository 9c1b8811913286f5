import json

import pytest

from graphloom.diagnostics import LoomError
from graphloom.functions import values as V
from graphloom.plans import pipeline as P
from graphloom.sources import documents as D
from graphloom.sources import filesystem as FS
from graphloom.sources.memory import NodeSpec, in_memory


@pytest.fixture(scope="module")
def env(spark):
    rows = [("a", "alpha", True, "one"), ("b", "beta", False, "two"), ("c", "gamma", True, "one")]
    nodes = [NodeSpec(i, "memory::item", {"name": n, "enabled": e, "group": g}, f"memory:fixture#{i}") for i, n, e, g in rows]
    graph = in_memory(spark, "memory", nodes, [], ["a", "b", "c"])
    kinds = {"uri": P.Argument("string", required=True), "tags": P.Argument("string", many=True), "n": P.Argument("number", default=3), "mode": P.Argument("string", choices=("x", "y"))}
    e = P.Environment({"memory": P.Source(lambda **a: graph.roots(), kinds, "roots")})
    e.functions["t::twice"] = P.Function(("string",), "string", lambda c: c)
    return e


FROM = 'from memory({ uri: "m" })'


def run(env, text):
    return P.compile_program(text, env).query


def test_where_project_sort_take(env):
    q = run(env, f"{FROM} | select 'memory::item' | where @enabled = true | project {{ name: @name, uri: @origin.uri }} | sort name | take 2")
    assert q.collect() == [{"name": "alpha", "uri": "memory:fixture#a"}, {"name": "gamma", "uri": "memory:fixture#c"}]


def test_same_plan_as_fluent(env):
    from graphloom.plans.selector import select

    q = run(env, f"{FROM} | select 'memory::item' | take 2")
    fluent = select(env.sources["memory"].open(), "memory::item", "roots").take(2)
    assert q.explain() == fluent.explain() and q.collect() == fluent.collect()


def test_bindings_and_join(env):
    q = run(env, f"let enabled = {FROM} | select 'memory::item' | where @enabled = true;\n{FROM} | select 'memory::item' | where @enabled = true | join enabled on @group = @group | project {{ left: $left.name, right: $right.name }} | sort left, right")
    assert [tuple(x.values()) for x in q.collect()] == [("alpha", "alpha"), ("alpha", "gamma"), ("gamma", "alpha"), ("gamma", "gamma")]


def test_captures_and_functions(env):
    q = run(env, f"{FROM} | select 'memory::item as $item' | project {{ n: $item.name, f: t::twice(@name), k: 12n, z: null }} | take 1")
    assert q.collect() == [{"n": "alpha", "f": "alpha", "k": V.BigInt(12), "z": None}]
    assert run(env, f"{FROM} | count").collect() == [3]
    assert len(run(env, f"{FROM} | project {{ g: @group }} | distinct").collect()) == 3
    assert [x["attributes"]["name"] for x in run(env, f"{FROM} | where @name ^= \"b\"").collect()] == ["beta"]
    assert len(run(env, f"{FROM} | where @name > 'alpha' | where @name is missing").collect()) == 0


@pytest.mark.parametrize(
    "text, code",
    [
        ("", "empty"),
        ("from memory({", "unbalanced"),
        ("from memory({ uri: \"m }) ", "unterminated-string"),
        ("select 'x'", "expected-source"),
        ("let x from y; " + FROM, "invalid-binding"),
        (f"let x = {FROM};", "missing-result"),
        ("from nothing()", "unknown-source"),
        ("from memory()", "missing-argument"),
        ('from memory({ uri: 1 })', "argument-type"),
        ('from memory({ uri: ["m"] })', "argument-cardinality"),
        ('from memory({ uri: "m", tags: "x" })', "argument-cardinality"),
        ('from memory({ uri: "m", what: 1 })', "unknown-argument"),
        ('from memory({ uri: "m", uri: "m" })', "duplicate-argument"),
        ('from memory({ uri: "m", mode: "z" })', "argument-choice"),
        (f"{FROM} | what", "unknown-step"),
        (f"{FROM} | count | select 'memory::item'", "select-after-derived"),
        (f"{FROM} | where @nothing = 1", "unknown-attribute"),
        (f"{FROM} | where @name = 1", "type-mismatch"),
        (f"{FROM} | where @name", "invalid-where"),
        (f"{FROM} | where @name = what", "expected-literal"),
        (f"{FROM} | project x", "expected-projection"),
        (f"{FROM} | project {{ a: @name, a: @name }}", "duplicate-field"),
        (f"{FROM} | distinct x", "invalid-distinct"),
        (f"{FROM} | take x", "invalid-take"),
        (f"{FROM} | count x", "invalid-count"),
        (f"{FROM} | sort", "invalid-sort"),
        (f"{FROM} | join x on @a = @b", "unknown-binding"),
        (f"{FROM} | mount json()", "unsupported-mount"),
        (f"{FROM} | invoke a::b {{}} | plan", "unsupported-operation"),
        (f"{FROM} | plan", "invalid-plan"),
        (f"{FROM} | project {{ a: f::g(1) }}", "unknown-function"),
        (f"{FROM} | project {{ a: t::twice(1) }}", "function-arguments"),
        (f"{FROM} | project {{ a: related('some', 'memory::item', @name) }}", "related-mode"),
        (f"{FROM} | project {{ a: related('one', 'memory::item') }}", "related-arguments"),
        (f"let a = {FROM}; let a = {FROM}; {FROM}", "duplicate-binding"),
    ],
)
def test_faults(env, text, code):
    with pytest.raises(LoomError) as e:
        run(env, text)
    assert e.value.code == f"dsl.{code}"


def test_selector_faults_keep_their_place(env):
    text = f"{FROM} | select 'memory::nothing'"
    with pytest.raises(LoomError) as e:
        run(env, text)
    at = e.value.diagnostic.locations[0]
    assert e.value.code == "selector.unknown-kind" and text[at["start"] : at["end"]] == "memory::nothing"


def test_format_is_stable():
    text = "let a = from x() | take 1;from y()|select 'a|b'  |  count"
    once = P.format_program(text)
    assert P.format_program(once) == once == "let a = from x()\n| take 1;\nfrom y()\n| select 'a|b'\n| count"


def files_env(spark):
    def fs(uri):
        return FS.files(spark, uri, include=["*.json"], kinds=["file"])

    mount = P.Mount(lambda q: D.mount(q, "json", "path", docs=q.shape.graph.contents()), D.JSON_SCHEMA)
    return P.Environment({"fs": P.Source(fs, {"uri": P.Argument("string", required=True)}, "selection")}, {"json": mount})


def test_inventory_with_related_values(spark, tmp_path):
    (tmp_path / "package.json").write_text('{"name":"demo","dependencies":{"first":"^1","nullable":null}}\n')
    text = f"""from fs({{ uri: {json.dumps(str(tmp_path))} }})
    | mount json()
    | select 'fs::file[name = "package.json"] > json::root'
    | project {{
        name: related("one", 'json::property[name = "name"] > json::scalar', @value),
        missing: related("one", 'json::property[name = "missing"] > json::scalar', @value),
        dependencies: related("many", 'json::property[name = "dependencies"] > json::object > json::property as $d > json::scalar', {{ name: $d.name, version: @value }})
      }}"""
    got = P.compile_program(text, files_env(spark)).query.collect()
    assert got == [{"name": "demo", "dependencies": [{"name": "first", "version": "^1"}, {"name": "nullable", "version": None}]}]


def test_related_one_meets_two(spark, tmp_path):
    (tmp_path / "package.json").write_text('{"name":"first","name":"second"}')
    text = f"""from fs({{ uri: {json.dumps(str(tmp_path))} }}) | mount json() | select 'json::root' | project {{ n: related("one", 'json::property[name = "name"] > json::scalar', @value) }}"""
    with pytest.raises(Exception, match="related-cardinality"):
        P.compile_program(text, files_env(spark)).query.collect()
