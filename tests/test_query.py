import math

import pytest

from graphloom.functions import values as V
from graphloom.operators.query import from_values
from graphloom.sources.memory import EdgeSpec, NodeSpec, in_memory


@pytest.fixture(scope="module")
def tree(spark):
    nodes = [NodeSpec("root", "memory::root", {"name": "root"})] + [NodeSpec(n, "memory::node", {"name": n, "group": g}) for n, g in (("a", "odd"), ("b", "even"), ("c", "odd"))]
    edges = [EdgeSpec("memory::children", "child", "root", "a", 0), EdgeSpec("memory::children", "child", "root", "b", 1), EdgeSpec("memory::children", "child", "a", "c", 0), EdgeSpec("memory::back", "reference", "c", "root", 0)]
    return in_memory(spark, "memory", nodes, edges, ["root", "root"])


def locals_of(q):
    return [x["id"]["local"] for x in q.collect()]


def test_roots_are_a_bag(tree):
    assert locals_of(tree.roots()) == ["root", "root"]
    assert tree.roots().project(lambda r: r.local).collect() == ["root", "root"]
    assert locals_of(tree.roots().distinct()) == ["root"]


def test_capture_traverse_filter(tree):
    q = tree.roots().distinct().capture("root").traverse(roles=["child"], max_depth=2).filter(lambda r: r["group"] == "odd")
    got = [(c["root"]["id"]["local"], v["id"]["local"]) for v, c in q.collect_with_captures()]
    assert got == [("root", "a"), ("root", "c")]


def test_cyclic_traversal_is_bounded_and_in_pre_order(tree):
    q = tree.roots().distinct().traverse(edges=["memory::children", "memory::back"], max_depth=4)
    assert locals_of(q) == ["a", "c", "root", "a", "b", "b"]


def test_traverse_self_and_reverse(tree):
    q = tree.roots().distinct().traverse(roles=["child"], max_depth=9, include_self=True)
    assert locals_of(q) == ["root", "a", "c", "b"]
    back = q.filter(lambda r: r["name"] == "c").traverse(roles=["child"], direction="reverse", max_depth=5)
    assert locals_of(back) == ["a", "root"]
    assert locals_of(tree.roots().traverse(max_depth=0)) == []


def test_scalars(spark):
    q = from_values(spark, [3, 1, 2, 2])
    assert q.filter(lambda r: r.value > 1).distinct().take(2).project(lambda r: V.native(r.col * 10, "number")).collect() == [30, 20]
    assert from_values(spark, [1, 2, 3]).flat_map(lambda r: [V.native(r.col, "number"), V.native(-r.col, "number")]).collect() == [1, -1, 2, -2, 3, -3]
    assert from_values(spark, [1, 2, 3]).count().collect() == [3]
    assert from_values(spark, []).count().collect() == [0]
    groups = from_values(spark, [1, 2, 3]).group_by(lambda r: V.native(r.col % 2, "number")).collect()
    assert groups == [{"key": 1, "values": [1, 3]}, {"key": 0, "values": [2]}]
    assert from_values(spark, [1, 2]).take(0).collect() == []
    with pytest.raises(TypeError):
        q.take(-1)


def test_join_keys_have_identity_not_coercion(spark):
    a, b = from_values(spark, [1, 2, 3]), from_values(spark, [2, 3, 4])
    assert a.join(b, lambda r: r.value, lambda r: r.value).collect() == [[2, 2], [3, 3]]
    a = from_values(spark, [1, "1", None, math.nan, V.BigInt(1), True])
    got = a.join(a, lambda r: r.value, lambda r: r.value).collect()
    assert len(got) == 6 and [x[0] for x in got[:3]] == [1, "1", None]
    assert all(type(x) is type(y) for x, y in got)


def test_distinct_of_records_is_no_operation(spark):
    q = from_values(spark, [1, 1]).project(lambda r: {"v": r.value}).distinct()
    assert q.collect() == [{"v": 1}, {"v": 1}]
    assert from_values(spark, [1, 1]).project(lambda r: {"v": r.value}).distinct(lambda r: r["v"]).collect() == [{"v": 1}]
    assert len(from_values(spark, [math.nan, math.nan, 0.0, -0.0]).distinct().collect()) == 2


def test_sort_is_stable_and_take_follows(spark):
    q = from_values(spark, [3, 1, 2, 11]).project(lambda r: {"v": r.value, "k": V.native(r.col % 2, "number")}).sort(lambda r: r["k"])
    assert [x["v"] for x in q.collect()] == [2, 3, 1, 11]
    assert [x["v"] for x in q.take(2).collect()] == [2, 3]
    q = from_values(spark, [1, 2, 3]).sort(lambda r: r.col.desc())
    assert q.take(2).collect() == [3, 2]


def test_mixed_values_compare_by_type(spark):
    q = from_values(spark, [1, "1", None, True])
    assert q.filter(lambda r: r.value == 1).collect() == [1]
    assert q.filter(lambda r: r.value == None).collect() == [None]  # noqa: E711
    assert q.filter(lambda r: r.value != 1).collect() == ["1", None, True]
    nan = from_values(spark, [math.nan, 1.0])
    assert nan.filter(lambda r: r.value == r.value).collect() == [1.0]


def test_missing_sorts_last_and_differs_from_null(spark):
    nodes = [NodeSpec("x", "m::n", {"v": 7}), NodeSpec("y", "m::n", {}), NodeSpec("z", "m::n", {"v": 3})]
    q = in_memory(spark, "m", nodes, [], ["x", "y", "z"]).roots()
    assert locals_of(q.filter(lambda r: r["v"] > 5)) == ["x", "y"]
    assert locals_of(q.filter(lambda r: r["v"] < 5)) == ["z"]
    assert locals_of(q.filter(lambda r: r["v"] != 7)) == ["y", "z"]
    assert locals_of(q.filter(lambda r: r["nothing"] == r["v"])) == ["y"]
    assert locals_of(q.sort(lambda r: r["v"])) == ["z", "x", "y"]
    nodes = [NodeSpec("x", "m::n", {"v": None}), NodeSpec("y", "m::n", {})]
    q = in_memory(spark, "m", nodes, [], ["x", "y"]).roots()
    assert locals_of(q.filter(lambda r: r["v"].is_null())) == ["x"]
    assert locals_of(q.filter(lambda r: r["v"].missing())) == ["y"]


def test_explain_flags(spark):
    q = from_values(spark, [1]).sort(lambda r: r.value).take(1)
    tree = q.explain()
    assert tree["physical"]["buffering"] and tree["logical"]["operator"] == "take"
    assert not from_values(spark, [1]).distinct().explain()["physical"]["buffering"]


def test_captures_are_unique(spark):
    q = from_values(spark, [1]).capture("a")
    with pytest.raises(TypeError):
        q.capture("a")
    with pytest.raises(TypeError):
        q.join(q, lambda r: r.value, lambda r: r.value)


def test_fixture_contract(spark):
    for bad in (
        lambda: in_memory(spark, "m", [NodeSpec("x", "m::n"), NodeSpec("x", "m::n")]),
        lambda: in_memory(spark, "m", [NodeSpec("x", "m::n")], [EdgeSpec("m::e", "child", "x", "y")]),
        lambda: in_memory(spark, "m", [NodeSpec("x", "m::n")], [], ["q"]),
        lambda: in_memory(spark, "m", [NodeSpec("x", "m::n"), NodeSpec("y", "m::n")], [EdgeSpec("m::e", "child", "x", "y"), EdgeSpec("m::e", "reference", "y", "x")]),
        lambda: in_memory(spark, "m", [NodeSpec("x", "nokind")]),
    ):
        with pytest.raises(ValueError):
            bad()
