"""Walks over edge lists: every path as by hand, nodes looked up once and only if read, nothing broadcast by the size of its file."""

import pytest

from graphloom.operators.shapes import Scalar
from graphloom.schema import AdapterSchema, Edge, attr
from graphloom.sources.graph import EdgeListGraph

EDGES = [("a", "b", 0), ("a", "c", 1), ("b", "a", 0), ("b", "b", 1), ("c", "d", 0), ("c", "nowhere", 1), ("d", "e", 0)]
NAMES = "abcdef"


def net(spark):
    nodes = spark.createDataFrame([("net", "net", n, "net::node", None, None, n.upper()) for n in NAMES], "adapter string, resource string, local string, kind string, uri string, revision string, `@label` string")
    edges = spark.createDataFrame([("net::leads", "child", "net", a, "net", b, p) for a, b, p in EDGES], "name string, role string, from_resource string, from_local string, to_resource string, to_local string, pos long")
    roots = spark.createDataFrame([("net", n, i) for i, n in enumerate(NAMES)], "resource string, local string, position long")
    schema = AdapterSchema("net", {"net::node": {"label": attr("string")}}, {"net::leads": Edge("net::leads", "child", ("net::node",), ("net::node",))})
    return EdgeListGraph(spark, schema, nodes, edges, roots, {"label": Scalar("", "string", False, "never")})


def by_hand(direction, depth, include_self):
    pairs = {"forward": EDGES, "reverse": [(b, a, p) for a, b, p in EDGES]}
    pairs["both"] = pairs["forward"] + pairs["reverse"]
    out, level = [], [(n, n, ()) for n in NAMES]
    for k in range(depth + 1):
        out += level if k or include_self else []
        level = [(s, b, (*path, p)) for s, at, path in level for a, b, p in pairs[direction] if a == at and b in NAMES]
    return sorted(out)


@pytest.mark.parametrize("direction", ["forward", "reverse", "both"])
@pytest.mark.parametrize("depth,include_self", [(0, False), (0, True), (1, False), (2, True), (4, True), (5, False)])
def test_walks_give_every_path(spark, direction, depth, include_self):
    q = net(spark).roots().capture("root").traverse(direction=direction, max_depth=depth, include_self=include_self)
    got = [(dict(c)["root"]["id"]["local"], x["id"]["local"], x["attributes"]["label"], x["kind"]) for x, c in q.collect_with_captures()]
    want = by_hand(direction, depth, include_self)
    assert sorted(got) == sorted((s, n, n.upper(), "net::node") for s, n, _ in want)
    if direction == "forward":  # positions of a node differ, so the order is a pre-order walk of each root
        assert [x[:2] for x in got] == [(s, n) for s, n, _ in sorted(want, key=lambda x: (x[0], x[2]))]


def test_walks_look_nodes_up_only_for_what_is_read(spark):
    q = net(spark).roots().capture("root").traverse(roles=["child"], max_depth=4, include_self=True)
    who = q.dataframe(root=lambda r: r.capture("root").local.col, node=lambda r: r.local.col)._jdf.queryExecution()
    assert "LeftOuter" not in who.optimizedPlan().toString()
    assert "Broadcast" not in who.executedPlan().toString()
    what = q.dataframe(root=lambda r: r.capture("root").local.col, label=lambda r: r["label"].col)._jdf.queryExecution()
    assert what.optimizedPlan().toString().count("LeftOuter") == 1
    assert "Broadcast" not in what.executedPlan().toString()
