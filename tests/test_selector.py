import pytest

from graphloom.diagnostics import LoomError
from graphloom.plans.selector import select
from graphloom.sources.memory import EdgeSpec, NodeSpec, in_memory

NODES = [
    NodeSpec("root", "memory::root", {"name": "root"}),
    NodeSpec("alpha", "memory::item", {"name": "alpha", "active": True, "nullable": None, "tags": ["selected", "first"]}),
    NodeSpec("beta", "memory::item", {"name": "beta", "active": False, "tags": ["second"]}),
    NodeSpec("alpha-leaf", "memory::leaf", {"name": "alpha", "score": 3}),
    NodeSpec("beta-leaf", "memory::leaf", {"name": "beta", "score": 1}),
    NodeSpec("target", "memory::target", {"name": "target"}),
]


def child(a, b, n):
    return EdgeSpec("memory::children", "child", a, b, n)


EDGES = [child("root", "alpha", 0), child("root", "beta", 1), child("root", "target", 2), child("alpha", "alpha-leaf", 0), child("beta", "beta-leaf", 0), EdgeSpec("memory::link", "reference", "alpha", "target")]


@pytest.fixture(scope="module")
def graph(spark):
    return in_memory(spark, "memory", NODES, EDGES, ["root", "root"])


@pytest.mark.parametrize(
    "text, expected",
    [
        ('memory::item[name ^= "a"] > memory::leaf[score >= 2]', ["alpha-leaf"]),
        ('memory::item:is([name in ("alpha","other")], [name ~= /^bet/]):not([active = false])', ["alpha"]),
        ("memory::item[nullable is null][unknown is missing]", ["alpha"]),
        ("memory::item[nullable is missing]", ["beta"]),
        ("memory::item:has(> memory::leaf[score >= 2])", ["alpha"]),
        ("memory::item:not(:has(> memory::leaf[score >= 2]))", ["beta"]),
        ('memory::item[tags *= "selected"]', ["alpha"]),
        ('memory::item[tags != "selected"]', ["beta"]),
        ("memory::root memory::leaf", ["alpha-leaf", "beta-leaf"]),
        ("memory::item + memory::item", ["beta"]),
        ("memory::item ~ memory::item", ["beta"]),
        ("memory::item ->memory::link memory::target", ["target"]),
        ("memory::target <-memory::link memory::item", ["alpha"]),
        ("memory::item:is(memory::item > memory::leaf)", ["alpha", "beta"]),
        ("[score < 2]", ["beta-leaf"]),
        ("memory::item[active != true]", ["beta"]),
        ("memory::leaf[score != 3]", ["beta-leaf"]),
        ("memory::item[name $= 'ta']", ["beta"]),
        ("memory::item[name ~= /A/i]", ["alpha", "beta"]),
    ],
)
def test_selectors(graph, text, expected):
    got = [x["id"]["local"] for x in select(graph.roots(), text, "roots").collect()]
    assert got == expected * 2


def test_captures(graph):
    q = select(graph.roots(), "memory::item as $item > memory::leaf[name = $item.name] as $leaf", "roots")
    got = [(c["item"]["id"]["local"], c["leaf"]["id"]["local"]) for _, c in q.collect_with_captures()]
    assert got == [("alpha", "alpha-leaf"), ("beta", "beta-leaf")] * 2


def test_shared_children_repeat_for_each_path(spark):
    nodes = [NodeSpec("root", "memory::root", {}), NodeSpec("alpha", "memory::item", {}), NodeSpec("beta", "memory::item", {}), NodeSpec("shared", "memory::leaf", {"name": "shared"})]
    edges = [child("root", "alpha", 0), child("root", "beta", 1), child("alpha", "shared", 0), child("beta", "shared", 0)]
    q = select(in_memory(spark, "memory", nodes, edges, ["root"]).roots(), 'memory::leaf[name="shared"]', "roots")
    assert len(q.collect()) == 2
    assert len(q.distinct().collect()) == 1


@pytest.mark.parametrize(
    "text, code",
    [
        ("item", "ambiguous-name"),
        ("memory::nothing", "unknown-kind"),
        ("memory::item[nothing]", "unknown-attribute"),
        ("memory::item[name = 1]", "type-mismatch"),
        ("memory::item[active > true]", "invalid-comparison"),
        ("memory::item ->memory::nothing memory::leaf", "unknown-edge"),
        ("memory::item[name = $x.name]", "unknown-capture"),
        ("memory::item as $x > memory::leaf as $x", "duplicate-capture"),
        ("memory::item[name ~= /(/]", "invalid-regex"),
        ("memory::item:what::ever()", "unknown-predicate"),
        ("memory::item, memory::leaf", "syntax"),
        ("", "syntax"),
        ("memory::item[name = $x.tags]", "unknown-capture"),
        ("memory::item as $x > memory::leaf[name = $x.tags]", "invalid-comparison"),
    ],
)
def test_faults(graph, text, code):
    with pytest.raises(LoomError) as e:
        select(graph.roots(), text, "roots")
    assert e.value.code == f"selector.{code}"


def test_siblings_need_order(spark):
    g = in_memory(spark, "memory", NODES, EDGES, ["root"], ordering="unknown")
    with pytest.raises(LoomError) as e:
        select(g.roots(), "memory::item + memory::item", "roots")
    assert e.value.code == "selector.unordered-sibling"


def test_selection_mode_matches_rows_as_they_are(graph):
    assert select(graph.roots(), "memory::item").collect() == []
    assert len(select(graph.roots(), "memory::root > memory::item").collect()) == 4
