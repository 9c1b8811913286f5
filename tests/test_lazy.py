"""Sources that make no more rows than are taken, walks in pre-order, places in texts, contributed renderers."""

import itertools

import pytest
from pyspark.sql import functions as F

from graphloom import change as C
from graphloom import plugin as G
from graphloom.functions import values as V
from graphloom.operators.query import from_values
from graphloom.plans.selector import select
from graphloom.sources import documents as D
from graphloom.sources import relational as R
from graphloom.sources.filesystem import files

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def tree(tmp_path):
    (tmp_path / "000-target.ts").write_text("target")
    for i in range(200):
        d = tmp_path / f"dir-{i:04d}"
        d.mkdir()
        (d / "later.ts").write_text("later")
    return str(tmp_path)


def test_a_taken_file_ends_the_walk(spark, tree):
    q = files(spark, tree, include=["**/*.ts"], kinds=["file"])
    first = q.take(1)
    assert [x["attributes"]["path"] for x in first.collect()] == ["000-target.ts"]
    walk = first.shape.graph.walk
    assert walk.counters["directories"] == 1 and walk.counters["entries"] == 200 + 1
    assert q.take(5).take(2).count().collect() == [2.0] and q.take(0).collect() == []
    assert len(q.collect()) == 201 and q.shape.graph.walk.counters["directories"] == 201


def test_endless_sources(spark):
    drawn = []

    def numbers():
        for i in itertools.count():
            drawn.append(i)
            yield float(i)

    assert from_values(spark, numbers).take(2).collect() == [0.0, 1.0]
    assert drawn == [0, 1]
    assert from_values(spark, lambda: iter([3.0, 4.0])).collect() == [3.0, 4.0]


def test_equality_reaches_the_scan(spark):
    q = R.star(spark, SMALL).kind_query("star::order").filter(lambda r: r["o_orderstatus"] == "F")
    plan = q.dataframe(k=lambda r: r["o_orderkey"].col)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,F)" in plan
    rest = R.star(spark, SMALL).kind_query("star::order").filter(lambda r: ~(r["o_orderstatus"] == "F"))
    total = spark.read.parquet(f"{SMALL}/orders.parquet").count()
    assert rest.df.count() + q.df.count() == total


def test_equality_is_false_not_null_outside_filters(spark):
    v = V.native(F.col("x"), "string")
    df = spark.createDataFrame([("a",), (None,)], "x string")
    assert [r[0] for r in df.select(~V.equal(v, V.literal("a"))).collect()] == [False, True]


def test_walks_over_several_kinds_are_in_pre_order(spark):
    q = R.star(spark, SMALL).kind_query("star::region").filter(lambda r: r["r_regionkey"] < 2).traverse(roles=["child"], max_depth=2, include_self=True)
    got = [(r["kind"], r["id"]["local"]) for r in q.collect()]
    read = lambda n: spark.read.parquet(f"{SMALL}/{n}.parquet").collect()
    want = []
    for r in sorted(x.r_regionkey for x in read("region") if x.r_regionkey < 2):
        want.append(("star::region", str(r)))
        for n in sorted(x.n_nationkey for x in read("nation") if x.n_regionkey == r):
            want.append(("star::nation", str(n)))
            want += [("star::customer", str(c)) for c in sorted(x.c_custkey for x in read("customer") if x.c_nationkey == n)]
    assert [x for x in got if x[0] != "star::supplier"] == want


def test_json_places_have_lines_and_columns(spark):
    text = '{\n  "a": "😀",\n  "b": [1,\n 2]\n}'
    q = select(D.documents(spark, D.texts(spark, {"f": text}), "json").all(), "json::scalar")
    got = [x["origin"]["range"] for x in q.collect()]
    assert got[0] == {"start": 9, "end": 13, "startLine": 1, "startColumn": 7, "endLine": 1, "endColumn": 11}
    assert (got[2]["startLine"], got[2]["startColumn"], got[2]["endColumn"]) == (3, 1, 2)


def test_a_document_is_parsed_once_below_a_mount(spark):
    q = D.mount(R.events(spark, SMALL).kind_query("ev::event"), "json", "props")
    q = select(q, "ev::event > json::root > json::object > json::property > json::scalar")
    assert "MapInArrow" not in q.df._jdf.queryExecution().executedPlan().toString()


def test_fenced_documents_follow_their_block(spark):
    text = '# one\n\n```json\n{"a": 1}\n```\n\n```yaml\na: 1\n```\n'
    q = D.mount(D.documents(spark, D.texts(spark, {"f": text}), "markdown").roots(), "json", "content")
    got = select(q, "markdown::document json::scalar").collect()
    assert [x["attributes"]["value"] for x in got] == [1.0] and got[0]["origin"]["uri"].startswith("f#")
    assert len(select(q, "markdown::document markdown::code-block").collect()) == 2


def test_contributed_renderers_and_diffs():
    m = G.Manifest("p", "1", namespaces=("ex",), aliases={"short": "ex::text"}, contributes={"renderers": ("ex::text",), "diffs": ("ex::diff",)})
    r = G.Registry(G.Policy(("p",)))
    r.admit(G.Plugin(m, renderers={"ex::text": lambda plan: f"{len(plan.changes)} changes"}, diffs={"ex::diff": lambda a, b: f"{a} -> {b}"}))
    plan = C.Plan([], [], {})
    assert r.render(plan, "ex::text") == r.render(plan, "short") == "0 changes"
    with pytest.raises(Exception, match="no plugin"):
        r.render(plan, "ex::other")
    one = C.Change(id="c", adapter="fs", operation="o", action="write", uri="u", risk="safe", before="a", after="b") if hasattr(C, "Change") else None
    assert "a -> b" in r.render(C.Plan([one], [], {}), diff="ex::diff", reveal=True)
