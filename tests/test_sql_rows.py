import pytest

from graphloom.plans.selector import select
from graphloom.sources import sql_rows as S

USERS, FLAGS = ("public", "users"), ("public", "flags")


@pytest.fixture
def tables(spark):
    catalog = S.Catalog(
        "local",
        "app",
        "catalog:1",
        {
            "public": (
                S.TableSpec("users", (S.ColumnSpec("id", "number"), S.ColumnSpec("name", "string", True), S.ColumnSpec("score", "number"), S.ColumnSpec("version", "number")), ("id",), "version", 1_000_000),
                S.TableSpec("flags", (S.ColumnSpec("user_id", "number"), S.ColumnSpec("enabled", "boolean")), ("user_id",)),
                S.TableSpec("events", (S.ColumnSpec("message", "string"),)),
            )
        },
        (S.Relation("flags_user", ("public", "flags", "user_id"), ("public", "users", "id")),),
    )
    frames = {
        "users": spark.createDataFrame([(i, f"n{i}" if i else None, i, 1) for i in range(5)], "id long, name string, score long, version long"),
        "flags": spark.createDataFrame([(1, True), (2, False), (None, True)], "user_id long, enabled boolean"),
        "events": spark.createDataFrame([("hello",), ("hello",)], "message string"),
    }
    return S.SqlTables(spark, catalog, frames, "sql:test")


def attrs(q):
    return [x["attributes"] for x in q.collect()]


def test_catalog_graph(tables):
    g = tables.graph()
    kinds = [x["kind"] for x in g.roots().traverse(roles=["child"], max_depth=9, include_self=True).collect()]
    assert kinds == ["sql::server", "sql::database", "sql::schema"] + ["sql::table"] + ["sql::column"] * 4 + ["sql::table"] + ["sql::column"] * 2 + ["sql::table", "sql::column", "sql::relation"]
    assert [x["attributes"]["estimatedRows"] for x in select(g.roots(), "sql::table[estimatedRows > 10]", "roots").collect()] == [1e6]
    assert [x["attributes"]["name"] for x in select(g.roots(), "sql::relation ->sql::to sql::table", "roots").collect()] == ["users"]


def test_text_and_rows(tables):
    q = tables.rows(S.RowQuery(USERS, ("name",), S.Compare("name", "=", 'a" OR 1=1 --'), limit=3))
    d = q.explain()["physical"]["details"]
    assert '"users"."name" = $1' in d["sql"] and "LIMIT $2" in d["sql"] and d["parameters"] == ['a" OR 1=1 --', 3] and d["pushdown"] == "predicate,projection,limit"
    assert q.collect() == []
    row = tables.rows(S.RowQuery(USERS, ("name",), S.Compare("id", "=", 1))).collect()[0]
    assert row["id"]["local"] == "row:public.users:[1]" and row["origin"] == {"uri": "sql:test#public.users", "revision": "1"}
    assert row["attributes"] == {"name": "n1", "_table": "public.users", "_identity": "primary-key", "_revision": 1}
    assert attrs(tables.rows(S.RowQuery(USERS, ("name",), S.IsNull("name"))))[0]["name"] is None
    assert {a["_identity"] for a in attrs(tables.rows(S.RowQuery(("public", "events"))))} == {"query-ordinal"}


def test_predicates_are_three_valued(tables):
    ids = lambda w: sorted(a["id"] for a in attrs(tables.rows(S.RowQuery(USERS, ("id",), w))))
    assert ids(S.Compare("name", "=", None)) == []
    assert ids(S.Not(S.Compare("name", "=", "n1"))) == [2, 3, 4]
    assert ids(S.In("id", ())) == []
    assert ids(S.Or((S.Compare("name", "like", "n1%"), S.Compare("score", ">=", 4)))) == [1, 4]
    for bad in (S.And(()), S.Compare("id", "~", 1), S.Compare("nothing", "=", 1), S.Compare("score", "=", float("nan"))):
        with pytest.raises(TypeError):
            tables.compile(S.RowQuery(USERS, where=bad))


def test_join_aggregate_order(tables):
    q = S.RowQuery(USERS, ("name", ("flags", "enabled")), joins=(S.Join(FLAGS, "id", "user_id"),))
    assert sorted((a["name"], a["enabled"]) for a in attrs(tables.rows(q))) == [("n1", True), ("n2", False)]
    assert 'INNER JOIN "public"."flags" AS "flags"' in tables.compile(q).text
    q = S.RowQuery(USERS, where=S.Compare("score", ">", 0), aggregate=S.Aggregate("count", "count"), limit=1)
    assert 'COUNT(*) AS "count"' in tables.compile(q).text
    assert attrs(tables.rows(q)) == [{"function": "count", "column": None, "value": 4}]
    assert attrs(tables.rows(S.RowQuery(USERS, where=S.Compare("id", ">", 99), aggregate=S.Aggregate("sum", "s", "score"))))[0]["value"] is None
    q = tables.rows(S.RowQuery(USERS, ("id",), order_by=(("score", "desc"),), limit=2, offset=1))
    assert [a["id"] for a in attrs(q)] == [3, 2]
    for bad in (
        S.RowQuery(USERS, limit=-1),
        S.RowQuery(USERS, joins=(S.Join(USERS, "id", "id"),)),
        S.RowQuery(USERS, ("name", "name")),
        S.RowQuery(USERS, aggregate=S.Aggregate("sum", "s")),
        S.RowQuery(USERS, aggregate=S.Aggregate("median", "s", "id")),
        S.RowQuery(USERS, order_by=(("id", "up"),)),
        S.RowQuery(USERS, joins=(S.Join(FLAGS, "id", "user_id", "left"),)),
        S.RowQuery(("public", "nothing")),
    ):
        with pytest.raises(TypeError):
            tables.compile(bad)


def test_runtime_predicate_comes_before_the_limit(tables):
    q = tables.rows(S.RowQuery(USERS, ("id", "score"), runtime=lambda r: r["score"].col >= 2, limit=2))
    assert sorted(a["id"] for a in attrs(q)) == [2, 3]
    tree = q.explain()["physical"]
    assert tree["operator"] == "take" and tree["inputs"][0]["operator"] == "filter" and tree["inputs"][0]["inputs"][0]["details"]["fallback"] == "predicate,limit"
    with pytest.raises(TypeError):
        tables.compile(S.RowQuery(USERS, runtime=lambda r: r["score"].col > 1, offset=1))


def test_changed_tables(tables):
    got = sorted(tables.updated(USERS, {"name": "x"}, S.Compare("id", "=", 2)).collect())
    assert [tuple(r) for r in got][1:3] == [(1, "n1", 1, 1), (2, "x", 2, 2)]
    assert tables.deleted(USERS, S.Compare("name", "=", "n1")).count() == 4
    with pytest.raises(TypeError):
        tables.updated(USERS, {"id": 1}, S.Compare("id", "=", 2))


def test_catalog_faults():
    c = S.ColumnSpec("a", "number")
    for make in (lambda: S.Catalog("s", "d", "1", {"p": (S.TableSpec("t", ()),)}), lambda: S.Catalog("s", "d", "1", {"p": (S.TableSpec("t", (c, c)),)}), lambda: S.Catalog("s", "d", "1", {"p": (S.TableSpec("t", (c,), ("b",)),)}), lambda: S.Catalog("s", "d", "1", {"p": (S.TableSpec("t", (S.ColumnSpec("a", "date"),)),)})):
        with pytest.raises(TypeError):
            make()
