"""Steps through parsed documents at size: no broadcast of nodes, tasks of bounded memory, no columns that nobody reads."""

import re

import pyarrow as pa
from pyspark.sql import functions as F

from graphloom.plans.selector import select
from graphloom.sources import documents as D
from graphloom.sources import relational as R


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def small(spark, n=50):
    return D.texts(spark, {f"d{i}": '{"k": %d}' % i for i in range(n)})


def test_steps_of_trees_broadcast_no_nodes(spark):
    """A file of nodes is small, its rows are not: the driver must never hold them."""
    q = select(D.documents(spark, small(spark), "json").roots(), "json::root > json::object > json::property > json::scalar")
    assert "Broadcast" not in plan_of(q.df)
    assert sorted(x["attributes"]["value"] for x in q.collect()) == [float(i) for i in range(50)]
    inside = select(D.documents(spark, small(spark), "json").roots(), "json::root json::scalar")
    assert "Broadcast" not in plan_of(inside.df)
    assert inside.df.count() == 50


def test_steps_into_mounts_broadcast_no_nodes(spark, tmp_path):
    rows = [(i, None, i % 7, "view" if i % 2 else "purchase", 1.5, '{"k": %d}' % i) for i in range(40)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    q = D.mount(R.events(spark, str(tmp_path)).kind_query("ev::event"), "json", "props")
    q = select(q, 'ev::event[event_type = "purchase"] as $e > json::root > json::object > json::property > json::scalar')
    assert "Broadcast" not in plan_of(q.df)
    got = q.dataframe(k=lambda r: r.capture("e")["event_id"].col, v=lambda r: r["value"].col["n"]).collect()
    assert sorted(map(tuple, got)) == [(i, float(i)) for i in range(0, 40, 2)]


class Caught:
    """Stands for a DataFrame of documents: gives the task function itself."""

    def select(self, *_):
        return self

    def mapInArrow(self, run, schema):  # noqa: N802
        return run


def test_tasks_send_nodes_on_before_they_hold_many():
    """A batch of documents may have thousands of times as many nodes as texts."""
    n, words = 300, 200
    rows = [(f"d{i}", f"d{i}", None, "word " * words) for i in range(n)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], ["resource", "uri", "revision", "text"])
    out = list(D.parsed(Caught(), "ts")(iter([batch])))
    assert sum(b.num_rows for b in out) == n * (words + 1)
    assert max(b.num_rows for b in out) < 2 * 10_000
    assert [k for b in out for k in b.column(out[0].schema.get_field_index("pre")).to_pylist()] == [k for _ in range(n) for k in range(words + 1)]



def test_columns_that_nobody_reads_are_not_made(spark):
    docs = D.texts(spark, {"a": '{"k": [1, null]}', "b": "{", "c": "7"})
    graph = D.documents(spark, docs, "json")
    flat = graph.all().dataframe(kind=lambda r: r.kind, start=lambda r: F.col(r.shape.cols["start"]), value=lambda r: r["value"].col["n"])
    made = re.search(r"MapInArrow.*", flat._jdf.queryExecution().optimizedPlan().toString())[0]
    assert "kind" in made and "start" in made and "local" not in made and "depth" not in made
    rows = graph.table()[0]
    every = D.documents(spark, docs, "json").nodes
    assert sorted(map(str, flat.collect())) == sorted(map(str, every.select("kind", "start", F.col("`@value`")["n"].alias("value")).collect()))
    assert rows.count() == every.count() == 10
    assert [(d["uri"], d["code"]) for d in graph.diagnostics.collect()] == [("b", "json.invalid-syntax")]
