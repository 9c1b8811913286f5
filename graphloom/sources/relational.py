"""The analytic tables as graphs: orders and their region, conversations, users and their events, documents."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..schema import AdapterSchema, Edge, View, attr
from .graph import Kind, Link, RelationalGraph

_S, _N = "string", "number"


def _table(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def iso(column: str):
    return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def _columns(table, rename=None):
    """All columns as attributes; times become ISO-8601 strings."""
    out = {}
    for c, kind in table.dtypes:
        if kind.startswith(("timestamp", "date")):
            out[c] = (iso(c), _S)
        elif kind == "string":
            out[c] = (F.col(c), _S)
        elif kind in ("tinyint", "smallint", "int", "bigint", "float", "double"):
            out[c] = (F.col(c), _N)
    return out


def _graph(spark, namespace, kinds, links, roots, resource) -> RelationalGraph:
    declared = {k: {a: attr(tag, required=a not in v.optional) for a, (_, tag) in v.attrs.items()} for k, v in kinds.items()}
    edges: dict[str, Edge] = {}
    for x in links:
        old = edges.get(x.name)
        edges[x.name] = Edge(x.name, x.role, tuple(dict.fromkeys([*(old.sources if old else ()), x.source])), tuple(dict.fromkeys([*(old.targets if old else ()), x.target])))
    children = tuple(e.name for e in edges.values() if e.role == "child")
    schema = AdapterSchema(namespace, declared, edges, {f"{namespace}::tree": View(f"{namespace}::tree", children, True)} if children else {}, pushdown=("predicate", "projection"))
    return RelationalGraph(spark, schema, kinds, links, roots, resource)


def star(spark: SparkSession, sf_dir: str) -> RelationalGraph:
    """region > nation > customer > order > lineitem, with references to part, supplier and nation."""
    t = {n: _table(spark, sf_dir, n) for n in ("region", "nation", "customer", "orders", "lineitem", "supplier", "part")}
    # a line has no key of its own: a hash of the whole row tells equal positions apart
    line = t["lineitem"].select("*", F.xxhash64(*t["lineitem"].columns).alias("row_hash"))
    order = _columns(t["orders"])
    order["finished"] = (F.when(F.col("o_orderstatus") == "F", True), "boolean")
    kinds = {
        "star::region": Kind(t["region"], ("r_regionkey",), _columns(t["region"])),
        "star::nation": Kind(t["nation"], ("n_nationkey",), _columns(t["nation"])),
        "star::customer": Kind(t["customer"], ("c_custkey",), _columns(t["customer"])),
        "star::order": Kind(t["orders"], ("o_orderkey",), order, optional=frozenset({"finished"})),
        "star::lineitem": Kind(line, ("l_orderkey", "l_linenumber", "row_hash"), _columns(t["lineitem"]), ("l_linenumber", "row_hash")),
        "star::supplier": Kind(t["supplier"], ("s_suppkey",), _columns(t["supplier"])),
        "star::part": Kind(t["part"], ("p_partkey",), _columns(t["part"])),
    }
    links = [
        Link("star::children", "child", "star::region", "star::nation", ("r_regionkey",), ("n_regionkey",)),
        Link("star::children", "child", "star::nation", "star::customer", ("n_nationkey",), ("c_nationkey",)),
        Link("star::children", "child", "star::customer", "star::order", ("c_custkey",), ("o_custkey",)),
        Link("star::children", "child", "star::order", "star::lineitem", ("o_orderkey",), ("l_orderkey",)),
        Link("star::part", "reference", "star::lineitem", "star::part", ("l_partkey",), ("p_partkey",)),
        Link("star::supplier", "reference", "star::lineitem", "star::supplier", ("l_suppkey",), ("s_suppkey",)),
        Link("star::nation", "reference", "star::supplier", "star::nation", ("s_nationkey",), ("n_nationkey",)),
    ]
    return _graph(spark, "star", kinds, links, ("star::region",), "star")


def conversations(spark: SparkSession, sf_dir: str) -> RelationalGraph:
    """conversation > turn, turns in order."""
    t = _table(spark, sf_dir, "conversations")
    heads = t.select("conv_id").distinct()
    kinds = {
        "conv::conversation": Kind(heads, ("conv_id",), {"conv_id": (F.col("conv_id"), _N)}),
        "conv::turn": Kind(t, ("conv_id", "turn"), _columns(t), ("turn",)),
    }
    links = [Link("conv::children", "child", "conv::conversation", "conv::turn", ("conv_id",), ("conv_id",))]
    return _graph(spark, "conv", kinds, links, ("conv::conversation",), "conv")


def events(spark: SparkSession, sf_dir: str) -> RelationalGraph:
    """user > event, events by time."""
    t = _table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    attrs = _columns(t.drop("at"))
    attrs["at"] = (F.col("at"), _N)
    users = t.select("user_id").distinct()
    kinds = {
        "ev::user": Kind(users, ("user_id",), {"user_id": (F.col("user_id"), _N)}),
        "ev::event": Kind(t, ("event_id",), attrs, ("at", "event_id")),
    }
    links = [Link("ev::children", "child", "ev::user", "ev::event", ("user_id",), ("user_id",))]
    return _graph(spark, "ev", kinds, links, ("ev::user",), "ev")


def documents(spark: SparkSession, sf_dir: str) -> RelationalGraph:
    """document, with a reference to its label."""
    d, m = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    kinds = {"doc::document": Kind(d, ("doc_id",), _columns(d)), "doc::label": Kind(m, ("doc_id",), _columns(m))}
    links = [Link("doc::label", "reference", "doc::document", "doc::label", ("doc_id",), ("doc_id",))]
    return _graph(spark, "doc", kinds, links, ("doc::document",), "doc")
