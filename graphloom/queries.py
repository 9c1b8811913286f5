"""Registered queries over the analytic tables, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.query import from_dataframe
from .plans import pipeline as P
from .plans.selector import select
from .sources import documents as D
from .sources import relational as R
from .sources import sql_rows as S

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = " ".join(sql.split())
        return f

    return register


def _star(spark, d, kind):
    return R.star(spark, d).kind_query(f"star::{kind}")


def _flat(q, **fields) -> DataFrame:
    """Columns of attributes: name=attribute, or a callback."""
    return q.dataframe(**{n: ((lambda r, a=a: r[a].col) if isinstance(a, str) else a) for n, a in fields.items()})


# -- filters ---------------------------------------------------------------------


@query("SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'F'")
def q_filter_eq(spark: SparkSession, d: str) -> DataFrame:
    return _flat(select(_star(spark, d, "order"), 'star::order[o_orderstatus = "F"]'), k="o_orderkey")


@query("SELECT l_orderkey AS k, l_linenumber AS n, l_quantity AS quantity FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 24")
def q_filter_range(spark, d):
    return _flat(select(_star(spark, d, "lineitem"), "star::lineitem[l_quantity >= 10][l_quantity < 24]"), k="l_orderkey", n="l_linenumber", quantity="l_quantity")


@query("SELECT c_custkey AS k FROM customer WHERE starts_with(c_mktsegment, 'B')")
def q_filter_prefix(spark, d):
    return _flat(select(_star(spark, d, "customer"), 'star::customer[c_mktsegment ^= "B"]'), k="c_custkey")


@query("SELECT p_partkey AS k FROM part WHERE suffix(p_name, 'e')")
def q_filter_suffix(spark, d):
    return _flat(select(_star(spark, d, "part"), 'star::part[p_name $= "e"]'), k="p_partkey")


@query("SELECT p_partkey AS k FROM part WHERE contains(p_name, 'a')")
def q_filter_contains(spark, d):
    return _flat(select(_star(spark, d, "part"), 'star::part[p_name *= "a"]'), k="p_partkey")


@query("SELECT o_orderkey AS k FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def q_filter_in(spark, d):
    return _flat(select(_star(spark, d, "order"), 'star::order[o_orderpriority in ("1-URGENT", "2-HIGH")]'), k="o_orderkey")


@query("SELECT c_custkey AS k FROM customer WHERE regexp_matches(c_name, '[13579]$')")
def q_filter_regex(spark, d):
    return _flat(select(_star(spark, d, "customer"), "star::customer[c_name ~= /[13579]$/]"), k="c_custkey")


@query("SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'F' THEN true END AS finished FROM orders WHERE o_orderstatus IS DISTINCT FROM 'F'")
def q_where_ne_missing(spark, d):
    """An expression's != is true on a missing value."""
    q = _star(spark, d, "order").filter(lambda r: r["finished"] != True)  # noqa: E712
    return _flat(q, k="o_orderkey", finished="finished")


@query("SELECT o_orderkey AS k FROM orders WHERE false")
def q_selector_ne_missing(spark, d):
    """A selector's != is false on a missing value."""
    return _flat(select(_star(spark, d, "order"), "star::order[finished != true]"), k="o_orderkey")


@query("SELECT o_orderkey AS k FROM orders WHERE o_orderstatus <> 'F'")
def q_is_missing(spark, d):
    return _flat(select(_star(spark, d, "order"), "star::order[finished is missing]"), k="o_orderkey")


@query("SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'F'")
def q_exists(spark, d):
    return _flat(select(_star(spark, d, "order"), "star::order[finished]"), k="o_orderkey")


@query("SELECT e.event_id AS k FROM events e WHERE e.props IS NOT NULL AND e.value > 50 AND e.event_type = 'click'")
def q_where_order(spark, d):
    q = R.events(spark, d).kind_query("ev::event").filter(lambda r: r["value"] > 50).filter(lambda r: r["event_type"] == "click")
    return _flat(q, k="event_id")


# -- algebra ----------------------------------------------------------------------


@query("SELECT c_custkey AS id, c_name AS name, c_acctbal * 2 AS twice FROM customer")
def q_project_record(spark, d):
    return _star(spark, d, "customer").project(lambda r: {"id": r["c_custkey"], "name": r["c_name"], "twice": r["c_acctbal"].col * 2}).dataframe()


@query("SELECT n_nationkey AS id, n_name AS label_name, n_regionkey AS label_region FROM nation")
def q_project_nested(spark, d):
    return _star(spark, d, "nation").project(lambda r: {"id": r["n_nationkey"], "label": {"name": r["n_name"], "region": r["n_regionkey"]}}).dataframe()


@query("SELECT doc_id AS k, unnest(string_split(text, chr(10))) AS line FROM documents")
def q_flatmap(spark, d):
    q = R.documents(spark, d).kind_query("doc::document").capture("doc").flat_map(lambda r: F.split(r["text"].col, "\n"))
    return q.dataframe(k=lambda r: r.capture("doc")["doc_id"].col, line=lambda r: r.col)


@query("SELECT c_mktsegment AS segment, min(c_custkey) AS first_customer FROM customer GROUP BY 1")
def q_distinct_key(spark, d):
    return _flat(_star(spark, d, "customer").distinct(lambda r: r["c_mktsegment"]), segment="c_mktsegment", first_customer="c_custkey")


@query("SELECT o_orderkey AS k, o_totalprice AS price, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS rank FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 25")
def q_sort_take(spark, d):
    q = _star(spark, d, "order").project(lambda r: {"k": r["o_orderkey"], "price": r["o_totalprice"]}).sort(lambda r: r["price"]).take(25)
    return q.ranked()


@query("SELECT count(*) AS n FROM lineitem WHERE l_returnflag = 'R'")
def q_count(spark, d):
    return _star(spark, d, "lineitem").filter(lambda r: r["l_returnflag"] == "R").count().dataframe(n=lambda r: r.col)


@query("SELECT n_regionkey AS region, string_agg(n_name, ',' ORDER BY n_nationkey) AS nations FROM nation GROUP BY 1")
def q_group_values(spark, d):
    q = _star(spark, d, "nation").project(lambda r: {"region": r["n_regionkey"], "name": r["n_name"]}).group_by(lambda r: r["region"])
    df = q.df.select(F.col(q.shape.key.name).alias("region"), F.col(q.shape.name).alias("v"))
    names = [f for f in df.schema["v"].dataType.elementType.fieldNames()]
    return df.select("region", F.concat_ws(",", F.transform("v", lambda x: x[names[1]])).alias("nations"))


@query("SELECT c_custkey AS customer, o_orderkey AS k FROM customer JOIN orders ON o_custkey = c_custkey")
def q_capture(spark, d):
    g = R.star(spark, d)
    q = g.kind_query("star::customer").capture("c")
    q = g.hop(q, next(x for x in g.links if x.target == "star::order"))
    return q.dataframe(customer=lambda r: r.capture("c")["c_custkey"].col, k=lambda r: r["o_orderkey"].col)


@query("SELECT s_suppkey AS supplier, c_custkey AS customer FROM supplier JOIN customer ON s_nationkey = c_nationkey WHERE s_acctbal < 0 AND c_acctbal < 0")
def q_join_eq(spark, d):
    left = _star(spark, d, "supplier").filter(lambda r: r["s_acctbal"] < 0)
    right = _star(spark, d, "customer").filter(lambda r: r["c_acctbal"] < 0)
    return left.join(right, lambda r: r["s_nationkey"], lambda r: r["c_nationkey"]).dataframe(supplier=lambda r: r.left["s_suppkey"].col, customer=lambda r: r.right["c_custkey"].col)


@query(
    """WITH u AS (SELECT n_nationkey AS k, CASE WHEN n_regionkey > 1 THEN n_regionkey END AS r FROM nation)
    SELECT a.k AS a, b.k AS b FROM u a JOIN u b ON a.r IS NOT DISTINCT FROM b.r"""
)
def q_join_null_safe(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("k"), F.when(F.col("n_regionkey") > 1, F.col("n_regionkey")).alias("r"))
    q = from_dataframe(n, ["k"])
    return q.join(q, lambda r: r["r"], lambda r: r["r"]).dataframe(a=lambda r: r.left["k"].col, b=lambda r: r.right["k"].col)


# -- selectors: steps -----------------------------------------------------------


@query("SELECT n_name AS nation, c_custkey AS k FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey WHERE r_name = 'ASIA'")
def q_child(spark, d):
    q = select(R.star(spark, d).roots(), 'star::region[r_name = "ASIA"] > star::nation as $n > star::customer')
    return q.dataframe(nation=lambda r: r.capture("n")["n_name"].col, k=lambda r: r["c_custkey"].col)


@query("SELECT o_orderkey AS k FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey WHERE r_name = 'EUROPE'")
def q_descendant(spark, d):
    return _flat(select(R.star(spark, d).roots(), 'star::region[r_name = "EUROPE"] star::order'), k="o_orderkey")


@query("SELECT l_orderkey AS k, l_linenumber AS n, p_brand AS brand FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size = 10")
def q_edge_fwd(spark, d):
    q = select(_star(spark, d, "lineitem"), "star::lineitem as $l ->star::part star::part[p_size = 10]")
    return q.dataframe(k=lambda r: r.capture("l")["l_orderkey"].col, n=lambda r: r.capture("l")["l_linenumber"].col, brand=lambda r: r["p_brand"].col)


@query("SELECT n_name AS nation, s_suppkey AS k FROM nation JOIN supplier ON s_nationkey = n_nationkey")
def q_edge_rev(spark, d):
    q = select(_star(spark, d, "nation"), "star::nation as $n <-star::nation star::supplier")
    return q.dataframe(nation=lambda r: r.capture("n")["n_name"].col, k=lambda r: r["s_suppkey"].col)


@query("SELECT b.conv_id, b.turn FROM conversations a JOIN (SELECT *, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) b ON a.conv_id = b.conv_id AND b.before = a.turn WHERE a.role = 'user' AND b.role = 'assistant'")
def q_sibling_adjacent(spark, d):
    q = select(R.conversations(spark, d).kind_query("conv::turn"), 'conv::turn[role = "user"] + conv::turn[role = "assistant"]')
    return _flat(q, conv_id="conv_id", turn="turn")


@query("SELECT b.conv_id, b.turn FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn > a.turn WHERE a.role = 'system'")
def q_sibling_following(spark, d):
    return _flat(select(R.conversations(spark, d).kind_query("conv::turn"), 'conv::turn[role = "system"] ~ conv::turn'), conv_id="conv_id", turn="turn")


_HAS_F = "EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')"


@query(f"SELECT c_custkey AS k FROM customer WHERE {_HAS_F}")
def q_has(spark, d):
    return _flat(select(_star(spark, d, "customer"), 'star::customer:has(> star::order[o_orderstatus = "F"])'), k="c_custkey")


@query(f"SELECT c_custkey AS k FROM customer WHERE NOT {_HAS_F}")
def q_not_has(spark, d):
    return _flat(select(_star(spark, d, "customer"), 'star::customer:not(:has(> star::order[o_orderstatus = "F"]))'), k="c_custkey")


@query("SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'O' OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)")
def q_is(spark, d):
    return _flat(select(_star(spark, d, "order"), 'star::order:is([o_orderstatus = "O"], star::order > star::lineitem[l_quantity > 45])'), k="o_orderkey")


@query("SELECT o_orderkey AS k FROM orders WHERE NOT (o_orderstatus = 'F' OR o_totalprice > 100000)")
def q_not(spark, d):
    return _flat(select(_star(spark, d, "order"), 'star::order:not([o_orderstatus = "F"], [o_totalprice > 100000])'), k="o_orderkey")


@query("SELECT c_custkey AS customer, s_suppkey AS supplier FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE s_nationkey = c_nationkey")
def q_capture_compare(spark, d):
    q = select(_star(spark, d, "customer"), "star::customer as $c > star::order > star::lineitem ->star::supplier star::supplier[s_nationkey = $c.c_nationkey]")
    return q.dataframe(customer=lambda r: r.capture("c")["c_custkey"].col, supplier=lambda r: r["s_suppkey"].col)


@query(f"SELECT r_name AS region, n_name AS nation, count(*) AS customers FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey WHERE {_HAS_F} GROUP BY 1, 2")
def q_flagship(spark, d):
    q = select(R.star(spark, d).roots(), 'star::region as $r > star::nation as $n > star::customer:has(> star::order[o_orderstatus = "F"])')
    rows = q.dataframe(region=lambda r: r.capture("r")["r_name"].col, nation=lambda r: r.capture("n")["n_name"].col)
    return rows.groupBy("region", "nation").agg(F.count("*").alias("customers"))


# -- traversal on a graph without typed tables: orders as a cyclic edge list ----------


def _edges(spark, d):
    """Orders linked to the customer's next order, the last one to the first, and each to the first: a graph with cycles."""
    from pyspark.sql import Window
    from pyspark.sql import types as T

    from .operators.shapes import Scalar
    from .schema import AdapterSchema, Edge, attr
    from .sources.graph import EdgeListGraph

    n = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus")
    nodes = n.select(F.lit("net").alias("adapter"), F.lit("net").alias("resource"), F.col("o_orderkey").cast("string").alias("local"), F.lit("net::order").alias("kind"), F.lit(None).cast("string").alias("uri"), F.lit(None).cast("string").alias("revision"), F.col("o_orderstatus").alias("@status"))
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    first = F.first("o_orderkey").over(w)
    turns = n.select("o_orderkey", F.coalesce(F.lead("o_orderkey").over(w), first).alias("next"), first.alias("first"))

    def link(target, pos):
        return turns.select(F.lit("net::leads").alias("name"), F.lit("child").alias("role"), F.lit("net").alias("from_resource"), F.col("o_orderkey").cast("string").alias("from_local"), F.lit("net").alias("to_resource"), F.col(target).cast("string").alias("to_local"), F.lit(pos).cast(T.LongType()).alias("pos"))

    edges = link("next", 0).unionAll(link("first", 1))
    schema = AdapterSchema("net", {"net::order": {"status": attr("string")}}, {"net::leads": Edge("net::leads", "child", ("net::order",), ("net::order",))})
    roots = n.select(F.lit("net").alias("resource"), F.col("o_orderkey").cast("string").alias("local"), F.col("o_orderkey").cast("long").alias("position"))
    return EdgeListGraph(spark, schema, nodes, edges, roots, {"status": Scalar("", "string", False, "never")})


_NET = """w AS (SELECT o_orderkey AS a, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS f FROM orders),
    e AS (SELECT a, coalesce(n, f) AS b FROM w UNION ALL SELECT a, f FROM w)"""


@query(f"WITH {_NET}, t AS (SELECT a AS root, b FROM e UNION ALL SELECT x.a, y.b FROM e x JOIN e y ON y.a = x.b) SELECT CAST(root AS VARCHAR) AS root, CAST(b AS VARCHAR) AS node FROM t")
def q_traverse_depth2(spark, d):
    q = _edges(spark, d).roots().capture("root").traverse(roles=["child"], max_depth=2)
    return q.dataframe(root=lambda r: r.capture("root").local.col, node=lambda r: r.local.col)


@query(
    f"""WITH RECURSIVE {_NET}, t AS (SELECT o_orderkey AS root, o_orderkey AS node, 0 AS depth FROM orders
    UNION ALL SELECT t.root, e.b, depth + 1 FROM t JOIN e ON e.a = t.node WHERE depth < 4)
    SELECT CAST(root AS VARCHAR) AS root, CAST(node AS VARCHAR) AS node, count(*) AS paths FROM t GROUP BY 1, 2"""
)
def q_traverse_cycle(spark, d):
    q = _edges(spark, d).roots().capture("root").traverse(roles=["child"], max_depth=4, include_self=True)
    return q.dataframe(root=lambda r: r.capture("root").local.col, node=lambda r: r.local.col).groupBy("root", "node").agg(F.count("*").alias("paths"))


@query(f"WITH {_NET} SELECT CAST(a AS VARCHAR) AS node, CAST(b AS VARCHAR) AS target FROM e")
def q_traverse_reverse(spark, d):
    q = _edges(spark, d).roots().capture("target").traverse(direction="reverse", max_depth=1)
    return q.dataframe(node=lambda r: r.local.col, target=lambda r: r.capture("target").local.col)


@query("SELECT n_nationkey AS nation, c_custkey AS k, NULL::BIGINT AS o FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_regionkey = 2 UNION ALL SELECT n_nationkey, NULL, o_orderkey FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey WHERE n_regionkey = 2")
def q_traverse_tables(spark, d):
    """A walk over tables of several kinds: what a kind lacks is missing."""
    q = _star(spark, d, "nation").filter(lambda r: r["n_regionkey"] == 2).capture("n").traverse(roles=["child"], max_depth=2)
    return q.dataframe(nation=lambda r: r.capture("n")["n_nationkey"].col, k=lambda r: r["c_custkey"].col.cast("long"), o=lambda r: r["o_orderkey"].col.cast("long"))


# -- pipeline programs ----------------------------------------------------------------


def _environment(spark, d) -> P.Environment:
    def table(make, kind):
        return P.Source(lambda: make(spark, d).kind_query(kind), {}, "selection")

    env = P.Environment()
    for name, kind in (("region", "star::region"), ("nation", "star::nation"), ("customer", "star::customer"), ("orders", "star::order"), ("lineitem", "star::lineitem"), ("supplier", "star::supplier"), ("part", "star::part")):
        env.sources[name] = table(R.star, kind)
    env.sources["conversations"] = table(R.conversations, "conv::conversation")
    env.sources["events"] = table(R.events, "ev::event")
    env.sources["documents"] = table(R.documents, "doc::document")
    env.mounts["json"] = P.Mount(lambda q: D.mount(q, "json", "props"), D.JSON_SCHEMA)
    env.mounts["markdown"] = P.Mount(lambda q: D.mount(q, "markdown", "text"), D.MARKDOWN_SCHEMA)
    env.functions["text::upper"] = P.Function(("string",), "string", F.upper)
    from .plugin import Predicate

    env.predicates["text::longer"] = Predicate("text::longer", ("number",), lambda r, n: F.length(r["n_name"].col) > int(n))
    return env


def _program(spark, d, text) -> DataFrame:
    return P.compile_program(text, _environment(spark, d)).query.dataframe()


@query("SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_regionkey = 1 ORDER BY n_nationkey LIMIT 3")
def q_pipeline(spark, d):
    return _program(spark, d, "from nation() | where @n_regionkey = 1 | project { id: @n_nationkey, name: @n_name } | sort id | take 3")


@query("SELECT s_suppkey AS supplier, n_name AS nation FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def q_related_one(spark, d):
    return _program(spark, d, "from supplier() | project { supplier: @s_suppkey, nation: related('one', 'star::supplier ->star::nation star::nation', @n_name) }")


@query("SELECT c_custkey AS customer, coalesce((SELECT string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) FROM orders WHERE o_custkey = c_custkey), '') AS orders FROM customer")
def q_related_many(spark, d):
    q = P.compile_program("from customer() | project { customer: @c_custkey, orders: related('many', 'star::customer > star::order', @o_orderkey) }", _environment(spark, d)).query
    many = q.shape.fields["orders"]
    return q.df.select(F.col(q.shape.fields["customer"].name).alias("customer"), F.concat_ws(",", F.transform(many.name, lambda x: x[many.element.name].cast("string"))).alias("orders"))


@query("WITH f AS (SELECT * FROM orders WHERE o_orderstatus = 'F') SELECT a.c_name AS name, f.o_orderkey AS k FROM customer a JOIN f ON f.o_custkey = a.c_custkey WHERE a.c_mktsegment = 'BUILDING'")
def q_let_join(spark, d):
    return _program(spark, d, "let done = from orders() | where @o_orderstatus = 'F'; from customer() | where @c_mktsegment = 'BUILDING' | join done on @c_custkey = @o_custkey | project { name: $left.c_name, k: $right.o_orderkey }")


@query("SELECT upper(n_name) AS name FROM nation")
def q_udf_function(spark, d):
    return _program(spark, d, "from nation() | project { name: text::upper(@n_name) }")


@query("SELECT n_nationkey AS k FROM nation WHERE length(n_name) > 8")
def q_udf_predicate(spark, d):
    return _program(spark, d, "from nation() | select 'star::nation:text::longer(8)' | project { k: @n_nationkey }")


# -- documents --------------------------------------------------------------------------


@query("SELECT event_id AS k, CAST(json_extract(props, '$.k') AS DOUBLE) AS v FROM events WHERE event_type = 'purchase'")
def q_json_mount(spark, d):
    q = P.compile_program("""from events() | select 'ev::event[event_type = "purchase"] as $e' | mount json() | select 'ev::event > json::root > json::object > json::property[name = "k"] > json::scalar'""", _environment(spark, d)).query
    return q.dataframe(k=lambda r: r.capture("e")["event_id"].col, v=lambda r: r["value"].col["n"])


@query("SELECT 'json::root' AS kind, count(*) AS n FROM events UNION ALL SELECT 'json::object', count(*) FROM events UNION ALL SELECT 'json::property', count(*) FROM events UNION ALL SELECT 'json::scalar', count(*) FROM events")
def q_json_nodes(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    docs = e.select(F.col("event_id").cast("string").alias("resource"), F.col("event_id").cast("string").alias("uri"), F.lit(None).cast("string").alias("revision"), F.col("props").alias("text"))
    q = D.documents(spark, docs, "json").all()
    return q.dataframe(kind=lambda r: r.kind).groupBy("kind").agg(F.count("*").alias("n"))


@query()
def q_markdown_blocks(spark, d):
    """Blocks of every document by kind; no SQL has these rules."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").cast("string").alias("resource"), F.col("doc_id").cast("string").alias("uri"), F.lit(None).cast("string").alias("revision"), "text")
    q = D.documents(spark, docs, "markdown").all()
    return q.dataframe(kind=lambda r: r.kind).groupBy("kind").agg(F.count("*").alias("n"))


@query()
def q_typescript_calls(spark, d):
    """Syntax nodes, calls among them, of every document read as source code, by kind; no SQL has these rules."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").cast("string").alias("resource"), F.col("doc_id").cast("string").alias("uri"), F.lit(None).cast("string").alias("revision"), "text")
    q = D.documents(spark, docs, "ts").all()
    return q.dataframe(kind=lambda r: r.kind).groupBy("kind").agg(F.count("*").alias("n"))


@query()
def q_fs_walk(spark, d):
    """Parquet files and folders of the data directory."""
    from .sources.filesystem import files

    return files(spark, d, kinds=["file", "directory"]).dataframe(path=lambda r: r["path"].col, size=lambda r: r["size"].col)


# -- SQL rows ------------------------------------------------------------------------------


def _tables(spark, d) -> S.SqlTables:
    frames = {n: spark.read.parquet(f"{d}/{n}.parquet") for n in ("region", "nation", "customer", "orders", "supplier", "part", "lineitem")}
    keys = {"region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "orders": ("o_orderkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",)}
    p = "public"
    relations = [S.Relation("nation_region", (p, "nation", "n_regionkey"), (p, "region", "r_regionkey")), S.Relation("customer_nation", (p, "customer", "c_nationkey"), (p, "nation", "n_nationkey")), S.Relation("orders_customer", (p, "orders", "o_custkey"), (p, "customer", "c_custkey"))]
    return S.SqlTables(spark, S.catalog_of(spark, frames, keys, relations), frames)


def _rows(spark, d, q: S.RowQuery, **fields) -> DataFrame:
    return _flat(_tables(spark, d).rows(q), **fields)


_C, _O = ("public", "customer"), ("public", "orders")


@query("SELECT c_name AS c_name, c_acctbal AS c_acctbal FROM customer")
def q_sql_select(spark, d):
    return _rows(spark, d, S.RowQuery(_C, ("c_name", "c_acctbal")), c_name="c_name", c_acctbal="c_acctbal")


@query("SELECT c_custkey AS k FROM customer WHERE (c_acctbal >= 1000 OR c_mktsegment LIKE 'A%') AND NOT (c_nationkey = 3)")
def q_sql_where(spark, d):
    where = S.And((S.Or((S.Compare("c_acctbal", ">=", 1000), S.Compare("c_mktsegment", "like", "A%"))), S.Not(S.Compare("c_nationkey", "=", 3))))
    return _rows(spark, d, S.RowQuery(_C, ("c_custkey",), where), k="c_custkey")


@query("SELECT c_custkey AS k FROM customer WHERE c_nationkey IN (1, 5, 9)")
def q_sql_in(spark, d):
    return _rows(spark, d, S.RowQuery(_C, ("c_custkey",), S.In("c_nationkey", (1, 5, 9))), k="c_custkey")


@query("SELECT c_custkey AS k FROM customer WHERE c_mktsegment IS NOT NULL")
def q_sql_isnull(spark, d):
    return _rows(spark, d, S.RowQuery(_C, ("c_custkey",), S.IsNull("c_mktsegment", True)), k="c_custkey")


@query("SELECT o_orderkey AS k, o_totalprice AS price FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def q_sql_orderlimit(spark, d):
    return _rows(spark, d, S.RowQuery(_O, ("o_orderkey", "o_totalprice"), order_by=(("o_totalprice", "desc"), ("o_orderkey", "asc")), limit=20), k="o_orderkey", price="o_totalprice")


@query("SELECT o_orderkey AS k FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 5")
def q_sql_offset(spark, d):
    return _rows(spark, d, S.RowQuery(_O, ("o_orderkey",), order_by=(("o_orderkey", "asc"),), limit=10, offset=5), k="o_orderkey")


@query("SELECT o_orderkey AS k, c_name AS name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def q_sql_join(spark, d):
    q = S.RowQuery(_O, ("o_orderkey", ("customer", "c_name")), S.Compare(("customer", "c_mktsegment"), "=", "BUILDING"), (S.Join(_C, "o_custkey", "c_custkey"),))
    return _rows(spark, d, q, k="o_orderkey", name="c_name")


def _aggregate(name, function, column, sql):
    @query(sql)
    def run(spark, d):
        q = S.RowQuery(_O, where=S.Compare("o_orderstatus", "=", "F"), aggregate=S.Aggregate(function, "v", column))
        return _tables(spark, d).rows(q).dataframe(value=lambda r: F.round(r["value"].col, 2))

    QUERIES[name] = QUERIES.pop("run")
    ORACLE_SQL[name] = ORACLE_SQL.pop("run")


_aggregate("q_sql_count", "count", None, "SELECT CAST(count(*) AS BIGINT) AS value FROM orders WHERE o_orderstatus = 'F'")
_aggregate("q_sql_sum", "sum", "o_orderkey", "SELECT CAST(sum(o_orderkey) AS BIGINT) AS value FROM orders WHERE o_orderstatus = 'F'")
_aggregate("q_sql_min", "min", "o_totalprice", "SELECT round(min(o_totalprice), 2) AS value FROM orders WHERE o_orderstatus = 'F'")
_aggregate("q_sql_max", "max", "o_totalprice", "SELECT round(max(o_totalprice), 2) AS value FROM orders WHERE o_orderstatus = 'F'")
_aggregate("q_sql_avg", "avg", "o_totalprice", "SELECT round(avg(o_totalprice), 2) AS value FROM orders WHERE o_orderstatus = 'F'")


@query(
    """SELECT 'sql::table' AS kind, t AS name FROM (VALUES ('region'), ('nation'), ('customer'), ('orders'), ('supplier'), ('part'), ('lineitem')) v(t)
    UNION ALL SELECT 'sql::relation', t FROM (VALUES ('nation_region'), ('customer_nation'), ('orders_customer')) v(t)"""
)
def q_sql_catalog(spark, d):
    q = select(_tables(spark, d).graph().roots(), ":is(sql::table, sql::relation)", "roots")
    return q.dataframe(kind=lambda r: r.kind, name=lambda r: r["name"].col)


@query("SELECT 'orders' AS a, 'customer' AS b UNION ALL SELECT 'customer', 'nation' UNION ALL SELECT 'nation', 'region'")
def q_sql_relations(spark, d):
    g = _tables(spark, d).graph()
    q = select(g.roots(), "sql::relation as $r ->sql::from sql::table as $a", "roots")
    left = q.dataframe(rel=lambda r: r.capture("r")["name"].col, a=lambda r: r["name"].col)
    q = select(g.roots(), "sql::relation as $r ->sql::to sql::table", "roots")
    return left.join(q.dataframe(rel=lambda r: r.capture("r")["name"].col, b=lambda r: r["name"].col), "rel").select("a", "b")


@query("SELECT c_custkey AS k, CASE WHEN c_nationkey = 3 THEN 'X' ELSE c_mktsegment END AS segment FROM customer")
def q_sql_update(spark, d):
    return _tables(spark, d).updated(_C, {"c_mktsegment": "X"}, S.Compare("c_nationkey", "=", 3)).select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("segment"))


@query("SELECT c_custkey AS k FROM customer WHERE NOT (c_acctbal < 0)")
def q_sql_delete(spark, d):
    return _tables(spark, d).deleted(_C, S.Compare("c_acctbal", "<", 0)).select(F.col("c_custkey").alias("k"))


@query(
    """WITH c AS (SELECT event_id AS id, user_id AS uri, CAST(floor(value * 1000) AS BIGINT) AS s, CAST(floor(value * 1000) AS BIGINT) + event_id % 3 AS e FROM events)
    SELECT a.uri AS uri, a.id AS a, b.id AS b FROM c a JOIN c b ON a.uri = b.uri AND a.id < b.id AND CASE
    WHEN a.s = a.e AND b.s = b.e THEN a.s = b.s WHEN a.s = a.e THEN b.s < a.s AND a.s < b.e
    WHEN b.s = b.e THEN a.s < b.s AND b.s < a.e ELSE a.s < b.e AND b.s < a.e END"""
)
def q_conflicts(spark, d):
    from .change import conflicts

    e = spark.read.parquet(f"{d}/events.parquet")
    start = F.floor(F.col("value") * 1000).cast("long")
    return conflicts(e.select(F.col("event_id").alias("id"), F.col("user_id").alias("uri"), start.alias("start"), (start + F.col("event_id") % 3).alias("end")))


# -- more of the language, row identity and embedded documents ----------------------------------


@query("SELECT o_orderkey AS k FROM orders WHERE o_orderstatus IS DISTINCT FROM 'F'")
def q_pipeline_missing(spark, d):
    return _program(spark, d, "from orders() | where @finished is missing | project { k: @o_orderkey }")


@query("SELECT count(*) AS value FROM (SELECT DISTINCT c_mktsegment FROM customer)")
def q_pipeline_distinct_count(spark, d):
    q = P.compile_program("from customer()", _environment(spark, d)).query.project(lambda r: r["c_mktsegment"]).distinct().count()
    return q.dataframe(value=lambda r: r.col)


@query("SELECT count(*) AS value FROM lineitem WHERE l_quantity > 30")
def q_pipeline_count(spark, d):
    return _program(spark, d, "from lineitem() | where @l_quantity > 30 | count")


@query("SELECT c_custkey AS customer, o_orderkey AS k, o_totalprice AS price FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_nationkey = 7")
def q_pipeline_capture(spark, d):
    return _program(spark, d, "from customer() | where @c_nationkey = 7 | select 'star::customer as $c > star::order' | project { customer: $c.c_custkey, k: @o_orderkey, price: @o_totalprice }")


@query("SELECT p_partkey AS k, p_name AS info_name, p_size AS info_size FROM part WHERE p_size >= 40")
def q_pipeline_record(spark, d):
    return _program(spark, d, "from part() | where @p_size >= 40 | project { k: @p_partkey, info: { name: @p_name, size: @p_size } }")


@query("SELECT CAST(c_custkey AS VARCHAR) AS k, c_name AS name FROM customer WHERE length(c_name) % 2 = 0 AND c_acctbal > 0")
def q_sql_runtime(spark, d):
    """A condition that only the engine can judge, after the one that the tables can."""
    q = _tables(spark, d).rows(S.RowQuery(_C, ("c_custkey", "c_name"), S.Compare("c_acctbal", ">", 0)))
    return q.filter(lambda r: F.length(r["c_name"].col) % 2 == 0).dataframe(k=lambda r: r["c_custkey"].col.cast("string"), name=lambda r: r["c_name"].col)


@query("SELECT n, count(*) AS times FROM (SELECT event_id, 2 AS n FROM events WHERE props IS NOT NULL) GROUP BY n")
def q_json_depth(spark, d):
    """Depth of the one value in each small document, from the ranges of its tree."""
    e = spark.read.parquet(f"{d}/events.parquet")
    docs = e.select(F.col("event_id").cast("string").alias("resource"), F.col("event_id").cast("string").alias("uri"), F.lit(None).cast("string").alias("revision"), F.col("props").alias("text"))
    q = select(D.documents(spark, docs, "json").roots(), "json::root > json::object > json::property > json::scalar")
    return q.df.groupBy((F.col(q.shape.keys["depth"]) - 1).cast("int").alias("n")).agg(F.count("*").alias("times"))


@query("SELECT doc_id AS k, 2 * doc_id AS twice FROM documents")
def q_fence_mount(spark, d):
    """A value in the fenced block of a text about each document: two mounts, one inside the other."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    ident = F.col("doc_id").cast("string")
    text = F.concat(F.lit("# about\n\n```json\n{\"twice\": "), (F.col("doc_id") * 2).cast("string"), F.lit("}\n```\n\n```text\n{\"twice\": 0}\n```\n"))
    q = D.documents(spark, docs.select(ident.alias("resource"), ident.alias("uri"), F.lit(None).cast("string").alias("revision"), text.alias("text")), "markdown").roots()
    q = D.mount(q, "json", "content")
    q = select(q, 'markdown::document > markdown::code-block > json::root > json::object > json::property[name = "twice"] > json::scalar')
    return q.dataframe(k=lambda r: F.split(F.col(r.shape.cols["uri"]), "#")[0].cast("long"), twice=lambda r: r["value"].col["n"])
