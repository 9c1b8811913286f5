"""Every registered query of the graph engine against its SQL, on small tables."""

import numbers
import os

import duckdb
import pandas as pd
import pytest

import graphloom.queries as Q

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


def rows(frame):
    out = []
    for r in frame.itertuples(index=False):
        out.append(tuple(round(x, 4) if isinstance(x, float) else x for x in (None if pd.isna(v) else v for v in r)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for n in os.listdir(DATA):
        con.sql(f"create view {n.removesuffix('.parquet')} as select * from '{DATA}/{n}'")
    return con


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, db, name):
    got = Q.QUERIES[name](spark, DATA).toPandas()
    if name not in Q.ORACLE_SQL:
        assert len(got)
        return
    want = db.sql(Q.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    a, b = rows(got[cols]), rows(want[cols])
    norm = lambda xs: [tuple(float(v) if isinstance(v, numbers.Real) and not isinstance(v, bool) else v for v in x) for x in xs]
    assert sorted(norm(a), key=repr) == sorted(norm(b), key=repr)


def test_typescript_nodes_of_all_documents(spark, tmp_path):
    from collections import Counter

    from graphloom.sources.parsers import parse_typescript

    texts = ["f(g(1)); const x = h(2);", "plain words only", "import a from 'b'; a.b(3);", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.kind: r.n for r in Q.QUERIES["q_typescript_calls"](spark, str(tmp_path)).collect()}
    assert got["ts::call"] == 4
    want = Counter()
    for t in texts[:3]:
        want.update(r.kind for r in parse_typescript(t).rows)
    assert {k: n for k, n in got.items() if k != "ts::source-file"} == {k: n for k, n in want.items() if k != "ts::source-file"}
