import random

import duckdb
import pytest
from fixtures import awkward, documents, words

from graphloom.llm import line_quality as L


def brute(rows, min_docs, share, keep):
    """rows (doc_id, text, host) -> [(doc_id, new text)]"""
    norm = lambda x: " ".join(x.lower().split())
    docs, held = {}, {}
    for d, t, h in rows:
        if d is not None:
            docs.setdefault(h, set()).add(d)
            for line in (t or "").split("\n"):
                if norm(line):
                    held.setdefault((h, norm(line)), set()).add(d)
    bad = {k for k, v in held.items() if len(v) > min_docs and len(v) > share * len(docs[k[0]])}
    out = []
    for d, t, h in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if (h, norm(x)) not in bad]
        if any(norm(x) for x in kept) and (len(kept) == len(lines) or sum(map(len, kept)) >= keep * sum(map(len, lines))):
            out.append((d, "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("max_sent", [10**6, 0])
def test_against_brute_force(spark, max_sent):
    g = random.Random(3)
    pool = [words(g, 4) for _ in range(12)]
    rows = []
    for i in range(60):
        lines = [g.choice(pool) if g.random() < 0.5 else words(g, 5) for _ in range(g.randint(0, 8))]
        rows.append((g.choice([None, i, i, i % 50]), g.choice([None, "\n".join(x.upper() if g.random() < 0.3 else f"  {x}\t " for x in lines)]) if g.random() < 0.1 else "\n".join(lines), g.choice(["h", "h", "k", None])))
    df = documents(spark, [(d, t, h, "en") for d, t, h in rows], "clash")
    got = L.clean_lines(df, min_docs=3, host_share=0.05, keep_share=0.4, max_sent=max_sent)
    assert got.columns == df.columns
    found = got.collect()
    assert sorted(((r.doc_id, r.text) for r in found), key=repr) == brute(rows, 3, 0.05, 0.4)
    assert all(r.n_chars == len(r.text) for r in found)


def test_awkward_rows(spark):
    got = sorted(((r.doc_id, (r.text or "")[:3]) for r in L.clean_lines(documents(spark, awkward())).collect()), key=repr)
    assert [d for d, _ in got] == [4, 5, 6, 6, 7, 8, None]
    assert L.clean_lines(documents(spark, [])).collect() == []


def test_sql_on_a_fixture(spark):
    rows = [(i, f"shared line\nown {i} text of some length here", "h", "en") for i in range(12)] + [(99, "shared line", "h", "en")]
    df = documents(spark, rows)
    documents_table = df.toPandas()
    con = duckdb.connect()
    con.register("documents", documents_table)
    want = sorted(map(tuple, con.sql(L.ORACLE).df()[["doc_id", "text"]].itertuples(index=False)))
    got = sorted((r.doc_id, r.text) for r in L.clean_lines(df).collect())
    assert got == want and len(got) == 12 and "shared" not in got[0][1]
