import random

import numpy as np
import pytest
from fixtures import awkward, documents, words

from graphloom.llm import mixing as M


def table(spark, n=300):
    g = random.Random(2)
    return documents(spark, [(i, words(g, g.randint(1, 120)), g.choice(["x", "x", "x", "y", None]), g.choice(["en", "de"])) for i in range(n)], "clash")


def test_targets_are_met(spark):
    p = M.mixture(table(spark), targets={"source": {"x": 0.2, "y": 0.5, None: 0.3}, "lang": {"en": 0.7, "de": 0.3}}).toPandas()
    total = p.n_tokens.sum()
    mass = p.n_tokens * p.rate
    assert abs(mass.sum() / total - 1) < 1e-5
    for column, want in (("source", {"x": 0.2, "y": 0.5}), ("lang", {"en": 0.7, "de": 0.3})):
        for k, v in want.items():
            assert abs(mass[p[column] == k].sum() / total - v) < 1e-5
    z = np.log1p(p.n_tokens)
    assert abs((mass * z).sum() / mass.sum() - (p.n_tokens * z).sum() / total) < 1e-5
    assert ((p.copies - p.rate).abs() < 1).all()
    assert abs(p.copies.sum() / p.rate.sum() - 1) < 0.15


def test_solution_is_the_optimum(spark):
    """A feasible change of the rates never lowers the objective."""
    p = M.mixture(table(spark, 60), targets={"source": {"x": 0.5, "y": 0.3, None: 0.2}}).toPandas()
    t, w = p.n_tokens.to_numpy(float), p.rate.to_numpy()
    z = np.log1p(t)
    rows = np.array([t * (p.source.fillna("?") == s) for s in ("x", "y", "?")] + [t * (p.lang == k) for k in ("en", "de")] + [t * z])
    null = np.linalg.svd(rows)[2][np.linalg.matrix_rank(rows) :]
    f = lambda r: (t * r * (np.log(r) - 1)).sum()
    for v in null[:20]:
        step = 1e-3 * v / np.abs(v / w).max()
        assert f(w + step) >= f(w) - 1e-9 and f(w - step) >= f(w) - 1e-9


def test_copies_repeat_rows(spark):
    df = table(spark)
    plan = {r.doc_id: r.copies for r in M.mixture(df).collect()}
    out = M.mixed(df)
    assert out.columns == df.columns
    got = {}
    for r in out.select("doc_id").collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {k: v for k, v in plan.items() if v}
    assert max(plan.values()) > 1 and min(plan.values()) == 0


def test_awkward(spark):
    p = M.mixture(documents(spark, awkward())).toPandas()
    assert len(p) == len(awkward()) and (p[p.n_tokens == 0].copies == 1).all() and len(p[p.doc_id == 6]) == 2
    assert M.mixture(documents(spark, [])).collect() == [] and M.mixed(documents(spark, [])).collect() == []
    got = M.mixture(documents(spark, [(1, "a b", "x", "en"), (2, "c", "y", "en")]), targets={"source": {"z": 1.0}, "lang": {"en": 1}})
    assert len(got.collect()) == 2
    assert [r.n_tokens for r in M.mixture(documents(spark, [(1, "hello world")]), measure="bpe").collect()] == [2]
    assert [r.n_tokens for r in M.mixture(documents(spark, [(1, "hello")]), measure="n_chars").collect()] == [5]


def test_contradicting_targets_settle(spark):
    docs = documents(spark, [(i, "w " * 10, s, s) for i, s in enumerate(["x"] * 10 + ["y"] * 10)])
    p = M.mixture(docs, targets={"source": {"x": 0.9, "y": 0.1}, "lang": {"x": 0.1, "y": 0.9}}).toPandas()
    assert np.isfinite(p.rate).all()


@pytest.mark.parametrize("text, n", [(" a  b\n", 2), ("", 0), ("abc", 1), ("\t", 0)])
def test_words(text, n):
    import pyarrow as pa

    assert M.count_words(pa.array(["x y", text, None])).tolist() == [2, n, 0]
