"""The whole pipeline against a slow version of every stage, and its edge cases."""

import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
from fixtures import awkward, documents, words
from test_neardup import similar, weighted

import corpus_pipeline
from graphloom.llm import decontaminate as D
from graphloom.llm import line_quality as Q
from graphloom.llm import mixing as M
from graphloom.llm import neardup as N
from graphloom.llm import tokenizers as T

ITEMS = "item_id long, text string"


def corpus(seed=21):
    g = random.Random(seed)
    items = [(i, words(g, 20)) for i in range(6)]
    junk = [words(g, 6) for _ in range(3)]
    rows, k = [], 0
    for source, lang, n in (("web", "en", 40), ("web", "de", 15), ("books", "en", 12), ("code", "fr", 8)):
        for _ in range(n):
            lines = [words(g, g.randint(8, 25)) for _ in range(g.randint(2, 6))]
            if source == "web" and g.random() < 0.5:
                lines.insert(g.randint(0, len(lines)), g.choice(junk))
            if g.random() < 0.15:
                lines.append("so " + g.choice(items)[1])
            rows.append((k, "\n".join(lines), source, lang))
            k += 1
    for d, t, s, x in g.sample(rows, 12):
        text = t.split(" ")
        for _ in range(g.randint(0, 2)):
            text[g.randrange(len(text))] = "edited"
        rows.append((k, " ".join(text), s, x))
        k += 1
    rows += [(k, junk[0], "web", "en"), (k + 1, "", "web", "en"), (k + 2, None, "books", "en")]
    return rows, items


def quality(rows):
    con = duckdb.connect()
    table = pa.table({"doc_id": [r[0] for r in rows], "text": pa.array([r[1] for r in rows], pa.string()), "lang": [r[3] for r in rows], "source": [r[2] for r in rows]})
    con.register("documents", table)
    return [(r[0], r[1], r[3], r[2]) for r in con.sql(Q.ORACLE).fetchall()]


def deduplicated(rows):
    sets = weighted([(r[0], r[1]) for r in rows])
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and similar(sets[a], sets[b]) >= N.THRESHOLD:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [r for r in rows if find(r[0]) == r[0]]


def clean(rows, items):
    return [r for r in rows if not any(D.expected_containment(t, r[1]) for _, t in items)]


def mixed(rows):
    """Rates by Newton's method over the documents themselves."""
    tokens = np.array([len(r[1].split()) for r in rows], float)
    total = tokens.sum()
    columns, want = [], []
    for i in (2, 3):
        values = sorted({r[i] for r in rows})
        mass = np.array([tokens[[r[i] == v for r in rows]].sum() for v in values])
        share = mass**M.TEMPERATURE
        columns += [[float(r[i] == v) for r in rows] for v in values]
        want += list(share / share.sum())
    z = np.log1p(tokens)
    columns.append(list(z - (tokens * z).sum() / total))
    a, want = np.array(columns).T, np.array([*want, 0.0])
    lam, share = np.zeros(a.shape[1]), tokens / total

    def value(x):
        return (share * np.exp(a @ x)).sum() - x @ want + M.RIDGE / 2 * x @ x

    for _ in range(200):
        w = share * np.exp(a @ lam)
        grad = a.T @ w - want + M.RIDGE * lam
        step = np.linalg.solve((a * w[:, None]).T @ a + M.RIDGE * np.eye(len(lam)), grad)
        size = 1.0
        while value(lam - size * step) > value(lam) and size > 1e-9:
            size /= 2
        lam = lam - size * step
        if np.abs(grad).max() < 1e-12:
            break
    rate = np.exp(a @ lam)
    unit = M._unit(pa.array([r[0] for r in rows]), M.SEED)
    return [r for r, n, u in zip(rows, rate, unit) for _ in range(int(np.floor(n) + (u < n - np.floor(n))))]


def written(spark, tmp_path, rows, items, extra=""):
    documents(spark, rows, extra).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, ITEMS).write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_against_brute_force(spark, tmp_path):
    rows, items = corpus()
    steps = [rows, quality(rows)]
    steps.append(deduplicated(steps[-1]))
    steps.append(clean(steps[-1], items))
    steps.append(mixed(steps[-1]))
    assert all(len(a) > len(b) for a, b in zip(steps, steps[1:4])) and steps[4] != steps[3]
    enc = T.encoding()
    want = Counter((r[0], len(enc.encode_ordinary(r[1]))) for r in steps[-1])
    got = corpus_pipeline.run(spark, written(spark, tmp_path, rows, items, "clash")).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in got) == want
    assert sorted(r.start for r in got)[0] == 0 and sum(r.n_tokens for r in got) == max(r.start + r.n_tokens for r in got)


def test_every_stage_with_hard_cases(spark, tmp_path):
    rows = awkward() + [(None, None), (20, "plain text of a few words that stays"), (20, "plain text of a few words that stays")]
    folder = written(spark, tmp_path, rows, [(1, None), (None, "x"), (2, "")], "clash")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.count() <= 2 * docs.count()
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()} >= {4, 5, 8, 20}


def test_empty_table(spark, tmp_path):
    folder = written(spark, tmp_path, [], [(1, "one two three")])
    assert corpus_pipeline.run(spark, folder).collect() == []
