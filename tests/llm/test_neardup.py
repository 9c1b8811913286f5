import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from fixtures import awkward, documents, words

from graphloom.llm import components as G
from graphloom.llm import neardup as N


def family(g, n_docs, copies):
    rows, groups, k = [], [], 0
    for _ in range(n_docs):
        base = words(g, 120).split()
        own = []
        for _ in range(g.choice(copies)):
            text = list(base)
            for _ in range(g.randint(0, 4)):
                text[g.randrange(len(text))] = "changed"
            rows.append((k, " ".join(text)))
            own.append(k)
            k += 1
        groups.append(own)
    return rows, groups


def shingled(text):
    """Three-word shingles and their counts, by plain string work."""
    w = re.findall(rb"[0-9a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2)) if len(w) > 2 else Counter([tuple(w)] if w else [])


def weighted(rows, total=None):
    """Weighted shingle sets straight from the definition, with exact document counts."""
    sets = {d: shingled(t) for d, t in rows}
    df = Counter(x for s in sets.values() for x in s)
    n = total or len(rows)
    return {d: {x: tf * math.log(1 + n / df[x]) for x, tf in s.items()} for d, s in sets.items()}


def similar(a, b):
    top = sum(max(a.get(x, 0), b.get(x, 0)) for x in a.keys() | b.keys())
    return sum(min(a[x], b[x]) for x in a.keys() & b.keys()) / top if top else 0.0


def test_recall_against_brute_force(spark):
    g = random.Random(12)
    rows, _ = family(g, 40, [1, 2, 3, 6])
    sets = weighted(rows)
    true = {(a, b) for a in sets for b in sets if a < b and similar(sets[a], sets[b]) >= N.THRESHOLD}
    got = {r.doc_id: r.group_id for r in N.near_duplicates(documents(spark, rows, "clash")).collect()}
    joined = {(a, b) for a in got for b in got if a < b and got[a] == got[b]}
    assert len(true & joined) >= 0.9 * len(true) and len(true) > 50
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in true:
        parent[find(b)] = find(a)
    assert all(find(a) == find(b) for a, b in joined)


def test_sampling_collides_as_often_as_sets_agree():
    g = np.random.default_rng(3)
    ids = np.sort(g.choice(1 << 40, 300, replace=False)).astype(np.uint64)
    other = np.sort(np.r_[ids[:200], g.choice(1 << 40, 100, replace=False).astype(np.uint64)])
    at = np.zeros(300, np.int64)
    for w, v in ((np.full(300, 4.6), np.full(300, 4.6)), (1.0 + ids % 5, 1.0 + other % 5), (1.0 + ids % 5, 2.0 + other % 3)):
        a = N.signatures(at, ids, w, 1, 400, 1)[0]
        b = N.signatures(at, other, v, 1, 400, 1)[0]
        assert abs((a == b).mean() - N.weighted_jaccard((ids, w), (other, v))) < 0.09


def test_one_of_each_group_stays_whatever_the_task_size(spark):
    g = random.Random(13)
    rows, groups = family(g, 12, [1, 2, 9])
    rows = [(d, t) for d, t in rows]
    for together, sent in ((N.MAX_TOGETHER, N.MAX_SENT), (2000, 0), (400, N.MAX_SENT)):
        left = {r.doc_id for r in N.without_near_duplicates(documents(spark, rows, "clash"), max_together=together, max_sent=sent).collect()}
        assert left == {min(x) for x in groups}


def test_awkward(spark):
    got = {r.doc_id: (r.group_id, r.keep) for r in N.near_duplicates(documents(spark, awkward())).collect()}
    assert got == {1: (1, True), 2: (2, True), 3: (3, True), 4: (4, True), 5: (5, True), 6: (5, False), 7: (7, True), 8: (8, True)}
    assert N.near_duplicates(documents(spark, [])).collect() == []
    assert N.without_near_duplicates(documents(spark, awkward())).where("doc_id is null").count() == 1


def test_a_document_with_several_texts_joins_their_groups(spark):
    g = random.Random(16)
    x, y, z = (words(g, 60) for _ in range(3))
    rows = [(3, x), (7, x), (7, y), (9, y), (11, z), (12, z + " more")]
    got = {r.doc_id: (r.group_id, r.keep) for r in N.near_duplicates(documents(spark, rows)).collect()}
    assert got == {3: (3, True), 7: (3, False), 9: (3, False), 11: (11, True), 12: (11, False)}


@pytest.mark.parametrize("one_task", [10**6, 0])
def test_components(spark, one_task):
    edges = [(i, i + 1) for i in range(20)] + [(40, 41), (41, 42), (50, 50), (None, 3), (41, 40)]
    got = {r.node: r.component for r in G.connected(spark.createDataFrame(edges, "a long, b long"), one_task).collect()}
    assert got == {**{i: 0 for i in range(21)}, 40: 40, 41: 40, 42: 40}
    assert G.connected(spark.createDataFrame([], "a long, b long"), one_task).collect() == []


def test_components_of_random_graphs():
    g = np.random.default_rng(4)
    for n in (1, 5, 60, 400):
        a, b = g.integers(0, n, n), g.integers(0, n, n)
        label = list(range(n))
        for _ in range(n):
            for x, y in zip(a, b):
                label[x] = label[y] = min(label[x], label[y])
        nodes, root = G.joined(a, b)
        assert root.tolist() == [label[x] for x in nodes]


def shared_passage(n_docs, holders, passage, own):
    """Rows in which ``holders`` documents share ``passage`` shingles, have ``own`` further ones each, and the rest are fillers."""
    g = random.Random(14)
    text = words(g, passage + 2)
    rows = [(k, text + " " + words(g, own)) for k in range(holders)]
    return rows + [(k, f"filler{k}") for k in range(holders, n_docs)]


def test_weights_have_no_floor(spark):
    rows = shared_passage(20_000, 20, 102, 30)
    exact = weighted(rows[:20], len(rows))
    alike = similar(exact[0], exact[1])
    assert alike < 0.57 < N.THRESHOLD < 102 / 162
    got = N.near_duplicates(documents(spark, rows)).where("doc_id < 20").collect()
    assert len(got) == 20 and all(r.keep for r in got)
    assert not all(r.keep for r in N.near_duplicates(documents(spark, rows), threshold=alike - 0.02).where("doc_id < 20").collect())


@pytest.mark.parametrize("size", [N.PIECE, 2000])
def test_counts_against_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(N, "PIECE", size)
    monkeypatch.setattr(N, "BUCKET", size)
    rows, _ = family(random.Random(15), 12, [1, 3, 7])
    want = {}
    for _, t in rows:
        for _, _, _, ids, _ in N.doc_shingles(pa.array([t])):
            for i in ids.tolist():
                want[i] = want.get(i, 0) + 1
    n, got = N.signed(N._texts(documents(spark, rows + [(None, "left out"), (900, None)])))
    assert n == len(rows) + 1
    got = {r.doc_id: bytes(r.df) for r in got.collect()}
    for d, t in rows:
        ids = next(N.doc_shingles(pa.array([t])))[3]
        assert N._numbers(got[d], len(ids)).tolist() == [want[i] for i in ids.tolist()]
