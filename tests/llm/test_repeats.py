import random

import numpy as np
import pyarrow as pa
from fixtures import awkward, documents, words

from graphloom.llm import repeats as R


def brute(rows, k):
    """(matches, repeated runs): all pairs of places with k equal words, extended word by word, and all such runs of k words."""
    texts = sorted({(d, tuple((t or "").lower().split())) for d, t in rows if d is not None})
    where = {}
    for d, w in texts:
        for i in range(len(w) - k + 1):
            where.setdefault(w[i : i + k], []).append((d, i, w))
    pairs, runs = set(), set()
    for d, w in texts:
        for i in range(len(w) - k + 1):
            for e, j, v in where[w[i : i + k]]:
                if e != d:
                    a, b, c = i, i + k, j
                    while a and c and w[a - 1] == v[c - 1]:
                        a, c = a - 1, c - 1
                    while b < len(w) and b - a + c < len(v) and w[b] == v[b - a + c]:
                        b += 1
                    pairs.add((d, w, a, b, e, c))
                    runs.add((d, w, i))
    return pairs, runs


def check(rows, got, k):
    """Every row is a maximal match of the pair it names, none is inside another, and all repeated runs are in one."""
    pairs, runs = brute(rows, k)
    assert got <= {(d, a, b, e, c) for d, _, a, b, e, c in pairs}
    for d, w, i in runs:
        assert any(x[0] == d and x[1] <= i and i + k <= x[2] and (d, w, *x[1:]) in pairs for x in got), (d, i)
    several = {d for d, t in rows if len({u for e, u in rows if e == d}) > 1}
    for x in got:
        assert x[0] in several or not any(y[0] == x[0] and y != x and y[1] <= x[1] and x[2] <= y[2] for y in got)
    return runs


def matches(df):
    rows = [(r.doc_id, r.start_word, r.end_word, r.first_doc_id, r.first_start) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_against_brute_force(spark):
    g = random.Random(9)
    shared = [words(g, g.randint(8, 60)).split() for _ in range(8)]
    rows = []
    for i in range(50):
        text = []
        for _ in range(g.randint(0, 4)):
            text += words(g, g.randint(0, 20)).split()
            part = g.choice(shared)
            a = g.randint(0, len(part) // 2)
            text += [w.upper() for w in part[a:]]
        rows.append((i, " \n".join(text)))
    rows += [(0, rows[0][1])]
    assert len(check(rows, matches(R.repeated_passages(documents(spark, rows, "clash"), min_words=12, seed=4)), 12)) > 100
    # frequent anchors joined window by window
    check(rows, matches(R.repeated_passages(documents(spark, rows), min_words=12, seed=4, hot=3, sample=1)), 12)


def test_near_copies_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(R, "CHUNK", 2000)
    g = random.Random(11)
    base = words(g, 150).split()
    rows = []
    for i in range(40):
        text = list(base)
        for _ in range(g.randint(0, 4)):
            text[g.randrange(len(text))] = g.choice(["x", "y"])
        a = g.randint(0, 60) if i % 3 == 0 else 0
        rows.append((g.randint(0, 30), " ".join(text[a:] + text[: g.randint(0, 40)] * (i % 5 == 0))))
    got = matches(R.repeated_passages(documents(spark, rows), min_words=20, seed=5))
    assert len(check(rows, got, 20)) > 1000 and len(got) > 80
    check(rows, matches(R.repeated_passages(documents(spark, rows), min_words=20, seed=5, hot=2, sample=1)), 20)


def test_matches_do_not_run_into_one_another(spark):
    w = [f"w{i}" for i in range(80)]
    rows = [(1, " ".join(w)), (2, " ".join(w[:60])), (3, " ".join(w[11:]))]
    got = matches(R.repeated_passages(documents(spark, rows)))
    assert got == {(1, 0, 60, 2, 0), (1, 11, 80, 3, 0), (2, 0, 60, 1, 0), (3, 0, 69, 1, 11)}


def test_extension_stops_where_runs_differ():
    own = np.array([(0, 4, 7, 0), (5, 9, 8, 3), (10, 11, 5, 0), (12, 20, 7, 0)]).T
    other = np.array([(10, 14, 7, -10), (15, 17, 8, -7), (18, 30, 9, 0)]).T
    assert R.extended(own, other, np.array([[1], [2]]), 10) == [(0, 7)]
    assert R.extended(own, own, np.array([[13], [13]]), 0) == [(0, 20)]
    assert R.extended(own, other, np.array([[9], [9]]), 10) == []


def test_long_passages(spark):
    g = random.Random(10)
    passage = words(g, 55)
    rows = [(1, words(g, 40) + " " + passage + " " + words(g, 10)), (2, passage), (3, words(g, 300)), (4, passage.rsplit(" ", 6)[0])]
    got = {(r.doc_id, r.n_words, r.first_doc_id, r.first_start) for r in R.repeated_passages(documents(spark, rows)).collect()}
    assert got == {(1, 55, 2, 0), (2, 55, 1, 40)}


def test_awkward(spark):
    got = R.repeated_passages(documents(spark, awkward())).collect()
    assert {(r.doc_id, r.start_word, r.end_word) for r in got} == {(5, 0, 30_000), (6, 0, 30_000)}
    assert R.repeated_passages(documents(spark, [])).collect() == []
    only = [(9, awkward()[5][1]), (9, awkward()[5][1])]
    assert R.repeated_passages(documents(spark, only)).collect() == []


def test_windows_are_compared_by_anchor_and_whole_hash():
    ids, at, h = np.array([1, 2]), np.array([0, 0]), np.uint64(0x123456789ABCDEF0)
    one, same, other = np.ones(2, np.int64), np.array([5, 5]), np.array([5, 6])
    got = R._meetings(same, ids, ids, [ids], at, one, np.array([h, h]))
    assert [x.tolist() for x in got] == [[1, 2], [1, 2], [0, 0], [0, 0], [1, 1], [1, 1], [0, 0], [2, 1], [2, 1], [0, 0]]
    assert R._meetings(other, ids, ids, [ids], at, one, np.array([h, h])) is None
    assert R._meetings(same, ids, ids, [ids], at, one, np.array([h, h ^ np.uint64(1 << 60)])) is None
    mixed = R._meetings(np.array([6, 5, 6, 5]), np.array([1, 2, 3, 4]), np.zeros(4, int), [], np.zeros(4, int), np.ones(4, int), np.array([h, h, h, h + np.uint64(1)]))
    assert sorted(mixed[0].tolist()) == [1, 3]


def test_the_hash_that_travels_is_whole():
    batch = next(R.anchored_windows(np.array([1]), np.array([2]), pa.array([" ".join(f"w{i}" for i in range(60))]), 50, 10))
    sizes = [len(x.as_py()) for x in batch.column("windows")]
    assert sum(sizes) == 11 * 8


def everything(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def classes(df, k):
    """Places (document, text, word) that member rows lead to one first place, for each."""
    out = {}
    for r in df.where("kind = 'member'").collect():
        for i in range(r.n_words - k + 1):
            out.setdefault((r.first_doc_id, r.first_text_id, r.first_start + i), set()).add((r.doc_id, r.text_id, r.start_word + i))
    return out


def brute_classes(docs, k):
    """Places of each run of k words that several documents hold, under the first of them."""
    runs = {}
    for r in docs.selectExpr("doc_id", "xxhash64(text) as id", "text").where("doc_id is not null and text is not null").collect():
        w = r.text.lower().split()
        for i in range(len(w) - k + 1):
            runs.setdefault(tuple(w[i : i + k]), set()).add((r.doc_id, r.id, i))
    return {min(x): x for x in runs.values() if len({p[0] for p in x}) > 1}


def edited_copies():
    g = random.Random(12)
    base = words(g, 120).split()
    rows = []
    for i in range(30):
        text = list(base)
        for _ in range(g.randint(0, 3)):
            text[g.randrange(len(text))] = g.choice(["x", "y"])
        rows.append((g.randint(0, 24), " ".join(text[g.randint(0, 40) * (i % 3 == 0) :] + text[:45] * (i % 4) + [f"end{i}"] * (i % 2))))
    rows += [rows[0], rows[5], (40, rows[7][1]), (41, " ".join(["a", "b", "c"] * 30)), (42, " ".join(["b", "c", "a"] * 40)), (43, words(g, 70))]
    return rows


def test_members_lose_no_link(spark):
    docs = documents(spark, edited_copies(), "clash")
    want = brute_classes(docs, 20)
    assert len(want) > 200 and max(map(len, want.values())) > 20
    assert classes(R.linked_passages(docs, min_words=20, seed=5), 20) == want
    assert classes(R.linked_passages(docs, min_words=20, seed=5, hot=2, sample=1), 20) == want


def test_frequent_seeds_find_the_same(spark):
    docs = documents(spark, edited_copies())
    assert everything(R.linked_passages(docs, min_words=20, seed=5, hot=2, sample=1)) == everything(R.linked_passages(docs, min_words=20, seed=5))


def test_pair_with_every_run_in_earlier_documents(spark):
    w = [f"w{i}" for i in range(30)]
    whole = " ".join(w)
    rows = [(1, " ".join(w[:25])), (2, " ".join(w[5:])), (3, whole), (4, whole)]
    for hot in (R.HOT, 1):
        got = R.linked_passages(documents(spark, rows), min_words=20, seed=5, hot=hot, sample=1)
        assert {(3, 0, 30, 4, 0), (4, 0, 30, 3, 0)} <= matches(got.where("kind = 'match'"))
        held = got.where("kind = 'member'").select("doc_id", "start_word", "end_word", "first_doc_id", "first_start").collect()
        assert {tuple(x) for x in held} == {(1, 0, 25, 1, 0), (2, 0, 20, 1, 5), (2, 1, 25, 2, 1), (3, 0, 25, 1, 0), (3, 6, 30, 2, 1), (4, 0, 25, 1, 0), (4, 6, 30, 2, 1)}
