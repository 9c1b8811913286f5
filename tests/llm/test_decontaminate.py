import random

import pytest
from fixtures import awkward, documents, words

from graphloom.llm import decontaminate as D

ITEMS = "item_id long, text string"


@pytest.mark.parametrize("max_sent", [10**6, 0])
def test_against_brute_force(spark, max_sent):
    g = random.Random(5)
    items = [(i, words(g, g.randint(1, 30))) for i in range(25)] + [(None, "some text that is never used here"), (30, None), (31, ""), (3, words(g, 12))]
    rows = []
    for i in range(60):
        text = words(g, g.randint(0, 200)).split()
        if g.random() < 0.7:
            part = g.choice(items[:25])[1].split()
            for _ in range(g.randint(0, 3)):
                part[g.randrange(len(part))] = "changed"
            at = g.randint(0, len(text))
            text[at:at] = [w.upper() + "," for w in part]
        rows.append((i, " ".join(text)))
    got = {(r.doc_id, r.item_id): round(r.containment, 9) for r in D.contaminated(documents(spark, rows, "clash"), spark.createDataFrame(items, ITEMS), max_sent=max_sent).collect()}
    want = {}
    for d, t in rows:
        for i, x in items:
            c = D.expected_containment(x or "", t) if i is not None else 0
            if c:
                want[d, i] = max(want.get((d, i), 0), round(c, 9))
    assert got == want and len(want) > 20


def test_awkward_and_empty(spark):
    items = spark.createDataFrame([(1, "null id text here now"), (2, "é😀 ünï")], ITEMS)
    assert [(r.doc_id, r.item_id) for r in D.contaminated(documents(spark, awkward()), items).collect()] == [(8, 2)]
    left = D.without_contaminated(documents(spark, awkward(), "clash"), items)
    assert left.count() == len(awkward()) - 1 and left.where("doc_id is null").count() == 1
    assert D.contaminated(documents(spark, []), items).collect() == []
    assert D.contaminated(documents(spark, awkward()), spark.createDataFrame([], ITEMS)).collect() == []


def test_windows_are_item_sized():
    import numpy as np

    place, code = np.array([0, 1, 2, 10, 11]), np.array([5, 6, 5, 7, 8])
    assert D.best_window(place, code, np.array([10]), 3, 2) == 2
    assert D.best_window(place, code, np.array([0]), 12, 4) == 4
    assert D.best_window(place, code, np.array([0]), 3, 3) == 0


def test_short_items_can_be_left_out(spark):
    items = spark.createDataFrame([(1, "paris"), (2, "one two three four five six seven")], ITEMS)
    docs = documents(spark, [(1, "in Paris"), (2, "one two three four five six seven in paris")])
    assert {(r.doc_id, r.item_id) for r in D.contaminated(docs, items).collect()} == {(1, 1), (2, 1), (2, 2)}
    assert {(r.doc_id, r.item_id) for r in D.contaminated(docs, items, min_words=3).collect()} == {(2, 2)}
