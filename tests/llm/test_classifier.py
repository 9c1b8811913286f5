import random

import numpy as np
import pyarrow as pa
from fixtures import awkward, documents, words

from graphloom.llm import classifier as C

LABELS = "doc_id long, quality int, toxic int"


def corpus(n=700, seed=11):
    g = random.Random(seed)
    common = [words(g, 1) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        text = g.choices(common, k=g.randint(20, 120))
        toxic, junk = g.random() < 0.25, g.random() < 0.25
        if toxic:
            text += g.choices(["vileword", "nastything"], k=4)
        g.shuffle(text)
        body = "\n".join([" ".join(text)] if not junk else [" ".join(text[:5])] * 12)
        docs.append((i, body, "s", "en"))
        labels.append((i, int(not junk), int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_keeps(spark):
    docs, labels = corpus()
    got = C.classified(documents(spark, docs, "clash"), spark.createDataFrame(labels[:500], LABELS)).toPandas().set_index("doc_id")
    test = labels[500:]
    truth = np.array([q == 1 and t == 0 for _, q, t in test])
    kept = got.loc[[d for d, _, _ in test]].keep.to_numpy()
    assert kept[truth].mean() > 0.95 and kept[~truth].mean() < 0.15


def test_sum_of_squares_identity():
    g = np.random.default_rng(1)
    m = C.Machine(rank=3, n=20)
    m.w[:] = g.normal(size=20)
    m.v[:] = g.normal(size=(20, 3))
    index, value = np.array([0, 3, 7, 2, 9]), np.array([1.0, 2.0, -1.0, 0.5, 3.0])
    cut = np.array([0, 3, 5])
    got = m.raw(cut, index, value)
    for k in range(2):
        i, x = index[cut[k] : cut[k + 1]], value[cut[k] : cut[k + 1]]
        pairs = sum(m.v[i[a]] @ m.v[i[b]] * x[a] * x[b] for a in range(len(i)) for b in range(a + 1, len(i)))
        assert abs(got[k] - (m.w0 + m.w[i] @ x + pairs)) < 1e-4


def test_interactions_are_learned():
    g = np.random.default_rng(2)
    rows, y = [], []
    for _ in range(1500):
        a, b = g.integers(0, 2, 2)
        rows.append((np.array([a, 2 + b, C._WORDS + 8], np.int32), np.ones(3, np.float32)))
        y.append(float(a == b))
    m = C.Machine().fit(rows, np.array(y), epochs=60)
    assert ((C.scores_of(m, rows) > 0) == np.array(y)).mean() > 0.95  # no linear model exceeds 0.75


def test_features_by_hand():
    text = "Abc abc 12\nabc!\nabc!"
    (_, _, cut, index, value), = C.features(pa.array([text, None, ""]), [pa.array(["en", None, ""])])
    assert cut.tolist()[0] == 0 and len(cut) == 4
    at = cut[1] - len(C._STRUCTURE) - 1
    dense = value[at : at + len(C._STRUCTURE)]
    assert index[at] == C._WORDS and abs(dense[0] - np.log1p(len(text)) / 10) < 1e-6
    assert abs(dense[6] - (1 - 2 / 5)) < 1e-6 and abs(dense[7] - 1 / 3) < 1e-6 and dense[8] == 1


def test_awkward_and_empty(spark):
    docs, labels = corpus(120)
    rows = docs + [(1000 + (d or 0) if d is not None else None, t, None, None) for d, t in awkward()]
    table = spark.createDataFrame(labels + [(5, None, None), (None, 1, 0), (77777, 1, 1), (6, 7, 7)], LABELS)
    got = C.classified(documents(spark, rows), table).toPandas()
    assert len(got) == len(rows) - 1 and got.quality.between(0, 1).all() and (got[got.doc_id == 1006].quality.nunique() == 1)
    none = spark.createDataFrame([], LABELS)
    assert all(r.keep for r in C.classified(documents(spark, awkward()), none).collect())
    assert C.classified(documents(spark, []), table).collect() == []
