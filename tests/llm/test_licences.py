import random

from fixtures import awkward, documents, words

from graphloom.llm import licences as L


def test_against_brute_force(spark):
    g = random.Random(8)
    sentences = [s for r in L.RULES for s in r[2]]
    rows = []
    for i in range(80):
        parts = []
        for _ in range(g.randint(0, 12)):
            x = g.random()
            if x < 0.4:
                parts.append(words(g, g.randint(1, 15)).capitalize() + ".")
            elif x < 0.7:
                parts.append(g.choice(sentences))
            else:
                whole = list(g.choice(L.RULES)[2])
                if g.random() < 0.3:
                    whole.reverse()
                parts += whole
        text = g.choice([" ", "\n"]).join(parts)
        rows.append((i, g.choice([text, text.upper(), text.replace(" ", "\n", 5), "# " + text.replace(", ", ",\n# ")])))
    got = {(r.doc_id, r.rule, r.start_word, r.end_word) for r in L.licence_matches(documents(spark, rows, "clash")).collect()}
    want = {(d, *m) for d, t in rows for m in L.brute_matches(t)}
    assert got == want and len({m[1] for m in want}) > 12


def test_order_matters(spark):
    parts = next(r[2] for r in L.RULES if r[0] == "gpl-3-header")
    rows = [(1, " ".join(parts)), (2, " ".join(reversed(parts))), (3, parts[0]), (4, (" filler" * 20 + ". ").join(parts))]
    got = [(r.doc_id, r.rule) for r in L.licence_matches(documents(spark, rows)).collect()]
    assert got == [(1, "gpl-3-header")]


def test_awkward(spark):
    rows = awkward() + [(50, "Released under the MIT License."), (50, "Released under the MIT License."), (None, "Released under the MIT License.")]
    got = L.licence_matches(documents(spark, rows)).collect()
    assert [tuple(r) for r in got] == [(50, "mit-notice-released", "MIT", 0, 5)]
    assert L.licence_matches(documents(spark, [])).collect() == []


def test_gap_is_a_parameter(spark):
    parts = next(r[2] for r in L.RULES if r[0] == "gpl-3-header")
    docs = documents(spark, [(4, (" filler" * 20 + ". ").join(parts)), (5, "".join(f"{s} {'between ' * 60}. " for s in next(r[2] for r in L.RULES if r[0] == "apache-2-text")))])
    assert {(r.doc_id, r.rule) for r in L.licence_matches(docs).collect()} == {(5, "apache-2-text")}
    assert {(r.doc_id, r.rule) for r in L.licence_matches(docs, gap=25).collect()} == {(4, "gpl-3-header"), (5, "apache-2-text")}


def test_many_repeats_of_one_sentence():
    import time

    known = L.Rules()
    seq = known.sequences[[n for n, _ in known.names].index("gpl-3-header")]
    found = [(i * 100, i * 100 + 40, seq[0]) for i in range(20_000)] + [(i * 100 + 45, i * 100 + 70, seq[1]) for i in range(20_000)]
    began = time.perf_counter()
    assert known.match(sorted(found)) == []
    assert time.perf_counter() - began < 5
