import os
import random

import numpy as np
import pytest
from fixtures import awkward, documents, words

from graphloom.llm import token_bin as B
from graphloom.llm import token_counts as C
from graphloom.llm import tokenizers as T

TEXTS = ["Hello  world\n\n  again", "it's 12 o'clock", "é ü  x 😀 y", "a\tb\nc", " lead", "trail ", "", "x" * 500, "¡!? ... a-b"]


def encode(text):
    return T.encoding().encode_ordinary(text)


def test_chunks_encode_like_the_tokenizer():
    import pyarrow as pa

    from graphloom.llm import kernels as K

    g = random.Random(4)
    texts = TEXTS + ["".join(g.choices("ab \n\t.'1é 😀", k=g.randint(0, 60))) for _ in range(400)]
    data, offs = K.buffer(pa.array(texts))
    ids, n = T.chunks().encode(data, offs)
    assert ids.tolist() == [i for t in texts for i in encode(t)]
    assert n.tolist() == [len(encode(t)) for t in texts]


def test_counts_and_cache(spark, tmp_path):
    g = random.Random(6)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + awkward() + [(100 + i, words(g, 50)) for i in range(20)]
    cache = f"file://{tmp_path}/cache"
    df = documents(spark, rows, "clash")
    first = C.token_counts(df, cache).collect()
    import pyarrow as pa

    norm = dict(zip(range(len(rows)), C.normalised(pa.array([t for _, t in rows])).to_pylist()))
    want = sorted(((d, 0 if norm[i] is None else len(encode(norm[i]))) for i, (d, _) in enumerate(rows)), key=repr)
    assert sorted(((r.doc_id, r.n_tokens) for r in first), key=repr) == want
    assert not any(r.cached for r in first)
    again = C.token_counts(documents(spark, rows + [(7777, "fresh words only here")]), cache).collect()
    assert {r.doc_id for r in again if not r.cached and r.digest is not None} == {7777}
    stored = C.stored(spark, cache, T.digest_of()).collect()
    assert len(stored) == len({t for t in norm.values() if t is not None}) + 1
    other = C.token_counts(df, cache, "byte_bpe_multi_50k.tiktoken").collect()
    assert not any(r.cached for r in other)
    assert C.token_counts(documents(spark, []), cache).collect() == []


@pytest.mark.parametrize("max_sent", [2_000_000, 0])
def test_every_way_of_leaving_out_what_is_stored(spark, tmp_path, max_sent):
    g = random.Random(8)
    rows = [(i, words(g, 20)) for i in range(30)]
    cache = f"file://{tmp_path}/cache"
    C.token_counts(documents(spark, rows[:20]), cache, max_sent=max_sent).collect()
    got = {r.doc_id: (r.n_tokens, r.cached) for r in C.token_counts(documents(spark, rows), cache, max_sent=max_sent).collect()}
    assert got == {d: (len(encode(t)), d < 20) for d, t in rows}
    assert C.stored(spark, cache, T.digest_of()).count() == 30


def test_the_query_keeps_the_cache_of_its_corpus(spark, tmp_path):
    from graphloom.llm.queries import QUERIES

    documents(spark, [(i, f"text number {i}") for i in range(5)]).write.parquet(f"{tmp_path}/documents.parquet")
    run = QUERIES["op4_token_counts"]
    assert [r.cached for r in run(spark, str(tmp_path)).collect()] == [False] * 5
    documents(spark, [(9, "one more")]).write.mode("append").parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.cached for r in run(spark, str(tmp_path)).collect()} == {**{i: True for i in range(5)}, 9: False}


@pytest.mark.parametrize("a, b", [("é", "é"), ("a\r\nb", "a\nb"), (" a ", "a")])
def test_equal_contents_share_a_digest(a, b):
    import pyarrow as pa

    one, two = C.digests(C.normalised(pa.array([a, b]))).to_pylist()
    assert one == two


def test_files_round_trip(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + awkward()
    out = str(tmp_path / "tokens")
    index = B.write_tokens(documents(spark, rows, "clash").repartition(3), out).toPandas()
    files = B.TokenFiles(out)
    assert len(files) == len(index) == len(rows)
    index = index.sort_values(["shard", "row"]).reset_index(drop=True)
    by = {}
    for d, t in rows:
        by.setdefault(d, []).append(encode(t or ""))
    for k, r in index.iterrows():
        doc = None if np.isnan(r.doc_id) else int(r.doc_id)
        assert files[k].tolist() in by[doc] and len(files[k]) == r.n_tokens
    starts = index.start.to_numpy()
    assert (starts[1:] == starts[:-1] + index.n_tokens.to_numpy()[:-1]).all() and starts[0] == 0
    assert sum(os.path.getsize(f"{out}/{n}") for n in os.listdir(out) if n.startswith("tokens")) == 2 * index.n_tokens.sum()
    assert B.write_tokens(documents(spark, []), str(tmp_path / "none")).collect() == []
    assert len(B.TokenFiles(str(tmp_path / "none"))) == 0
