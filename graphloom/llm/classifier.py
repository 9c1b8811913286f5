"""Quality classifier: a factorisation machine over hashed words, structure and metadata."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .shared import sent

#: Buckets of hashed words; after them come the structure and metadata features.
WORD_BITS = 17
META_BUCKETS = 512
#: Bytes of a word's stem, and the factor of a word's share of the text under the logarithm.
STEM = 6
DENSE = 200
RANK = 6
#: Bound on labelled rows for fitting; those with the least hash of doc_id are taken.
MAX_LABELLED = 6000
EPOCHS = 12
BATCH = 64
#: Share of the sample held out to choose the decision threshold.
HELD_OUT = 0.25
#: Losing a clean document counts so many times as much as passing a bad one.
CLEAN_COST = 3.0
#: Words of a bucket that fewer sampled documents hold have no weight.
MIN_DOCS = 8
_STRUCTURE = ("length", "word length", "digits", "marks", "capitals", "line length", "repeated words", "repeated lines", "bias")
_WORDS = 1 << WORD_BITS
N_FEATURES = _WORDS + len(_STRUCTURE) + META_BUCKETS


def features(texts: pa.Array, meta: list[pa.Array]):
    """Pieces (lo, hi, cut, index, value): sparse features, those of row i at cut[i]:cut[i+1].

    Words and the first bytes of longer words count by the logarithm of how dense
    they are among the words of the text, so that length alone changes little.
    """
    table, wide = K.fold_table("alnum"), K.fold_table("ws")
    data, offs = K.buffer(texts)
    digit, capital = np.zeros(256, np.int64), np.zeros(256, np.int64)
    digit[48:58] = 1
    capital[65:91] = 1
    mark = ((table == 0) & (wide != 0)).astype(np.int64)
    for lo, hi in K.pieces(offs):
        own, part = data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        n = hi - lo
        row, s, e, h = K.words(own, part, table)
        total = np.bincount(row, minlength=n)
        stem = np.flatnonzero(e - s > STEM)
        stems = K.span_hash(table[own], s[stem], s[stem] + STEM) * np.uint64(K._Q) if len(stem) else h[:0]
        bucket = (np.r_[h, stems] >> np.uint64(64 - WORD_BITS)).astype(np.int64)
        pair, tf = np.unique(np.r_[row, row[stem]] * _WORDS + bucket, return_counts=True)
        r, b = pair // _WORDS, pair % _WORDS
        distinct = np.bincount(r, minlength=n)
        size = np.maximum(np.diff(part), 1)

        def per_row(x):
            c = np.r_[0, np.cumsum(x)]
            return c[part[1:]] - c[part[:-1]]

        ends = np.flatnonzero(own == 10)
        line_row = np.searchsorted(part, ends, "right") - 1
        lines = np.bincount(line_row, minlength=n) + 1
        starts = np.r_[part[:-1], ends + 1]
        stops = np.r_[np.zeros(n, np.int64), np.zeros(len(ends), np.int64)]
        who = np.r_[np.arange(n), line_row]
        o = np.lexsort((starts, who))
        starts, who = starts[o], who[o]
        stops = np.r_[starts[1:] - 1, len(own)]
        last = np.r_[who[1:] != who[:-1], True] if len(who) else np.zeros(0, bool)
        stops[last] = part[who[last] + 1]
        full = stops > starts
        keys = K.span_hash(own, starts[full], stops[full], K._random_table(14, 256)) if full.any() else np.zeros(0, np.uint64)
        k = np.lexsort((keys, who[full]))
        same = (np.diff(who[full][k]) == 0) & (keys[k][1:] == keys[k][:-1]) if len(k) else np.zeros(0, bool)
        again = np.bincount(who[full][k][1:][same], minlength=n) if len(k) else np.zeros(n)
        letters = np.maximum(per_row(table[own] != 0), 1)
        dense = np.stack(
            [
                np.log1p(size) / 10,
                letters / np.maximum(total, 1) / 10,
                per_row(digit[own]) / size * 5,
                per_row(mark[own]) / size * 5,
                per_row(capital[own]) / size * 5,
                np.log1p(size / lines) / 8,
                1 - distinct / np.maximum(total + np.bincount(row[stem], minlength=n), 1),
                again / lines,
                np.ones(n),
            ],
            1,
        )
        tags = [np.arange(n) * 0 + _meta(m.slice(lo, n), i) for i, m in enumerate(meta)]
        d = dense.shape[1] + len(tags)
        count = distinct + d
        cut = np.r_[0, np.cumsum(count)]
        index, value = np.empty(cut[-1], np.int32), np.empty(cut[-1], np.float32)
        place = np.arange(len(r)) - np.repeat(np.r_[0, np.cumsum(distinct)][:-1], distinct) + cut[r]
        index[place], value[place] = b, np.log1p(DENSE * tf / total[r]) / 3
        tail = cut[1:, None] - d + np.arange(d)
        index[tail] = np.concatenate([np.tile(_WORDS + np.arange(dense.shape[1]), (n, 1)), *(t[:, None] for t in tags)], 1)
        value[tail] = np.concatenate([dense, np.full((n, len(tags)), 0.3)], 1)
        yield lo, hi, cut, index, value


def _meta(column: pa.Array, which: int) -> np.ndarray:
    values = column.to_pylist()
    codes = {v: K._P * (hash_text(f"{which}:{v}")) % (1 << 64) % META_BUCKETS for v in set(values)}
    return np.array([_WORDS + len(_STRUCTURE) + codes[v] for v in values], np.int64)


def hash_text(x: str) -> int:
    import zlib

    return zlib.crc32(x.encode())


class Machine:
    """y = w0 + sum w x + half the sum over ranks of (sum v x)^2 - sum v^2 x^2."""

    def __init__(self, rank: int = RANK, seed: int = 3, n: int = N_FEATURES):
        g = np.random.default_rng(seed)
        self.w0 = 0.0
        self.w = np.zeros(n, np.float32)
        self.v = (g.normal(0, 0.02, (n, rank))).astype(np.float32)
        self.used = np.ones(n, bool)
        self.cutoff = 0.0

    def raw(self, cut, index, value) -> np.ndarray:
        """Scores of rows in time linear in their features."""
        if len(cut) < 2:
            return np.zeros(0)
        vx = self.v[index] * value[:, None]
        s = np.add.reduceat(vx, cut[:-1])
        q = np.add.reduceat(vx * vx, cut[:-1])
        return self.w0 + np.add.reduceat(self.w[index] * value, cut[:-1]) + 0.5 * (s * s - q).sum(1)

    def fit(self, rows, y, epochs: int = EPOCHS, rate: float = 0.08, decay: float = 1e-3, seed: int = 5):
        """Adaptive-gradient descent on the logistic loss; classes weigh alike."""
        g = np.random.default_rng(seed)
        n = len(y)
        docs = np.bincount(np.concatenate([i for i, _ in rows]), minlength=len(self.w)) if n else np.zeros(len(self.w))
        self.used = docs >= MIN_DOCS
        self.used[_WORDS:] = True
        self.v[~self.used] = 0
        good = max(1, int(y.sum()))
        weight = np.where(y == 1, n / (2 * good), n / (2 * max(1, n - good)))
        gw, gv, g0 = np.full(len(self.w), 1e-3, np.float32), np.full(self.v.shape, 1e-3, np.float32), 1e-3
        for _ in range(epochs):
            order = g.permutation(n)
            for a in range(0, n, BATCH):
                some = order[a : a + BATCH]
                index = np.concatenate([rows[i][0] for i in some])
                value = np.concatenate([rows[i][1] for i in some])
                size = np.array([len(rows[i][0]) for i in some])
                on = self.used[index]
                cut = np.r_[0, np.cumsum(size)]
                value = np.where(on, value, 0)
                vx = self.v[index] * value[:, None]
                s = np.add.reduceat(vx, cut[:-1])
                z = self.w0 + np.add.reduceat(self.w[index] * value, cut[:-1]) + 0.5 * (s * s - np.add.reduceat(vx * vx, cut[:-1])).sum(1)
                e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[some]) * weight[some] / len(some)
                who = np.repeat(np.arange(len(some)), size)
                ex = (e[who] * value).astype(np.float32)
                uniq, back = np.unique(index, return_inverse=True)
                dw = np.bincount(back, ex, len(uniq)).astype(np.float32) + decay * self.w[uniq]
                full = ex[:, None] * (s[who] - vx)
                dv = np.stack([np.bincount(back, full[:, f], len(uniq)) for f in range(full.shape[1])], 1).astype(np.float32) + decay * self.v[uniq]
                gw[uniq] += dw * dw
                gv[uniq] += dv * dv
                self.w[uniq] -= rate * dw / np.sqrt(gw[uniq])
                self.v[uniq] -= rate / 3 * dv / np.sqrt(gv[uniq])
                d0 = float(e.sum())
                g0 += d0 * d0
                self.w0 -= rate * d0 / math.sqrt(g0)
        self.w[~self.used] = 0
        self.v[~self.used] = 0
        return self


def best_cutoff(score: np.ndarray, y: np.ndarray, clean: int) -> float:
    """Score with the least cost on either side, classes weighed alike but for ``CLEAN_COST``; the middle of its gap."""
    if not len(y) or y.min() == y.max():
        return 0.0
    o = np.argsort(score, kind="stable")
    s, t = score[o], y[o]
    zero, one = (CLEAN_COST, 1.0) if clean == 0 else (1.0, CLEAN_COST)
    below = zero * np.r_[0, np.cumsum(t == 0)] / (t == 0).sum() + one * (1 - np.r_[0, np.cumsum(t == 1)] / t.sum())
    ok = np.r_[True, s[1:] > s[:-1], True]
    below[~ok] = -1
    k = int(below.argmax())
    return float(s[0] - 1 if k == 0 else s[-1] + 1 if k == len(s) else (s[k - 1] + s[k]) / 2)


def _pack(docs: DataFrame, meta) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(m).cast("string").alias(f"meta{i}") for i, m in enumerate(meta)]).where("doc_id is not null")


def sample(docs: DataFrame, labels: DataFrame, target: str, meta, limit: int):
    """(rows of features, labels) of a bounded sample of labelled documents, least hash of doc_id first."""
    texts = _pack(docs, meta)
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    marks = marks.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)

    def pack(batches):
        for batch in batches:
            k = batch.num_columns - 1
            for lo, hi, cut, index, value in features(batch.column(1), [batch.column(i) for i in range(2, k)]):
                at = range(hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(k).slice(lo, hi - lo), pa.array([index[cut[i] : cut[i + 1]].tobytes() for i in at], pa.binary()), pa.array([value[cut[i] : cut[i + 1]].tobytes() for i in at], pa.binary())],
                    ["doc_id", "y", "index", "value"],
                )

    got = texts.join(marks, "doc_id").mapInArrow(pack, "doc_id long, y int, index binary, value binary").toPandas().sort_values(["doc_id", "index"], kind="stable").drop_duplicates("doc_id")
    rows = [(np.frombuffer(i, np.int32), np.frombuffer(v, np.float32)) for i, v in zip(got["index"], got["value"])]
    return rows, got["y"].to_numpy(float)


def train(docs: DataFrame, labels: DataFrame, target: str, meta=("lang", "source"), limit: int = MAX_LABELLED) -> Machine:
    """Fit one head on at most ``limit`` labelled documents; a quarter of them sets the cutoff.

    Without both classes among the labels the cutoff accepts the one that is there.
    """
    rows, y = sample(docs, labels, target, meta, limit)
    return fit(rows, y, int(target == "quality"))


def fit(rows, y, clean: int) -> Machine:
    n = len(y)
    machine = Machine()
    if not n or y.min() == y.max():
        machine.v[:] = 0
        machine.cutoff = -1.0 if n and y[0] == 1 else 1.0
        return machine
    held = np.random.default_rng(9).random(n) < HELD_OUT
    machine.fit([r for r, h in zip(rows, held) if not h], y[~held])
    out = scores_of(machine, [r for r, h in zip(rows, held) if h])
    machine.cutoff = best_cutoff(out, y[held], clean)
    return machine


def scores_of(machine: Machine, rows) -> np.ndarray:
    if not rows:
        return np.zeros(0)
    cut = np.r_[0, np.cumsum([len(i) for i, _ in rows])]
    return machine.raw(cut, np.concatenate([i for i, _ in rows]), np.concatenate([v for _, v in rows]))


def classified(docs: DataFrame, labels: DataFrame, meta=("lang", "source"), limit: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, quality, toxicity, keep): one row for each row of ``docs`` (doc_id, text, meta columns, ...).

    quality and toxicity are probabilities of two factorisation machines fitted on
    ``labels`` (doc_id, quality, toxic), shifted so that 0.5 is the cutoff of least cost
    on held-out labels (:func:`best_cutoff`); keep is quality >= 0.5 > toxicity.

    Rows with a null doc_id are left out.  Null and empty texts have only structure
    and metadata; a null in metadata is a value of its own.  Labels that are null,
    not 0 or 1, or without a document are ignored; of repeated labels the greatest
    holds.  Without labels every document passes.  Repeated rows each return; long
    texts are scored whole; a score at 0.5 passes as quality and fails as toxic.  An
    empty table gives an empty result; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    heads = [train(docs, labels, t, meta, limit) for t in ("quality", "toxic")]
    if not heads[0].w.any() and heads[0].cutoff > 0:
        heads[0].cutoff = -1.0
    held = sent(spark, heads)

    def score(batches):
        good, bad = held()
        for batch in batches:
            for lo, hi, cut, index, value in features(batch.column(1), [batch.column(i) for i in range(2, batch.num_columns)]):
                q = _probability(good.raw(cut, index, value) - good.cutoff)
                t = _probability(bad.raw(cut, index, value) - bad.cutoff)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(q), pa.array(t), pa.array((q >= 0.5) & (t < 0.5))], ["doc_id", "quality", "toxicity", "keep"])

    return _pack(docs, meta).mapInArrow(score, "doc_id long, quality double, toxicity double, keep boolean")


def _probability(z: np.ndarray) -> np.ndarray:
    return np.round(1 / (1 + np.exp(-np.clip(z, -30, 30))), 6).astype(float)
