"""Mixing sources to target weights: entropy balancing of token constraints."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from . import tokenizers as tok
from .shared import sent, written

#: Columns whose values get target shares of the tokens.
DIMENSIONS = ("source", "lang")
#: Default targets are the token shares to this power, normalised.
TEMPERATURE = 0.5
#: Strength of the pull towards rate 1, as a share of all tokens: it settles targets that contradict each other.
RIDGE = 1e-9
TOLERANCE = 1e-7
MAX_STEPS = 60
SEED = 17
#: Bytes of copies that leave a worker at once.
ROOM = 64 << 20


def count_words(texts: pa.Array) -> np.ndarray:
    """White-space separated words of every text; null has none."""
    data, offs = K.buffer(texts)
    out = np.zeros(len(offs) - 1, np.int64)
    ws = K.fold_table("ws") == 0
    for lo, hi in K.pieces(offs):
        w = ~ws[data[offs[lo] : offs[hi]]]
        part = offs[lo : hi + 1] - offs[lo]
        begin = w.copy()
        begin[1:] &= ~w[:-1]
        heads = part[:-1][part[:-1] < len(w)]
        begin[heads] = w[heads]
        total = np.r_[0, np.cumsum(begin)]
        out[lo:hi] = total[part[1:]] - total[part[:-1]]
    return out


def count_bpe(texts: pa.Array, tokenizer: str, folder: str) -> np.ndarray:
    data, offs = K.buffer(texts)
    enc = tok.chunks(tokenizer, folder)
    parts = [enc.counts(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]) for lo, hi in K.pieces(offs)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


class Balance:
    """The solved dual: a multiplier for each value of each dimension, and one for length."""

    def __init__(self, tables, slope, centre, steps, residual):
        self.tables, self.slope, self.centre, self.steps, self.residual = tables, slope, centre, steps, residual

    def rates(self, values, tokens: np.ndarray) -> np.ndarray:
        """Rate of each document; ``values`` has a list of values for each dimension."""
        x = self.slope * (np.log1p(tokens) - self.centre)
        for table, column in zip(self.tables, values):
            x = x + np.array([table.get(v, 0.0) for v in column], float)
        return np.exp(np.clip(x, -50, 50))


def _shares(values, mass, wanted, temperature):
    have = np.array([mass[v] for v in values], float)
    share = have**temperature if wanted is None else np.array([max(0.0, float(wanted.get(v, 0.0))) for v in values])
    if share.sum() <= 0:
        share = have
    # entropy balancing keeps every rate above zero; a target of zero is approached, not met
    return np.maximum(share / share.sum(), 1e-9)


def solve(cells: DataFrame, dims: list[str], targets: dict | None = None, temperature: float = TEMPERATURE, budget: float = 1.0, keep_length: bool = True) -> Balance:
    """Newton's method on the convex dual, over ``cells`` (dims..., tokens, docs).

    Minimise sum of tokens x rate x (log rate - 1) under: the tokens of each value
    equal its target share of ``budget`` times all tokens, and (``keep_length``) the
    token-weighted mean of log length stays as it is.  The optimum is a rate of
    exp(multipliers of the document's values + slope x (log length - mean)).

    Only the slope enters a distributed sum: for each cell of values the workers
    return the tilted token mass and its first two moments, so the driver holds a
    few numbers for each combination of values that occurs, never documents, and a
    step costs one aggregation.
    """
    log_len = F.log1p(F.col("tokens").cast("double"))
    mass = F.col("tokens").cast("double") * F.col("docs")
    whole = cells.agg(F.sum(mass).alias("t"), F.sum(mass * log_len).alias("z")).first()
    total = whole.t or 0.0
    if total <= 0:
        return Balance([{} for _ in dims], 0.0, 0.0, 0, 0.0)
    centre = whole.z / total

    def moments(slope):
        z = log_len - F.lit(centre)
        w = mass * F.exp(z * F.lit(float(slope)))
        rows = cells.where("tokens > 0").groupBy(*[F.col(d) for d in dims]).agg(F.sum(w).alias("m0"), F.sum(w * z).alias("m1"), F.sum(w * z * z).alias("m2")).collect()
        return {tuple(r[i] for i in range(len(dims))): (r["m0"] / total, r["m1"] / total, r["m2"] / total) for r in rows}

    now = moments(0.0)
    keys = sorted(now, key=repr)
    values = [sorted({k[i] for k in keys}, key=repr) for i in range(len(dims))]
    place = [{v: j for j, v in enumerate(vs)} for vs in values]
    offset = np.r_[0, np.cumsum([len(v) for v in values])].astype(int)
    size = int(offset[-1]) + 1  # the last one is the slope
    want = np.zeros(size)
    for i, d in enumerate(dims):
        own = {v: sum(now[k][0] for k in keys if k[i] == v) for v in values[i]}
        want[offset[i] : offset[i + 1]] = budget * _shares(values[i], own, (targets or {}).get(d), temperature)
    spots = np.array([[offset[i] + place[i][k[i]] for i in range(len(dims))] for k in keys], int).reshape(len(keys), len(dims))

    def sums(lam, got):
        """Value, gradient and tilted moments of each cell."""
        m = np.array([got[k] for k in keys])
        e = np.exp(np.clip(lam[spots].sum(1), -50, 50))[:, None] * m
        grad = np.zeros(size)
        for j in range(len(dims)):
            grad += np.bincount(spots[:, j], e[:, 0], size)
        if keep_length:
            grad[-1] = e[:, 1].sum()
        else:
            e[:, 1:] = 0.0
        value = e[:, 0].sum() - lam @ want + RIDGE / 2 * lam @ lam
        return value, grad - want + RIDGE * lam, e

    def times(e, x):
        """The second derivatives times a vector, from the cells; no matrix is made."""
        along = x[spots].sum(1)
        pull = e[:, 0] * along + e[:, 1] * x[-1]
        out = RIDGE * x
        for j in range(len(dims)):
            out += np.bincount(spots[:, j], pull, size)
        out[-1] += e[:, 1] @ along + e[:, 2].sum() * x[-1]
        return out

    def newton(grad, e):
        """Step of Newton's method by conjugate gradients."""
        diagonal = np.full(size, RIDGE)
        for j in range(len(dims)):
            diagonal += np.bincount(spots[:, j], e[:, 0], size)
        diagonal[-1] += e[:, 2].sum()
        x, r = np.zeros(size), -grad
        z = r / diagonal
        p, rz = z, r @ z
        for _ in range(4 * size + 50):
            if np.abs(r).max() <= 1e-3 * TOLERANCE or rz <= 0:
                break
            q = times(e, p)
            step = rz / (p @ q)
            x, r = x + step * p, r - step * q
            z = r / diagonal
            rz, old = r @ z, rz
            p = z + rz / old * p
        return x

    lam = np.zeros(size)
    value, grad, cell = sums(lam, now)
    steps = 0
    while steps < MAX_STEPS and np.abs(grad).max() > TOLERANCE:
        move = newton(grad, cell)
        # no rate changes by more than this at once; multipliers may, where those of one document cancel out
        move *= min(1.0, 3.0 / max(np.abs(move[spots].sum(1)).max(), abs(move[-1]), 1e-300))
        scale = 1.0
        while True:
            trial = lam + scale * move
            got = moments(trial[-1]) if trial[-1] != lam[-1] else now
            v, g, h = sums(trial, got)
            if v <= value + 1e-4 * scale * (grad @ move) or scale < 1e-6:
                break
            scale /= 2
        steps += 1
        if scale < 1e-6 or value - v <= 1e-15 * max(1.0, abs(value)):
            lam, now, value, grad, cell = (trial, got, v, g, h) if v <= value else (lam, now, value, grad, cell)
            break
        lam, now, value, grad, cell = trial, got, v, g, h
    tables = [{v: float(lam[offset[i] + place[i][v]]) for v in values[i]} for i in range(len(dims))]
    return Balance(tables, float(lam[-1]), centre, steps, float(np.abs(grad).max()))


def _counted(texts, batch_tokens, measure, tokenizer, folder):
    if measure == "words":
        return count_words(texts)
    if measure == "bpe":
        return count_bpe(texts, tokenizer, folder)
    return np.maximum(np.nan_to_num(batch_tokens.to_numpy(zero_copy_only=False).astype(float)), 0).astype(np.int64)


def _sizes(texts: pa.Array) -> np.ndarray:
    return np.diff(K.buffer(texts.cast(pa.string()))[1])


def _unit(ids: pa.Array, seed: int) -> np.ndarray:
    """A number in [0, 1) that depends on the identifier (0 for null) and the seed."""
    x = np.asarray(ids.fill_null(0).to_numpy(zero_copy_only=False), np.int64).view(np.uint64)
    return (K.mix(K.mix(x * np.uint64(K._P) + np.uint64(seed)) + np.uint64(K._Q)) >> np.uint64(11)).astype(float) / float(1 << 53)


def _rounded(rate: np.ndarray, unit: np.ndarray) -> np.ndarray:
    low = np.floor(rate)
    return (low + (unit < rate - low)).astype(np.int64)


def _plan(docs, dimensions, targets, temperature, budget, measure, tokenizer, folder, seed):
    """(input columns, function from an Arrow batch of them to (tokens, rates, copies))."""
    spark = docs.sparkSession
    dims = list(dimensions)
    extra = [] if measure in ("words", "bpe") else [measure]
    base = docs.select(F.col("doc_id").cast("long").alias("m0"), F.col("text").cast("string").alias("m1"), *[F.col(d).cast("string").alias(f"d{i}") for i, d in enumerate(dims)], *[F.col(e).cast("double").alias("m2") for e in extra])
    names = [f"d{i}" for i in range(len(dims))]

    def tally(batches):
        """Counts by values and length, summed within the task before anything is sent."""
        for batch in batches:
            t = _counted(batch.column(1), batch.column(batch.num_columns - 1), measure, tokenizer, folder)
            table = pa.Table.from_arrays([*[batch.column(2 + i) for i in range(len(dims))], pa.array(t), pa.array(np.ones(len(t), np.int64))], [*names, "tokens", "docs"])
            got = table.group_by([*names, "tokens"]).aggregate([("docs", "sum")]).select([*names, "tokens", "docs_sum"]).rename_columns([*names, "tokens", "docs"])
            yield from got.to_batches()

    schema = ", ".join(f"{n} string" for n in names) + ", tokens long, docs long"
    cells = written(base.mapInArrow(tally, schema).groupBy(*names, "tokens").agg(F.sum("docs").alias("docs")), "cells")
    wanted = {f"d{i}": (targets or {}).get(d) for i, d in enumerate(dims)}
    balance = solve(cells, names, wanted, temperature, budget)
    held = sent(spark, balance)

    def rate(batch, at):
        t = _counted(batch.column(at["text"]).cast(pa.string()), batch.column(at["tokens"]), measure, tokenizer, folder)
        r = held().rates([batch.column(k).cast(pa.string()).to_pylist() for k in at["dims"]], t)
        r[t == 0] = 1.0
        return t, r, _rounded(r, _unit(batch.column(at["id"]).cast(pa.int64()), seed))

    return base, rate, balance


def mixture(docs: DataFrame, dimensions=DIMENSIONS, targets: dict | None = None, temperature: float = TEMPERATURE, budget: float = 1.0, measure: str = "words", tokenizer: str = tok.DEFAULT, folder: str = tok.TOKENIZER_DIR, seed: int = SEED) -> DataFrame:
    """(doc_id, dimensions..., n_tokens, rate, copies) of every row of ``docs`` (doc_id, text, ...).

    ``targets`` maps a dimension to {value: share of the tokens}; a dimension
    without targets gets the shares of its values to the power ``temperature``.
    Rates meet them (see :func:`solve`) and keep ``budget`` times all tokens.  copies
    is the rate rounded down, or up with the probability of the remainder, drawn
    from a hash of doc_id and ``seed``, so that a repeated run gives the same.
    ``measure`` counts tokens: "words" (runs without ASCII white space), "bpe"
    (the named tokenizer) or the name of a column that has them.

    Nulls in a dimension are a value of their own (key None in ``targets``); a null
    doc_id draws as 0.  Null, empty and blank texts have no tokens, weigh nothing and
    stay once.  Repeated rows each count and draw alike.  A value without a target
    is brought near zero; a target without documents is left out and the others are
    scaled to one.  Targets that contradict each other are met as nearly as
    possible.  Long texts count whole; a remainder equal to its draw is rounded down.
    An empty table gives an empty result; other columns are ignored, whatever their names.
    """
    base, rate, _ = _plan(docs, dimensions, targets, temperature, budget, measure, tokenizer, folder, seed)
    dims = list(dimensions)
    at = {"id": 0, "text": 1, "dims": [2 + i for i in range(len(dims))], "tokens": len(base.columns) - 1}
    names = ["doc_id", *[f"d{i}" for i in range(len(dims))], "n_tokens", "rate", "copies"]

    def apply(batches):
        for batch in batches:
            t, r, c = rate(batch, at)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[batch.column(i) for i in at["dims"]], pa.array(t), pa.array(r), pa.array(c)], names)

    out = base.mapInArrow(apply, "doc_id long, " + ", ".join(f"d{i} string" for i in range(len(dims))) + ", n_tokens long, rate double, copies long")
    return out.select("doc_id", *[F.col(f"d{i}").alias(d) for i, d in enumerate(dims)], "n_tokens", "rate", "copies")


def mixed(docs: DataFrame, dimensions=DIMENSIONS, targets: dict | None = None, temperature: float = TEMPERATURE, budget: float = 1.0, measure: str = "words", tokenizer: str = tok.DEFAULT, folder: str = tok.TOKENIZER_DIR, seed: int = SEED) -> DataFrame:
    """``docs`` with every row as often as :func:`mixture` says; all columns, no shuffle of texts."""
    _, rate, _ = _plan(docs, dimensions, targets, temperature, budget, measure, tokenizer, folder, seed)
    names = docs.columns
    place = {n: i for i, n in enumerate(names)}
    at = {"id": place["doc_id"], "text": place["text"], "dims": [place[d] for d in dimensions], "tokens": place.get(measure, 0)}

    def repeat(batches):
        for batch in batches:
            _, _, c = rate(batch, at)
            take = np.repeat(np.arange(batch.num_rows), c)
            # copies of long rows leave in batches of bounded size
            room = np.cumsum(batch.nbytes // max(batch.num_rows, 1) + _sizes(batch.column(at["text"]))[take])
            while len(take):
                n = max(1, min(4096, int(np.searchsorted(room, ROOM, "right"))))
                some = pa.array(take[:n])
                yield pa.RecordBatch.from_arrays([x.take(some) for x in batch.columns], names)
                take, room = take[n:], room[n:] - room[n - 1]

    return docs.mapInArrow(repeat, docs.schema)
