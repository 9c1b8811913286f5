"""Repeated passages across documents: joined on winnowed seeds, all places tied to the first, matches extended both ways."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .shared import discard, sent, written

#: A repeat has at least this many words.
MIN_WORDS = 50
#: Words of a seed (anchor).
SEED = 10
#: Places of one seed that one task compares; the windows of a more frequent seed are joined one by one.
HOT = 500_000
#: Share of the documents (1 in so many) among which frequent seeds are looked for; it decides where seeds meet, not what is found.
HOT_SAMPLE = 64
#: Bytes of windows compared at once.
CHUNK = 32 << 20
_WIDE = 8  # bytes of a window hash
#: Anchors before and after it (places from, to) that a partner should share, the first the least.
CONTEXT = ((-2, 0), (0, 2), (-8, 0), (0, 8))
_PLACED = "anchor long, doc long, body long, c0 long, c1 long, c2 long, c3 long, at int, windows binary"
_STRETCH = "doc long, body long, a long, b long, r_doc long, r_body long, r_diag long, p_doc long, p_body long, p_diag long"
_WINDOW = "anchor long, doc long, body long, c0 long, c1 long, c2 long, c3 long, pos long, hash long"
_RUN = "doc long, body long, low long, high long, partners long, lead long, p_doc long, p_body long, p_diag long, parts binary, spans binary"
_MATCH = "doc long, body long, low long, a long, b long, p_doc long, p_body long, p_diag long"
_MEMBER = "doc long, body long, a long, b long, p_doc long, p_body long, p_diag long"


def anchored_windows(ids: np.ndarray, bodies: np.ndarray, texts: pa.Array, min_words: int, seed: int, chosen=None):
    """Record batches of :data:`_PLACED` of one batch of texts.

    Every run of ``min_words`` words belongs to the rarest-looking seed inside it:
    the one with the least hash, the rightmost among equals.  That choice depends
    on those words alone, so equal runs meet under equal anchors.  The runs of one
    anchor are consecutive; ``windows`` packs their hashes, ``at`` is the first.
    c0 to c3 hash the anchors around it.  ``chosen`` is a mask of anchors.
    """
    table = K.fold_table("ws")
    data, offs = K.buffer(texts)
    for lo, hi in K.pieces(offs):
        part = offs[lo : hi + 1]
        row, _, _, h = K.words(data[part[0] : part[-1]], part - part[0], table)
        if len(h) < min_words:
            continue
        seeds = K.window_hash(h, seed)
        own = K.sliding_argmin(seeds, min_words - seed + 1)
        n = len(own)
        inside = row[:n] == row[min_words - 1 :]
        at = np.flatnonzero(inside)
        if not len(at):
            continue
        win = K.window_hash(h, min_words)[at]
        first = np.flatnonzero(np.r_[True, (own[at][1:] != own[at][:-1]) | (row[at][1:] != row[at][:-1])])
        begin = np.searchsorted(row, np.arange(hi - lo))
        packed = np.ascontiguousarray(win).view(np.uint8)
        cuts = (np.r_[first, len(at)] * _WIDE).astype(np.int32)
        head = at[first]
        anchor = seeds[own[head]]
        up, down = K.powers(K._P, len(anchor) + 1)
        total = np.r_[np.uint64(0), np.cumsum(anchor * up[: len(anchor)])]
        of = row[head]
        begins, ends, n = np.searchsorted(of, of), np.searchsorted(of, of, "right"), np.arange(len(of))

        def around(left, right):
            a, b = np.maximum(n + left, begins), np.minimum(n + right + 1, ends)
            return K.mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))

        out = pa.RecordBatch.from_arrays(
            [K.long_column(anchor), K.long_column(ids[lo:hi][row[head]]), K.long_column(bodies[lo:hi][row[head]]), *(K.long_column(around(*x)) for x in CONTEXT), pa.array((head - begin[row[head]]).astype(np.int32)), pa.Array.from_buffers(pa.binary(), len(head), [None, pa.py_buffer(cuts), pa.py_buffer(packed)])],
            [f.split()[0] for f in _PLACED.split(", ")],
        )
        yield out if chosen is None else out.filter(pa.array(chosen(anchor)))


def _hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(windows of each record, all hashes) of a packed column."""
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2], np.uint8)[off[0] : off[-1]] if off[-1] > off[0] else np.zeros(0, np.uint8)
    return np.diff(off) // _WIDE, raw.copy().view(np.uint64)


def _meetings(anchor, doc, body, contexts, at, size, h):
    """Columns of :data:`_STRETCH`: stretches of windows (a to b) that other documents hold.

    Windows are equal if their anchors and their 64-bit hashes both are.  The least
    place (document, text, position) among equal windows stands for them (r).  The
    partner (p) of a window is the least place in another document, of those with
    the same text, else the same context, else of all; a stretch has one
    of each, at one distance (diag).  Places that come twice count once.
    """
    o = np.lexsort((at, body, doc, anchor))
    o = o[_starts(anchor[o], doc[o], body[o], at[o])]
    base = np.cumsum(size) - size
    start = base[o]
    anchor, doc, body, at, size = (x[o] for x in (anchor, doc, body, at, size))
    contexts = [x[o] for x in contexts]
    who = np.repeat(np.arange(len(size)), size)
    step = np.arange(len(who)) - (np.cumsum(size) - size)[who]
    h = h[start[who] + step]
    pos = at[who] + step
    k = np.argsort(h, kind="stable")  # among equal hashes by anchor, document, text, position
    key, under = h[k], anchor[who[k]]
    if ((key[1:] == key[:-1]) & (under[1:] < under[:-1])).any():
        k = k[np.lexsort((np.arange(len(k)), under, key))]
        key, under = h[k], anchor[who[k]]
    g = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (under[1:] != under[:-1])])
    del key, under
    times = np.diff(np.r_[g, len(k)])
    d = doc[who[k]]
    shared = np.repeat(np.maximum.reduceat(d, g) != d[g], times)
    k, group = k[shared], np.repeat(np.arange(len(g)), times)[shared]
    if not len(k):
        return None
    n = len(k)
    d, text = doc[who[k]], body[who[k]]

    def mates(starts, order):
        """A place of another document within each group, n where there is none; ``order`` has groups together.

        It is in the text with the most places, the least one of equals.  Of its
        places the one with the rank that the window has in its own text is taken,
        round and round: text that repeats itself is matched at few distances.
        """
        e, f = d[order], text[order]
        count = np.diff(np.r_[starts, n])
        new = np.r_[True, (e[1:] != e[:-1]) | (f[1:] != f[:-1])]
        new[starts] = True
        part = np.flatnonzero(new)
        size = np.diff(np.r_[part, n])
        at, size = np.repeat(part, size), np.repeat(size, size)
        lead = starts.copy()
        other = np.minimum.reduceat(np.where(e != np.repeat(e[starts], count), np.arange(n), n), starts)
        odd = np.flatnonzero((np.maximum.reduceat(size, starts) > 1) & (other < n))
        if len(odd):
            mine = np.repeat(np.arange(len(starts)), count)[part]
            p = part[np.isin(mine, odd)]
            own = np.searchsorted(starts, p, "right") - 1
            o = np.lexsort((p, -size[p], own))
            p, own = p[o], own[o]
            g = K.groups(own)
            lead[odd] = p[g]
            best = np.repeat(e[p[g]], np.diff(np.r_[g, len(p)]))
            other[odd] = p[np.minimum.reduceat(np.where(e[p] != best, np.arange(len(p)), len(p)), g)]
        lead, second = np.repeat(lead, count), np.repeat(other, count)
        pick = np.where(e != e[lead], lead, second)
        rank = np.arange(n) - at
        pick = np.where(pick < n, pick + rank % size[np.minimum(pick, n - 1)], n)
        out = np.full(n, n)
        out[order] = np.where(pick < n, order[np.minimum(pick, n - 1)], n)
        return out

    starts = K.groups(group)
    mate = mates(starts, np.arange(n))
    for context in (*contexts, body):
        code = K.mix(context[who[k]].view(np.uint64) * np.uint64(K._P) + group.astype(np.uint64))
        order = np.argsort(code, kind="stable")
        better = mates(K.groups(code[order]), order)
        mate = np.where(better < n, better, mate)
    rep, partner, on = np.empty(len(h), np.int64), np.empty(len(h), np.int64), np.zeros(len(h), bool)
    rep[k], partner[k], on[k] = k[np.repeat(starts, np.diff(np.r_[starts, n]))], k[mate], True
    i = np.flatnonzero(on)
    r, p, w = rep[i], partner[i], who[i]
    row = doc[w], body[w], pos[i], doc[who[r]], body[who[r]], pos[r] - pos[i], doc[who[p]], body[who[p]], pos[p] - pos[i]
    new = np.r_[True, (w[1:] != w[:-1]) | (pos[i][1:] != pos[i][:-1] + 1)]
    for x in row[3:]:
        new[1:] |= x[1:] != x[:-1]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(i)] - 1
    return [row[0][first], row[1][first], row[2][first], row[2][last], *(x[first] for x in row[3:])]


def _batch(columns, schema: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([K.long_column(np.asarray(c)) for c in columns], [f.split()[0] for f in schema.split(", ")])


def _compare(batches):
    """Stretches of one partition of places, sorted by anchor; a few anchors at a time."""
    held, size = [], 0

    def run(cols):
        got = _meetings(*cols[:3], cols[3:-3], *cols[-3:]) if len(cols[0]) else None
        if got:
            yield _batch(got, _STRETCH)

    for b in batches:
        if not b.num_rows:
            continue
        held.append([x.to_numpy() for x in b.columns[:-2]] + [b.column("at").to_numpy().astype(np.int64), *_hashes(b.column("windows"))])
        size += len(held[-1][-1]) * _WIDE
        last = held[-1][0][-1]
        if size >= CHUNK and held[0][0][0] != last:
            cols = [np.concatenate(x) for x in zip(*held)]
            cut = int(np.searchsorted(cols[0], last))  # the anchor that is open waits
            at = int(cols[-2][:cut].sum())
            yield from run([*(x[:cut] for x in cols[:-1]), cols[-1][:at]])
            held = [[*(x[cut:] for x in cols[:-1]), cols[-1][at:]]]
            size = len(held[0][-1]) * _WIDE
    if held:
        yield from run([np.concatenate(x) for x in zip(*held)])


def _one_by_one(places: DataFrame) -> DataFrame:
    """The same stretches, a window each, by joins that spread the windows of a frequent anchor.

    Places and partners are chosen by the rules of :func:`_meetings`, one context after the other, the best first.
    """

    def spread(batches):
        for b in batches:
            size, h = _hashes(b.column("windows"))
            who = np.repeat(np.arange(len(size)), size)
            step = np.arange(len(who)) - (np.cumsum(size) - size)[who]
            yield _batch([*(b.column(i).to_numpy()[who] for i in range(3 + len(CONTEXT))), b.column("at").to_numpy()[who] + step, h], _WINDOW)

    rows = written(places.mapInArrow(spread, _WINDOW).distinct(), "windows")
    key = ["anchor", "hash"]
    first = rows.groupBy(*key).agg(F.min(F.struct("doc", "body", "pos")).alias("r"), F.max("doc").alias("last")).where("r.doc <> last").drop("last")
    met = written(rows.join(first, key).withColumn("p", F.lit(None).cast("struct<doc: bigint, body: bigint, pos: bigint>")), "met")
    discard(rows)
    key.append("near")
    for near in ("body", *(f"c{i}" for i in reversed(range(len(CONTEXT)))), "0L"):
        own = Window.partitionBy(*key, "doc", "body")
        ranked = met.withColumn("near", F.expr(near)).withColumn("rank", F.row_number().over(own.orderBy("pos")) - 1).withColumn("size", F.count(F.lit(1)).over(own))
        # of each text its number of places; the one with the most leads, and one of another document is for the leading document
        parts = ranked.where("rank = 0").select(*key, F.expr("struct(-size as size, doc, body)").alias("part"))
        lead = parts.groupBy(*key).agg(F.min("part").alias("lead"))
        both = parts.join(lead, key).where("part.doc <> lead.doc").groupBy(*key).agg(F.min("lead").alias("lead"), F.min("part").alias("other"))
        asked = ranked.join(both, key, "left").withColumn("to", F.expr("if(doc <> lead.doc, lead, other)"))
        asked = asked.withColumns({"to_doc": F.col("to.doc"), "to_body": F.col("to.body"), "turn": F.expr("rank % -to.size")})
        held = ranked.select(*key, F.col("doc").alias("to_doc"), F.col("body").alias("to_body"), F.col("rank").cast("long").alias("turn"), F.col("pos").alias("to_pos"))
        found = F.expr("coalesce(p, if(to_pos is null, null, struct(to_doc as doc, to_body as body, to_pos as pos)))")
        done = written(asked.join(held, [*key, "to_doc", "to_body", "turn"], "left").withColumn("p", found).select(met.columns), "met")
        discard(met)
        met = done
        if met.where("p is null").isEmpty():
            break
    return met.selectExpr("doc", "body", "pos as a", "pos as b", "r.doc as r_doc", "r.body as r_body", "r.pos - pos as r_diag", "p.doc as p_doc", "p.body as p_body", "p.pos - pos as p_diag")


def _pack(*columns) -> bytes:
    return zlib.compress(np.diff(np.array(columns, np.int64), axis=1, prepend=0).tobytes(), 1)


def _unpack(raw: bytes, columns: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(raw), np.int64).reshape(columns, -1), axis=1)


def _code(doc: np.ndarray, body: np.ndarray) -> np.ndarray:
    return K.mix(doc.view(np.uint64) * np.uint64(K._P) + K.mix(body.view(np.uint64))).view(np.int64)


def _starts(*columns) -> np.ndarray:
    """Mask of rows that differ from the one before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _gather(batches):
    """Rows of :data:`_RUN` from stretches sorted by document, text and place: one for each run and partner in it.

    ``parts`` packs what stands for the windows of the run (first, last, document, text, diag),
    ``spans`` the windows (first, last) whose partner it is.  One row of each run has the ``lead``.
    """
    rest = None

    def runs(c):
        if not len(c[0]):
            return
        doc, body, a, b = c[:4]
        fresh = _starts(doc, body)
        fresh[1:] |= a[1:] != b[:-1] + 1
        head = np.flatnonzero(fresh)
        tail = np.r_[head[1:], len(a)]
        same_r = ~(_starts(*c[4:7]) | fresh)
        same_p = ~(_starts(*c[7:]) | fresh)
        out = []
        for i, j in zip(head.tolist(), tail.tolist()):
            x = i + np.flatnonzero(~same_r[i:j])
            parts = _pack(a[x], b[np.r_[x[1:], j] - 1], *(z[x] for z in c[4:7]))
            y = i + np.flatnonzero(~same_p[i:j])
            low, high = a[y], b[np.r_[y[1:], j] - 1]
            who = [z[y] for z in c[7:]]
            o = np.lexsort((low, *who[::-1]))
            first = np.flatnonzero(_starts(*(z[o] for z in who)))
            for m, n in zip(first, np.r_[first[1:], len(o)]):
                out.append((doc[i], body[i], a[i], b[j - 1], len(first), int(m == 0), *(z[o[m]] for z in who), parts, _pack(low[o[m:n]], high[o[m:n]])))
        cols = list(zip(*out))
        names = [f.split()[0] for f in _RUN.split(", ")]
        yield pa.RecordBatch.from_arrays([K.long_column(np.array(x, np.int64)) for x in cols[:9]] + [pa.array(x, pa.binary()) for x in cols[9:]], names)

    for batch in batches:
        if not batch.num_rows:
            continue
        c = [x.to_numpy() for x in batch.columns]
        if rest is not None:
            c = [np.concatenate([x, y]) for x, y in zip(rest, c)]
        same = np.flatnonzero((c[0] != c[0][-1]) | (c[1] != c[1][-1]))
        cut = int(same[-1]) + 1 if len(same) else 0  # the last text may go on
        yield from runs([x[:cut] for x in c])
        rest = [x[cut:] for x in c]
    if rest is not None:
        yield from runs(rest)


def extended(own, other, spans, diag: int) -> list[tuple[int, int]]:
    """Longest (first, last) stretches of windows in which two runs agree and that hold one of ``spans``.

    A run is four arrays (first, last, code, diag) of what stands for its windows;
    the other one's places are ``diag`` further on.
    """
    a, b, code, off = own
    t, f, mark, lead = other[0] - diag, other[1] - diag, other[2], other[3] + diag
    low, high = max(a[0], t[0]), min(b[-1], f[-1])
    if low > high:
        return []
    cuts = np.unique(np.concatenate([a, t, [low, high + 1]]))
    cuts = cuts[(cuts >= low) & (cuts <= high + 1)]
    at = cuts[:-1]
    i, j = np.searchsorted(a, at, "right") - 1, np.searchsorted(t, at, "right") - 1
    agree = (code[i] == mark[j]) & (off[i] == lead[j])
    edge = np.flatnonzero(np.diff(np.r_[False, agree, False].astype(np.int8)))
    first, last = cuts[edge[::2]], cuts[edge[1::2]] - 1
    held = np.searchsorted(first, spans[0], "right") - 1
    good = (held >= 0) & (spans[0] <= last[np.maximum(held, 0)]) if len(last) else np.zeros(len(held), bool)
    k = np.unique(held[good])
    return list(zip(first[k].tolist(), last[k].tolist()))


def _extend(batches):
    """Rows of :data:`_MATCH` of runs whose windows have several partners."""

    def coded(raw):
        a, b, doc, body, diag = _unpack(raw, 5)
        return a, b, _code(doc, body), diag

    for batch in batches:
        out = []
        for x in batch.to_pylist():
            for a, b in extended(coded(x["parts"]), coded(x["f_parts"]), _unpack(x["spans"], 2), x["p_diag"]):
                out.append((x["doc"], x["body"], x["low"], a, b, x["p_doc"], x["p_body"], x["p_diag"]))
        if out:
            yield _batch([np.array(c, np.int64) for c in zip(*out)], _MATCH)


def _members(batches):
    """Rows of :data:`_MEMBER` from the parts of runs."""
    for batch in batches:
        packed = [_unpack(x, 5) for x in batch.column("parts").to_pylist()]
        if packed:
            who = np.repeat(np.arange(len(packed)), [x.shape[1] for x in packed])
            a, b, doc, body, diag = np.concatenate(packed, axis=1)
            yield _batch([batch.column("doc").to_numpy()[who], batch.column("body").to_numpy()[who], a, b, doc, body, diag], _MEMBER)


def linked_passages(docs: DataFrame, min_words: int = MIN_WORDS, seed: int = SEED, hot: int = HOT, sample: int = HOT_SAMPLE) -> DataFrame:
    """Every repeat of ``docs`` (doc_id, text, ...) as pairs and membership: (doc_id, start_word, end_word, n_words, first_doc_id, first_start, text_id, first_text_id, kind).

    A word is a run without ASCII white space, compared with ASCII letters
    lowered; start_word and end_word (exclusive) count words from 0.  Words start_word to end_word
    of text text_id of document doc_id stand whole in text first_text_id of document first_doc_id
    from word first_start on.  Places of documents are joined on the winnowed seed of each run of
    ``min_words`` words.

    ``kind`` member: each run of ``min_words`` words that several documents hold is a class. The
    first place that holds it (the least document, text and position) stands for it, and every
    place that holds it, the first included, has it inside a member row that leads there.  So
    two documents hold equal runs if and only if member rows of theirs overlap by ``min_words``
    words or more in one first text, and those are the equal words: a join of member rows on
    (first_doc_id, first_text_id) with that overlap gives all pairs of places.  Rows grow with
    the text, not with the pairs.

    ``kind`` match: maximal matches.  Each run that another document holds is paired with a
    place where another document holds it: one in an equal text if there is one, else one with as many equal
    seeds around it as can be; among these in the text that holds it most often, the
    least doc_id of equals.  The pair is extended both ways as far as the two documents agree, so
    neither end can be moved out.  Matches inside another match of the same text are left out; of
    equal ones the least partner stays.  So every repeated run is covered and every copy of
    a passage has a row, with one of its partners; the others are found by the member rows.

    Rows with a null doc_id are left out; null, empty and shorter texts have no
    repeats; long texts count whole.  Rows with one doc_id are one document: what recurs only among them
    is no repeat, equal rows give their rows once, and different texts of one doc_id each
    give their own.  An empty table gives an empty result; other columns are
    ignored, whatever their names.  ``hot`` and ``sample`` decide where seeds meet, not what is found.
    """
    if not 0 < seed <= min_words:
        raise ValueError("seed must be between 1 and min_words")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    texts = texts.select("doc_id", F.xxhash64("text").alias("body"), "text")

    def placed(chosen=None):
        def run(batches):
            pick = chosen() if chosen else None
            for b in batches:
                yield from anchored_windows(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2), min_words, seed, pick)

        return run

    some = texts.where(F.pmod(F.xxhash64("doc_id", "body"), F.lit(sample)) == 0).mapInArrow(placed(), _PLACED)
    often = [r.anchor for r in some.groupBy("anchor").count().where(F.col("count") > hot / sample).select("anchor").collect()]
    if often:
        held = sent(docs.sparkSession, np.array(often, np.int64).view(np.uint64))
        rare = texts.mapInArrow(placed(lambda: lambda x: ~np.isin(x, held())), _PLACED)
    else:
        rare = texts.mapInArrow(placed(), _PLACED)
    stretches = rare.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_compare, _STRETCH)
    if often:
        stretches = stretches.unionByName(_one_by_one(texts.mapInArrow(placed(lambda: lambda x: np.isin(x, held())), _PLACED)))
    runs = written(stretches.repartition("doc").sortWithinPartitions("doc", "body", "a").mapInArrow(_gather, _RUN), "runs")
    # the only partner of a run has all of it, and no window before or after it is repeated
    single = runs.where("partners = 1").select("doc", "body", "low", F.col("low").alias("a"), F.col("high").alias("b"), "p_doc", "p_body", "p_diag")
    asked = runs.where("partners > 1").select("doc", "body", "low", F.col("low").alias("a"), F.col("high").alias("b"), "p_doc", "p_body", "p_diag", "parts", "spans")
    other = runs.where("lead = 1").select(F.col("doc").alias("p_doc"), F.col("body").alias("p_body"), F.col("low").alias("f_low"), F.col("high").alias("f_high"), F.col("parts").alias("f_parts"))
    met = asked.join(other, ["p_doc", "p_body"]).where("a + p_diag <= f_high and b + p_diag >= f_low")
    long = met.select("doc", "body", "low", "p_doc", "p_body", "p_diag", "parts", "spans", "f_parts").mapInArrow(_extend, _MATCH)
    order = Window.partitionBy("doc", "body", "low").orderBy("a", F.desc("b"), "p_doc", "p_body", "p_diag")
    whole = long.withColumn("reach", F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))).where("reach is null or b > reach").drop("reach")
    members = runs.where("lead = 1").select("doc", "body", "parts").mapInArrow(_members, _MEMBER)
    matches = single.unionByName(whole).drop("low").withColumn("kind", F.lit("match"))
    return matches.unionByName(members.withColumn("kind", F.lit("member"))).select(
        F.col("doc").alias("doc_id"),
        F.col("a").cast("int").alias("start_word"),
        (F.col("b") + min_words).cast("int").alias("end_word"),
        (F.col("b") + min_words - F.col("a")).cast("int").alias("n_words"),
        F.col("p_doc").alias("first_doc_id"),
        (F.col("a") + F.col("p_diag")).cast("int").alias("first_start"),
        F.col("body").alias("text_id"),
        F.col("p_body").alias("first_text_id"),
        "kind",
    )


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, seed: int = SEED, hot: int = HOT, sample: int = HOT_SAMPLE) -> DataFrame:
    """(doc_id, start_word, end_word, n_words, first_doc_id, first_start): the matches of :func:`linked_passages` alone."""
    return linked_passages(docs, min_words, seed, hot, sample).where("kind = 'match'").drop("kind", "text_id", "first_text_id")
