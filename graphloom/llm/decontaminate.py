"""Benchmark decontamination: a prefix-filtered set join of benchmark items with document windows."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .shared import sent, spare_name, written

#: Words of a shingle; an item with fewer words is one shingle of all its words.
SHINGLE = 5
#: Share of an item's distinct shingles that a window of the item's length must hold.
CONTAINMENT = 0.6
#: Benchmark shingles (about 24 bytes each) sent to every executor at once; beyond it they are joined by a shuffle.
MAX_SENT = 2_000_000


def item_shingles(texts: pa.Array, n: int):
    """(row, shingle length, words of the row, hash), a row for each distinct shingle of each item."""
    table = K.fold_table("alnum")
    data, offs = K.buffer(texts)
    row, _, _, h = K.words(data, offs, table)
    words = np.bincount(row, minlength=len(offs) - 1)
    size = np.minimum(words, n)
    parts = []
    for k in np.unique(size[size > 0]).tolist():
        mine = size[row] == k
        r, _, g = K.shingles(row[mine], h[mine], k, short=False)
        o = np.lexsort((g, r))
        r, g = r[o], g[o]
        new = np.r_[True, (r[1:] != r[:-1]) | (g[1:] != g[:-1])]
        parts.append((r[new], np.full(int(new.sum()), k), words[r[new]], g[new] ^ np.uint64(k)))
    if not parts:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64)
    return tuple(np.concatenate([p[i] for p in parts]) for i in range(4))


def doc_shingles(texts: pa.Array, sizes):
    """Pieces (lo, hi, row, place, hash) of all shingles of the lengths ``sizes``; place counts words in the text."""
    table = K.fold_table("alnum")
    data, offs = K.buffer(texts)
    for lo, hi in K.pieces(offs):
        row, _, _, h = K.words(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], table)
        begin = np.searchsorted(row, np.arange(hi - lo))
        for k in sizes:
            r, at, g = K.shingles(row, h, k, short=False)
            yield lo, hi, r, at - begin[r], g ^ np.uint64(k)


def prefix_lengths(n: np.ndarray, containment: float) -> np.ndarray:
    """Shingles that must be looked up of an item with n: any set that holds enough of all holds one of these."""
    return n - np.ceil(n * containment - 1e-9).astype(np.int64) + 1


class Index:
    """Benchmark shingles in order of rarity, as arrays: one entry for each (hash, item)."""

    def __init__(self, item, size, words, hashes, df, containment):
        self.item, self.containment = item, containment
        o = np.lexsort((hashes, df, item))  # rarest first within an item
        item, words, hashes = item[o], words[o], hashes[o]
        start = K.groups(item)
        n = np.diff(np.r_[start, len(item)])
        rank = np.arange(len(item)) - np.repeat(start, n)
        first = rank < np.repeat(prefix_lengths(n, containment), n)
        self.need = dict(zip(item[start].tolist(), np.ceil(n * containment - 1e-9).astype(int).tolist()))
        self.total = dict(zip(item[start].tolist(), n.tolist()))
        self.span = dict(zip(item[start].tolist(), words[start].tolist()))
        self.length = dict(zip(item[start].tolist(), size[o][start].tolist()))
        k = np.argsort(hashes, kind="stable")
        self.hashes, self.items, self.first = hashes[k], item[k], first[k]
        lead = self.first
        self.lead_hashes, self.lead_items = self.hashes[lead], self.items[lead]
        self.hint = None

    def __getstate__(self):
        return {**self.__dict__, "hint": None}

    def lookup(self, g: np.ndarray, hashes: np.ndarray):
        """(index into g, entry) of every pair of a document shingle and an entry of equal hash in ``hashes``."""
        a, b = np.searchsorted(hashes, g), np.searchsorted(hashes, g, "right")
        n = b - a
        return np.repeat(np.arange(len(g)), n), np.repeat(a - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))

    def candidates(self, row: np.ndarray, g: np.ndarray):
        """(rows, pairs row x items + item, ascending) that share a prefix shingle; nothing else can match."""
        low = np.uint64((1 << 22) - 1)
        if self.hint is None:
            self.hint = np.zeros(1 << 22, bool)
            self.hint[(self.lead_hashes & low).astype(np.int64)] = True
        maybe = np.flatnonzero(self.hint[(g & low).astype(np.int64)])
        who, entry = self.lookup(g[maybe], self.lead_hashes)
        pair = np.unique(row[maybe[who]].astype(np.int64) * len(self.total) + self.lead_items[entry])
        return np.unique(pair // max(len(self.total), 1)), pair


def best_window(place: np.ndarray, code: np.ndarray, anchors: np.ndarray, width: int, need: int) -> int:
    """Most distinct codes among places of one window of ``width`` shingle places that holds an anchor; 0 if under ``need``.

    place is ascending; a window is [p, p + width).  Windows need only begin at a place.
    """
    best, begin = 0, np.searchsorted(place, place - width, "right")
    held: dict[int, int] = {}
    left, last = 0, -1
    where = set(anchors.tolist())
    for right in range(len(place)):
        while left < begin[right]:
            c = int(code[left])
            held[c] -= 1
            if not held[c]:
                del held[c]
            left += 1
        held[int(code[right])] = held.get(int(code[right]), 0) + 1
        if int(place[right]) in where:
            last = int(place[right])
        # positional bound: without a prefix shingle inside, the window cannot reach the need
        if len(held) > best and len(held) >= need and last >= place[left]:
            best = len(held)
    return best


def _verified(index: Index, row, place, g):
    """(row, item, shared) of the contained items among all shingles of some documents."""
    # prefix filter: only pairs that meet in a prefix shingle are looked up in full
    rows, pairs = index.candidates(row, g)
    if not len(pairs):
        return []
    on = np.flatnonzero(np.isin(row, rows))
    row, place, g = row[on], place[on], g[on]
    who, entry = index.lookup(g, index.hashes)
    pair = row[who].astype(np.int64) * len(index.total) + index.items[entry]
    met = pairs[np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)] == pair
    who, entry = who[met], entry[met]
    r, item, p, h, lead = row[who], index.items[entry], place[who], index.hashes[entry], index.first[entry]
    o = np.lexsort((p, item, r))
    r, item, p, h, lead = r[o], item[o], p[o], h[o], lead[o]
    start = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (item[1:] != item[:-1])])
    stop = np.r_[start[1:], len(r)]
    # length bound: fewer hits than needed rule the pair out
    out = []
    for k in range(len(start)):
        a, b = start[k], stop[k]
        i = int(item[a])
        need = index.need[i]
        if b - a < need:
            continue
        width = index.span[i] - index.length[i] + 1
        # positional bound: only hits less than a window away from a prefix shingle count
        q, c, leads = p[a:b], h[a:b], p[a:b][lead[a:b]]
        j = np.searchsorted(leads, q)
        near = (leads[np.minimum(j, len(leads) - 1)] - q < width) & (j < len(leads)) | (q - leads[np.maximum(j - 1, 0)] < width) & (j > 0)
        got = best_window(q[near], c[near], leads, width, need)
        if got:
            out.append((int(r[a]), i, got))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT, n: int = SHINGLE, max_sent: int = MAX_SENT, min_words: int = 1) -> DataFrame:
    """(doc_id, item_id, containment): items that a window of a document holds.

    Words are runs of letters and digits with ASCII case folded.  A window has as
    many words as the item; its containment is the share of the item's distinct
    shingles among its own, reported for the best window.  Shingles of an item are
    ordered by the number of documents that hold them, counted over the whole
    corpus; by the prefix filter only the rarest can start a match.

    One row for each pair with distinct doc_id and item_id.  Null identifiers and
    null, empty or wordless texts on either side match nothing.  An item with
    fewer than ``n`` words is one shingle of all its words, so that an item of one
    word is found in every document with that word; ``min_words`` leaves out shorter
    items.  Rows that repeat an identifier are judged each for itself and the best
    counts.  Long texts count whole; ties in rarity go by hash.  Empty tables on
    either side give an empty result; other columns are ignored, whatever their names.
    """
    if not 0 < containment <= 1:
        raise ValueError("containment must be in (0, 1]")
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()

    def split(batches):
        for batch in batches:
            r, k, w, g = item_shingles(batch.column(1), n)
            on = w >= min_words
            r, k, w, g = r[on], k[on], w[on], g[on]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(r)), batch.column(2).take(pa.array(r)), pa.array(k.astype(np.int32)), pa.array(w.astype(np.int32)), K.long_column(g)], ["item_id", "copy", "size", "words", "hash"])

    entries = written(items.withColumn("copy", F.xxhash64("text")).mapInArrow(split, "item_id long, copy long, size int, words int, hash long"), "items")
    count = entries.count()
    if not count:
        return spark.createDataFrame([], "doc_id long, item_id long, containment double")
    sizes = sorted(r[0] for r in entries.select("size").distinct().collect())
    if count <= max_sent:
        found = _by_broadcast(spark, texts, entries, sizes, containment)
    else:
        found = _by_join(texts, entries, sizes, containment)
    return found.groupBy("doc_id", "item_id").agg(F.max("containment").alias("containment"))


def _by_broadcast(spark, texts, entries, sizes, containment):
    e = entries.toPandas().sort_values(["item_id", "copy", "hash"])
    e["item"] = e.groupby(["item_id", "copy"]).ngroup()
    hashes = np.unique(e["hash"].to_numpy(np.int64).view(np.uint64))
    held = sent(spark, hashes)

    def count(batches):
        own = held()
        got = np.zeros(len(own), np.int64)
        low = np.uint64((1 << 22) - 1)
        hint = np.zeros(1 << 22, bool)
        hint[(own & low).astype(np.int64)] = True
        for batch in batches:
            for _, _, row, _, g in doc_shingles(batch.column(0), sizes):
                m = np.flatnonzero(hint[(g & low).astype(np.int64)])
                at = np.minimum(np.searchsorted(own, g[m]), len(own) - 1)
                on = own[at] == g[m]
                pair = np.unique(row[m][on].astype(np.int64) * len(own) + at[on])
                got += np.bincount(pair % len(own), minlength=len(own))
        yield pa.RecordBatch.from_arrays([K.long_column(own[got > 0]), K.long_column(got[got > 0])], ["hash", "df"])

    df = texts.select("text").mapInArrow(count, "hash long, df long").groupBy("hash").agg(F.sum("df").alias("df")).toPandas()
    rarity = dict(zip(df["hash"].tolist(), df["df"].tolist()))
    order = e["hash"].map(rarity).fillna(0).to_numpy(np.int64)
    index = Index(e["item"].to_numpy(np.int64), e["size"].to_numpy(np.int64), e["words"].to_numpy(np.int64), e["hash"].to_numpy(np.int64).view(np.uint64), order, containment)
    names = e.drop_duplicates("item").set_index("item")["item_id"].sort_index().to_numpy(np.int64)
    found = sent(spark, (index, names))

    def match(batches):
        index, names = found()
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for lo, _, row, place, g in doc_shingles(batch.column(1), sizes):
                got = _verified(index, row, place, g)
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array([int(ids[lo + r]) for r, _, _ in got], pa.int64()), pa.array([int(names[i]) for _, i, _ in got], pa.int64()), pa.array([c / index.total[i] for _, i, c in got], pa.float64())], ["doc_id", "item_id", "containment"])

    return texts.mapInArrow(match, "doc_id long, item_id long, containment double")


def _by_join(texts, entries, sizes, containment):
    """The same without sending the benchmark: shingles meet by hash, pairs are verified together."""

    def spread(batches):
        for batch in batches:
            keys = batch.column(2)
            for lo, _, row, place, g in doc_shingles(batch.column(1), sizes):
                at = pa.array(lo + row)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), keys.take(at), pa.array(place.astype(np.int32)), K.long_column(g)], ["doc_id", "body", "place", "hash"])

    shingles = texts.withColumn("body", F.xxhash64("text")).mapInArrow(spread, "doc_id long, body long, place int, hash long")
    hits = written(shingles.join(entries.select("hash").distinct(), "hash", "left_semi"), "hits")
    df = hits.groupBy("hash").agg(F.count_distinct("doc_id", "body").alias("df"))
    total = entries.groupBy("item_id", "copy").agg(F.count("*").alias("total"))
    ranked = entries.join(df, "hash", "left").join(total, ["item_id", "copy"])
    ranked = ranked.selectExpr("*", "row_number() over (partition by item_id, copy order by coalesce(df, 0), hash) as rank")
    need = F.ceil(F.col("total") * F.lit(containment) - 1e-9).cast("int")
    ranked = written(ranked.select("item_id", "copy", "size", "words", "hash", "total", need.alias("need"), (F.col("rank") <= F.col("total") - need + 1).alias("lead")), "ranked")
    pair = ["doc_id", "body", "item_id", "copy"]
    candidates = hits.join(ranked.where("lead").select("hash", "item_id", "copy"), "hash").select(*pair).distinct()
    # only documents and items that meet in a prefix shingle are joined in full
    both = hits.join(candidates, ["doc_id", "body"]).join(ranked, ["hash", "item_id", "copy"])
    grouped = both.groupBy(*pair, "total", "need", (F.col("words") - F.col("size") + 1).alias("width")).agg(F.sort_array(F.collect_list(F.struct("place", "hash", "lead"))).alias("hits")).where(F.size("hits") >= F.col("need"))

    def verify(batches):
        for batch in batches:
            rows = batch.to_pylist()
            out = []
            for x in rows:
                place = np.array([h["place"] for h in x["hits"]])
                code = np.array([h["hash"] for h in x["hits"]])
                lead = np.array([h["lead"] for h in x["hits"]], bool)
                got = best_window(place, code, place[lead], x["width"], x["need"])
                if got:
                    out.append((x["doc_id"], x["item_id"], got / x["total"]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.float64())], ["doc_id", "item_id", "containment"])

    return grouped.mapInArrow(verify, "doc_id long, item_id long, containment double")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """Rows of ``docs``, all columns, whose doc_id is in no match; rows with a null doc_id stay."""
    name = spare_name(docs, "loom_drop")
    drop = contaminated(docs, benchmark, **how).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(drop, docs["doc_id"].cast("long") == drop[name], "left_anti")


def expected_containment(item: str, text: str, n: int = SHINGLE) -> float:
    """Containment of one pair straight from the definition (for tests)."""
    import re

    def words(x):
        return re.findall(rb"[0-9a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), x.encode()))

    a, b = words(item), words(text)
    if not a:
        return 0.0
    k = min(n, len(a))
    need = {tuple(a[i : i + k]) for i in range(len(a) - k + 1)}
    best = 0
    for s in range(max(1, len(b) - len(a) + 1)):
        w = b[s : s + len(a)]
        best = max(best, len(need & {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}))
    return best / len(need) if best >= math.ceil(len(need) * CONTAINMENT - 1e-9) else 0.0
