"""Near duplicates: improved consistent weighted sampling over TF-IDF shingles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .components import connected
from .shared import discard, spare_name, worker_cache, written

SHINGLE = 3
BANDS, ROWS = 24, 4
THRESHOLD = 0.6
#: Bytes of text whose shingles are counted and signed together.
PIECE = 4 << 20
#: Bytes of text for which one task counts documents; shingles are dealt to such tasks by their identifiers.
BUCKET = 16 << 20
#: Shingles whose texts one task compares at once; larger candidate groups are split by their buckets, larger buckets into blocks.
MAX_TOGETHER = 4_000_000
#: Identifiers (8 bytes each) sent to every executor to thin out the texts before they are shuffled; more are joined.
MAX_SENT = 2_000_000
_ID = np.uint64(12)  # shingle identifiers keep the upper 52 bits
_TABLE = 1 << 16


def doc_shingles(texts: pa.Array, n: int = SHINGLE):
    """Pieces (lo, hi, row, id, tf) of distinct shingles by row; id has 52 bits, ascending in a row."""
    table = K.fold_table("alnum")
    data, offs = K.buffer(texts)
    for lo, hi in K.pieces(offs):
        part = offs[lo : hi + 1]
        row, _, _, h = K.words(data[part[0] : part[-1]], part - part[0], table)
        r, _, g = K.shingles(row, h, n)
        g = g >> _ID
        if hi - lo <= 4096:
            key = np.sort((r.astype(np.uint64) << np.uint64(52)) | g)
            at = K.groups(key)
            yield lo, hi, (key[at] >> np.uint64(52)).astype(np.int64), key[at] & np.uint64((1 << 52) - 1), np.diff(np.r_[at, len(key)])
        else:
            o = np.lexsort((g, r))
            r, g = r[o], g[o]
            at = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (g[1:] != g[:-1])]) if len(r) else np.zeros(0, np.int64)
            yield lo, hi, r[at], g[at], np.diff(np.r_[at, len(r)])


def weights(tf: np.ndarray, df: np.ndarray, n_docs: int) -> np.ndarray:
    """Term frequency times log(1 + documents / documents that hold the shingle)."""
    return tf * np.log1p(max(n_docs, 1) / df)


def _draws():
    """Tables of the sampling scheme's random variables: r, log c, beta.

    A shingle takes r and beta from one place and c from another, chosen by
    different bits of its identifier, so that 2**32 combinations are possible.
    """
    cache = worker_cache()
    if "icws" not in cache:
        g = np.random.default_rng(20260101)
        r = g.gamma(2.0, 1.0, _TABLE)
        c = np.log(g.gamma(2.0, 1.0, _TABLE))
        b = g.random(_TABLE)
        cache["icws"] = (r.astype(np.float32), c.astype(np.float32), b.astype(np.float32), K._random_table(5, 512) | np.uint64(1))
    return cache["icws"]


def _sample(log_w, r, b):
    """(log a without log c, level t) of a weight under the draws; the element with the least a is sampled."""
    t = np.floor(log_w / r + b)
    return -r * (t - b + np.float32(1)), t


def signatures(row, ids, w, rows: int, bands: int = BANDS, per: int = ROWS) -> np.ndarray:
    """Band keys (rows x bands) of shingle sets with weights ``w``; rows without shingles keep zeros."""
    out = np.zeros((rows, bands), np.uint64)
    if not len(row):
        return out
    start = K.groups(row)
    size = np.diff(np.r_[start, len(row)])
    who = np.repeat(np.arange(len(start)), size)
    r, c, b, mult = _draws()
    # most shingles weigh what one occurrence in one document does: their samples are looked up
    log_w = np.log(w).astype(np.float32)
    values, many = np.unique(log_w, return_counts=True)
    base = values[many.argmax()]
    odd = np.flatnonzero(log_w != base)
    base_a, base_t = _sample(base, r, b)
    wo, io = log_w[odd], ids[odd]
    for k in range(bands):
        key = np.full(len(start), k + 1, np.uint64)
        for j in range(k * per, (k + 1) * per):
            draw = ids * mult[j]
            at = (draw >> np.uint64(48)).astype(np.uint16)
            a = base_a[at]
            x = at[odd]
            a_odd, t_odd = _sample(wo, r[x], b[x])
            a[odd] = a_odd
            a += c[(draw >> np.uint64(32)).astype(np.uint16)]
            low = np.minimum.reduceat(a, start)
            hit = np.flatnonzero(a == np.repeat(low, size))
            hit = hit[K.groups(who[hit])]
            t = base_t[at[hit]]
            where = np.searchsorted(odd, hit)
            own = np.flatnonzero((where < len(odd)) & (odd[np.minimum(where, max(len(odd) - 1, 0))] == hit)) if len(odd) else []
            if len(own):
                t[own] = t_odd[where[own]]
            key = K.mix(key * np.uint64(K._Q) + ids[hit] * np.uint64(K._P) + (t.astype(np.int64) + 1000).astype(np.uint64))
        out[row[start], k] = key
    return out


def weighted_jaccard(a, b) -> float:
    """Sum of minima over sum of maxima of two (ids ascending, weights) sets; 0 for two empty ones."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    if len(a[0]) > len(b[0]):
        a, b = b, a
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    on = b[0][at] == a[0]
    low = np.minimum(a[1][on], b[1][at[on]]).sum()
    return float(low / (a[1].sum() + b[1].sum() - low))


def _identified(texts: DataFrame) -> DataFrame:
    """Two 64-bit hashes of the text: equal ones are equal texts."""
    return texts.withColumn("digest", F.xxhash64("text")).withColumn("twin", F.xxhash64(F.lit(1), "text"))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")


def _planes(a: np.ndarray) -> bytes:
    """Whole numbers as byte planes, the lowest bytes first; as many as the greatest number needs."""
    a = np.ascontiguousarray(a, np.uint64)
    width = max(1, -(-int(a.max()).bit_length() // 8)) if len(a) else 1
    return a.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _numbers(raw: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, : len(raw) // n] = np.frombuffer(raw, np.uint8).reshape(-1, n).T
    return out.view(np.uint64).reshape(-1)


def _piece_shingles(texts: pa.Array):
    """Distinct shingle identifiers of all texts, ascending; documents of each; (lo, hi, row, id, tf) by block."""
    blocks = list(doc_shingles(texts))
    ids = np.concatenate([x for _, _, _, x, _ in blocks]) if blocks else np.zeros(0, np.uint64)
    return *np.unique(ids, return_counts=True), blocks


_PACKED = "piece long, ids binary, sizes binary, texts binary"


def _packer(pieces: int):
    """Deal rows (doc_id, digest, twin, text) to pieces; those of one batch and piece travel as one compressed row."""

    def pack(batches):
        zstd = pa.Codec("zstd", compression_level=1)
        for batch in batches:
            ids = np.stack([batch.column(i).to_numpy() for i in range(3)], 1)
            home = (K.mix(ids[:, 0].view(np.uint64) * np.uint64(K._P)) % np.uint64(pieces)).astype(np.int64)
            o = np.argsort(home, kind="stable")
            at = np.r_[K.groups(home[o]), len(o)]
            data, offs = K.buffer(batch.column(3))
            size = np.diff(offs)
            cols = ([], [], [], [])
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                k = o[a:b]
                raw = b"".join(data[offs[i] : offs[i + 1]].tobytes() for i in k)
                for c, x in zip(cols, (home[k[0]], ids[k].tobytes(), size[k].tobytes(), zstd.compress(raw, asbytes=True) if raw else b"")):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])], [f.split()[0] for f in _PACKED.split(", ")])

    return pack


def _unpacked(table: pa.Table):
    """(doc_id, digest, twin, texts) of packed rows; a null text counts as empty."""
    zstd = pa.Codec("zstd")
    ids = np.frombuffer(b"".join(table.column("ids").to_pylist()), np.int64).reshape(-1, 3)
    sizes = [np.frombuffer(x, np.int64) for x in table.column("sizes").to_pylist()]
    raw = b"".join(zstd.decompress(x, int(n.sum()), asbytes=True) if x else b"" for x, n in zip(table.column("texts").to_pylist(), sizes))
    offs = np.cumsum(np.r_[0, *sizes]).astype(np.int64)
    texts = pa.LargeStringArray.from_buffers(len(ids), pa.py_buffer(offs), pa.py_buffer(raw))
    return ids[:, 0], ids[:, 1], ids[:, 2], texts


def counted(texts: DataFrame) -> tuple[int, DataFrame, DataFrame]:
    """(documents, pieces, counts): exact document counts of all shingles of ``texts`` (doc_id, text).

    pieces are the rows of ``texts`` with two digests, packed.  counts has, by
    piece and bucket, the document counts over the whole corpus of the piece's
    distinct shingles of that bucket, in the order of their identifiers.  A
    bucket is a range of identifiers; all that pieces hold of it meets in one task.
    """
    total = texts.agg(F.count("*").alias("docs"), F.sum(F.octet_length("text")).alias("bytes")).first()
    size = total.bytes or 0
    buckets = min(-(-size // BUCKET) or 1, 1 << 20)
    parts = _identified(texts).select("doc_id", "digest", "twin", "text").mapInArrow(_packer(-(-size // PIECE) or 1), _PACKED)

    def spread(table):
        ids, docs, _ = _piece_shingles(_unpacked(table)[3])
        home = (ids >> np.uint64(20)) * np.uint64(buckets) >> np.uint64(32)
        at = np.r_[K.groups(home), len(ids)].astype(np.int64)
        cuts = list(zip(at[:-1].tolist(), at[1:].tolist()))
        return pa.table(
            {
                "bucket": K.long_column(home[at[:-1]]),
                "piece": pa.array([table.column("piece")[0].as_py()] * len(cuts), pa.int64()),
                "n": pa.array(np.diff(at), pa.int64()),
                "first": K.long_column(ids[at[:-1]]),
                "gaps": pa.array([_planes(np.diff(ids[i:j])) for i, j in cuts], pa.binary()),
                "docs": pa.array([_planes(docs[i:j]) for i, j in cuts], pa.binary()),
            }
        )

    def count(table):
        size = table.column("n").to_pylist()
        first = table.column("first").to_numpy().view(np.uint64)
        ids = np.concatenate([np.cumsum(np.r_[f, _numbers(g.as_py(), n - 1)], dtype=np.uint64) for f, g, n in zip(first, table.column("gaps"), size)])
        docs = np.concatenate([_numbers(d.as_py(), n) for d, n in zip(table.column("docs"), size)])
        o = np.argsort(ids)
        at = K.groups(ids[o])
        df = np.empty(len(ids), np.uint64)
        df[o] = np.repeat(np.add.reduceat(docs[o], at), np.diff(np.r_[at, len(o)]))
        ends = np.cumsum(size)
        return pa.table({"piece": table.column("piece"), "bucket": table.column("bucket"), "n": table.column("n"), "df": pa.array([_planes(df[e - n : e]) for e, n in zip(ends, size)], pa.binary())})

    sent = parts.groupBy("piece").applyInArrow(spread, "bucket long, piece long, n long, first long, gaps binary, docs binary")
    return total.docs, parts, sent.groupBy("bucket").applyInArrow(count, "piece long, bucket long, n long, df binary")


def _verify(members, buckets, threshold):
    """(doc_id, root) of documents joined within shared buckets.

    members: {(doc_id, digest): (ids, weights)}; buckets: lists of members that share a key.
    Equal sets count as one.  Any two members of a bucket that are not connected
    yet are compared, so the components are those of all-pairs comparison.
    """
    alike, root = {}, {}
    for d in sorted(members):
        ids, w = members[d]
        root[d] = alike.setdefault((ids.tobytes(), w.tobytes()), d)

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    failed, done = set(), set()
    for docs in buckets:
        nodes = sorted({alike[members[d][0].tobytes(), members[d][1].tobytes()] for d in docs})
        if len(nodes) < 2 or tuple(nodes) in done:
            continue
        done.add(tuple(nodes))
        for i, x in enumerate(nodes):
            for y in nodes[:i]:
                a, b = find(x), find(y)
                if a == b or (x, y) in failed:
                    continue
                if weighted_jaccard(members[x], members[y]) >= threshold:
                    root[max(a, b)] = min(a, b)
                else:
                    failed.add((x, y))
    return sorted({(d[0], find(d)[0]) for d in members if find(d)[0] != d[0]})


def signed(texts: DataFrame, bands: int = BANDS, rows: int = ROWS) -> tuple[int, DataFrame]:
    """Number of documents, and (doc_id, digest, twin, bands, df) of each text with a shingle.

    df has the document counts of its shingles in the order of their identifiers.
    """
    n_docs, parts, counts = counted(texts)

    def sign(table, counts):
        doc, digest, twin, held = _unpacked(table)
        u, _, blocks = _piece_shingles(held)
        counts = counts.sort_by("bucket")
        df = np.concatenate([np.zeros(0, np.uint64), *(_numbers(d.as_py(), n) for d, n in zip(counts.column("df"), counts.column("n").to_pylist()))])
        if len(df) != len(u):
            raise RuntimeError("a piece of the corpus changed between two reads")
        out = []
        for lo, hi, row, x, tf in blocks:
            if not len(row):
                continue
            own = df[np.searchsorted(u, x)]
            sig = signatures(row, x, weights(tf, own, n_docs), hi - lo, bands, rows)
            cut = np.searchsorted(row, np.arange(hi - lo + 1))
            out += [(lo + i, sig[i], _planes(own[cut[i] : cut[i + 1]])) for i in np.flatnonzero(np.diff(cut))]
        at = np.array([i for i, _, _ in out], np.int64)
        keys = K.long_column(np.concatenate([np.zeros(0, np.uint64), *(s for _, s, _ in out)]))
        return pa.table(
            {
                "doc_id": K.long_column(doc[at]),
                "digest": K.long_column(digest[at]),
                "twin": K.long_column(twin[at]),
                "bands": pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * bands, pa.int32()), keys),
                "df": pa.array([d for _, _, d in out], pa.binary()),
            }
        )

    return n_docs, parts.groupBy("piece").cogroup(counts.groupBy("piece")).applyInArrow(sign, "doc_id long, digest long, twin long, bands array<long>, df binary")


def _homes(shared: DataFrame, placed: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, digest, home, buckets): where the members of candidate groups are compared; and a table that it reads.

    A group with at most ``most`` shingles has one home.  Of a larger one each bucket
    is a home of its own, and a larger bucket is dealt into chunks of which every
    two meet in a home: any two texts that share a bucket meet somewhere.
    """
    by_text = shared.groupBy("doc_id", "digest").agg(F.collect_set("bucket").alias("buckets"), F.first("n").alias("n"))
    whole = by_text.join(placed, by_text.doc_id == placed.node)
    together = F.array(F.struct(F.col("component").alias("home"), F.col("buckets").alias("buckets")))
    apart = F.transform("buckets", lambda b: F.struct(b.alias("home"), F.array(b).alias("buckets")))
    large = F.col("size") > most
    homes = written(whole.select("doc_id", "digest", "n", large.alias("apart"), F.explode(F.when(large, apart).otherwise(together)).alias("h")).select("doc_id", "digest", "n", "apart", "h.home", "h.buckets"), "homes")
    over = homes.where("apart").groupBy("home").agg(F.sum("n").alias("held")).where(F.col("held") > most)
    over = over.select("home", F.ceil(F.col("held") * 2 / most).cast("long").alias("chunks"))
    split = homes.join(over.withColumn("apart", F.lit(True)), ["home", "apart"], "left")
    chunk = F.pmod(F.xxhash64("doc_id", "digest"), F.col("chunks"))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), lambda j: F.xxhash64("home", F.least(chunk, j), F.greatest(chunk, j)))
    return split.select("doc_id", "digest", F.explode(F.when(F.col("chunks").isNull(), F.array("home")).otherwise(pairs)).alias("home"), "buckets"), homes


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, max_together: int = MAX_TOGETHER, max_sent: int = MAX_SENT) -> DataFrame:
    """(doc_id, group_id, keep): near-duplicate groups of ``docs`` (doc_id, text, ...).

    Two documents are near duplicates if the weighted Jaccard similarity of their
    TF-IDF word shingles reaches ``threshold``, with IDF = log(1 + documents /
    documents that hold the shingle), counted exactly for every shingle; groups are
    connected components over pairs that share a band of samples and pass that
    test.  group_id is the smallest doc_id of the group, and only that document has
    keep = true.

    One row per distinct doc_id.  Rows with a null doc_id are left out.  A text
    that is null, empty or without letters and digits is a group of its own.  Rows
    of one doc_id are one document, near whatever any of its texts is near to; each
    row counts in the document counts.  Texts with fewer than three words are one
    shingle; long texts count whole.  Equal texts are one in the comparison; ties
    have no effect on groups.  An empty table gives an empty result; other columns
    are ignored, whatever their names.
    """
    texts = _texts(docs)
    n_docs, signs = signed(texts, bands, rows)
    # equal texts have equal signatures: one of them stands for all
    classes = written(signs.groupBy("digest", "twin").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"), F.first("df").alias("df")), "classes")
    keys = classes.select("doc_id", "digest", F.octet_length("df").alias("n"), F.explode("bands").alias("bucket"))
    who = F.struct("doc_id", "digest")
    many = keys.groupBy("bucket").agg(F.min(who).alias("first"), F.max(who).alias("last")).where("first <> last").select("bucket", F.col("first.doc_id").alias("first"))
    shared = written(keys.join(many, "bucket").select("doc_id", "digest", "n", "bucket", "first"), "shared")
    candidates = written(connected(shared.select(F.col("doc_id").alias("a"), F.col("first").alias("b"))), "candidates")
    sizes = shared.select("doc_id", "digest", "n").distinct().join(candidates, F.col("doc_id") == F.col("node")).groupBy("component").agg(F.sum("n").alias("size"))
    homes, table = _homes(shared, candidates.join(sizes, "component"), max_together)
    members = written(classes.select("doc_id", "digest", "df").join(homes, ["doc_id", "digest"]), "members")
    discard(shared, candidates, table)
    few = members.select("doc_id").distinct()
    near = texts.join(F.broadcast(few), "doc_id", "left_semi") if few.count() <= max_sent else texts
    fetched = near.withColumn("digest", F.xxhash64("text")).join(members, ["doc_id", "digest"]).select("home", "doc_id", "digest", "buckets", "text", "df")
    fetched = fetched.repartition("home").sortWithinPartitions("home")

    def verify(batches):
        at, members, where = None, {}, {}

        def joined():
            got = _verify(members, [sorted(x) for x in where.values() if len(x) > 1], threshold)
            return [pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64())], ["a", "b"])] if got else []

        for batch in batches:
            home, ids, digest, keys = (batch.column(i).to_pylist() for i in range(4))
            for lo, hi, row, x, tf in doc_shingles(batch.column(4)):
                cut = np.searchsorted(row, np.arange(hi - lo + 1))
                df = np.concatenate([_numbers(batch.column(5)[lo + i].as_py(), int(cut[i + 1] - cut[i])) for i in range(hi - lo)])
                w = weights(tf, df, n_docs)
                for i in range(hi - lo):
                    if home[lo + i] != at:
                        yield from joined()
                        at, members, where = home[lo + i], {}, {}
                    d = (ids[lo + i], digest[lo + i])
                    members[d] = (x[cut[i] : cut[i + 1]].copy(), w[cut[i] : cut[i + 1]].copy())
                    for b in keys[lo + i]:
                        where.setdefault(b, set()).add(d)
        yield from joined()

    pairs = written(fetched.mapInArrow(verify, "a long, b long"), "pairs")
    discard(members)
    own = written(_identified(texts).select("doc_id", "digest", "twin"), "identities")
    # a doc_id with several texts joins the groups of all of them
    several = own.groupBy("doc_id").agg(F.min(F.struct("digest", "twin")).alias("low"), F.max(F.struct("digest", "twin")).alias("high")).where("low <> high").select("doc_id")
    reps = classes.select("digest", "twin", F.col("doc_id").alias("rep"))
    bridges = own.join(several, "doc_id").join(reps, ["digest", "twin"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    groups = connected(pairs.unionAll(bridges))
    every = own.join(reps, ["digest", "twin"], "left").select("doc_id", F.coalesce("rep", "doc_id").alias("rep"))
    out = every.join(groups, every.rep == groups.node, "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "rep")).alias("group_id"))
    return out.select("doc_id", "group_id", (F.col("group_id") == F.col("doc_id")).alias("keep"))


def without_near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """Rows of ``docs``, all columns, without the near duplicates that :func:`near_duplicates` drops.

    Rows with a null doc_id stay, as nothing is known against them.
    """
    name = spare_name(docs, "loom_drop")
    drop = near_duplicates(docs, **how).where("not keep").select(F.col("doc_id").alias(name))
    return docs.join(drop, docs["doc_id"].cast("long") == drop[name], "left_anti")
