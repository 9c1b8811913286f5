"""Quality rules: lines that too many documents of one host share are removed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .shared import cast_like, spare_name, written

#: A line goes if more documents of its host hold it than both of these allow, or more than the third whatever the size of the host.
MIN_DOCS = 5
HOST_SHARE = 0.005
MAX_DOCS = 5_000
#: A document goes if less than this share of its characters is left.
KEEP_SHARE = 0.3
#: Keys (16 bytes each) sent to every executor at once; beyond it they are joined by doc_id.
MAX_SENT = 2_000_000
_NO_HOST = np.uint64(0x51F15EED)


def line_keys(texts: pa.Array, hosts: pa.Array):
    """Pieces (lo, hi, row, line, key) of the lines with a word, in order; ``line`` counts from 0 in its text.

    A key hashes the host and the line's words with case folded, so white space
    of any length counts as one blank.
    """
    table = K.fold_table("ws")
    data, offs = K.buffer(pc.utf8_lower(texts))
    hd, ho = K.buffer(hosts)
    hh = np.full(len(offs) - 1, _NO_HOST)
    some = np.flatnonzero(np.diff(ho) > 0)
    if len(some):
        hh[some] = K.span_hash(hd, ho[:-1][some], ho[1:][some], K._random_table(13, 256))
    if hosts.null_count:
        hh[hosts.is_null().to_numpy(zero_copy_only=False)] = ~_NO_HOST
    for lo, hi in K.pieces(offs):
        part = offs[lo : hi + 1] - offs[lo]
        own = data[offs[lo] : offs[hi]]
        row, s, _, h = K.words(own, part, table)
        if not len(row):
            continue
        breaks = np.flatnonzero(own == 10)
        upto = np.searchsorted(breaks, s)
        line = upto - np.searchsorted(breaks, part[:-1])[row]
        first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (line[1:] != line[:-1])])
        size = np.diff(np.r_[first, len(row)])
        up, _ = K.powers(K._Q, int(size.max()) + 1)
        k = np.arange(len(row)) - np.repeat(first, size)
        key = K.mix(np.add.reduceat(h * up[k], first) + size.astype(np.uint64)) ^ hh[lo:hi][row[first]]
        yield lo, hi, row[first], line[first], K.mix(key)


def frequent_lines(docs: DataFrame, host: str, min_docs: int, host_share: float, max_docs: int) -> DataFrame:
    """(key, docs) of the lines above the limits; distinct documents are counted over the whole table."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col(host).cast("string")).alias("home"))

    def spread(batches):
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, row, _, key in line_keys(batch.column(2), batch.column(1)):
                o = np.lexsort((key, row))
                r, k = row[o], key[o]
                new = np.r_[True, (r[1:] != r[:-1]) | (k[1:] != k[:-1])]
                r, k = r[new], k[new]
                at = pa.array(lo + r)
                yield pa.RecordBatch.from_arrays([K.long_column(k), ids.take(at), batch.column(3).take(at)], ["key", "doc_id", "home"])

    lines = rows.where("doc_id is not null").mapInArrow(spread, "key long, doc_id long, home long")
    # a key includes its host, so any one of its rows tells which host's limit holds
    counts = lines.groupBy("key", "doc_id").agg(F.min("home").alias("home")).groupBy("key").agg(F.count("*").alias("docs"), F.min("home").alias("home")).where(F.col("docs") > min_docs)
    sizes = rows.where("doc_id is not null").groupBy("home").agg(F.count_distinct("doc_id").alias("host_docs"))
    return counts.join(sizes, "home").where((F.col("docs") > F.col("host_docs") * host_share) | (F.col("docs") > max_docs)).select("key", "docs")


def _cleaned(texts: pa.Array, hosts: pa.Array, bad, keep_share: float):
    """(texts without bad lines, mask of the rows that stay); ``bad(lo, row, key)`` is a mask."""
    out = texts.to_pylist()
    live = np.zeros(len(out), bool)
    for lo, _, row, line, key in line_keys(texts, hosts):
        hit = bad(lo, row, key)
        live[lo + row] = True
        for i in np.unique(row[hit]).tolist():
            a, b = np.searchsorted(row, [i, i + 1])
            gone = set(line[a:b][hit[a:b]].tolist())
            lines = out[lo + i].split("\n")
            kept = [x for j, x in enumerate(lines) if j not in gone]
            total, left = sum(map(len, lines)), sum(map(len, kept))
            live[lo + i] = any(x.strip(" \t\r\x0b\x0c") for x in kept) and left >= keep_share * total
            out[lo + i] = "\n".join(kept)
    return out, live


def clean_lines(docs: DataFrame, host: str = "source", min_docs: int = MIN_DOCS, host_share: float = HOST_SHARE, keep_share: float = KEEP_SHARE, max_sent: int = MAX_SENT, max_docs: int = MAX_DOCS) -> DataFrame:
    """``docs`` (doc_id, text, host column, ...) without over-frequent lines and without depleted documents.

    Lines are compared with case folded and white space collapsed.  A line is
    removed if more than ``min_docs`` distinct documents of its host hold it and
    these are more than ``host_share`` of the host's documents or more than
    ``max_docs``.  A document is
    rejected if less than ``keep_share`` of its characters (line breaks aside)
    is left, or no word.  All columns return; ``n_chars``, if there, is that of
    the new text.

    Null, empty and blank texts have no word and are rejected.  A null host is a
    host of its own.  Rows with a null doc_id count for no limit but are cleaned
    like others.  Rows with one doc_id count once; each row stays a row.  Blank
    lines are neither counted nor removed.  Long texts are judged whole; a line at a
    limit stays.  An empty table gives an empty one; further columns stay as they are.
    """
    spark = docs.sparkSession
    bad = written(frequent_lines(docs, host, min_docs, host_share, max_docs), "lines")
    names = docs.columns
    at_text, at_host = names.index("text"), names.index(host)
    at_chars = names.index("n_chars") if "n_chars" in names else None
    schema = docs.schema

    def rebuild(batch, out, live):
        cols = [c for c in batch.columns[: len(names)]]
        cols[at_text] = pa.array(out, pa.string())
        if at_chars is not None:
            cols[at_chars] = cast_like(pc.utf8_length(cols[at_text]), batch.schema.field(at_chars).type)
        return pa.RecordBatch.from_arrays(cols, names).filter(pa.array(live))

    if bad.count() <= max_sent:
        sent = spark.sparkContext.broadcast(np.sort(bad.select("key").toPandas()["key"].to_numpy(np.int64).view(np.uint64)))

        def scrub(batches):
            keys = sent.value

            def hit(lo, row, key):
                if not len(keys):
                    return np.zeros(len(key), bool)
                return keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key

            for batch in batches:
                yield rebuild(batch, *_cleaned(_text(batch.column(at_text)), _text(batch.column(at_host)), hit, keep_share))

        return docs.mapInArrow(scrub, schema)

    # too many keys to send: each document receives its own ones
    ident, mine = spare_name(docs, "loom_row"), spare_name(docs, "loom_keys")

    def name_keys(batches):
        for batch in batches:
            for lo, hi, row, _, key in line_keys(_text(batch.column(1)), _text(batch.column(2))):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(lo + row)), K.long_column(key)], [ident, "key"])

    digest = F.xxhash64(F.col("text").cast("string"), F.col(host).cast("string"))
    marked = docs.withColumn(ident, digest)
    held = marked.select(ident, "text", host).mapInArrow(name_keys, f"{ident} long, key long").distinct().join(bad.select("key"), "key")
    held = held.groupBy(ident).agg(F.collect_set("key").alias(mine))

    def scrub_own(batches):
        for batch in batches:
            own = [np.array(sorted(x or ()), np.int64).view(np.uint64) for x in batch.column(len(names)).to_pylist()]

            def hit(lo, row, key):
                return np.array([k in own[lo + r] for r, k in zip(row.tolist(), key)], bool)

            yield rebuild(batch, *_cleaned(_text(batch.column(at_text)), _text(batch.column(at_host)), hit, keep_share))

    joined = marked.join(held, ident, "left").select(*[F.col(f"`{n}`") for n in names], mine)
    return joined.mapInArrow(scrub_own, schema)


def _text(column: pa.Array) -> pa.Array:
    return column if pa.types.is_string(column.type) else column.cast(pa.string())


ORACLE = f"""
WITH lines AS (
  SELECT doc_id, source, pos, line,
         trim(regexp_replace(lower(line), '[ \\t\\r\\x0b\\x0c]+', ' ', 'g')) AS norm
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
               unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents)
), hosts AS (
  SELECT source, count(DISTINCT doc_id) AS host_docs FROM documents GROUP BY source
), bad AS (
  SELECT l.source, l.norm FROM lines l JOIN hosts h ON l.source IS NOT DISTINCT FROM h.source
  WHERE l.norm <> '' GROUP BY l.source, l.norm, h.host_docs
  HAVING count(DISTINCT doc_id) > {MIN_DOCS} AND (count(DISTINCT doc_id) > h.host_docs * CAST({HOST_SHARE} AS DOUBLE) OR count(DISTINCT doc_id) > {MAX_DOCS})
), judged AS (
  SELECT l.*, b.norm IS NOT NULL AS gone
  FROM lines l LEFT JOIN bad b ON l.source IS NOT DISTINCT FROM b.source AND l.norm = b.norm
), kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone) AS text,
         sum(length(line)) AS total, coalesce(sum(length(line)) FILTER (NOT gone), 0) AS remaining,
         coalesce(sum(length(norm)) FILTER (NOT gone), 0) AS inked, bool_or(gone) AS touched
  FROM judged GROUP BY doc_id
)
SELECT k.doc_id, k.text, d.lang, d.source, CAST(length(k.text) AS BIGINT) AS n_chars
FROM kept k JOIN documents d USING (doc_id)
WHERE k.inked > 0 AND (NOT k.touched OR k.remaining >= k.total * CAST({KEEP_SHARE} AS DOUBLE))
"""
