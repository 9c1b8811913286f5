"""Token counts through a cache of content digests."""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from . import tokenizers as tok
from .shared import fresh_path, written

_ENTRY = "digest binary, n_tokens long"
#: Digests (16 bytes each) sent to every executor so that only the texts to encode are shuffled; beyond it they are joined.
MAX_SENT = 2_000_000


def normalised(texts: pa.Array) -> pa.Array:
    """Unicode form C, line feeds for all line ends, no white space around."""
    if not pa.types.is_string(texts.type):
        texts = texts.cast(pa.string())
    out = pc.replace_substring(pc.replace_substring(pc.utf8_normalize(texts, form="NFC"), "\r\n", "\n"), "\r", "\n")
    return pc.ascii_trim_whitespace(out)


def digests(texts: pa.Array) -> pa.Array:
    """The first 16 bytes of SHA-256 of every text; null for null."""
    data, offs = K.buffer(texts)
    view, cut = memoryview(data), offs.tolist()
    raw = b"".join(hashlib.sha256(view[a:b]).digest()[:16] for a, b in zip(cut, cut[1:]))
    none = None
    if texts.null_count:
        none = pc.is_valid(texts).buffers()[1]
    return pa.Array.from_buffers(pa.binary(), len(texts), [none, pa.py_buffer(np.arange(len(texts) + 1, dtype=np.int32) * 16), pa.py_buffer(raw)])


def _folder(cache: str, version: str) -> str:
    return f"{cache.rstrip('/')}/tokenizer={version[:32]}"


def stored(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """(digest, n_tokens) that the cache has for one tokenizer version; each digest once."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(_folder(cache, version))
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], _ENTRY)
    return spark.read.schema(_ENTRY).parquet(f"{_folder(cache, version)}/batch-*").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def _append(counts: DataFrame, cache: str, version: str) -> None:
    """A batch is written aside and moved into place whole, so readers never see half of one."""
    spark = counts.sparkSession
    name = uuid.uuid4().hex
    aside, home = f"{cache.rstrip('/')}/.aside-{name}", _folder(cache, version)
    counts.write.option("compression", "zstd").parquet(aside)
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(home).getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(path(home))
    if not system.rename(path(aside), path(f"{home}/batch-{name}")):
        raise OSError(f"cannot move {aside} into {home}")


def token_counts(docs: DataFrame, cache: str | None = None, tokenizer: str = tok.DEFAULT, folder: str = tok.TOKENIZER_DIR, max_sent: int = MAX_SENT) -> DataFrame:
    """(doc_id, digest, n_tokens, cached) of every row of ``docs`` (doc_id, text, ...).

    n_tokens counts the tokens of the normalised text (:func:`normalised`).  Counts
    are stored by digest of that text and version of the tokenizer in the folder
    ``cache`` (by default a new one in the shared folder): contents found there are
    not encoded again; of the others each distinct one is encoded once and its
    count appended.  ``cached`` tells whether the count was there before; digest is
    its hexadecimal form.

    A null text has no digest, 0 tokens and cached = false; an empty or blank one is
    the empty text with 0 tokens.  A null doc_id stays null.  Repeated rows stay
    rows and share one encoding; long texts are encoded whole.  An empty table gives
    an empty result and appends an empty batch; other columns are ignored, whatever
    their names.
    """
    spark = docs.sparkSession
    cache = cache or fresh_path(spark, "token-cache")
    version = tok.digest_of(tokenizer, folder)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def identify(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), digests(normalised(batch.column(1)))], ["doc_id", "digest"])

    def distinct(batches):
        """Each content once in a task."""
        seen: set[bytes] = set()
        for batch in batches:
            own = normalised(batch.column(0))
            keys = digests(own)
            new = []
            for i, d in enumerate(keys.to_pylist()):
                if d is not None and d not in seen:
                    seen.add(d)
                    new.append(i)
            if new:
                at = pa.array(new)
                yield pa.RecordBatch.from_arrays([keys.take(at), own.take(at)], ["digest", "text"])

    def encode(batches):
        """Rows of one digest are all in one task."""
        enc, seen = tok.chunks(tokenizer, folder), set()
        for batch in batches:
            new = []
            for i, d in enumerate(batch.column(0).to_pylist()):
                if d not in seen:
                    seen.add(d)
                    new.append(i)
            if new:
                some = batch.take(pa.array(new))
                data, offs = K.buffer(some.column(1))
                n = [enc.counts(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]) for lo, hi in K.pieces(offs)]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(np.concatenate(n))], ["digest", "n_tokens"])

    keys = written(texts.mapInArrow(identify, "doc_id long, digest binary"), "digests")
    wanted = keys.select("digest").where("digest is not null").distinct()
    before = written(stored(spark, cache, version).select("digest").join(wanted, "digest", "left_semi"), "hits")
    missed = written(wanted.join(before, "digest", "left_anti"), "misses")
    n_before, n_missed = before.count(), missed.count()
    contents = texts.where("text is not null").select("text").mapInArrow(distinct, "digest binary, text string")
    # digests meet first: texts whose count is stored are not shuffled
    if n_before and n_missed <= max_sent:
        contents = contents.join(F.broadcast(missed), "digest", "left_semi")
    elif n_before and n_before <= max_sent:
        contents = contents.join(F.broadcast(before), "digest", "left_anti")
    elif n_before:
        contents = contents.join(missed.hint("shuffle_hash"), "digest", "left_semi")
    if n_missed or not n_before:
        _append(contents.repartition("digest").mapInArrow(encode, _ENTRY), cache, version)
    after = stored(spark, cache, version)
    known = before.select("digest", F.lit(True).alias("cached"))
    out = keys.join(after, "digest", "left").join(known, "digest", "left")
    return out.select("doc_id", F.lower(F.hex("digest")).alias("digest"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), F.coalesce("cached", F.lit(False)).alias("cached"))
