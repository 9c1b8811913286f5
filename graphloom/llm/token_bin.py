"""Token files: flat unsigned integers, 64-bit document offsets, memory-mapped."""

from __future__ import annotations

import json
import os
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from . import tokenizers as tok
from .shared import fresh_path

_INDEX = "doc_id long, shard int, row int, local_offset long, n_tokens long, crc32 long"


def _open(uri: str):
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:", "file://", 1))


def _put(uri: str, parts) -> None:
    """Write a file under a name of its own, then move it into place: a repeated task does no harm."""
    system, path = _open(uri)
    task = TaskContext.get()
    own = f"{path}.{task.taskAttemptId() if task else 0}.part"
    with system.open_output_stream(own) as out:
        for p in parts:
            out.write(p)
    system.move(own, path)


def write_tokens(docs: DataFrame, out: str | None = None, tokenizer: str = tok.DEFAULT, folder: str = tok.TOKENIZER_DIR) -> DataFrame:
    """Encode ``docs`` (doc_id, text, ...) into token files; returns their index.

    Each input partition becomes one shard: ``tokens-NNNNN.bin`` holds the token
    ids of its documents end to end as little-endian uint16 (uint32 if the
    vocabulary needs it), and ``offsets-NNNNN.bin`` the uint64 global offset of
    each of its documents and, last, of its end.  A shard's base is the prefix sum
    of the tokens of the shards before it.  One row for each input row:
    (doc_id, shard, row, start, n_tokens, crc32), start being the global offset and
    crc32 that of the ids' bytes.  ``format.json`` has the type of the ids.  Files go
    to ``out``, by default a new folder in the shared one.

    A null doc_id stays null; null and empty texts have zero tokens; repeated rows
    are written as often as they come; long texts are encoded whole; an empty table
    has no shards and an empty index.  Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    out = (out or fresh_path(spark, "tokens")).rstrip("/")
    if out.startswith("/"):
        out = "file://" + out
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(out)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(hadoop)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def encode(batches):
        shard = TaskContext.get().partitionId()
        index = []

        def ids():
            at = row = 0
            for batch in batches:
                enc = tok.chunks(tokenizer, folder)
                data, offs = K.buffer(batch.column(1))
                for lo, hi in K.pieces(offs):
                    part = offs[lo : hi + 1]
                    t, n = enc.encode(data[part[0] : part[-1]], part - part[0])
                    raw = t.astype(np.dtype(enc.wide).newbyteorder("<")).tobytes()
                    ends = np.cumsum(n)
                    width = np.dtype(enc.wide).itemsize
                    view = memoryview(raw)
                    crc = np.array([zlib.crc32(view[(e - k) * width : e * width]) for e, k in zip(ends.tolist(), n.tolist())], np.int64)
                    m = hi - lo
                    index.append(pa.RecordBatch.from_arrays([batch.column(0).slice(lo, m), pa.array(np.full(m, shard, np.int32)), pa.array(np.arange(row, row + m, dtype=np.int32)), K.long_column(at + ends - n), K.long_column(n), pa.array(crc)], ["doc_id", "shard", "row", "local_offset", "n_tokens", "crc32"]))
                    at, row = at + int(ends[-1]), row + m
                    yield raw

        first = next(batches, None)
        while first is not None and not first.num_rows:
            first = next(batches, None)
        if first is not None:
            rest = batches

            def again():
                yield first
                yield from rest

            batches = again()
            _put(f"{out}/tokens-{shard:05d}.bin", ids())
        yield from index

    kind = np.dtype(tok.chunks(tokenizer, folder).wide).newbyteorder("<")
    _put(f"{out}/format.json", [json.dumps({"dtype": kind.str, "tokenizer": tokenizer, "version": tok.digest_of(tokenizer, folder)}).encode()])
    path = f"{out}/index-local"
    texts.mapInArrow(encode, _INDEX).write.option("compression", "zstd").parquet(path)
    local = spark.read.schema(_INDEX).parquet(path)
    sums = local.groupBy("shard").agg(F.sum("n_tokens").alias("shard_tokens"))
    # one row for each shard: the prefix sum is taken over file counts, not documents
    bases = sums.withColumn("base", F.sum("shard_tokens").over(Window.orderBy("shard")) - F.col("shard_tokens"))
    index = local.join(bases.select("shard", "base"), "shard").select("doc_id", "shard", "row", (F.col("base") + F.col("local_offset")).alias("start"), "n_tokens", "crc32")

    def offsets(batches):
        held: dict[int, list] = {}
        for b in batches:
            for s in np.unique(b.column(0).to_numpy()).tolist():
                m = b.column(0).to_numpy() == s
                held.setdefault(s, []).append((b.column(1).to_numpy()[m], b.column(2).to_numpy()[m], b.column(3).to_numpy()[m]))
        for s, parts in held.items():
            row, start, n = (np.concatenate([p[i] for p in parts]) for i in range(3))
            o = np.argsort(row)
            _put(f"{out}/offsets-{s:05d}.bin", [np.r_[start[o], start[o[-1]] + n[o[-1]]].astype("<u8").tobytes()])
        yield pa.RecordBatch.from_arrays([pa.array([len(held)], pa.int64())], ["n"])

    index.select("shard", "row", "start", "n_tokens").repartition("shard").mapInArrow(offsets, "n long").agg(F.sum("n")).collect()
    return index


class TokenFiles:
    """Memory-mapped reader of a folder of token files: document k by its place, in order of shards.

    The width of the ids is read from ``format.json``.
    """

    def __init__(self, folder: str):
        folder = folder.removeprefix("file://")
        with open(os.path.join(folder, "format.json")) as f:
            dtype = np.dtype(json.load(f)["dtype"])
        names = sorted(n for n in os.listdir(folder) if n.startswith("tokens-") and n.endswith(".bin"))
        self.offsets = [np.memmap(os.path.join(folder, n.replace("tokens", "offsets")), "<u8", "r") for n in names]
        size = np.dtype(dtype).itemsize
        self.tokens = [np.memmap(p, dtype, "r") if os.path.getsize(p) >= size else np.zeros(0, dtype) for p in (os.path.join(folder, n) for n in names)]
        self.first = np.cumsum([0] + [len(o) - 1 for o in self.offsets])

    def __len__(self):
        return int(self.first[-1])

    def __getitem__(self, k: int) -> np.ndarray:
        if not 0 <= k < len(self):
            raise IndexError(k)
        s = int(np.searchsorted(self.first, k, "right")) - 1
        o = self.offsets[s]
        a, b = int(o[k - self.first[s]]), int(o[k - self.first[s] + 1])
        return self.tokens[s][a - int(o[0]) : b - int(o[0])]
