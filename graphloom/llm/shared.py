"""Session helpers: the shared folder, lineage cuts, size-checked lookups."""

from __future__ import annotations

import atexit
import shutil
import sys
import tempfile
import types
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, str] = {}
_PATH = "_loom_path"


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach, as named by ``spark.checkpoint.dir``.

    A local session without that setting gets a temporary folder of its own;
    a cluster without it is an error, since no machine-local folder would do.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        _ROOTS[app] = tempfile.mkdtemp(prefix="loom-")
        atexit.register(shutil.rmtree, _ROOTS[app], ignore_errors=True)
    return "file://" + _ROOTS[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts lineage: a lost executor costs a re-read, not a recomputation.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.__dict__[_PATH] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Drop tables of :func:`written` all of whose readers have been written themselves."""
    for df in tables:
        spark = df.sparkSession
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(df.__dict__[_PATH])
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def sent(spark: SparkSession, value):
    """Broadcast ``value``; the result is a function that gives it back on a worker.

    Classes of this package travel by value, as a plain broadcast would need the
    package on every executor.  A Python worker unpacks each value once.
    """
    packed = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    name = uuid.uuid4().hex

    def get():
        held = worker_cache().setdefault("sent", {})
        if name not in held:
            while len(held) > 3:
                held.pop(next(iter(held)))
            held[name] = cloudpickle.loads(packed.value)
        return held[name]

    return get


def worker_cache() -> dict:
    """Per-process dictionary that outlives one task in a reused Python worker."""
    name = "_loom_worker_cache"
    if name not in sys.modules:
        sys.modules[name] = types.ModuleType(name)
    return sys.modules[name].__dict__


def spare_name(df: DataFrame, name: str) -> str:
    """``name``, or the first of name_1, name_2, ... that no column of ``df`` has."""
    have = {c.lower() for c in df.columns}
    k, out = 0, name
    while out.lower() in have:
        k += 1
        out = f"{name}_{k}"
    return out


def cast_like(column, kind):
    """Arrow column in the type of the column it takes the place of."""
    return column.cast(kind) if column.type != kind else column
