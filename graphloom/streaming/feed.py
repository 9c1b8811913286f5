"""Queries over streams: the stateless steps of a query applied to a streaming table.

Filters, projections and selectors without steps plan alike on a stream; what needs
the whole input (order, groups, distinct, joins with itself) does not.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.query import ORD, Query
from ..operators.shapes import fresh, infer
from ..operators.shapes import Record
from ..plans.plan import PlanNode

STATELESS = ("source", "filter", "project", "capture")


def read_stream(spark: SparkSession, path: str, schema, max_files: int | None = None) -> DataFrame:
    """Parquet files as they arrive."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def feed(df: DataFrame) -> Query:
    """Rows of a streaming table as records, in no order."""
    m = {c: fresh(c) for c in df.columns}
    out = df.select(F.struct(F.lit(0).alias("a")).alias(ORD), *[F.col(f"`{c}`").alias(n) for c, n in m.items()])
    return Query(out, Record({c: infer(out, n) for c, n in m.items()}), PlanNode("source", "unknown", {"label": "stream"}))


def stateless(q: Query) -> Query:
    node = q.plan
    while True:
        if node.operator not in STATELESS:
            raise ValueError(f"{node.operator} needs the whole input")
        if not node.inputs:
            return q
        node = node.inputs[0]


def counts(q: Query, time: Callable, key: Callable, width: str, late: str) -> DataFrame:
    """(start, key, n): rows in each window of time, closed when the watermark passes."""
    stateless(q)
    df = q.df.withColumn("_at", time(q.view)).withColumn("_key", key(q.view).col)
    out = df.withWatermark("_at", late).groupBy(F.window("_at", width).alias("w"), F.col("_key").alias("key")).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), "key", "n")


def write(df: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """A running query that appends Parquet; exactly once by its checkpoint."""
    return df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).format("parquet").start(path)
