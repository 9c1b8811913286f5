"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, written

#: Edges (16 bytes each) that one task joins by itself; more are joined in distributed rounds, to the same result.
ONE_TASK = 1_000_000


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node of each one's component) of the edges a-b, by hooking and pointer jumping."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        p, q = label[x], label[y]
        open_ = p != q
        if not open_.any():
            return nodes, nodes[label]
        np.minimum.at(label, np.maximum(p, q)[open_], np.minimum(p, q)[open_])
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches):
        held = [b for b in batches if b.num_rows]
        if held:
            t = pa.Table.from_batches(held)
            nodes, root = joined(t.column(0).to_numpy(), t.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(root)], ["node", "component"])

    return edges.select("a", "b").coalesce(1).mapInArrow(run, "node long, component long")


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the smallest of its neighbourhood."""
    low = _both(edges).groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return _both(edges).join(low, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them."""
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    hop = edges.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hop.unionAll(low.select("a", F.col("m").alias("b"))).distinct()


def connected(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """``edges`` (a, b: long) to (node, component): the smallest node that each one reaches.

    Rows with a null or with a = b are ignored; repeated rows do no harm; nodes
    without an edge are absent from the result.  Every round is written to the
    shared folder; rounds grow with the logarithm of the longest path.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    if now.count() <= one_task:
        return _in_one_task(now)
    mark = None
    while True:
        n, s = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if n == 0 or (n, s) == mark:
            break
        mark = (n, s)
        before, now = now, written(_small_star(_large_star(now)), "edges")
        discard(before)
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots.select("node", F.col("node").alias("component")))
