"""Queries over streams against the same counts over the whole table."""

import pytest
from pyspark.sql import functions as F

from graphloom.streaming import feed as S


def test_windowed_counts_of_a_stream(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{i // 4:02d}:{i % 4 * 15:02d}", "a" if i % 3 else "b", i % 5) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, at string, kind string, value long").withColumn("at", F.to_timestamp("at"))
    df.where("id < 100").coalesce(1).write.parquet(f"{tmp_path}/in")
    df.where("id >= 100").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    q = S.feed(S.read_stream(spark, f"{tmp_path}/in", df.schema, 1)).filter(lambda r: r["value"] > 0)
    time = lambda r: F.col(r.shape.fields["at"].name).cast("timestamp")
    running = S.write(S.counts(q, time, lambda r: r["kind"], "10 minutes", "1 minute"), f"{tmp_path}/out", f"{tmp_path}/check")
    running.processAllAvailable()
    running.stop()
    want = df.where("value > 0").groupBy(F.window("at", "10 minutes").start.alias("start"), F.col("kind").alias("key")).agg(F.count("*").alias("n")).collect()
    got = {tuple(r) for r in spark.read.schema("start timestamp, key string, n long").parquet(f"{tmp_path}/out").collect()}
    last = max(r.start for r in want)
    assert got == {tuple(r) for r in want if r.start < last} and len(got) >= 8


def test_what_needs_the_whole_input_is_refused(spark, tmp_path):
    df = spark.createDataFrame([(1, 2)], "a long, b long")
    with pytest.raises(ValueError, match="whole input"):
        S.stateless(S.feed(df).distinct(lambda r: r["a"]))
    assert S.stateless(S.feed(df).filter(lambda r: r["a"] > 0)) is not None
