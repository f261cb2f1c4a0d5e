"""Streams that stop and start again, and batches that come twice."""

import datetime as dt
import random

from pyspark.sql import functions as F

from logloom.streaming import jobs

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "ts timestamp, user_id long, value double"


def test_state_and_timers_outlive_a_restart(spark, tmp_path):
    rng = random.Random(1)
    root, where = str(tmp_path / "in"), str(tmp_path / "job")
    batches = [[(T0 + dt.timedelta(hours=20 * b, minutes=rng.randrange(600)), rng.randrange(8) if b < 2 else 100 + b, float(rng.randrange(50))) for _ in range(60)] for b in range(4)]
    for rows in batches:  # a new query each time, from the same checkpoint
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(root)
        stream = spark.readStream.schema(spark.createDataFrame([], SCHEMA).schema).parquet(root)
        out = jobs.drain_updates(jobs.latest_per_key(stream, "user_id"), where)
    seen, n = {}, {}
    for rows in batches[:2]:
        for ts, k, v in rows:
            seen[k], n[k] = max(seen.get(k, (ts, v)), (ts, v)), n.get(k, 0) + 1
    gone = {int(r.key): (r.ts, r.value) for r in out.where("expired").orderBy("batch").collect() if int(r.key) < 100}
    assert gone == seen
    counted = out.where("not expired").groupBy("key").agg(F.max("n").alias("n"), F.max("batch").alias("b")).collect()
    assert {int(r.key) for r in counted} == {*range(8), 102, 103}


def test_late_rows_are_counted_once_over_restarts(spark, tmp_path):
    root, where = str(tmp_path / "in"), str(tmp_path / "job")
    now = dt.datetime(2025, 1, 1)
    for b, rows in enumerate([[(T0, 1, 1.0), (None, 1, 1.0)], [(T0 - dt.timedelta(days=1), 1, 1.0), (dt.datetime(2026, 1, 1), 1, 1.0)]]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(root)
        stream = spark.readStream.schema(spark.createDataFrame([], SCHEMA).schema).parquet(root)
        out = jobs.count_late(stream, now, where=where)
    assert sorted(tuple(r)[:5] for r in out.collect()) == [(0, 2, 1, 0, 0), (1, 2, 0, 1, 1)]


def test_two_batches_keep_their_partitions(spark, tmp_path):
    first = spark.range(1000, numPartitions=6).select(F.col("id").alias("k"))
    s = jobs.two_batches(spark, first, spark.range(5000, 5003).select(F.col("id").alias("k")))
    out = jobs.drain_updates(s.groupBy("k").count())
    got = {r.batch: r.n for r in out.groupBy("batch").agg(F.count("*").alias("n")).collect()}
    assert got == {0: 1000, 1: 3}
