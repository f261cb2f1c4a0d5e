"""Exact ranks of hot groups, and months beyond a bounded trend."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from logloom.operators import ranks, trends, usage


@pytest.mark.parametrize("seed", [1, 2])
def test_places_equal_sorted_lists(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([None, "a", "b", "c"]), rng.choice([None, *[float(rng.randrange(40)) for _ in range(9)]])) for _ in range(700)] + [("empty", None), ("one", 5.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    got = ranks.at_places(df, "g", "v", p50=ranks.nearest(0.5), p95=ranks.nearest(0.95), p0=ranks.nearest(0.0), top=ranks.nearest(1.0), mid=ranks.upper_middle()).collect()
    want = {}
    for g, v in rows:
        if v is not None:
            want.setdefault(g, []).append(v)
    pick = lambda vs, p: vs[max(1, -(-int(p * len(vs) * 100) // 100)) - 1] if p in (0.0, 1.0, 0.5) else vs[-(-len(vs) * 95 // 100) - 1]
    assert {r.g: (r.n, r.p50, r.p95, r.p0, r.top, r.mid) for r in got} == {
        g: (len(vs), pick(vs, 0.5), pick(vs, 0.95), vs[0], vs[-1], vs[len(vs) // 2]) for g, vs in ((g, sorted(vs)) for g, vs in want.items())
    }


def test_one_command_with_a_million_durations(spark):
    df = spark.range(1_000_000).select(F.lit("cmd").alias("command"), F.col("id").alias("session_id"), (F.xxhash64("id") % 1_000_003).cast("double").alias("duration_ms"))
    df = df.unionByName(spark.createDataFrame([("idle", 1, None), (None, 2, 7.0)], "command string, session_id long, duration_ms double"))
    got = {r.command: r for r in usage.hook_health(df).collect()}
    want = df.where("command = 'cmd'").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY duration_ms)"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY duration_ms)")).first()
    assert (got["cmd"].p50, got["cmd"].p95) == tuple(want) and (got["idle"].p50, got["idle"].n, got["idle"].missing) == (0.0, 1, 1) and got[None].p95 == 7.0


def test_sketches_unite(spark):
    df = spark.range(60_000).select((F.col("id") % 30).alias("day"), (F.xxhash64("id") % 20_000).alias("user"))
    days = usage.distinct_sketches(df, "user", "day")
    exact = df.select("user").distinct().count()
    r = usage.distinct_over(days).first()
    assert abs(r.distinct - exact) <= usage.SKETCH_ERROR * exact and r.n == 60_000


def test_a_cluster_without_a_shared_folder_is_told(spark):
    from logloom.shared import scratch_dir

    class Far:
        def __init__(self, **conf):
            self.all = conf
            self.sparkContext = self.conf = self
            self.master = "yarn"

        def getConf(self):
            return self

        def get(self, k, *default):
            return self.all.get(k, *default)

    with pytest.raises(RuntimeError):
        scratch_dir(Far(**{"spark.sql.warehouse.dir": "file:/home/me/spark-warehouse"}))
    assert scratch_dir(Far(**{"spark.sql.warehouse.dir": "hdfs://n/w"})) == "hdfs://n/w/logloom-scratch"
    assert scratch_dir(Far(**{"spark.checkpoint.dir": "file:///shared"})) == "file:///shared"


def test_months_outside_are_counted(spark):
    df = spark.createDataFrame([(datetime(2020, 1, 5),), (datetime(2024, 3, 5),), (datetime(2024, 4, 5),), (datetime(2025, 4, 5),), (None,)], "ts timestamp")
    got = {r.month: r.n for r in trends.month_spine(df, "ts", F.lit("2024-05-01").cast("timestamp"), 3).collect()}
    assert got == {"before": 1, "2024-03": 1, "2024-04": 1, "2024-05": 0, "after": 1}
