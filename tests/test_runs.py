"""Runs aligned tile by tile, against a plain table."""

import random

import pytest
from pyspark.sql import functions as F

from logloom.operators import graph


def table(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


@pytest.mark.parametrize("size", [1, 5, 64])
def test_tiles_equal_a_table(spark, size):
    rng = random.Random(size)
    runs = {f"r{i}": [rng.choice("abcde") for _ in range(rng.randrange(0, 14 if size == 1 else 150))] for i in range(9)}
    runs["copy"] = list(runs["r3"])
    steps = spark.createDataFrame([(k, i, s) for k, v in runs.items() for i, s in enumerate(v)], "run string, seq long, signature string").repartition(5)
    names = [*runs, "none"]
    pairs = [(a, b) for a in names for b in rng.sample(names, 3)] + [("r3", "copy")]
    got = {(r.a, r.b): r for r in graph.run_diffs(steps, spark.createDataFrame(pairs, "a string, b string"), size=size).collect()}
    assert set(got) == set(pairs)
    for (a, b), r in got.items():
        x, y = runs.get(a, []), runs.get(b, [])
        off = next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), None)
        want = None if x == y else off if off is not None else min(len(x), len(y))
        assert (r.steps_a, r.steps_b, r.aligned, r.first_divergence) == (len(x), len(y), table(x, y), want)
        assert r.similarity == (r.aligned / max(len(x), len(y)) if x or y else 1.0) and not r.truncated
    few = graph.run_diffs(steps, spark.createDataFrame([("r3", "copy"), ("r1", "r2")], "a string, b string"), most=4, size=2).collect()
    for r in few:
        assert r.aligned == table(runs[r.a][:4], runs[r.b][:4]) and r.truncated == (max(len(runs[r.a]), len(runs[r.b])) > 4)


def test_a_run_of_200_000_steps(spark):
    kind = (F.xxhash64("id") % 50).cast("string")
    a = spark.range(200_000).select(F.lit("long").alias("run"), F.col("id").alias("seq"), kind.alias("signature"))
    b = a.where("seq % 1000 <> 999").withColumn("run", F.lit("less"))
    r = graph.run_diffs(a.unionByName(b), spark.createDataFrame([("long", "less")], "a string, b string")).first()
    assert (r.steps_a, r.steps_b, r.aligned) == (200_000, 199_800, 199_800) and 999 <= r.first_divergence < 1010
