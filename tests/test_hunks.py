"""Alignments of what both sides hold, and hunks that leave a task together."""

import random

import pandas as pd

from logloom.operators import graph


def test_alignments_hold_only_what_both_sides_have(monkeypatch):
    held, kept = [], graph._next_row
    monkeypatch.setattr(graph, "_next_row", lambda y: held.append(len(y)) or kept(y))
    a, b = [f"a{i}" for i in range(500)], [f"b{i}" for i in range(500)]
    a[100], a[300], b[50], b[400] = "x", "y", "y", "x"
    steps = graph.lcs(a, b)
    assert held == [2] and sum(s[0] == "both" for s in steps) == 1 and len(steps) == 999
    rng = random.Random(5)
    for _ in range(300):
        a, b = ([rng.choice(s) for _ in range(rng.randrange(12))] for s in ("abcde", "cdefg"))
        steps = graph.lcs(a, b)
        assert [i for _, i, _ in steps if i >= 0] == list(range(len(a))) and [j for _, _, j in steps if j >= 0] == list(range(len(b)))
        assert sum(s == "both" for s, *_ in steps) == graph.lcs_length(a, b)
        assert all(a[i] == b[j] for s, i, j in steps if s == "both")


def test_hunks_of_many_versions_leave_together(spark, monkeypatch):
    """The frames of a task hold the hunks of many pairs."""
    v = spark.range(300).selectExpr("'c' AS chain", "CAST(id AS INT) AS version", "concat('same\n', id % 2) AS text").coalesce(1)
    made = []

    class Frames:
        def __init__(self, df):
            self.df = df

        def mapInPandas(self, run, schema):
            made.extend(run([self.df.toPandas()]))

    kept = graph._consecutive
    monkeypatch.setattr(graph, "_consecutive", lambda x: Frames(kept(x)))
    graph.version_hunks(v)
    assert len(made) == 1 and len(made[0]) == 299 * 3 and isinstance(made[0], pd.DataFrame)
