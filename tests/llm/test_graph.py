"""Connected components on random graphs, paths, stars and nothing."""

import random

import pytest

from logloom.llm import graph
from logloom.llm.graph import components


def expected(edges):
    par = {n: n for e in edges for n in e}

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        par[max(a, b)] = min(a, b)
    return {n: find(n) for n in par if any(n in e and e[0] != e[1] for e in edges)}


rng = random.Random(5)
GRAPHS = [
    [],
    [(5, 5)],
    [(i, i + 1) for i in range(60)],
    [(i * 37 % 61, (i + 1) * 37 % 61) for i in range(50)],
    [(50, i) for i in range(40)] + [(60, 61), (61, 60), (60, 61)],
    [(rng.randrange(120), rng.randrange(120)) for _ in range(90)],
]


@pytest.mark.parametrize("few", [0, 20, 1 << 16])
@pytest.mark.parametrize("k", range(len(GRAPHS)))
def test_components(spark, k, few, monkeypatch):
    monkeypatch.setattr(graph, "FEW", few)
    df = spark.createDataFrame(GRAPHS[k], "a long, b long")
    assert {r.node: r.component for r in components(df, "t").collect()} == expected(GRAPHS[k])
