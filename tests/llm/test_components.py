"""Components of chains, stars and rings against union-find, also where rounds are forced."""

import random

import pytest

from verdictflow.llm.common import connected_components


def expected(edges):
    low = {}

    def root(n):
        while low[n] != n:
            low[n] = low[low[n]]
            n = low[n]
        return n

    for a, b in edges:
        a, b = root(low.setdefault(a, a)), root(low.setdefault(b, b))
        low[max(a, b)] = min(a, b)
    return {n: root(n) for n in low}


def chain(n, seed, base=0):
    ids = list(range(base, base + n))
    random.Random(seed).shuffle(ids)
    return list(zip(ids, ids[1:]))


SHAPES = {
    "chain of 1000": chain(1000, 1),
    "star, ring, lone node, two chains": [(5000, k) for k in range(300)] + [(6000 + k, 6000 + (k + 1) % 70) for k in range(70)] + [(9999, 9999)] + chain(200, 2, 20_000) + chain(90, 3, 30_000),
    "nothing": [],
}


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("few", [0, 40, 200_000])
def test_components(spark, shape, few):
    edges = SHAPES[shape]
    rows = [*edges, *[(b, a) for a, b in edges[::3]], (None, 1), (2, None)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(rows, "a long, b long"), few=few).collect()}
    assert got == expected(edges)


@pytest.mark.parametrize("few", [0, 1000])
def test_values_of_nodes(spark, few):
    values = spark.createDataFrame([(1, 70), (2, 30), (3, 30), (5, 9), (6, -1)], "node long, low long")
    got = connected_components(spark.createDataFrame([(1, 2), (2, 3), (5, 4), (7, 7)], "a long, b long"), values, few).collect()
    assert {r.node: r.component for r in got} == {1: 30, 2: 30, 3: 30, 4: 4, 5: 4, 7: 7}


def test_long_chain(spark):
    edges = chain(100_000, 4)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), few=5_000).collect()}
    assert got == dict.fromkeys(range(100_000), 0)
