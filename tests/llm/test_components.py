"""Connected components against a union-find, with few rounds on chains."""

import math
import random

import pytest

from phrasemill.llm import _components as C


def roots(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {x: find(x) for x in up}


def chain(n, order):
    return [(order[i], order[i + 1]) for i in range(n - 1)]


_rng = random.Random(7)
_mixed = list(range(3000))
_rng.shuffle(_mixed)


@pytest.mark.parametrize(
    "edges",
    [chain(10_000, range(10_000)), chain(3000, _mixed), [(_rng.randrange(4000), _rng.randrange(4000)) for _ in range(2500)], [(0, i) for i in range(1, 2000)]],
    ids=["in order", "shuffled", "random", "star"],
)
def test_components_of_graphs(spark, monkeypatch, edges):
    written, steps = C.written, []
    monkeypatch.setattr(C, "written", lambda df, name: steps.append(name) or written(df, name))
    got = {r.node: r.root for r in C.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = roots([e for e in edges if e[0] != e[1]])
    assert got == want
    rounds, doublings = steps.count("labels"), steps.count("parents") - steps.count("labels")
    assert rounds <= 9 and doublings <= 2 * math.log2(len(got))
    if edges[0] == (0, 1) and len(edges) == 9999:
        assert rounds == 1 and doublings < 20


def test_no_edges(spark):
    assert C.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
    assert C.components(spark.createDataFrame([(3, 3)], "a bigint, b bigint")).count() == 0
