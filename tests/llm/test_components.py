import random

from tracewright.llm.components import components


def brute(edges):
    up = {}

    def find(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for u, v in edges:
        a, b = find(u), find(v)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in list(up) if find(n) != n}


def test_both_ways_agree_with_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(200 + i, 201 + i) for i in range(40)] + [(7, 7)]
    df = spark.createDataFrame(edges, "u long, v long")
    want = brute([e for e in edges if e[0] != e[1]])
    for at_once in (0, 10, 10**6):
        assert {r.node: r.root for r in components(df, at_once).collect()} == want


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
