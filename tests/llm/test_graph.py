import random

from calibrium.llm.common import cut_lineage, join_counted, release
from calibrium.llm.graph import components


def test_components_of_chains_stars_and_repeated_edges(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (300, 301), (301, 300), (300, 301)] + [(rng.randrange(500, 560), rng.randrange(500, 560)) for _ in range(40)]
    top = {}

    def find(x):
        top.setdefault(x, x)
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()}
    assert got == {x: find(x) for x in top if any(x in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hot_keys_join_by_broadcast(spark):
    big = cut_lineage(spark.createDataFrame([(1, i) for i in range(50)] + [(2, 1), (3, 1)], "k int, v int"))
    small = cut_lineage(spark.createDataFrame([(1, 50, "a"), (2, 1, "b")], "k int, members int, name string"))
    out = join_counted(big, small, ["k"], hot=10)
    assert sorted((r.k, r.v, r.name) for r in out.collect()) == sorted([(1, i, "a") for i in range(50)] + [(2, 1, "b")])
    release(big, small)
