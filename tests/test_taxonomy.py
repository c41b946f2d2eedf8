"""Closures agree in memory and by joins, and stop at cycles."""

import random

import pytest

from lodeweave.operators import taxonomy


def _pairs(df):
    return sorted((r.root, r.tag) for r in df.collect())


def test_both_ways_agree(spark):
    rng = random.Random(4)
    edges = [(f"t{a}", f"t{a + rng.randint(1, 9)}", "contains") for a in (rng.randint(0, 60) for _ in range(120))] + [("t1", "t50", "related_method")]
    e = spark.createDataFrame(edges, "parent string, child string, relation string")
    roots = spark.createDataFrame([(f"t{k}",) for k in range(0, 70, 3)] + [("t0",), ("alone",)], "root string")
    walked, joined = _pairs(taxonomy.closure(e, roots)), _pairs(taxonomy.closure(e, roots, small=3))
    assert walked == joined
    assert len(set(walked)) == len(walked) and ("alone", "alone") in walked


def test_cycles(spark):
    e = spark.createDataFrame([("a", "b", "contains"), ("b", "c", "contains"), ("c", "a", "contains"), ("x", "a", "contains")], "parent string, child string, relation string")
    roots = spark.createDataFrame([("x",)], "root string")
    assert _pairs(taxonomy.closure(e, roots)) == _pairs(taxonomy.closure(e, roots, small=1)) == [("x", t) for t in "abcx"]
    assert sorted(r.tag for r in taxonomy.unsorted_rest(e).collect()) == ["a", "b", "c"]


@pytest.mark.parametrize("small", [0, 10])
def test_nothing(spark, small):
    e = spark.createDataFrame([], "parent string, child string, relation string")
    assert taxonomy.closure(e, spark.createDataFrame([], "root string"), small=small).count() == 0


def plain_layers(edges):
    nodes = sorted({x for e in edges for x in e})
    above = {n: sorted({p for p, c in edges if c == n}) for n in nodes}
    depth, free = {}, [n for n in nodes if not above[n]]
    while free:
        for n in free:
            depth[n] = max((depth[p] + 1 for p in above[n]), default=0)
        free = [n for n in nodes if n not in depth and all(p in depth for p in above[n])]
    depth = {n: depth.get(n, 0) for n in nodes}
    place = {}
    for d in range(max(depth.values(), default=-1) + 1):
        layer = [n for n in nodes if depth[n] == d]
        mean = {n: [place[p] for p in above[n] if p in place] for n in layer}
        layer.sort(key=lambda n: (sum(mean[n]) / len(mean[n]) if mean[n] else float("inf"), n))
        place |= {n: k + 1 for k, n in enumerate(layer)}
    return {n: (depth[n], place[n]) for n in nodes}


def test_layers_by_the_laid_out_order(spark):
    import random

    dice = random.Random(6)
    cases = [[("b", "x"), ("a", "y"), ("a", "x"), ("y", "z"), ("x", "w")], [("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("a", "e")], [("a", "b"), ("b", "a")]]
    cases += [sorted({(f"n{i}", f"n{j}") for i, j in (sorted(dice.sample(range(14), 2)) for _ in range(22))}) for _ in range(3)]
    for edges in cases:
        df = spark.createDataFrame([(p, c, "contains") for p, c in edges], "parent string, child string, relation string")
        assert {r.tag: (r.depth, r.place) for r in taxonomy.layers(df).collect()} == plain_layers(edges), edges
    assert taxonomy.layers(df.limit(0)).collect() == []
