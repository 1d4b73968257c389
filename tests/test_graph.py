"""Components of graphs that take many rounds: few rounds, plans that stay small."""

import random

import pytest

from photolake.operators.graph import connected_components


def smallest(edges):
    up = {x: x for e in edges for x in e}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {x: top(x) for x in up}


def test_a_tree_is_hooked_whole(spark):
    """The second part's smallest node is its far end, which once heard of the first part one step a round."""
    line = [*range(60), *range(179, 59, -1)]
    edges = list(zip(line, line[1:]))
    found = connected_components(spark.createDataFrame(edges, "src long, dst long"), max_rounds=12)
    assert {r.node: r.component for r in found.collect()} == smallest(edges)
    with pytest.raises(RuntimeError, match="2 rounds"):
        connected_components(spark.createDataFrame(edges, "src long, dst long"), max_rounds=2)


def test_plans_do_not_grow_with_rounds(spark):
    nodes = list(range(600))
    random.Random(5).shuffle(nodes)
    edges = list(zip(nodes, nodes[1:])) + [(1000, 1001), (1001, 1002)]
    found = connected_components(spark.createDataFrame(edges, "src long, dst long"))
    size = found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert size < 2**40
    assert {r.node: r.component for r in found.collect()} == smallest(edges)
