"""The k-d tree of shards against all units at once."""

import numpy as np
import pytest

from lodestat.llm import sharding


def nodes(node, inside, x, names):
    """(node, rows inside) of all inner nodes, and of leaves."""
    if not node.sides:
        yield node, inside
        return
    yield node, inside
    left = x[:, names.index(node.dimension)] < node.cut
    yield from nodes(node.sides[0], inside & left, x, names)
    yield from nodes(node.sides[1], inside & ~left, x, names)


@pytest.mark.parametrize("shards,seed", [(24, 0), (5, 1), (8, 2), (1, 3)])
def test_cuts_are_weighted_quantiles_of_the_widest_dimension(spark, shards, seed):
    r = np.random.default_rng(seed)
    n = 1500
    x = np.c_[r.permutation(n) * 7919, r.integers(0, 40, n) << 42 | r.permutation(n), (r.pareto(1.2, n) * 1e6).astype(np.int64) * n + r.permutation(n)]
    w = (r.pareto(2.0, n) * 100).astype(np.int64) + 8
    units = spark.createDataFrame([(*map(int, v), int(k)) for v, k in zip(x, w)], "a long, b long, c long, w long").repartition(3)
    tree, names = sharding.kd_tree(units, shards, ["a", "b", "c"]), ["a", "b", "c"]
    seen = np.zeros(n, int)
    for node, inside in nodes(tree, np.ones(n, bool), x, names):
        if not node.sides:
            seen += inside
            continue
        spread = {d: int(np.ptp(x[inside, i])) for i, d in enumerate(names)}
        assert node.dimension == max(names, key=lambda d: (spread[d], d))
        v, u = x[inside, names.index(node.dimension)], w[inside]
        order = np.argsort(v)
        reached = np.r_[0, np.cumsum(u[order])]
        goal = u.sum() * (node.shards // 2) / node.shards
        best = np.abs(reached - goal).min()
        assert abs(u[v < node.cut].sum() - goal) <= best + u.sum() / node.shards / 5000 + 1e-9
    assert (seen == 1).all() and len(tree.leaves()) == shards
