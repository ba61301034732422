"""Reachability of many sets and chains by pointer jumping, against plain loops."""

import random

import pytest

from corpusloom.operators import reach

EDGES, SEEDS = "src string, dst string", "set_id long, node string"


def plain(edges, seeds, depth):
    """Rows (set_id, node, depth, chain), breadth first, least parent one step nearer."""
    importers = {}
    for src, dst in edges:
        if src is not None and dst is not None:
            importers.setdefault(dst, set()).add(src)
    rows = []
    for s in {s for s, n in seeds if s is not None and n is not None}:
        chain = {n: (n,) for t, n in seeds if t == s and n is not None}
        rows += [(s, n, 0, n) for n in chain]
        front = dict(chain)
        for level in range(1, depth + 1):
            parents = {}
            for n in front:
                for up in importers.get(n, ()):
                    if up not in chain:
                        parents[up] = min(n, parents.get(up, n))
            front = {up: (*chain[p], up) for up, p in parents.items()}
            chain |= front
            rows += [(s, up, level, " > ".join(c)) for up, c in front.items()]
    return sorted(rows)


@pytest.mark.parametrize("depth", [0, 1, 3, 6])
def test_random_graphs(spark, depth):
    rng = random.Random(depth)
    name = lambda: f"n{rng.randrange(60):02d}"
    edges = [(name(), name()) for _ in range(110)] + [("n01", "n01"), ("n02", "n03"), ("n02", "n03"), (None, "n01"), ("n01", None)]
    seeds = [(rng.choice([-1, -64, -65, 0, 1, 63, 64, 127, 128, 10**12]), name()) for _ in range(30)] + [(5, "nowhere"), (5, "nowhere"), (None, "n01"), (6, None)]
    got = reach.chains(reach.impact(spark.createDataFrame(edges, EDGES), spark.createDataFrame(seeds, SEEDS), depth))
    assert sorted(map(tuple, got.select("set_id", "node", "depth", "chain").collect())) == plain(edges, seeds, depth)


def test_long_chain(spark):
    """A path of 11 steps takes four rounds of jumping."""
    edges = [(f"{k + 1:02d}", f"{k:02d}") for k in range(20)]
    got = reach.chains(reach.impact(spark.createDataFrame(edges, EDGES), spark.createDataFrame([(63, "00")], SEEDS), 11))
    assert {r.node: r.chain for r in got.collect()} == {f"{k:02d}": " > ".join(f"{j:02d}" for j in range(k + 1)) for k in range(12)}


def test_empty_and_wrong(spark):
    none, seeds = spark.createDataFrame([], EDGES), spark.createDataFrame([], SEEDS)
    assert reach.chains(reach.impact(none, seeds)).isEmpty()
    with pytest.raises(ValueError):
        reach.impact(none, seeds, -1)
