"""Strongly connected components and closures from the condensed graph, against plain search."""

import random

import pytest

from corpusloom.operators import condense

EDGES, SEEDS = "src string, dst string", "set_id long, node string"


def reached(edges, node, back=False):
    found, todo = {node}, [node]
    while todo:
        at = todo.pop()
        for src, dst in edges:
            a, b = (dst, src) if back else (src, dst)
            if a == at and b is not None and b not in found:
                found.add(b)
                todo.append(b)
    return found


def plain_components(edges):
    nodes = {n for e in edges for n in e if n is not None and None not in e}
    comp = {n: min(reached(edges, n) & reached(edges, n, back=True)) for n in nodes}
    return sorted((n, c) for n, c in comp.items() if n != c)


def graphs():
    rng = random.Random(3)
    name = lambda n: f"n{rng.randrange(n):02d}"
    yield [(name(40), name(40)) for _ in range(60)] + [("n01", "n01"), ("n02", "n03"), ("n02", "n03"), (None, "n01"), ("n01", None)]
    # circles hanging on one another in both orders, a hub, a tail and a lone loop
    rings = [(f"r{k}{j}", f"r{k}{(j + 1) % 4}") for k in range(6) for j in range(4)]
    yield rings + [("r00", "r32"), ("r31", "r12"), ("r13", "r50"), ("r52", "r21")] + [(f"x{k}", "hub") for k in range(30)] + [("hub", "r00"), ("l", "l")]
    yield [(f"{k:02d}", f"{k + 1:02d}") for k in range(12)] + [("12", "00")]
    yield []


@pytest.mark.parametrize("case", range(4))
def test_components_and_closures(spark, case):
    edges = list(graphs())[case]
    rng = random.Random(case)
    nodes = sorted({n for e in edges for n in e if n}) or ["z"]
    seeds = [(rng.choice([-65, -1, 0, 1, 63, 64, 128, 10**12]), rng.choice(nodes)) for _ in range(20)] + [(5, "nowhere"), (5, "nowhere"), (None, nodes[0]), (6, None)]
    graph = spark.createDataFrame(edges, EDGES)
    index = condense.condense(graph)
    assert sorted(map(tuple, index.members.collect())) == plain_components(edges)
    got = condense.closures(index, spark.createDataFrame(seeds, SEEDS)).collect()
    expected = {(s, n) for s, seed in seeds if s is not None and seed is not None for n in reached(edges, seed, back=True)}
    assert len(got) == len(expected) and set(map(tuple, got)) == expected


def test_one_index_many_uses(spark):
    index = condense.condense(spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], EDGES))
    for seed, found in (("c", "abc"), ("a", "ab"), ("q", "q")):
        assert sorted(r.node for r in condense.closures(index, spark.createDataFrame([(1, seed)], SEEDS)).collect()) == list(found)
    assert condense.closures(index, spark.createDataFrame([], SEEDS)).isEmpty()


def test_only_small_fronts_are_broadcast(spark, monkeypatch):
    """No join of the loops leaves it to the planner to send a table through the driver."""
    plans, stored = [], condense.stored

    def watched(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df)

    monkeypatch.setattr(condense, "stored", watched)
    monkeypatch.setattr(condense, "SMALL", -1, raising=False)
    edges = [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "c")]
    got = condense.closures(condense.condense(spark.createDataFrame(edges, EDGES)), spark.createDataFrame([(1, "c"), (2, "a")], SEEDS))
    assert sorted(map(tuple, got.collect())) == [(1, n) for n in "abcd"] + [(2, n) for n in "ab"]
    assert any("SortMergeJoin" in p for p in plans)
    assert not any("Broadcast" in p for p in [*plans, got._jdf.queryExecution().executedPlan().toString()])


def test_cycle_sizes_are_not_broadcast(spark, small):
    from corpusloom import registry

    plan = registry.QUERIES["doc_cycles"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
