"""Closure by joins against plain searches, on graphs with chains, cycles, hubs and loops."""

from __future__ import annotations

import random

import pytest

from lawloom.operators import reachability


def plain(edges):
    """Pairs by a search from each node."""
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    out = set()
    for s in {x for e in edges for x in e}:
        todo, seen = list(after.get(s, ())), set()
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += after.get(x, ())
        out |= {(s, x) for x in seen}
    return out


def graphs():
    rng = random.Random(4)
    yield "chain and cycle", [(i, i + 1) for i in range(9)] + [(20, 21), (21, 22), (22, 20), (9, 20), (22, 30)]
    yield "hub", [(0, i) for i in range(1, 40)] + [(i, 0) for i in range(30, 40)] + [(5, 5), (50, 50), (60, 50)]
    yield "sparse", [(rng.randrange(60), rng.randrange(60)) for _ in range(60)]
    yield "dense", [(rng.randrange(25), rng.randrange(25)) for _ in range(90)]


@pytest.mark.parametrize("name,edges", list(graphs()), ids=[g[0] for g in graphs()])
def test_closure(spark, name, edges):
    df = spark.createDataFrame([*edges, edges[0], (None, 1), (1, None)], "u long, v long")
    want = plain(edges)
    got = [tuple(r) for r in reachability.reached(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    nodes = {x for e in edges for x in e}
    mutual = {x: max([x] + [y for y in nodes if (x, y) in want and (y, x) in want]) for x in nodes}
    assert {r["node"]: r["component"] for r in reachability.strong_components(df).collect()} == mutual
    sizes = list(mutual.values())
    told = {r["node"]: (r["component_size"], r["n_reached"]) for r in reachability.reach_counts(df).collect()}
    assert told == {x: (sizes.count(mutual[x]), sum(a == x for a, _ in want)) for x in nodes}


def test_no_edges(spark):
    none = spark.createDataFrame([(None, 1)], "u long, v long")
    assert reachability.reached(none).count() == reachability.reach_counts(none).count() == 0
