"""Faults that a review of the fourth round found."""

from __future__ import annotations

import time

import numpy as np
import pytest

from lawloom.functions import terms
from lawloom.llm import meeting, simhash
from lawloom.operators import models, rewriting
from lawloom.operators.catalogue import law_of_number
from lawloom.operators.magmas import law_holds


def _plans(monkeypatch, module) -> list[str]:
    """The plans of all tables that the module stores, as they come."""
    told, plain = [], module.materialise

    def telling(df, label):
        told.append(_plan(df))
        return plain(df, label)

    monkeypatch.setattr(module, "materialise", telling)
    return told


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_exploded_fingerprints_are_never_broadcast(spark, monkeypatch):
    """probes and points are many times what Spark takes them for."""
    told = _plans(monkeypatch, simhash)
    some = np.random.default_rng(4).integers(-(1 << 63), 1 << 63, 40, np.int64).tolist()
    fps = spark.createDataFrame([(x ^ m,) for x in some for m in (0, 1, 1 << 40)], "fp long").distinct()
    links = simhash.links(fps, hot=2)
    plans = [*told, _plan(links)]
    assert len(plans) == 2 and "SortMergeJoin" in plans[0] and not any("Broadcast" in p for p in plans)
    assert {frozenset(r) for r in links.collect()} >= {frozenset((x, x ^ 1)) for x in some}


def test_open_pairs_are_never_broadcast(spark, monkeypatch):
    """the members of open slots, exploded to their rarest elements, are joined by sorting."""
    seen, plain = [], meeting._verified

    def telling(pairs, sets, needed):
        seen.append(_plan(pairs))
        return plain(pairs, sets, needed)

    monkeypatch.setattr(meeting, "_verified", telling)
    own = {1: [1, 2, 3, 4, 5], 2: [11, 12, 13, 14, 15], 3: [11, 12, 13, 14, 16], 4: [1, 2, 3, 4, 6]}
    sets = spark.createDataFrame(list(own.items()), "node long, own array<long>")
    entries = spark.createDataFrame([(7, n, 9 - n, 5) for n in own], "slot long, node long, weight long, size int")
    roots = meeting.components_inside(entries, sets, lambda a, b: (a * 0 + 4).cast("int"))
    assert len(seen) == 2 and "SortMergeJoin" in seen[1] and "BroadcastHashJoin" not in seen[1]
    assert {tuple(r) for r in roots.collect()} == {(1, 1), (4, 1), (2, 2), (3, 2)}


def test_chains_in_a_large_class_take_no_walk_over_it():
    """60 pairs of a law that makes 47 150 terms equal; each walk over the class took a third of a second and more."""
    lhs, rhs = (0, 1, terms.OP), (2, 3, terms.OP)
    u = rewriting.Universe(5, 4)
    closed = rewriting.Closure(u, lhs, rhs)
    began = time.process_time()
    for t in range(40_000, 46_000, 100):
        chain = closed.chain(30 + t % 7, t)
        steps = [rewriting._tree(x) for x in chain]
        assert chain[0] == u.term(30 + t % 7) and chain[-1] == u.term(t)
        assert all(rewriting.is_step(rewriting._tree(lhs), rewriting._tree(rhs), a, b) for a, b in zip(steps, steps[1:], strict=False))
    assert time.process_time() - began < 8


@pytest.mark.parametrize("number", [8, 43, 168, 387, 3722, 4512])
def test_rounds_are_those_of_a_plain_closure(number):
    """each round merges what a search over all groups merges."""
    u = rewriting.Universe(3, 3)
    lhs, rhs = (tuple(map(int, x)) for x in law_of_number(number))
    closed = rewriting.Closure(u, lhs, rhs)
    label = list(range(len(u.ops)))

    def merged(groups):
        while True:
            before = list(label)
            for own in groups:
                least = min(label[x] for x in own)
                for old in {label[x] for x in own}:
                    label[:] = [least if x == old else x for x in label]
            if label == before:
                return

    by = {}
    for x, g in zip(closed.members.tolist(), closed.group.tolist(), strict=True):
        by.setdefault(g, []).append(x)
    rounds = [list(label)]
    while True:
        old, kinds = list(label), {}
        for x in range(3, len(label)):
            kinds.setdefault((old[u.left[x]], old[u.right[x]]), []).append(x)
        merged([*by.values(), *kinds.values()])
        if label == old:
            break
        rounds.append(list(label))
    assert [r.tolist() for r in closed.rounds] == rounds


def test_only_tables_that_changed_are_gone_through_again(monkeypatch):
    """of 41 partial tables 40 are whole from the start."""
    n, m, rows, plain = 3, 4, [], models._sides

    def counting(postfix, values, flat, size):
        rows.append(len(flat))
        return plain(postfix, values, flat, size)

    monkeypatch.setattr(models, "_sides", counting)
    lhs, rhs = [0, 1, terms.OP], [1, 0, terms.OP]
    inner = [i * m + j for i in range(n) for j in range(n)]
    flat = np.full((41, m * m), n)
    flat[:, inner] = np.array([0, 1, 2, 1, 2, 0, 2, 0, 1])
    flat[40, [1, 2, 6]] = n  # the upper half of a commutative table
    got = models.propagated(flat, lhs, rhs, n)
    assert (got[:, inner] == [0, 1, 2, 1, 2, 0, 2, 0, 1]).all() and len(got) == 41
    assert sum(rows) == 2 * (41 + 1)
    wrong = flat.copy()
    wrong[7, 1] = 0
    assert len(models.propagated(wrong, lhs, rhs, n)) == 40


def test_linear_tables_by_their_forms():
    """a law holds in a linear table exactly if all values say so."""
    for number in [1, 2, 3, 8, 43, 46, 168, 387, 1571, 2744, 3722, 4512, 4694]:
        lhs, rhs = (tuple(map(int, x)) for x in law_of_number(number))
        for n in (2, 3, 4, 5):
            assert (models.linear_holds(lhs, rhs, n) == law_holds(list(lhs), list(rhs), models.linear_models(n), n)).all()
