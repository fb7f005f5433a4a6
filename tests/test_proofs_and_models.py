"""Rewriting proofs and searched tables: each checked by other means, and neither ever against the other."""

from __future__ import annotations

import random
from itertools import product

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lawloom.functions import terms
from lawloom.operators import evidence, magmas, models, rewriting, verdicts
from lawloom.operators.catalogue import law_number, law_of_number, laws

OP = terms.OP
GROUPED_RIGHT = law_number((0,), (0, 1, 2, OP, OP))  # x = x * (y * z)
GROUPED_LEFT = law_number((0,), (0, 1, OP, 2, OP))  # x = (x * y) * z


def tree_of(term):
    return rewriting._tree(tuple(term))


def one_step(lhs, rhs, a):
    """All trees one replacement from ``a``, new variables standing for a's own variables: written for these tests."""
    found = set()
    names = sorted(set(t for t in flat(a) if t != "*"))
    for one, two in ((lhs, rhs), (rhs, lhs)):
        values = {}
        if fit(one, a, values):
            free = [v for v in set(flat(two)) - {"*"} if v not in values]
            for some in product(names, repeat=len(free)):
                found.add(put(two, values | dict(zip(free, some, strict=True))))
    if isinstance(a, tuple):
        found |= {(x, a[1]) for x in one_step(lhs, rhs, a[0])} | {(a[0], x) for x in one_step(lhs, rhs, a[1])}
    return found


def flat(t):
    return ["*", *flat(t[0]), *flat(t[1])] if isinstance(t, tuple) else [t]


def fit(p, t, values):
    if not isinstance(p, tuple):
        return values.setdefault(p, t) == t
    return isinstance(t, tuple) and fit(p[0], t[0], values) and fit(p[1], t[1], values)


def put(p, values):
    return tuple(put(x, values) for x in p) if isinstance(p, tuple) else values[p]


def test_universe_counts_and_numbers():
    for names, depth in ((1, 4), (2, 3), (3, 2)):
        u = rewriting.Universe(names, depth)
        every = [u.term(x) for x in range(len(u.ops))]
        assert len(set(every)) == len(every) and [u.number(t) for t in every] == list(range(len(every)))
        assert [t.count(OP) for t in every] == u.ops.tolist() and u.number(every[-1] + (0, OP)) == -1


def test_matching_by_trees():
    u = rewriting.Universe(2, 3)
    for pattern in ((0, 0, OP), (0, 1, OP, 0, OP), (0,), (0, 1, OP, 2, 0, OP, OP)):
        found, bound = u.matched(pattern)
        want = {}
        for x in range(len(u.ops)):
            values = {}
            if fit(tree_of(pattern), tree_of(u.term(x)), values):
                want[x] = values
        assert found.tolist() == sorted(want)
        for v, own in bound.items():
            assert [tree_of(u.term(y)) for y in own] == [want[x][v] for x in found.tolist()]


@pytest.mark.parametrize("number", [GROUPED_RIGHT, 3, 43, 65, 387, 4512, 3744, 2000])
def test_closure_holds_all_that_steps_reach(number):
    """All that breadth-first replacement inside the universe joins is joined, and what is joined replays and holds in all tables."""
    lhs, rhs = map(tuple, law_of_number(number))
    u = rewriting.Universe(2, 4)
    closed = rewriting.Closure(u, lhs, rhs)
    trees = {tree_of(u.term(x)): x for x in range(len(u.ops))}
    for t, x in trees.items():
        for other in one_step(tree_of(lhs), tree_of(rhs), t):
            if other in trees:
                assert closed.equal(x, trees[other])
    rng, label = random.Random(number), closed.rounds[-1]
    flat_tables = magmas.all_tables(3)
    models_of = flat_tables[magmas.law_holds(list(lhs), list(rhs), flat_tables, 3)]
    for _ in range(60):
        s = rng.randrange(len(label))
        t = rng.choice(np.flatnonzero(label == label[s]).tolist())
        chain = closed.chain(s, t)
        assert chain[0] == u.term(s) and chain[-1] == u.term(t)
        assert all(tree_of(b) in one_step(tree_of(lhs), tree_of(rhs), tree_of(a)) or rewriting.is_step(tree_of(lhs), tree_of(rhs), tree_of(a), tree_of(b)) for a, b in zip(chain, chain[1:], strict=False))
        if len(models_of):
            assert magmas.law_holds(list(chain[0]), list(chain[-1]), models_of, 3).all()


def test_false_steps_are_refused():
    h = tree_of((0, 1, OP)), tree_of((1, 0, OP))
    assert rewriting.is_step(*h, ((1, 2), 3), ((2, 1), 3)) and rewriting.is_step(*h, ((1, 2), 3), (3, (1, 2)))
    assert not rewriting.is_step(*h, ((1, 2), 3), ((2, 1), 4)) and not rewriting.is_step(*h, ((1, 2), 3), (3, (2, 1))) and not rewriting.is_step(*h, 1, 2)


def test_proofs_of_pairs(spark):
    rows = [(GROUPED_RIGHT, GROUPED_LEFT), (GROUPED_LEFT, GROUPED_RIGHT), (43, 4512), (2, 43), (43, 1), (None, 3), (3, None), (3, 99999), (43, 1), (4, 4)]
    pairs = spark.createDataFrame(rows, "hyp int, concl int").withColumn("h", F.lit(1))
    got = rewriting.replayed(rewriting.proofs(pairs.drop("h"), laws(spark)), laws(spark)).collect()
    told = {(r["hyp"], r["concl"]): (r["proved"], r["valid"]) for r in got}
    assert len(got) == len(rows)
    assert told[GROUPED_RIGHT, GROUPED_LEFT] == told[2, 43] == told[43, 1] == told[4, 4] == (True, True)
    assert all(told[p] == (None, None) for p in ((GROUPED_LEFT, GROUPED_RIGHT), (43, 4512), (None, 3), (3, None), (3, 99999)))
    assert rewriting.proofs(pairs.select("hyp", "concl").where("false"), laws(spark)).count() == 0


@pytest.fixture(scope="module")
def some_pairs(spark):
    rng = random.Random(8)
    rows = {(rng.randrange(1, 4695), rng.randrange(1, 4695)) for _ in range(400)}
    return spark.createDataFrame(sorted(rows), "hyp int, concl int")


def test_proofs_never_meet_a_table(spark, some_pairs):
    """Nothing is both proved and refuted, and everything one-step rules prove is proved."""
    told = evidence.with_status(rewriting.proofs(some_pairs, laws(spark)), evidence.derive(spark), "hyp", "concl", "status")
    rows = told.collect()
    assert not [r for r in rows if r["proved"] and r["status"] == evidence.PROOF_FALSE]
    assert all(r["proved"] for r in rows if r["status"] == evidence.PROOF_TRUE)
    assert any(r["proved"] and r["status"] == evidence.UNKNOWN for r in rows)
    both = models.counterexamples(some_pairs, laws(spark)).join(told.select("hyp", "concl", "proved"), ["hyp", "concl"])
    assert both.where("witness is not null and proved").count() == 0


def test_search_is_whole_at_size_2_and_sound_at_4():
    for number in (3, 43, 65, 387, 4512, 1000, 2500):
        lhs, rhs = map(list, law_of_number(number))
        every = magmas.all_tables(2)
        want = every[magmas.law_holds(lhs, rhs, every, 2)]
        got = models.find_models(lhs, rhs, 2, batches=10**6, enough=10**9)
        assert sorted(map(tuple, got.tolist())) == sorted(map(tuple, want.tolist()))
        assert magmas.law_holds(lhs, rhs, models.find_models(lhs, rhs, 4), 4).all()


def test_propagation_loses_no_model():
    """Whatever completes a partial table completes what propagation makes of it."""
    lhs, rhs = map(list, law_of_number(4512))
    every = magmas.all_tables(2)
    want = every[magmas.law_holds(lhs, rhs, every, 2)]
    inner = [0, 1, 3, 4]
    for cells in product((0, 1, 2), repeat=4):
        flat_table = np.full((1, 9), 2, np.int64)
        flat_table[0, inner] = cells
        fits = [t for t in want.tolist() if all(c in (2, x) for c, x in zip(cells, t, strict=True))]
        left = models.propagated(flat_table, lhs, rhs, 2)
        assert fits == [] or (len(left) == 1 and all(all(c in (2, x) for c, x in zip(left[0, inner].tolist(), t, strict=True)) for t in fits))


def test_tables_by_sql(spark, some_pairs):
    """Each table found satisfies the hypothesis and not the conclusion, by SQL that knows only the table and the laws' texts."""
    known = evidence.with_status(some_pairs, evidence.derive(spark), "hyp", "concl", "status").where("status <> 1").drop("status")
    found = models.refuted(models.counterexamples(known, laws(spark)), laws(spark)).where("witness is not null").collect()
    assert len(found) > 50 and all(r["valid"] for r in found) and {r["witness"]["n"] for r in found} >= {4}
    con = duckdb.connect()

    def fails(number, n, tab):
        lhs, rhs = law_of_number(number)

        def said(term):
            stack = []
            for t in term:
                stack.append(f"{tab}[{stack.pop(-2)} * {n} + {stack.pop()} + 1]" if t == OP else f"v{t}")
            return stack[0]

        names = ", ".join(f"range({n}) AS t{v}(v{v})" for v in sorted({*lhs, *rhs} - {OP}))
        return con.execute(f"SELECT count(*) FROM {names} WHERE {said(lhs)} <> {said(rhs)}").fetchone()[0]

    for r in found[:40]:
        n, tab = r["witness"]["n"], r["witness"]["tab"]
        assert fails(r["hyp"], n, tab) == 0 and fails(r["concl"], n, tab) > 0


def test_settled_labels(spark):
    rows = [(1, GROUPED_RIGHT, GROUPED_LEFT), (2, GROUPED_LEFT, GROUPED_RIGHT), (3, 43, 43), (4, None, 43), (5, 43, 4512), (5, 43, 4512)]
    pairs = spark.createDataFrame(rows, "k int, intended int, generated int")
    before = {r["k"]: r["label"] for r in verdicts.verdict_pairs(pairs, evidence.derive(spark)).collect()}
    after = verdicts.settled_pairs(pairs, evidence.derive(spark), laws(spark)).collect()
    assert before[1] == before[2] == "unknown" and len(after) == len(rows)
    assert {r["k"]: r["label"] for r in after} == {1: "weaker", 2: "stronger", 3: "equal", 4: "unknown", 5: "incomparable"}
    assert verdicts.settled_pairs(pairs.where("false"), evidence.derive(spark), laws(spark)).count() == 0
