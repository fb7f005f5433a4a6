"""The neighbour join against the edit distance of forests by plain recursion, over all pairs."""

from __future__ import annotations

from functools import cache

from lawloom.functions import terms
from lawloom.operators import nearby
from lawloom.operators.catalogue import law_of_number

OP = terms.OP
#: All laws of up to two operations, and some longer ones.
SMALL = [*range(1, 47), 47, 50, 307, 387, 4512, 4694]


def tree(term):
    stack = []
    for t in term:
        if t == OP:
            b, a = stack.pop(), stack.pop()
            stack.append(("o", (a, b)))
        else:
            stack.append((t, ()))
    return stack[0]


def renamed_in_order(a, b):
    seen = {}
    for t in (*a, *b):
        if t != OP:
            seen.setdefault(t, len(seen))
    return tuple(tree([t if t == OP else seen[t] for t in s]) for s in (a, b))


@cache
def weight(forest):
    return sum(1 + weight(kids) for _, kids in forest)


@cache
def distance(f, g):
    if not f or not g:
        return weight(f) + weight(g)
    (a, below_a), (b, below_b) = f[-1], g[-1]
    return min(
        distance(f[:-1] + below_a, g) + 1,
        distance(f, g[:-1] + below_b) + 1,
        distance(f[:-1], g[:-1]) + distance(below_a, below_b) + (a != b),
    )


def plain(m, n):
    (a, b), (c, d) = law_of_number(m), law_of_number(n)
    return min(distance(f, g) for f in (renamed_in_order(a, b), renamed_in_order(b, a)) for g in (renamed_in_order(c, d), renamed_in_order(d, c)))


def table(spark, numbers):
    rows = [(n, *map(list, law_of_number(n))) for n in numbers]
    return spark.createDataFrame(rows, "node int, lhs array<int>, rhs array<int>")


def test_all_pairs(spark):
    laws = table(spark, SMALL)
    want = {(m, n): plain(m, n) for m in SMALL for n in SMALL}
    for radius in (1, 2):
        got = nearby.within(laws, laws, radius).collect()
        assert len(got) == len({(r["id"], r["other"]) for r in got})
        assert {(r["id"], r["other"]): r["distance"] for r in got} == {p: d for p, d in want.items() if d <= radius}


def test_nearest_grows_its_radius(spark):
    some = [1, 2, 3, 43, 4512]
    got = {}
    for r in nearby.nearest(table(spark, some), table(spark, some), 2).collect():
        got.setdefault(r["id"], set()).add((r["other"], r["distance"]))
    want = {}
    for m in some:
        ranked = sorted((plain(m, n), n) for n in some if n != m)
        if ranked[0][0] <= 2:
            want[m] = {(n, d) for d, n in ranked if d == ranked[0][0]}
    assert got == want and {d for s in got.values() for _, d in s} == {1, 2}


def test_nulls_repeats_and_empty(spark):
    rows = [(1, [0], [0]), (1, [0], [0]), (2, [5], [7]), (None, [0], [1]), (3, None, [0]), (4, [0], None)]
    odd = spark.createDataFrame(rows, "node int, lhs array<int>, rhs array<int>").selectExpr("*", "1 AS id", "2 AS other", "3 AS variant", "4 AS cut")
    assert {tuple(r) for r in nearby.within(odd, odd, 1).collect()} == {(1, 1, 0), (2, 2, 0), (1, 2, 1), (2, 1, 1)}
    assert nearby.within(odd.limit(0), odd, 2).count() == nearby.nearest(odd, odd.limit(0), 1).count() == 0
