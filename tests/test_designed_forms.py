"""The ambiguous and the oriented form, against plain recursion."""

from __future__ import annotations

import random
from functools import cache

from pyspark.sql import functions as F

from lawloom.functions import terms
from lawloom.operators import ambiguous, orienting
from lawloom.operators.catalogue import law_number, law_of_number, laws

OP = terms.OP


@cache
def bracketings(names):
    if len(names) == 1:
        return [names[0]]
    return [(a, b) for k in range(1, len(names)) for a in bracketings(names[:k]) for b in bracketings(names[k:])]


def postfix(t):
    return postfix(t[0]) + postfix(t[1]) + (OP,) if isinstance(t, tuple) else (t,)


def tree(term):
    stack = []
    for t in term:
        stack.append((stack.pop(-2), stack.pop()) if t == OP else t)
    return stack[0]


def flat(t):
    return flat(t[0]) + flat(t[1]) if isinstance(t, tuple) else (t,)


def test_readings_of_all_laws(spark):
    every = laws(spark)
    texts = every.select("node", ambiguous.flat(F.col("lhs"), F.col("rhs"), F.col("names")).alias("text"))
    told = {r["text"]: (r["n_readings"], list(r["laws"])) for r in ambiguous.ambiguity(texts, "text").collect()}
    for r in texts.collect():
        left, right = (flat(tree(t)) for t in law_of_number(r["node"]))
        pairs = [(a, b) for a in bracketings(left) for b in bracketings(right)]
        numbers = {law_number(postfix(a), postfix(b)) for a, b in pairs} - {0}
        assert told[r["text"]] == (len(pairs), sorted(numbers)) and r["node"] in numbers


def test_charts_and_odd_texts(spark):
    rows = [("a ◇ b ◇ c ◇ d = e",), ("a = a",), (None,), ("",), ("a ◇ (b ◇ c) = a",), ("a = b = c",), ("a ◇ = b",), ("a ◇ b ◇ c ◇ d ◇ e = f ◇ g",)]
    df = spark.createDataFrame(rows, "t string").withColumn("s", ambiguous.sides(F.col("t")))
    got = df.select("t", ambiguous.chart(F.col("s.left")).alias("c"), ambiguous.tree_count(F.col("s.left")).alias("n")).collect()
    told = {r["t"]: ({tuple(x) for x in r["c"]} if r["c"] is not None else None, r["n"]) for r in got if r["t"]}
    four = {(s, k, m) for k in (2, 3, 4) for s in range(5 - k) for m in range(1, k)}
    assert told["a ◇ b ◇ c ◇ d = e"] == (four, 5) and told["a = a"] == (set(), 1) and len(four) == 4 * 3 * 5 // 6
    found = {(r["text"], r["node"]) for r in ambiguous.readings(df, "t").collect()}
    assert {t for t, _ in found} == {"a ◇ b ◇ c ◇ d = e", "a = a"} and ("a = a", 1) in found
    assert ambiguous.readings(df.where("false"), "t").count() == 0


def weight(t):
    return 1 + weight(t[0]) + weight(t[1]) if isinstance(t, tuple) else 1


def above(s, t):
    """The order by its definition."""
    if any(flat(s).count(v) < flat(t).count(v) for v in flat(t)):
        return False
    if weight(s) != weight(t):
        return weight(s) > weight(t)
    if not isinstance(s, tuple) or not isinstance(t, tuple):
        return False
    return above(s[0], t[0]) or (s[0] == t[0] and above(s[1], t[1]))


def test_order_is_its_definition(spark):
    for r in orienting.rules(laws(spark)).collect():
        a, b = (tree(t) for t in law_of_number(r["node"]))
        assert r["direction"] == ("right" if above(a, b) else "left" if above(b, a) else "unorientable"), r


def test_order_on_larger_terms_and_renaming(spark):
    rng = random.Random(6)

    def grown(n):
        if n == 0:
            return rng.randrange(3)
        k = rng.randrange(n)
        return (grown(k), grown(n - 1 - k))

    pairs = [(grown(n), grown(rng.choice([n, n, n - 1]))) for n in (3, 4, 5, 6, 7) for _ in range(60)]
    pairs += [(t, (t[0], grown(0)) if isinstance(t, tuple) and not isinstance(t[1], tuple) else t) for t, _ in pairs[:100]]
    rows = [(i, list(postfix(a)), list(postfix(b))) for i, (a, b) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "i int, a array<int>, b array<int>")
    other = lambda c: F.transform(c, lambda t: F.when(t == OP, t).otherwise(9 - t))
    got = df.select("i", orienting.greater(F.col("a"), F.col("b")).alias("g"), orienting.greater(other(F.col("a")), other(F.col("b"))).alias("h"))
    for r in got.collect():
        assert r["g"] == r["h"] == above(*pairs[r["i"]]), pairs[r["i"]]
