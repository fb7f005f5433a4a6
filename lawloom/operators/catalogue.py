"""The catalogue of laws: every identity of a given order, once, numbered.

Laws are generated, not read: shapes (binary trees) and rhymes (restricted
growth strings, the pattern of equal variables) are small dimensions, a law is
a pair of shapes and a rhyme, and symmetric repeats are filtered out.  The
number of a law is its rank by total order, shapes, then rhyme.
"""

from __future__ import annotations

from functools import cache
from math import comb
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import terms

MAX_ORDER = 4
CATALOGUE_SIZE = 4694
_kept: WeakKeyDictionary[SparkSession, dict[int, DataFrame]] = WeakKeyDictionary()


@cache
def shape_list(order: int) -> tuple[tuple[int, ...], ...]:
    """Postfix templates of all trees with ``order`` operations, smaller left arguments first; leaves are 0."""
    if order == 0:
        return ((0,),)
    return tuple(
        left + right + (terms.OP,) for k in range(order) for left in shape_list(k) for right in shape_list(order - 1 - k)
    )


def shapes(spark: SparkSession, max_order: int = MAX_ORDER) -> DataFrame:
    """``(ord, rank, template, bits)``: trees by order; the template numbers leaves from the left."""
    rows = []
    for n in range(max_order + 1):
        for rank, postfix in enumerate(shape_list(n)):
            leaf = iter(range(n + 1))
            rows.append((n, rank, [terms.OP if t == terms.OP else next(leaf) for t in postfix]))
    out = spark.createDataFrame(rows, "ord int, rank int, template array<int>")
    return out.withColumn("bits", terms.shape_bits(F.col("template")))


def rhymes(spark: SparkSession, length: int) -> DataFrame:
    """``(rhyme array<int>)``: restricted growth strings, one step of growth per join-free explode."""
    out = spark.range(1).select(F.array(F.lit(0)).alias("rhyme"))
    for _ in range(length - 1):
        grown = F.explode(F.sequence(F.lit(0), F.array_max("rhyme") + 1))
        out = out.select("rhyme", grown.alias("n")).select(F.concat("rhyme", F.array("n")).alias("rhyme"))
    return out


def _canonical(rhyme: Column) -> Column:
    """Renumber a rhyme by first appearance."""
    seen = F.array_distinct(rhyme)
    return F.transform(rhyme, lambda t: (F.array_position(seen, t) - 1).cast("int"))


def _of_order(spark: SparkSession, trees: DataFrame, n: int) -> DataFrame:
    left = trees.select(F.col("ord").alias("lhs_ord"), F.col("rank").alias("lhs_rank"), F.col("template").alias("l"))
    right = trees.select(F.col("ord").alias("rhs_ord"), F.col("rank").alias("rhs_rank"), F.col("template").alias("r"))
    fits = (F.col("lhs_ord") + F.col("rhs_ord") == n) & (F.col("lhs_ord") <= F.col("rhs_ord"))
    fits &= (F.col("lhs_ord") < F.col("rhs_ord")) | (F.col("lhs_rank") <= F.col("rhs_rank"))
    # Dimensions of at most some hundred rows: every shape pair takes every rhyme.
    pairs = F.broadcast(left.join(right, fits))
    laws = rhymes(spark, n + 2).join(pairs, F.lit(True))
    cut = F.col("lhs_ord") + 1
    turned = F.concat(F.slice("rhyme", cut + 1, F.size("rhyme") - cut), F.slice("rhyme", F.lit(1), cut))
    even = (F.col("lhs_ord") == F.col("rhs_ord")) & (F.col("lhs_rank") == F.col("rhs_rank"))
    repeat = even & ((_canonical(turned) < F.col("rhyme")) | ((turned == F.col("rhyme")) & F.lit(n > 0)))
    fill = lambda tree, skip: F.transform(tree, lambda t: F.when(t == terms.OP, F.lit(terms.OP)).otherwise(F.get("rhyme", t + skip)))
    return laws.where(~repeat).select(
        F.lit(n).alias("ord"), "lhs_ord", "lhs_rank", "rhs_ord", "rhs_rank", "rhyme",
        fill(F.col("l"), F.lit(0)).alias("lhs"), fill(F.col("r"), cut).alias("rhs"),
    )


def generated(spark: SparkSession, max_order: int = MAX_ORDER) -> DataFrame:
    """The laws' numbers, shapes, rhymes and sides, made as a distributed plan; for orders with many laws."""
    trees = shapes(spark, max_order)
    every = None
    for n in range(max_order + 1):
        part = _of_order(spark, trees, n)
        every = part if every is None else every.unionByName(part)
    # Numbers within a block of shapes come from a window over the block; blocks are few and their sizes are summed.
    block = ["ord", "lhs_ord", "lhs_rank", "rhs_rank"]
    ranked = every.withColumn("place", F.row_number().over(W.partitionBy(*block).orderBy("rhyme")))
    sizes = ranked.groupBy(*block).agg(F.count("*").alias("size"))
    before = sizes.withColumn("before", F.sum("size").over(W.orderBy(*block)) - F.col("size")).drop("size")
    numbered = ranked.join(F.broadcast(before), block).withColumn("node", (F.col("before") + F.col("place")).cast("int"))
    return numbered.select("node", "ord", "lhs_ord", "lhs_rank", "rhs_ord", "rhs_rank", "rhyme", "lhs", "rhs")


def spelled(numbered: DataFrame) -> DataFrame:
    """Numbered sides with the law's text, key and names."""
    n_vars = F.size(terms.variables(F.col("lhs"), F.col("rhs")))
    names = terms.letters(n_vars)
    return numbered.select(
        "node",
        terms.render(F.col("lhs"), F.col("rhs"), terms.letters()).alias("formal"),
        terms.canonical_key(F.col("lhs"), F.col("rhs")).alias("canonical_key"),
        "ord", n_vars.alias("n_vars"), names.alias("variables"), names.alias("names"), "lhs", "rhs",
    )


def laws(spark: SparkSession, max_order: int = MAX_ORDER) -> DataFrame:
    """``node, formal, canonical_key, ord, n_vars, variables, names, lhs, rhs``.

    The result has a fixed size for each ``max_order`` (4694 rows for 4) and is
    kept in memory, once per session, because most operators join it.  Up to
    order 4 the sides are counted out on the driver; more are generated in Spark.
    """
    kept = _kept.setdefault(spark, {})
    if max_order not in kept:
        if max_order <= MAX_ORDER:
            sides = (law_of_number(k) for k in range(1, sum(map(law_count, range(max_order + 1))) + 1))
            rows = [(k, sum(t == terms.OP for t in a + b), list(a), list(b)) for k, (a, b) in enumerate(sides, 1)]
            numbered = spark.createDataFrame(rows, "node int, ord int, lhs array<int>, rhs array<int>")
            numbered = numbered.repartition(min(16, spark.sparkContext.defaultParallelism), "node")
        else:
            numbered = generated(spark, max_order)
        kept[max_order] = spelled(numbered).cache()
    return kept[max_order]


def dual(laws_df: DataFrame) -> DataFrame:
    """``(node, dual_node)``: the law whose operation takes its arguments the other way round."""
    turned = laws_df.select("node", terms.canonical_key(terms.mirror(F.col("lhs")), terms.mirror(F.col("rhs"))).alias("key"))
    other = laws_df.select(F.col("node").alias("dual_node"), F.col("canonical_key").alias("key"))
    return turned.join(other, "key").select("node", "dual_node")


# -- Closed-form counts: how many laws there are, without making them.


@cache
def bell(n: int) -> int:
    """Restricted growth strings of length n."""
    return 1 if n == 0 else sum(comb(n - 1, k) * bell(k) for k in range(n))


@cache
def catalan(n: int) -> int:
    """Trees with n operations."""
    return comb(2 * n, n) // (n + 1)


@cache
def symmetric_rhymes(half: int) -> int:
    """Rhymes of two equal halves of ``half`` leaves that the swap of halves maps to themselves, up to renaming.

    The swap acts on the blocks of equal variables.  A block it keeps is a set
    of leaves in both halves at once; two blocks it exchanges cover the same
    leaf places, one in each half or mixed, which is 2 ** (size - 1) ways.
    """
    if half == 0:
        return 1
    total = 0
    for size in range(1, half + 1):  # the block that holds the first place
        total += comb(half - 1, size - 1) * (1 + 2 ** (size - 1)) * symmetric_rhymes(half - size)
    return total


def law_count(order: int) -> int:
    """Number of laws with ``order`` operations, by orbits of the swap of sides."""
    n = order
    pairs = sum(catalan(k) * catalan(n - k) for k in range(n + 1))
    even = catalan(n // 2) if n % 2 == 0 else 0
    rhymes_all = bell(n + 2)
    fixed = symmetric_rhymes(n // 2 + 1) if n % 2 == 0 else 0
    # Ordered pairs count twice what a law counts once, but for those that the swap maps to themselves.
    total = ((pairs - even) * rhymes_all + even * (rhymes_all + fixed)) // 2
    # Both sides the same term: a law of order 0 is kept, later ones say nothing.
    same = even * bell(n // 2 + 1) if n > 0 else 0
    return total - same


def law_counts(spark: SparkSession, max_order: int = MAX_ORDER) -> DataFrame:
    """``(ord, n_laws, first_node)`` from the closed form."""
    rows, first = [], 1
    for n in range(max_order + 1):
        rows.append((n, law_count(n), first))
        first += law_count(n)
    return spark.createDataFrame(rows, "ord int, n_laws long, first_node long")


# -- Numbers of laws of any order, by counting what comes before.


@cache
def _completions(length: int, used: int) -> int:
    """Ways to go on with a rhyme of ``used`` names for ``length`` more leaves."""
    return 1 if length == 0 else used * _completions(length - 1, used) + _completions(length - 1, used + 1)


def rhyme_rank(rhyme: tuple[int, ...]) -> int:
    """Place of a rhyme among all of its length, from 0."""
    rank, used = 0, 0
    for i, x in enumerate(rhyme):
        rank += x * _completions(len(rhyme) - i - 1, used)  # each lesser choice repeats a name in use
        used = max(used, x + 1)
    return rank


def rhyme_of_rank(length: int, rank: int) -> tuple[int, ...]:
    """Inverse of ``rhyme_rank``."""
    out, used = [], 0
    for left in range(length - 1, -1, -1):
        x = min(rank // _completions(left, used), used)
        rank -= x * _completions(left, used)
        out.append(x)
        used = max(used, x + 1)
    return tuple(out)


def _turned(rhyme: tuple[int, ...]) -> tuple[tuple[int, ...], bool]:
    """The rhyme with its halves swapped and renumbered, and whether the swap leaves it as it is."""
    half = len(rhyme) // 2
    raw = rhyme[half:] + rhyme[:half]
    seen: dict[int, int] = {}
    return tuple(seen.setdefault(x, len(seen)) for x in raw), raw == rhyme


def _counts(rhyme: tuple[int, ...], order: int) -> bool:
    turned, same = _turned(rhyme)
    return not (turned < rhyme or (same and order > 0))


@cache
def _symmetric_ranks(order: int) -> tuple[int, ...]:
    """Ranks of the rhymes that a law with two equal shapes can have, ascending."""
    n = order + 2
    return tuple(r for r in range(bell(n)) if _counts(rhyme_of_rank(n, r), order))


def _blocks(order: int):
    """Shape pairs of an order with how many laws each has, in the order of numbering."""
    for k in range(order // 2 + 1):
        for i in range(catalan(k)):
            for j in range(i if 2 * k == order else 0, catalan(order - k)):
                yield k, i, j, (len(_symmetric_ranks(order)) if 2 * k == order and i == j else bell(order + 2))


def law_number(lhs: tuple[int, ...], rhs: tuple[int, ...]) -> int:
    """Number of the law of two postfix sides, of any order; 0 for a tautology with an operation."""
    order = lhs.count(terms.OP) + rhs.count(terms.OP)
    bare = lambda t: tuple(x if x == terms.OP else 0 for x in t)
    spell = lambda a, b: tuple(x for x in a + b if x != terms.OP)
    place = lambda t: (t.count(terms.OP), shape_list(t.count(terms.OP)).index(bare(t)))

    def renumbered(r):
        seen: dict[int, int] = {}
        return tuple(seen.setdefault(x, len(seen)) for x in r)

    if lhs == rhs and order:
        return 0
    ways = sorted((place(a), place(b), renumbered(spell(a, b))) for a, b in ((lhs, rhs), (rhs, lhs)))
    (k, i), (_, j), rhyme = ways[0]
    number = sum(law_count(n) for n in range(order)) + 1
    for block in _blocks(order):
        if block[:3] == (k, i, j):
            rank = rhyme_rank(rhyme)
            return number + (_symmetric_ranks(order).index(rank) if 2 * k == order and i == j else rank)
        number += block[3]
    raise AssertionError("a law has a pair of shapes of its order")


def law_of_number(number: int) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """Postfix sides of the law with that number, of any order."""
    if number < 1:
        raise ValueError("laws are numbered from 1")
    order, left = 0, number - 1
    while left >= law_count(order):
        left -= law_count(order)
        order += 1
    for k, i, j, size in _blocks(order):
        if left < size:
            rank = _symmetric_ranks(order)[left] if 2 * k == order and i == j else left
            leaf = iter(rhyme_of_rank(order + 2, rank))
            return tuple(tuple(t if t == terms.OP else next(leaf) for t in shape) for shape in (shape_list(k)[i], shape_list(order - k)[j]))
        left -= size
    raise AssertionError("blocks cover an order")
