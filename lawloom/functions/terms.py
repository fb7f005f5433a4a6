"""Terms as postfix arrays, and the functions on them as Column expressions.

A side of an equation is an ``array<int>``: a number from 0 names a variable by
its place in ``names array<string>``, -1 is the operation applied to the two
terms before it.  An equation is three columns or fields, ``names, lhs, rhs``.
Everything here is a composition of Spark's own array functions, so it stays in
the JVM.  Lambdas are interpreted per element: apply these to tables of
distinct laws or texts and join the result to large tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

OP = -1
#: The operation's sign, and variable letters by first appearance.  Fixed values.
SIGN = "◇"
LETTERS = "xyzwuvtsrqpn"
#: Letters of the second dialect; past their end a number follows.  Fixed values.
DIALECT_LETTERS = "xyzwuvrst"

Leaf = Callable[[Column], Column]
Node = Callable[[Column, Column], Column]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it.

    Column expressions are trees: a value named twice, or inside a lambda, is
    computed again each time.  As a lambda's own variable it is not.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def order(term: Column) -> Column:
    """Number of operations."""
    return F.size(F.filter(term, lambda t: t == OP))


def leaves(term: Column) -> Column:
    """The variables of a term, left to right, with repeats."""
    return F.filter(term, lambda t: t != OP)


def variables(lhs: Column, rhs: Column) -> Column:
    """Distinct variables in order of first appearance, left side first."""
    return F.array_distinct(F.concat(leaves(lhs), leaves(rhs)))


def renumber(lhs: Column, rhs: Column) -> Column:
    """``struct<lhs, rhs>`` with variables numbered by first appearance."""

    def numbered(seen: Column) -> Column:
        def side(term: Column) -> Column:
            return F.transform(term, lambda t: F.when(t == OP, F.lit(OP)).otherwise((F.array_position(seen, t) - 1).cast("int")))

        return F.struct(side(lhs).alias("lhs"), side(rhs).alias("rhs"))

    return let(variables(lhs, rhs), numbered)


def letters(n: Column | int = 12, alphabet: str = LETTERS) -> Column:
    """The first ``n`` letters as an array of names."""
    return F.slice(F.array(*map(F.lit, alphabet)), 1, n)


def dialect_name(slot: Column) -> Column:
    """A variable's name in the second dialect: letters first, then letters with a number."""
    size = len(DIALECT_LETTERS)
    letter = F.substring(F.lit(DIALECT_LETTERS), 1, size)
    letter = F.substr(letter, (slot % size + 1).cast("int"), F.lit(1))
    turn = F.floor(slot / size).cast("int")
    return F.when(turn == 0, letter).otherwise(F.concat(letter, turn.cast("string")))


def fold(term: Column, leaf: Leaf, node: Node, kind: str) -> Column:
    """Evaluate a postfix term with a stack of ``kind`` values.

    ``leaf`` maps a variable's number to a value, ``node`` joins the values of
    an operation's two arguments.
    """
    stack = f"array<{kind}>"

    def step(st: Column, t: Column) -> Column:
        joined = F.concat(F.slice(st, F.lit(1), F.size(st) - 2), F.array(node(F.element_at(st, -2), F.element_at(st, -1))).cast(stack))
        return F.when(t == OP, joined).otherwise(F.concat(st, F.array(leaf(t)).cast(stack)))

    return F.element_at(F.aggregate(term, F.array().cast(stack), step), 1)


def render_with(term: Column, names: Column, inner: Node, nest: Callable[[Column], Column] | None = None, leaf: Leaf | None = None) -> Column:
    """Spell a term: ``inner`` joins two spelled arguments, ``nest`` wraps an operation that is an argument."""
    name = leaf or (lambda t: t)
    part = "struct<text: string, op: boolean>"
    wrap = nest or (lambda s: s)

    def argument(p: Column) -> Column:
        return F.when(p["op"], wrap(p["text"])).otherwise(p["text"])

    spelled = fold(
        term,
        lambda t: F.struct(name(F.get(names, t)).alias("text"), F.lit(False).alias("op")),
        lambda a, b: F.struct(inner(argument(a), argument(b)).alias("text"), F.lit(True).alias("op")),
        part,
    )
    return spelled["text"]


def _joined(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def infix(term: Column, names: Column) -> Column:
    """The canonical spelling of one side: nested operations in parentheses, the outermost bare."""
    return render_with(term, names, lambda a, b: _joined(a, f" {SIGN} ", b), lambda s: _joined("(", s, ")"))


def render(lhs: Column, rhs: Column, names: Column) -> Column:
    """The canonical spelling of an equation."""
    return _joined(infix(lhs, names), " = ", infix(rhs, names))


def normalized(lhs: Column, rhs: Column) -> Column:
    """The equation's text with letters by first appearance; null beyond twelve variables."""
    both = F.struct(renumber(lhs, rhs).alias("t"), letters().alias("names"))
    text = let(both, lambda b: render(b["t"]["lhs"], b["t"]["rhs"], b["names"]))
    return F.when(F.size(variables(lhs, rhs)) <= len(LETTERS), text)


def canonical_key(lhs: Column, rhs: Column) -> Column:
    """One text per law: the lesser of both orientations' normalized texts by code point."""
    return F.least(normalized(lhs, rhs), normalized(rhs, lhs))


def mirror(term: Column) -> Column:
    """The term with the arguments of every operation swapped."""
    return fold(term, lambda t: F.array(t), lambda a, b: F.concat(b, a, F.array(F.lit(OP))), "array<int>")


def shape_bits(term: Column) -> Column:
    """The tree without its variables, in preorder: 1 for an operation, 0 for a leaf."""
    return fold(term, lambda t: F.lit("0"), lambda a, b: _joined("1", a, b), "string")


def preorder_sides(tokens: Column) -> Column:
    """``array<array<string>>`` of postfix terms from a preorder token list; operations are spelled ``SIGN``.

    Two complete terms give two entries; anything else cannot be a pair of sides.
    """
    kind = "array<array<string>>"

    def step(st: Column, t: Column) -> Column:
        both = F.concat(F.coalesce(F.get(st, F.lit(0)), F.array().cast("array<string>")), F.coalesce(F.get(st, F.lit(1)), F.array().cast("array<string>")), F.array(t))
        joined = F.concat(F.array(both), F.slice(st, F.lit(3), F.greatest(F.size(st) - 2, F.lit(0))))
        return F.when((t == SIGN) & (F.size(st) >= 2), joined).otherwise(F.concat(F.array(F.array(t)), st)).cast(kind)

    return F.aggregate(F.reverse(tokens), F.array().cast(kind), step)


def encode(lhs: Column, rhs: Column) -> Column:
    """``struct<names, lhs, rhs>`` from two postfix token lists of names and ``SIGN``."""

    def numbered(v: Column) -> Column:
        def side(term: Column) -> Column:
            return F.transform(term, lambda t: F.when(t == SIGN, F.lit(OP)).otherwise((F.array_position(v["names"], t) - 1).cast("int")))

        return F.struct(v["names"].alias("names"), side(v["lhs"]).alias("lhs"), side(v["rhs"]).alias("rhs"))

    names = F.array_distinct(F.filter(F.concat(lhs, rhs), lambda t: t != SIGN))
    return let(F.struct(lhs.alias("lhs"), rhs.alias("rhs"), names.alias("names")), numbered)
