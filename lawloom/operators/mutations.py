"""Controlled changes of a law, to see whether a metric notices them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms

KINDS = ("merge_variables", "fresh_variable", "delete_subtree", "regroup", "swap_arguments", "flip_sides")


def merge_variables(lhs: Column, rhs: Column) -> Column:
    """The last variable becomes the first: an instance, so weaker or equal."""
    last = F.array_max(F.concat(lhs, rhs))
    side = lambda t: F.transform(t, lambda x: F.when((x == last) & (x > 0), F.lit(0)).otherwise(x))
    return F.struct(side(lhs).alias("lhs"), side(rhs).alias("rhs"))


def fresh_variable(lhs: Column, rhs: Column) -> Column:
    """The right side's last leaf gets a name of its own: the law becomes an instance of the result."""
    fresh = F.array_max(F.concat(lhs, rhs)) + 1
    last = F.array_max(F.transform(rhs, lambda x, i: F.when(x != terms.OP, i)))
    return F.struct(lhs.alias("lhs"), F.transform(rhs, lambda x, i: F.when(i == last, fresh).otherwise(x)).alias("rhs"))


def delete_subtree(lhs: Column, rhs: Column) -> Column:
    """The right side's outermost operation is replaced by its first argument."""
    first = terms.fold(
        rhs,
        lambda t: F.struct(F.array(t).alias("whole"), F.array(t).alias("first")),
        lambda a, b: F.struct(F.concat(a["whole"], b["whole"], F.array(F.lit(terms.OP))).alias("whole"), a["whole"].alias("first")),
        "struct<whole: array<int>, first: array<int>>",
    )["first"]
    return F.struct(lhs.alias("lhs"), first.alias("rhs"))


def regroup(lhs: Column, rhs: Column) -> Column:
    """The right side's leaves in order, all grouped from the left."""
    leaves = terms.leaves(rhs)
    grouped = F.aggregate(
        F.slice(leaves, F.lit(2), F.size(leaves) - 1), F.slice(leaves, 1, 1), lambda acc, x: F.concat(acc, F.array(x, F.lit(terms.OP)))
    )
    return F.struct(lhs.alias("lhs"), grouped.alias("rhs"))


def swap_arguments(lhs: Column, rhs: Column) -> Column:
    """Every operation of the right side takes its arguments the other way round."""
    return F.struct(lhs.alias("lhs"), terms.mirror(rhs).alias("rhs"))


def flip_sides(lhs: Column, rhs: Column) -> Column:
    """The same law."""
    return F.struct(rhs.alias("lhs"), lhs.alias("rhs"))


def mutated(laws_df: DataFrame) -> DataFrame:
    """``(node, kind, text, mutant_key)``: every law under every change, spelled, with the key to look it up by."""
    lhs, rhs = F.col("lhs"), F.col("rhs")
    made = F.array(*(F.struct(F.lit(k).alias("kind"), globals()[k](lhs, rhs).alias("eq")) for k in KINDS))
    each = laws_df.select("node", F.explode(made).alias("m")).select("node", "m.kind", "m.eq.lhs", "m.eq.rhs")
    return each.select("node", "kind", terms.normalized(lhs, rhs).alias("text"), terms.canonical_key(lhs, rhs).alias("mutant_key"))
