"""The oriented form: a law as a rewrite rule, if a reduction order says which side is the greater.

The order is Knuth's and Bendix's for one operation and weight 1 everywhere: a
term is greater than another if no variable occurs in it less often and it is
heavier, or as heavy and, from the left, its first different argument is
greater.  It does not look at names, so renaming turns no rule round.  Terms of
equal weight are compared along the pre-order walk, as a fold in the JVM: where
both walks agree so far, nothing is decided; the first place where they part
belongs to two subterms, whose sizes and variables decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms

RULE = "struct<direction:string,left:array<int>,right:array<int>>"


def _covers(a: Column, b: Column) -> Column:
    """No variable occurs in ``b`` more often than in ``a``."""
    count = lambda t, v: F.size(F.filter(t, lambda x: x == v))
    return F.forall(F.array_distinct(terms.leaves(b)), lambda v: count(a, v) >= count(b, v))


def _subterms(term: Column) -> Column:
    """The subterms in pre-order, each as its postfix array."""
    one = lambda t: F.array(F.array(t))
    joined = lambda a, b: F.concat(F.array(F.concat(F.get(a, F.lit(0)), F.get(b, F.lit(0)), F.array(F.lit(terms.OP)))), a, b)
    return terms.fold(term, one, joined, "array<array<int>>")


def greater(a: Column, b: Column) -> Column:
    """Whether term ``a`` is above ``b`` in the order.

    Of equally heavy terms the first pair of pre-order subterms, neither inside
    the other's walk, that differ in weight or kind decides; all pairs of subterms around it
    are as heavy as each other and must cover each other's variables, as each is compared in its turn.
    """

    def decided(x: Column, y: Column) -> Column:
        walk = F.arrays_zip(x.alias("p"), y.alias("q"))
        # As long as sizes agree the walks stay in step; the first pair of different sizes, or of different variables, ends them.
        apart = F.filter(walk, lambda w: (F.size(w["p"]) != F.size(w["q"])) | ((F.size(w["p"]) == 1) & (w["p"] != w["q"])))
        return F.get(apart, F.lit(0))

    def lower(x: Column, y: Column) -> Column:
        first = decided(x, y)
        heavier = F.coalesce(F.size(first["p"]) > F.size(first["q"]), F.lit(False)) & _covers(first["p"], first["q"])
        # Every pair on the way down to the first difference has it inside, and must cover too.
        walk = F.arrays_zip(x.alias("p"), y.alias("q"))
        until = F.array_position(F.transform(walk, lambda w: (F.size(w["p"]) != F.size(w["q"])) | ((F.size(w["p"]) == 1) & (w["p"] != w["q"]))), F.lit(True))
        around = F.filter(walk, lambda w, i: (i < until - 1) & (w["p"] != w["q"]) & (i + F.size(w["p"]) > until - 1))
        return heavier & F.forall(around, lambda w: _covers(w["p"], w["q"]))

    same = terms.let(F.struct(_subterms(a).alias("x"), _subterms(b).alias("y")), lambda s: lower(s["x"], s["y"]))
    return _covers(a, b) & ((F.size(a) > F.size(b)) | ((F.size(a) == F.size(b)) & same))


def oriented(lhs: Column, rhs: Column) -> Column:
    """``direction`` (``right``: left side to right side, ``left``, or ``unorientable``) and the rule's sides, null if there is none."""
    right, left = greater(lhs, rhs), greater(rhs, lhs)
    pair = lambda d, a, b: F.struct(F.lit(d).alias("direction"), a.alias("left"), b.alias("right"))
    none = F.lit(None).cast("array<int>")
    return F.when(right, pair("right", lhs, rhs)).when(left, pair("left", rhs, lhs)).otherwise(pair("unorientable", none, none))


def rules(laws_df: DataFrame) -> DataFrame:
    """``(node, direction, rule)`` of laws with ``node, lhs, rhs, names``; the rule's text has an arrow, null if there is no direction."""
    told = laws_df.withColumn("o", oriented(F.col("lhs"), F.col("rhs")))
    text = F.concat(terms.infix(F.col("o.left"), F.col("names")), F.lit(" → "), terms.infix(F.col("o.right"), F.col("names")))
    return told.select("node", F.col("o.direction").alias("direction"), F.when(F.col("o.left").isNotNull(), text).alias("rule"))
