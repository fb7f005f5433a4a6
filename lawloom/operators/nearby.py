"""Nearby laws: an exact neighbour join under tree edit distance, by shared variants instead of all pairs.

A law is the ordered forest of its two sides.  The distance of two laws is the
least number of nodes that are relabelled, deleted (their arguments move up) or
inserted to turn one forest into the other, the least over the order of the
sides of both; variables are numbered by first appearance.  The equality sign
stays where it is.

Relabelled nodes can be blanked on both sides, deleted ones left out of the
first law and inserted ones out of the second; what is left is equal.  So two
laws are within ``radius`` exactly if they share a variant with ``blanked``
nodes blanked, ``cut`` nodes left out of one and ``other_cut`` out of the other,
``blanked + cut + other_cut <= radius``; the least such sum is the distance.
Every joined row is therefore a pair of the result: nothing is verified and
thrown away.  A law with ``n`` nodes has about ``(2n) ** radius / radius!``
variants; radii of 1 and 2 are what this is made for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms
from ..sources.scratch import scratch

#: A node is one number: its depth times ``LEVEL``, and what it is: blank (0), an operation (1) or a variable (from 2).
LEVEL = 1 << 16


def _nodes(term: Column) -> Column:
    """The nodes of a term from the root, left to right."""
    deeper = lambda nodes: F.transform(nodes, lambda x: x + LEVEL)
    return terms.fold(term, lambda t: F.array(t + 2), lambda a, b: F.concat(F.array(F.lit(1)), deeper(a), deeper(b)), "array<int>")


def _forests(laws_df: DataFrame, key: str) -> DataFrame:
    """``(id, forest)``: each law once or twice, with its sides in both orders."""
    known = laws_df.select(F.col(key).alias("id"), "lhs", "rhs").where("id is not null and lhs is not null and rhs is not null").distinct()
    both = F.array(terms.renumber(F.col("lhs"), F.col("rhs")), terms.renumber(F.col("rhs"), F.col("lhs")))
    told = known.select("id", F.explode(F.array_distinct(both)).alias("t"))
    return told.select("id", F.concat(_nodes(F.col("t.lhs")), _nodes(F.col("t.rhs"))).alias("forest"))


def _edited(forest: Column, at: Column) -> tuple[Column, Column]:
    """The forest with one node blanked, and without it; what stood below it moves up."""
    node, before, after = F.get(forest, at), F.slice(forest, F.lit(1), at), F.slice(forest, at + 2, F.size(forest))
    level = node - node % LEVEL
    end = F.array_position(F.transform(after, lambda x: x < level + LEVEL), True)
    below = F.when(end == 0, F.size(after)).otherwise(end - 1).cast("int")
    up = F.concat(F.transform(F.slice(after, F.lit(1), below), lambda x: x - LEVEL), F.slice(after, below + 1, F.size(after)))
    return F.concat(before, F.array(level), after), F.concat(before, up)


def variants(laws_df: DataFrame, key: str, radius: int) -> DataFrame:
    """``(id, blanked, cut, variant)``: each law's forests with at most ``radius`` nodes blanked or left out, each once."""
    # Nodes are taken from the right, so that places further left stay what they are.
    fresh = _forests(laws_df, key).select("id", "forest", F.size("forest").alias("left"), F.lit(0).alias("blanked"), F.lit(0).alias("cut"))
    every = fresh
    for _ in range(radius):
        each = fresh.where("left > 0").withColumn("at", F.explode(F.sequence(F.lit(0), F.col("left") - 1)))
        blank, less = _edited(F.col("forest"), F.col("at"))
        ways = F.array(
            F.struct(blank.alias("forest"), (F.col("blanked") + 1).alias("blanked"), F.col("cut").alias("cut")),
            F.struct(less.alias("forest"), F.col("blanked").alias("blanked"), (F.col("cut") + 1).alias("cut")),
        )
        fresh = each.select("id", "at", F.explode(ways).alias("w")).select("id", "w.forest", F.col("at").alias("left"), "w.blanked", "w.cut")
        every = every.unionByName(fresh)
    return every.select("id", "blanked", "cut", F.col("forest").alias("variant")).distinct()


def within(queries: DataFrame, laws_df: DataFrame, radius: int, key: str = "node") -> DataFrame:
    """``(id, other, distance)``: all pairs of a query and a law within ``radius``, each once, a law and itself included.

    Both tables have ``key, lhs, rhs``; rows with a null there are nobody's
    neighbour, repeated rows count once.  A variant that many laws share gives
    rows of the result only, and adaptive execution can split it.
    """
    probes = variants(queries, key, radius).withColumn("other_cut", F.explode(F.sequence(F.lit(0), radius - F.col("blanked") - F.col("cut"))))
    index = variants(laws_df, key, radius).select(F.col("id").alias("other"), "blanked", F.col("cut").alias("other_cut"), "variant")
    met = probes.join(index, ["variant", "blanked", "other_cut"])
    return met.groupBy("id", "other").agg(F.min(F.col("blanked") + F.col("cut") + F.col("other_cut")).alias("distance"))


def nearest(queries: DataFrame, laws_df: DataFrame, most: int = 2, key: str = "node") -> DataFrame:
    """``(id, other, distance)``: the laws nearest to each query but itself, all that tie; a query with none within ``most`` has no row.

    The radius grows by one a round, for the queries only that found nothing.
    """
    spark, left, out = queries.sparkSession, queries.select(key, "lhs", "rhs"), None
    for radius in range(1, most + 1):
        path = scratch(spark, "nearest")
        within(left, laws_df, radius, key).where("distance > 0 and id <> other").write.parquet(path)
        found = spark.read.parquet(path)
        out = found if out is None else out.unionByName(found)
        left = left.join(found.select(F.col("id").alias(key)), key, "left_anti")
    return out
