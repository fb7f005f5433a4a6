"""The parenthesis-free form, which is ambiguous on purpose: a flat text and all laws it can be read as.

``x ◇ y ◇ z = w`` stands for every bracketing of its sides.  A flat side of n
names is the chart in which each span of two names or more splits at every
place; this packed forest has n (n - 1) (n + 1) / 6 splits, while the trees it holds are as
many as the Catalan numbers.  Trees are only made for the catalogue's few
shapes, as joins of distinct flat texts with the table of shapes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms
from .catalogue import MAX_ORDER, shapes
from .mapping import lookup_key

#: Splits of a span by its start and length: names are counted from 0, ``split`` names are on the left.
CHART = "array<struct<start:int,length:int,split:int>>"


def flat(lhs: Column, rhs: Column, names: Column) -> Column:
    """The law's text without any bracket."""
    side = lambda t: F.array_join(F.transform(terms.leaves(t), lambda v: F.get(names, v)), f" {terms.SIGN} ")
    return F.concat(side(lhs), F.lit(" = "), side(rhs))


def sides(text: Column) -> Column:
    """``struct<left, right>`` of name lists of a flat text; null unless it is two lists of names with one sign between."""
    parts = F.transform(F.split(text, " = ", -1), lambda s: F.split(s, f" {terms.SIGN} ", -1))
    name = rf"^[^\s{terms.SIGN}=()]+$"
    fine = (F.size(parts) == 2) & F.forall(F.flatten(parts), lambda n: F.rlike(n, F.lit(name)))
    return F.when(fine, F.struct(F.get(parts, F.lit(0)).alias("left"), F.get(parts, F.lit(1)).alias("right")))


def chart(names: Column) -> Column:
    """The packed forest of a flat side: every span of two names or more, with each place it can split at."""
    n = F.size(names)
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), lambda k: F.transform(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), lambda s: F.struct(s.alias("start"), k.alias("length")))))
    splits = F.flatten(F.transform(spans, lambda s: F.transform(F.sequence(F.lit(1), s["length"] - 1), lambda k: F.struct(s["start"].cast("int").alias("start"), s["length"].cast("int").alias("length"), k.cast("int").alias("split")))))
    return F.when(n >= 2, splits).otherwise(F.array().cast(CHART))


def tree_count(names: Column, most: int = 20) -> Column:
    """How many trees the forest of a flat side holds; null beyond ``most`` names, where the count leaves 64 bits soon after."""
    k = F.size(names) - 1
    grown = F.aggregate(F.sequence(F.lit(0), F.greatest(k, F.lit(1)) - 1), F.lit(1).cast("long"), lambda c, i: (c * 2 * (2 * i + 1) / (i + 2)).cast("long"))
    return F.when(F.size(names) <= most, F.when(k < 1, F.lit(1).cast("long")).otherwise(grown))


def readings(df: DataFrame, text: str, max_order: int = MAX_ORDER) -> DataFrame:
    """``(text, reading, node)``: every bracketing of each distinct flat text, and the catalogue's number of that law.

    ``reading`` is the law's normal form.  A reading that says the same on both
    sides has no number (null).  A text that is not flat, null or beyond
    ``max_order`` operations has no rows.  An empty table gives an empty result.
    """
    spark: SparkSession = df.sparkSession
    told = df.select(F.col(text).alias("text")).distinct().withColumn("s", sides(F.col("text"))).where("s is not null")
    told = told.withColumn("k", F.size("s.left") + F.size("s.right") - 2).where(F.col("k") <= max_order)
    names = F.array_distinct(F.concat("s.left", "s.right"))
    number = lambda side: F.transform(side, lambda x: (F.array_position(names, x) - 1).cast("int"))
    told = told.select("text", number(F.col("s.left")).alias("a"), number(F.col("s.right")).alias("b"))
    trees = F.broadcast(shapes(spark, max_order).select(F.col("ord"), "template"))  # 23 rows up to order 4
    put = lambda side, tree: F.transform(tree, lambda t: F.when(t == terms.OP, F.lit(terms.OP)).otherwise(F.get(side, t)))
    one = told.join(trees.toDF("n", "tree"), F.size("a") - 1 == F.col("n")).select("text", "b", put(F.col("a"), F.col("tree")).alias("lhs"))
    both = one.join(trees.toDF("n", "tree"), F.size("b") - 1 == F.col("n")).select("text", "lhs", put(F.col("b"), F.col("tree")).alias("rhs"))
    keyed = both.select("text", terms.normalized(F.col("lhs"), F.col("rhs")).alias("reading"), terms.canonical_key(F.col("lhs"), F.col("rhs")).alias("key"))
    return lookup_key(keyed, "key", "node").select("text", "reading", "node")


def ambiguity(df: DataFrame, text: str) -> DataFrame:
    """``(text, n_readings, laws)``: the number of bracketings, and the sorted numbers of the laws among them."""
    told = readings(df, text)
    return told.groupBy("text").agg(F.count("*").alias("n_readings"), F.array_sort(F.collect_set("node")).alias("laws"))
