"""Cheap metrics next to the oracle's labels, and where they disagree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parse

PRESERVED = ("equal", "equivalent")


def exact_match(a: Column, b: Column) -> Column:
    return a == b


def edit_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def with_normalized_match(df: DataFrame, a: str, b: str, out: str = "normalized_match") -> DataFrame:
    """Whether two texts are one law but for names, signs and the sides' order; false if one is no equation."""
    one = parse.analyzed(df, a, "__a")
    two = parse.analyzed(one, b, "__b")
    same = F.col("__a.canonical_key") == F.col("__b.canonical_key")
    return two.withColumn(out, F.coalesce(same, F.lit(False))).drop("__a", "__b")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null if one has no length."""

    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda s, p: s + p)

    size = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(size > 0, dot(a, b) / size)


def accuracy(df: DataFrame, preserved: str, label: str = "label") -> DataFrame:
    """``(label, n, agree, accuracy)``: how often a metric's yes or no agrees with the oracle, by relation."""
    truth = F.col(label).isin(*PRESERVED)
    agree = (F.col(preserved) == truth).cast("long")
    return df.where(F.col(label) != "unknown").groupBy(F.col(label).alias("label")).agg(
        F.count("*").alias("n"), F.sum(agree).alias("agree"), F.round(F.avg(agree), 6).alias("accuracy")
    )


def disagreements(df: DataFrame, metrics: tuple[str, ...], label: str = "label") -> DataFrame:
    """One row of counts: all, unresolved, and for each metric false equivalences and missed ones."""
    truth, open_ = F.col(label).isin(*PRESERVED), F.col(label) == "unknown"
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    counts = [F.count("*").alias("n"), n(open_).alias("unresolved")]
    for m in metrics:
        counts += [n(F.col(m) & ~truth & ~open_).alias(f"{m}_false"), n(~F.col(m) & truth).alias(f"{m}_missed")]
    return df.agg(*counts)


def by_relation(df: DataFrame, metrics: tuple[str, ...], group: str, label: str = "label") -> DataFrame:
    """The counts of ``disagreements`` by group and relation, by each alone and in all (null stands for all), in one pass.

    A null group or label is counted as the text ``null``, apart from all.
    """
    truth, open_ = F.col(label).isin(*PRESERVED), F.col(label) == "unknown"
    flags = {"__open": open_} | {f"__{m}_false": F.col(m) & ~truth & ~open_ for m in metrics} | {f"__{m}_missed": ~F.col(m) & truth for m in metrics}
    named = df.withColumns(flags | {c: F.coalesce(F.col(c), F.lit("null")) for c in (group, label)})
    own, rel = F.col(group), F.col(label)
    sums = [F.count("*").alias("n"), F.count_if("__open").alias("unresolved"), *(F.count_if(f"__{m}_{w}").alias(f"{m}_{w}") for m in metrics for w in ("false", "missed"))]
    return named.groupingSets([[own, rel], [own], [rel], []], own, rel).agg(*sums)


def confusion(df: DataFrame, expected: str, label: str = "label") -> DataFrame:
    """``(expected, label, n)``."""
    return df.groupBy(F.col(expected).alias("expected"), F.col(label).alias("label")).agg(F.count("*").alias("n"))
