"""Streams of equations or law pairs against the static catalogue.

Both operators are stateless: every micro-batch meets broadcast tables of fixed
size, so there is no state to keep, expire or recover.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import parse, terms
from ..operators.catalogue import laws
from ..operators.verdicts import verdict_pairs
from ..shipping import ship


def mapped_stream(stream: DataFrame, column: str) -> DataFrame:
    """A stream of equation texts with ``status``, ``node`` and ``reason``."""
    spark = stream.sparkSession
    ship(spark)
    read = stream.withColumn("__p", parse.parsed(F.col(column)))
    keyed = read.withColumn("__key", terms.canonical_key(F.col("__p.lhs"), F.col("__p.rhs")))
    known = laws(spark).select(F.col("canonical_key").alias("__known"), "node")
    met = keyed.join(F.broadcast(known), F.col("__key") == F.col("__known"), "left")
    status = F.when(~F.col("__p.ok"), F.col("__p.error")).when(F.col("node").isNull(), parse.OUTSIDE).otherwise("mapped")
    return met.withColumns({"status": status, "reason": F.col("__p.reason")}).drop("__p", "__key", "__known")


def labelled_stream(stream: DataFrame, matrix: DataFrame, intended: str = "intended", generated: str = "generated") -> DataFrame:
    """A stream of pairs of law numbers with their labels."""
    return verdict_pairs(stream, matrix, intended, generated)


def windowed_labels(labelled: DataFrame, time: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``(window, label, n)`` of a labelled stream, for as long as late rows may come."""
    return labelled.withWatermark(time, late).groupBy(F.window(time, width), "label").agg(F.count("*").alias("n"))
