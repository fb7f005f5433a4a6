"""What the trained operators share: bounded labelled samples and small numeric helpers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = 1 << 31


def labelled_sample(labels: DataFrame, total: int, keys: list[str] | None = None) -> tuple[DataFrame, dict]:
    """About ``total`` rows of ``labels(doc_id, label)`` at most, shared evenly by the label values.

    A row is taken by a hash of its ``keys`` (by default ``doc_id``), so the
    sample is the same for any partitioning.  Counts per label value cover all rows.  Returns the rows
    and each value's rate.  Rows with a null id or label are no examples.
    """
    known = labels.where("doc_id is not null and label is not null")
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    rates = {k: min(1.0, total / len(counts) / n) for k, n in counts.items()}
    if not rates:
        return known.where("false"), rates
    rate = F.create_map(*(x for k, r in rates.items() for x in (F.lit(k), F.lit(r))))[F.col("label")]
    unit = F.pmod(F.xxhash64(*(keys or ["doc_id"])), F.lit(UNIT)) / UNIT
    return known.where(unit < rate), rates


def examples(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """``doc_id, text, label`` of the sampled documents, one row per id: of several texts the first in order.

    The sample is bounded by its parameter and so broadcast; as is, by then, the
    number of examples, however often an id is repeated.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    told = narrow.join(F.broadcast(sample.select("doc_id", "label")), "doc_id")
    return told.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
