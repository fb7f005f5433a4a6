"""A corpus pipeline of the operators in ``lawloom.llm``.

Every stage gets all that its predecessor kept.  ``run`` writes each stage's
result to the folder that executors share and reads it back for the next one.

Null texts and ids, ties, repeated rows, very long texts and extra columns are
treated as the operators' docstrings say: a null text is never toxic, leaks
nothing, has no lines, and all null texts are one group of near copies; rows
without an id stay once per text; of rows that repeat id and text one is left
after near dedup.  Extra columns pass through all stages.  Empty documents give
an empty result; without labels nothing is toxic, without a benchmark nothing leaks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lawloom.llm import decontaminate, linededup, mixing, nearcopies, toxicity
from lawloom.llm.common import columns_of, materialise, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose severity is above grade 0 with a probability of a half or more go."""
    return toxicity.reject_toxic(docs, toxicity.fit_severity(docs, table(spark, sf_dir, "labels")))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go from the texts; no document goes, and ``n_chars`` follows the text."""
    out = linededup.drop_lines(docs)
    dropped = out.columns[-1]
    if "n_chars" in docs.columns:
        changed = F.when(F.col(dropped) > 0, F.length("text")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", changed.cast(docs.schema["n_chars"].dataType))
    return out.select(*columns_of(docs))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash groups and bands of min-hashes bring texts together; one stays of those whose five-word shingles have a similarity of 0.8 or more."""
    return nearcopies.keep_one_linked(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document is read at least once, small sources more often; with epoch, block and position."""
    return mixing.mix(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("source_mixing", mixing_stage),
]
#: The trained and the iterative stages are beyond SQL; tests hold them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
