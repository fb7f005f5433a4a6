"""Report on a table of intended and generated equations: labels, cheap metrics, and where the two disagree.

    python -m jobs.metric_report --config jobs/metric_report.json --input TABLE --output FOLDER

Each row of the Parquet table names an intended and a generated equation, as
text or as a number of the catalogue, by SQL expressions of the config.  The
implication evidence labels the pair (equal, equivalent, weaker, stronger,
incomparable, unknown, or why a side is not in the catalogue); exact match, normal-form match and edit distance
stand beside it.

Output, both tables partitioned by ``period``: ``pairs`` has a row per input
row, ``summary`` a row per group and label with counts, accuracy of the metrics
where the label is known, false equivalences and missed ones.

A run replaces the periods that it reads, and no others, so that running again,
over everything or with ``first`` and ``last``, ends in the same tables.  Null
equations are parse failures; null ids, groups and periods stay null; repeated
rows stay; an empty input writes nothing.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lawloom.operators import evidence, metrics, verdicts
from lawloom.sources import readers

log = logging.getLogger("jobs.metric_report")
PAIRS = "id long, grp string, intended int, generated int, label string, forward string, backward string, exact_match boolean, same_law boolean, distance int, evidence string, period string"
SUMMARY = "grp string, label string, n long, n_exact long, n_same long, false_equivalences long, missed long, mean_distance double, period string"


@dataclass(frozen=True)
class Config:
    """Paths; SQL expressions over the input's columns; evidence: ``derived``, ``plain`` (tables of size 2), or a path to published outcomes."""

    input: str
    output: str
    id: str
    intended: str
    generated: str
    group: str = "cast(null as string)"
    period: str = "'all'"
    evidence: str = "derived"
    first: str | None = None
    last: str | None = None


def matrix_of(spark: SparkSession, name: str) -> tuple[DataFrame, bool]:
    """The packed evidence, and whether it is published."""
    if name in ("derived", "plain"):
        return evidence.derive(spark) if name == "derived" else evidence.plain(spark), False
    return readers.read_outcomes(spark, name), True


def labelled(pairs: DataFrame, matrix: DataFrame, published: bool) -> DataFrame:
    """``pairs(id, grp, period, i, g)`` with verdict and metrics, as the table ``pairs`` has them."""
    told = verdicts.compare(pairs, "i", "g", matrix, published)
    v = F.col("verdict")
    a, b = v["intended"], v["generated"]
    return told.select(
        "id", "grp", a["node"].alias("intended"), b["node"].alias("generated"), v["label"].alias("label"),
        v["forward"].alias("forward"), v["backward"].alias("backward"),
        F.coalesce(metrics.exact_match(F.col("i"), F.col("g")), F.lit(False)).alias("exact_match"),
        F.coalesce(a["node"] == b["node"], F.lit(False)).alias("same_law"),
        metrics.edit_distance(a["normalized"], b["normalized"]).alias("distance"), F.coalesce(v["evidence"], v["notes"]).alias("evidence"), "period",
    )


def summary(pairs: DataFrame) -> DataFrame:
    """Counts by period, group and label; a metric errs where the label is known and says otherwise."""
    kept = F.col("label").isin(*metrics.PRESERVED)
    known = kept | F.col("label").isin("weaker", "stronger", "incomparable")
    n = lambda c: F.count_if(c)
    return pairs.groupBy("grp", "label", "period").agg(
        F.count("*").alias("n"), n(F.col("exact_match")).alias("n_exact"), n(F.col("same_law")).alias("n_same"),
        n(known & ~kept & F.col("same_law")).alias("false_equivalences"), n(kept & ~F.col("same_law")).alias("missed"),
        F.round(F.avg("distance"), 6).alias("mean_distance"),
    )


def _between(period: Column, config: Config) -> Column:
    held = F.lit(True)
    if config.first is not None:
        held = held & (period >= config.first)
    return held if config.last is None else held & (period <= config.last)


def run(spark: SparkSession, config: Config) -> dict:
    """Label all pairs of the wanted periods, write both tables, and tell what was read and written."""
    named = {"id": f"cast({config.id} as long)", "grp": f"cast({config.group} as string)", "period": f"cast({config.period} as string)"}
    named |= {"i": f"cast({config.intended} as string)", "g": f"cast({config.generated} as string)"}
    pairs = spark.read.parquet(config.input).select(*(F.expr(e).alias(c) for c, e in named.items())).where(_between(F.col("period"), config))
    log.info("reading %s, periods %s to %s, evidence %s", config.input, config.first or "first", config.last or "last", config.evidence)
    matrix, published = matrix_of(spark, config.evidence)
    _write(labelled(pairs, matrix, published), config, "pairs")
    done = output(spark, config, "pairs").where(_between(F.col("period"), config))
    _write(summary(done), config, "summary")
    told = {"pairs": done.count(), "unresolved": done.where("label = 'unknown'").count()}
    log.info("%s pairs written to %s, %s of them unresolved", told["pairs"], config.output, told["unresolved"])
    return told


def _write(df: DataFrame, config: Config, name: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("period").parquet(f"{config.output}/{name}")


def output(spark: SparkSession, config: Config, name: str) -> DataFrame:
    """An output table as it stands."""
    return spark.read.schema({"pairs": PAIRS, "summary": SUMMARY}[name]).parquet(f"{config.output}/{name}")


if __name__ == "__main__":
    from jobs.common import main

    raise SystemExit(main(run, Config, __doc__.split("\n")[0], ("input", "output", "evidence", "first", "last")))
