"""Nearest neighbours of embeddings by cosine: a partitioned index, and an exact mode by the same plan with one cell.

The index cuts the space into cells around centres that are fitted on a bounded
sample (``SAMPLE`` rows, 20 000); every row is put into its cell.  A query looks
into the ``probes`` cells nearest to it.  Cells are dealt out in groups of
bounded size: a crowded cell's rows are salted, its queries too, so no task
holds more than ``GROUP`` rows and ``GROUP`` queries, whatever the largest cell,
and it compares ``PIECE`` queries at a time.
Each group gives its best ``k`` per query, and those are ranked once more.

The defaults are for vectors without clusters (64 dimensions, neighbours of
cosine 0.3 to 0.5), where a recall of 0.9 takes half the cells; clustered vectors need
far fewer probes.  ``recall`` measures it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..shipping import ship
from ..sources.scratch import scratch

SAMPLE, CELLS, PROBES, GROUP, STEPS, SEED = 20_000, 128, 72, 4096, 12, 5
PIECE = 256
_UNIT = "id long, vec array<double>"


def unit(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``(id, vec)`` of length 1; rows without an id, or whose vector is null, empty, of length zero or holds a null, have no neighbours and go."""
    vec = F.transform(F.col(vector), lambda x: x.cast("double"))
    size = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    told = df.select(F.col(key).cast("long").alias("id"), vec.alias("vec")).withColumn("size", size)
    return told.where("id is not null and size > 0").select("id", F.transform("vec", lambda x: x / F.col("size")).alias("vec"))


def fit_centres(units: DataFrame, cells: int = CELLS, sample: int = SAMPLE) -> np.ndarray:
    """Centres of ``cells`` cells at most, by spherical k-means on ``sample`` rows (the first by a hash of the id)."""
    got = units.orderBy(F.xxhash64("id")).limit(sample).toPandas()
    if got.empty:
        return np.zeros((1, 0))
    points, rng = np.stack(got["vec"]), np.random.default_rng(SEED)
    centres = points[rng.permutation(len(points))[: min(cells, len(points))]]
    for _ in range(STEPS):
        own = (points @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.where(size > 0, size, 1), centres)
    return centres


def _placed(units: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    """``units`` once in each of its nearest ``probes`` cells."""
    if len(centres) <= 1:
        return units.withColumn("cell", F.lit(0))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                near = np.argsort(-(np.stack(batch["vec"]) @ centres.T), axis=1, kind="stable")[:, :probes]
                yield batch.assign(cells=list(near.astype(np.int32)))

    # A vector leaves Python once, with its cells; its copies are made in the JVM.
    return units.mapInPandas(run, f"{_UNIT}, cells array<int>").select("id", "vec", F.explode("cells").alias("cell"))


def best(one: pd.DataFrame, two: pd.DataFrame, k: int) -> pd.DataFrame:
    """``(id, other, cosine)``: the ``k`` rows of ``two`` most like each row of ``one``; cosines of ``PIECE`` rows are held at once."""
    if one.empty or two.empty:
        return pd.DataFrame({"id": [], "other": [], "cosine": []})
    two = two.sort_values("id", kind="stable")
    every, others = one["id"].to_numpy(), two["id"].to_numpy()
    asked, rows, parts = np.stack(one["vec"]), np.stack(two["vec"]).T, []
    for start in range(0, len(every), PIECE):
        ids = every[start : start + PIECE]
        near = asked[start : start + PIECE] @ rows
        near[ids[:, None] == others[None, :]] = -np.inf
        order = np.argsort(-near, axis=1, kind="stable")[:, :k]
        at = np.repeat(np.arange(len(ids)), order.shape[1])
        out = pd.DataFrame({"id": ids[at], "other": others[order.ravel()], "cosine": near[at, order.ravel()]})
        parts.append(out[np.isfinite(out["cosine"])])
    return pd.concat(parts)


def nearest(queries: DataFrame, rows: DataFrame, k: int = 5, centres: np.ndarray | None = None, probes: int = PROBES, group: int = GROUP) -> DataFrame:
    """``(id, rank, other, cosine)``: the ``k`` rows most like each query, itself left out; equal ones by the smaller id.

    Both tables are ``unit`` vectors ``(id, vec)`` of one dimension.  Without
    ``centres`` every query meets every row, block by block, and the result is
    exact.  Repeated ids count as different rows of that id.  Empty tables give
    an empty result.
    """
    spark = rows.sparkSession
    ship(spark)
    centres = np.zeros((1, 0)) if centres is None else centres

    def stored(df: DataFrame, label: str) -> DataFrame:
        path = scratch(spark, label)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    held, asked = stored(_placed(rows, centres, 1), "cells"), stored(_placed(queries, centres, probes), "probes")
    # As many rows as there are cells: how many groups a cell's rows and queries are dealt into.
    count = lambda df, n: df.groupBy("cell").agg(F.ceil(F.count("*") / group).cast("int").alias(n))
    cells = F.broadcast(stored(count(held, "n_rows").join(count(asked, "n_queries"), "cell"), "cell-sizes"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    salt = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    left = asked.join(cells, "cell").withColumns({"b": salt("n_queries")}).select("cell", every("n_rows").alias("a"), "b", "id", "vec")
    right = held.join(cells, "cell").withColumns({"a": salt("n_rows")}).select("cell", "a", every("n_queries").alias("b"), "id", "vec")

    keys = ("cell", "a", "b")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(lambda one, two: best(one, two, k), "id long, other long, cosine double")
    rank = F.row_number().over(W.partitionBy("id").orderBy(F.col("cosine").desc(), "other"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("id", "rank", "other", "cosine")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """``(n_exact, n_found, recall)``: how many of the exact neighbours of the exact table's queries the index has found."""
    told = exact.select("id", "other").join(found.select("id", "other", F.lit(1).alias("hit")), ["id", "other"], "left")
    return told.agg(F.count("*").alias("n_exact"), F.count("hit").alias("n_found"), F.round(F.count("hit") / F.count("*"), 4).alias("recall"))
