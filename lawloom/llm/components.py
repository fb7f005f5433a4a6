"""Connected components of a link table, without driver-side state.

Alternating large-star and small-star rounds.  Every round is two aggregations
and two equi-joins; the link table never grows.  Each step is a Parquet table in
the shared folder, so a lost executor costs one step at most, and goes as soon
as a later one stands.  Narrow tables of many partitions are read back in few
tasks, where a checkpoint takes one for each of its partitions, twice.  What a
task reads it contracts to stars, block by block, which spares rounds and the
removal of repeated links.

A hub's links meet one row of the hub; that row comes from a table on the
right of a left join, so adaptive execution can split the links over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, materialise, remove, stored

#: Links that a task contracts at once, 16 bytes each.
BLOCK = 1 << 20


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of every node to the least node that the links ``u, v`` connect it with; no more than there were."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    least = np.arange(len(nodes))
    while True:
        one, two = least[a], least[b]
        if (one == two).all():
            break
        np.minimum.at(least, np.maximum(one, two), np.minimum(one, two))
        while (least[least] != least).any():
            least = least[least]
    up = np.flatnonzero(least != np.arange(len(nodes)))
    return nodes[up], nodes[least[up]]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, rows = [], 0

    def done() -> pa.RecordBatch:
        u, v = stars(*(np.concatenate([b.column(k).to_numpy() for b in held]) for k in (0, 1)))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= BLOCK:
            yield done()
            held, rows = [], 0
    if rows:
        yield done()


def _stars(links: DataFrame) -> tuple[DataFrame, str]:
    return stored(links.mapInArrow(_contracted, "u long, v long"), "components-links")


def connected_components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """``links(u, v)`` (undirected longs) to ``(node, root)``, root = smallest node reachable.

    Self links and repeated links are allowed; nodes without a link do not
    appear.  Raises if ``rounds`` do not suffice (they grow with the logarithm
    of the longest chain).
    """
    spark = links.sparkSession
    arrow_batches(spark)
    # Written first, and so contracted in few large tasks.
    given, given_at = stored(links.where("u <> v").select("u", "v"), "components-given")
    links, links_at = _stars(given)
    remove(spark, given_at)
    for turn in range(rounds + 1):
        below, below_at = stored(links.groupBy("u").agg(F.min("v").alias("m"), (F.min("v") < F.max("v")).alias("several")), "components-below")
        # Large star: whatever is above a node is linked to the least node below it instead.
        large = links.join(below.select(F.col("u").alias("v"), "m"), "v", "left")
        large, large_at = stored(large.select("u", F.coalesce("m", "v").alias("v"), F.col("m").isNotNull().alias("moved")), "components-large")
        remove(spark, links_at)
        # Settled: every node is linked to one node below at most, and none has links both up and down.
        settled = below.where("several").isEmpty() and large.where("moved").isEmpty()
        if settled or turn == rounds:
            break
        # Small star: a node and all below it are linked to the least of them.
        least, least_at = stored(large.groupBy("u").agg(F.min("v").alias("m")), "components-least")
        small = large.join(least, "u", "left").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        links, links_at = _stars(small)
        for path in (below_at, large_at, least_at):
            remove(spark, path)
    if not settled:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    nodes = below.select(F.col("u").alias("node"), F.col("m").alias("root"))
    found = materialise(nodes.union(below.select(F.col("m").alias("node"), F.col("m").alias("root")).distinct()), "components")
    for path in (below_at, large_at):
        remove(spark, path)
    return found
