"""Components over all similar pairs of sets that share a slot, without comparing every pair.

First, all members of a slot are compared with one head.  A slot whose other
members are all connected then has nothing left to tell.  The members of the
others may still be similar to each other, and a large group of copies leaves
many such pairs, nearly all in vain.  An exact prefix filter finds those that
can be similar: with the elements in order of frequency, two similar sets share
one of their rarest, at places that leave enough elements behind them.  A
member outside the main component of its slot is not similar to the head, so
its rarest elements are not the head's, and few others have them.  Members
that share such an element are a slot again.  If comparing all their pairs is
no more work than a round, they are compared, else heads are taken once more,
and so on.

What is joined to many rows of one key is a table by then, so that adaptive
execution can split those rows over tasks.

So every pair of a slot is compared, connected already, or shown to be unlike:
the components are those of all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, materialise
from .components import connected_components

#: Rounds of heads before all open pairs are compared.
ROUNDS = 6
#: Open pairs for each entry, up to which they are compared at once.
OPEN = 4
#: Elements of both sets of all open pairs, up to which they are compared at once: half a gigabyte, less work than a round of heads.
WORK = 1 << 26
#: Words of 64 bits in the bitmap of wanted elements: 8 MB, whatever their number.
BITMAP_WORDS = 1 << 20

Needed = Callable[[Column, Column], Column]


def _verified(pairs: DataFrame, sets: DataFrame, needed: Needed) -> DataFrame:
    """Those of the ``pairs(u, v)`` that have the needed overlap."""
    both = pairs.join(sets.toDF("u", "x"), "u").join(sets.toDF("v", "y"), "v")
    need = needed(F.size("x"), F.size("y"))
    both = both.where(F.least(F.size("x"), F.size("y")) >= need)
    return both.where(F.size(F.array_intersect("x", "y")) >= need).select("u", "v")


def _ordered(a: str, b: str) -> tuple[Column, Column]:
    return F.least(a, b).alias("u"), F.greatest(a, b).alias("v")


def _open_nodes(left: DataFrame) -> DataFrame:
    """``(node, root, size, minor, smallest)`` of the members of open slots, those with two roots without the head.

    A member is ``minor`` if it is outside the main root of such a slot; every
    open pair has one.  ``smallest`` is the least size of what it meets there.
    """
    by_root = left.groupBy("slot", "root").agg(
        F.count("*").alias("n"), F.max(F.struct("weight", "node")).alias("top"), F.min("size").alias("smallest")
    )
    slots = by_root.groupBy("slot").agg(
        F.count("*").alias("roots"), F.max(F.struct("top", "n")).alias("head"), F.max(F.struct("n", "root")).alias("main"), F.min("smallest").alias("smallest")
    )
    slots = slots.where(F.col("roots") - (F.col("head.n") == 1).cast("int") > 1).select("slot", F.col("main.root").alias("main"), "smallest")
    held = left.join(materialise(slots, "meeting-slots"), "slot")
    return held.groupBy("node", "root", "size").agg(F.max(F.col("root") != F.col("main")).alias("minor"), F.min("smallest").alias("smallest"))


def _holders(nodes: DataFrame, sets: DataFrame, slots: DataFrame) -> DataFrame:
    """``(slot, node, root, size)`` for the elements of ``nodes`` that are among ``slots``.

    A bitmap of bounded size leaves most other elements out before any row is made of them.
    """
    spark, bits = nodes.sparkSession, BITMAP_WORDS * 64
    words = slots.select(F.pmod("slot", F.lit(bits)).alias("at"))
    words = words.select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bit"))
    words = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bitmap = np.zeros(BITMAP_WORDS, np.int64)
    bitmap[words["word"].to_numpy()] = words["bits"].to_numpy()
    sent = spark.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = sent.value
        for batch in batches:
            own = batch.column(3)
            at, row = own.flatten(), own.value_parent_indices().to_numpy()
            spot = at.to_numpy() % bits
            found = np.flatnonzero(bitmap[spot >> 6] >> (spot & 63) & 1)
            rows = pa.array(row[found])
            yield pa.RecordBatch.from_arrays([at.take(pa.array(found)), *(batch.column(k).take(rows) for k in range(3))], names=["slot", "node", "root", "size"])

    arrow_batches(spark)
    told = nodes.join(sets, "node").select("node", "root", "size", "own").mapInArrow(run, "slot long, node long, root long, size int")
    return told.join(slots, "slot", "left_semi")


def _refined(nodes: DataFrame, sets: DataFrame, needed: Needed) -> DataFrame:
    """``slot, node, root, size, rest, minor``: slots, each an element, in which all open pairs with the needed overlap meet.

    Minor members' elements are put in order of frequency among them.  Of the
    elements that two sets share take the first in this order: a minor set has
    at least the needed overlap left from there on (``rest``), so it is placed
    only where that can be.  Others are placed where a minor one is.
    """
    nodes = materialise(nodes, "meeting-open")
    told = nodes.where("minor").join(sets, "node").select("node", "root", "size", "smallest", F.explode("own").alias("slot"))
    told = materialise(told, "meeting-elements")
    common = materialise(told.groupBy("slot").agg(F.count("*").alias("df")), "meeting-common")
    own = told.join(common, "slot").groupBy("node", "root", "size", "smallest").agg(F.sort_array(F.collect_list(F.struct("df", "slot"))).alias("own"))
    most = F.col("size") - needed(F.col("size"), F.col("smallest")) + 1
    own = own.where(most > 0).select("node", "root", "size", F.posexplode(F.slice("own", F.lit(1), F.greatest(most, F.lit(0)))))
    placed = own.select(F.col("col.slot").alias("slot"), "node", "root", "size", (F.col("size") - F.col("pos")).alias("rest"), F.lit(True).alias("minor"))
    placed = materialise(placed, "meeting-prefixes")
    others = _holders(nodes.where("not minor"), sets, materialise(placed.select("slot").distinct(), "meeting-wanted"))
    every = placed.union(others.select("slot", "node", "root", "size", F.col("size").alias("rest"), F.lit(False)))
    every = materialise(every, "meeting-placed")
    mixed = every.groupBy("slot").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("slot")
    return every.join(materialise(mixed, "meeting-mixed"), "slot", "left_semi")


def components_inside(entries: DataFrame, sets: DataFrame, needed: Needed, rounds: int = ROUNDS, most: int = OPEN, work: int = WORK) -> DataFrame:
    """``entries(slot, node, weight, size)`` to ``(node, root)``; nodes without a link do not appear.

    ``sets(node, own)`` has each node's elements, ``size`` distinct longs.  Nodes u and
    v are similar if they share ``needed(size of u, size of v)`` elements at
    least; it must not fall when a size grows.  The heaviest member is a
    slot's head.  ``rounds`` of heads at most; ``most`` open pairs for each
    entry, or pairs of ``work`` elements in all, are compared at once.
    """
    left = entries.select("slot", "node", "weight", F.col("size").cast("int").alias("size"), F.col("node").alias("root"))
    links, n_entries = None, None
    for turn in range(rounds):
        heads = left.groupBy("slot").agg(F.max(F.struct("weight", "node", "root")).alias("head"), F.count("*").alias("n"))
        heads = heads.where("n > 1").select("slot", F.col("head.node").alias("head"), F.col("head.root").alias("head_root"))
        heads = materialise(heads, "meeting-heads")  # so that large slots can be split over tasks
        pairs = left.join(heads, "slot").where("root <> head_root").select(*_ordered("node", "head")).distinct()
        found = _verified(pairs, sets, needed)
        roots = connected_components(found if links is None else links.union(found))
        links = roots.toDF("u", "v")
        left = left.drop("root").join(roots, "node", "left").select("slot", "node", "weight", "size", F.coalesce("root", "node").alias("root"))
        left = materialise(left, "meeting-left")  # read twice, and by the next round
        refined = materialise(_refined(_open_nodes(left), sets, needed), "meeting-refined")
        groups = refined.groupBy("slot", "root").agg(F.count("*").alias("c"), F.sum("size").alias("held")).groupBy("slot")
        groups = groups.agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("own"), F.sum("held").alias("held"), F.sum(F.col("c") * F.col("held")).alias("within"))
        # A member meets all those of its slot that have another root, and brings its elements to each.
        met = groups.agg(F.sum((F.col("n") * F.col("n") - F.col("own")) / 2), F.sum((F.col("n") * F.col("held") - F.col("within")).cast("double"))).first()
        still = met[0] or 0
        if not still:
            return roots
        if met[1] <= work:
            break
        n_entries = n_entries or entries.count()
        if still <= most * n_entries or turn + 1 == rounds:
            break
        left = refined.select("slot", "node", F.xxhash64("node", F.lit(turn)).alias("weight"), "size", "root")  # other heads each time
    one = refined.where("minor").toDF("slot", "a", "p", "n", "i", "minor").drop("minor")
    two = refined.toDF("slot", "b", "q", "m", "j", "minor")
    # By sorting: rows that repeat their slot and node take few bytes in Parquet, by which Spark would choose to broadcast them.
    pairs = one.join(two.hint("merge"), "slot").where("p <> q and (not minor or a < b)").where(F.least("i", "j") >= needed(F.col("n"), F.col("m")))
    return connected_components(links.union(_verified(pairs.select(*_ordered("a", "b")).distinct(), sets, needed)))
