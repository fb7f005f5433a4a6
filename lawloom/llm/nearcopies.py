"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

At that similarity 64-bit SimHashes differ in about 10 bits, up to 18 or so, and
no multi-index over 64 bits has segments for such a radius.  So candidates meet
by bands of min-hashes: two texts of similarity 0.8 share one of BANDS bands of
ROWS min-hashes but for 6 in ten million pairs, more similar ones all the more.
What meets is compared by its exact similarity (see ``meeting``).  ``keep_one_linked``
takes SimHash's own groups as well: texts that its links of three bits connect meet too,
under the same exact check, and the bands bring what this radius does not reach.

Texts with the same shingles collapse before any join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import arrow_batches, materialise, sieve, sifted
from .keeping import keep_least, text_key
from .meeting import components_inside

WIDTH = 5
BANDS, ROWS = 20, 3
SEED = 42
_draw = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * ROWS, 1), np.int64).astype(np.uint64)
_TIMES, _FLIP = _draw[0] * np.uint64(2) + np.uint64(1), _draw[1]


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Distinct hashes of the text's shingles, in order; a shorter text is one shingle, one without words has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    n = max(1, len(words) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[-n:].tolist(), strict=True)], np.uint64))


def slots(found: np.ndarray) -> list[int]:
    """A signed number for each band of min-hashes."""
    if not len(found):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(found), 4096):
        mixed = (found[at : at + 4096] ^ _FLIP) * _TIMES
        least = np.minimum(least, (mixed ^ mixed >> np.uint64(31)).min(axis=1))
    raw, step = least.tobytes(), 8 * ROWS
    keys = [xxhash.xxh64_intdigest(raw[i * step : (i + 1) * step], i) for i in range(BANDS)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def needed(a: Column, b: Column) -> Column:
    """Shingles that sets of ``a`` and ``b`` share at least if they are similar: 4/5 of their union, in whole numbers."""
    return F.greatest(F.floor((4 * (a + b) + 8) / 9), F.floor((4 * F.greatest(a, b) + 4) / 5)).cast("int")


def _copy(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes(), SEED)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles(x.as_py()) for x in batch.column(2)]
        keys = np.array([_copy(s) for s in sets], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(keys), pa.array([len(s) for s in sets], pa.int32()), pa.array([slots(s) for s in sets], pa.list_(pa.int64()))],
            names=["doc_id", "text_key", "node", "size", "slots"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles(x.as_py()) for x in batch.column(0)]
        keys = np.array([_copy(s) for s in sets], np.uint64).view(np.int64)
        own = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(keys), own], names=["node", "own"])


def simhash_slots(docs: DataFrame) -> DataFrame:
    """``(text_key, slot)``: a signed number for the group of texts that SimHash's links connect with the text."""
    prints, rooted = simhash.grouped(docs)
    by_text = prints.groupBy("text_key").agg(F.min("fp").alias("fp"))
    return by_text.join(rooted, "fp").select("text_key", F.xxhash64(F.lit("simhash"), "root").alias("slot"))


def _grouped(docs: DataFrame, more: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, text_key, node)`` per row of ``docs``, and ``(node, least_id, root)`` per distinct set of shingles.

    Texts that share one of ``more(text_key, slot)`` meet as those do that share a band.
    """
    arrow_batches(docs.sparkSession)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), F.col("text").cast("string").alias("text"))
    seen = materialise(narrow.mapInArrow(_sketches, "doc_id long, text_key long, node long, size int, slots array<long>"), "copies-sketches")
    nodes = materialise(seen.groupBy("node").agg(F.min("doc_id").alias("least_id"), F.min("size").alias("size"), F.min("slots").alias("slots")), "copies-nodes")
    classes = nodes.select("node", "least_id")
    placed = nodes.select("node", "least_id", "size", F.explode("slots").alias("slot"))
    if more is not None:
        own = seen.groupBy("text_key").agg(F.min("node").alias("node")).join(more, "text_key").select("node", "slot").distinct()
        placed = materialise(placed.unionByName(nodes.where("size > 0").join(own, "node").select("node", "least_id", "size", "slot")), "copies-placed")
    shared = materialise(placed.groupBy("slot").agg(F.count("*").alias("n")).where("n > 1"), "copies-shared")
    met = materialise(placed.join(shared, "slot"), "copies-slots")
    # An original shares more slots with its copies than they do with each other, so it makes the best head.
    weights = materialise(met.groupBy("node").agg(F.sum("n").alias("weight"), F.min("least_id").alias("least_id")), "copies-weights")

    # The shingles of texts that meet others are made again where they occur first.
    again = sifted(narrow.select("doc_id", "text"), [F.col("doc_id")], sieve(weights.select("least_id").distinct()))
    sets = again.select("text").mapInArrow(_sets, "node long, own array<long>").join(weights.select("node"), "node", "left_semi")
    sets = materialise(sets.groupBy("node").agg(F.min("own").alias("own")), "copies-sets")
    entries = met.select("slot", "node", "size").join(weights.select("node", "weight"), "node").select("slot", "node", "weight", "size")
    roots = components_inside(entries, sets, needed)
    rooted = classes.join(roots, "node", "left").select("node", "least_id", F.coalesce("root", "node").alias("root"))
    return seen.select("doc_id", "text_key", "node"), materialise(rooted, "copies-rooted")


def near_copies(docs: DataFrame) -> DataFrame:
    """``(doc_id, component_id)`` per row of ``docs``.

    ``component_id`` is the smallest ``doc_id`` that is reachable over near
    copies.  Null texts and texts without words are copies of each other.  A
    null ``doc_id`` takes part, and is a component's id only if no other is
    there; an empty table gives an empty result.  A text of any length is one
    row of a pass; its distinct shingles, 8 bytes each, are held at once.
    """
    rows, rooted = _grouped(docs)
    named = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return rows.join(rooted.join(named, "root").select("node", "component_id"), "node").select("doc_id", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of near copies, the one with the smallest id.

    Null texts and texts without words are one group.  Rows without an id stay,
    once per text; of rows that repeat id and text one stays, any of them if
    other columns differ (see ``keep_least``).  Other columns stay as they are,
    whatever their names; an empty table gives an empty result; a text of any
    length is compared whole.
    """
    rows, rooted = _grouped(docs)
    rows = rows.join(rooted.select("node", F.col("root").alias("grp")), "node").select("doc_id", "text_key", "grp")
    return keep_least(docs, materialise(rows, "copies-rows"))


def keep_one_linked(docs: DataFrame) -> DataFrame:
    """As ``keep_one``, where texts that SimHash links meet as well (see ``simhash_slots``)."""
    rows, rooted = _grouped(docs, materialise(simhash_slots(docs), "copies-simhash"))
    rows = rows.join(rooted.select("node", F.col("root").alias("grp")), "node").select("doc_id", "text_key", "grp")
    return keep_least(docs, materialise(rows, "copies-rows"))
