"""SimHash near-duplicate detection by multi-index hashing.

Fingerprints are 64 bits over word shingles.  The index cuts a fingerprint into
two 32-bit segments.  Two fingerprints within three bits agree in one segment
up to one bit (two segments, and 3 < 2 * 2), so probing the radius-1 Hamming
ball of each segment finds every pair; full distances are verified.

Exact copies share a fingerprint and collapse before any join, so a group of
copies costs one index entry.  A segment value held by more than ``hot``
different fingerprints is not joined pair by pair: its members meet at the
points of small balls around the *other* segment and are linked to one hub per
point, which keeps the row count linear and loses no connection.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, materialise, table
from .components import connected_components
from .keeping import keep_least, text_key

SEED = 42
RADIUS = 3
HALF = 32
HOT = 64


def fingerprint(text: str | None, width: int = 3) -> bytes:
    """Eight bytes, most significant first; zero for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return bytes(8)
    digest = xxhash.xxh64_digest
    joined = b" ".join(words)
    n = len(words) - width + 1
    if n <= 1:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
    hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)])
    ones = np.zeros(64, np.int64)
    raw = np.frombuffer(hashes, np.uint8).reshape(n, 8)
    for at in range(0, n, 65536):
        ones += np.unpackbits(raw[at : at + 65536], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > n).tobytes()


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = b"".join(fingerprint(x.as_py(), width) for x in batch.column(2))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.frombuffer(raw, ">i8").astype(np.int64))], names=["doc_id", "text_key", "fp"]
            )

    return run


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``(doc_id, text_key, fp)`` per row of ``docs``; a null text counts as empty."""
    arrow_batches(docs.sparkSession)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(_fingerprints(width), "doc_id long, text_key long, fp long")


def _half(fp: F.Column, seg: int) -> F.Column:
    """Segment ``seg`` of a fingerprint, as a long below 2**32."""
    return F.shiftrightunsigned(fp, HALF) if seg == 0 else fp.bitwiseAND(F.lit((1 << HALF) - 1))


def _ball(key: F.Column, radius: int) -> F.Column:
    """All 32-bit values within ``radius`` (0, 1 or 2) of ``key``, as an array."""
    masks = [0] + [1 << i for i in range(HALF)] * (radius >= 1)
    masks += [1 << i | 1 << j for i in range(HALF) for j in range(i)] * (radius >= 2)
    return F.transform(F.array(*map(F.lit, [int(m) for m in masks])).cast("array<bigint>"), lambda m: m.bitwiseXOR(key))


def _indexed(fps: DataFrame) -> DataFrame:
    """Two index entries per fingerprint: ``slot`` tells segment and value, ``rest`` is the other segment."""
    fp = F.col("fp")
    return fps.select(
        "fp",
        F.explode(
            F.array(
                *(
                    F.struct(
                        F.lit(seg).alias("seg"), _half(fp, seg).alias("key"), _half(fp, 1 - seg).alias("rest")
                    )
                    for seg in (0, 1)
                )
            )
        ).alias("s"),
    ).select("fp", "s.seg", "s.key", "s.rest")


def links(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """Links ``(u, v)`` that connect all of the distinct ``fps(fp)`` within three bits.

    Every returned link is a true one.  For slots of up to ``hot`` fingerprints
    all links are returned; for larger ones a subset with the same components.

    All joins are by sorting: Spark takes an exploded table for no larger than
    what it was made from, and would broadcast tens of millions of probes.
    """
    hot = max(hot, 1)
    entries = _indexed(fps)
    sizes = entries.groupBy("seg", "key").agg(F.count("*").alias("n"))
    crowded = sizes.where(F.col("n") > hot).select("seg", "key")
    # One side of a differing bit has it 0, so flipping only zero bits finds each pair; u < v settles equal segments.
    bits = F.array(*(F.lit(1 << i) for i in range(HALF))).cast("array<bigint>")
    probes = entries.select(
        "fp",
        "seg",
        "rest",
        F.explode(
            F.concat(
                F.array(F.lit(0).cast("bigint")),
                F.filter(bits, lambda m: m.bitwiseAND(F.col("key")) == 0),
            )
        ).alias("mask"),
        "key",
    ).select(
        "fp", "seg", "rest", (F.col("mask") == 0).alias("same"), F.col("key").bitwiseXOR(F.col("mask")).alias("key")
    )
    # Most probes meet no slot and end here; a probe of a fingerprint's own slot needs company there.
    slots = sizes.select("seg", "key", "n", (F.col("n") > hot).alias("crowded")).hint("merge")
    met = materialise(probes.join(slots, ["seg", "key"]).where("not same or n > 1").drop("n"), "simhash-probes")
    held = entries.join(slots.drop("n"), ["seg", "key"])
    plain = met.where("not crowded").select("seg", "key", F.col("fp").alias("u"), "same")
    pairs = (
        held.where("not crowded")
        .select("seg", "key", F.col("fp").alias("v"))
        .join(plain.hint("merge"), ["seg", "key"])
        .where("u <> v and (not same or u < v)")
        .where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= RADIUS)
        .select("u", "v")
    )
    # Crowded slots: role 1 can be a hub; roles 2 and 3 attach to a hub at a shared point.
    inside = met.where("crowded and same")
    points = (
        inside.select("seg", "key", "fp", F.lit(True).alias("hub"), F.explode(_ball(F.col("rest"), 1)).alias("point"))
        .union(inside.select("seg", "key", "fp", F.lit(False), F.explode(_ball(F.col("rest"), 2))))
        .union(met.where("crowded and not same").select("seg", "key", "fp", F.lit(False), F.explode(_ball(F.col("rest"), 1))))
    )
    hubs = points.where("hub").groupBy("seg", "key", "point").agg(F.min("fp").alias("v"))
    starred = points.where("not hub").join(hubs.hint("merge"), ["seg", "key", "point"]).where("fp <> v").select(F.col("fp").alias("u"), "v")
    return pairs.union(starred).distinct()


def grouped(docs: DataFrame, width: int = 3, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, text_key, fp)`` per row of ``docs``, and ``(fp, least_id, root)`` per fingerprint."""
    fps = materialise(fingerprints(docs, width), "simhash-fingerprints")
    classes = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "simhash-classes")
    roots = connected_components(links(classes.select("fp"), hot))
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    return fps, rooted.select("fp", "least_id", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, width: int = 3, hot: int = HOT) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, fp, component_id``.

    ``component_id`` is the smallest ``doc_id`` whose fingerprint is reachable
    over links of at most three differing bits.  Null or empty texts have
    fingerprint zero and link like any other.  Repeated rows stay repeated; a
    null ``doc_id`` takes part, and is a component's id only if no other is
    there.  Extra columns are ignored; an empty table gives an empty result.
    Of a very long text eight bytes per shingle are held at once.
    """
    fps, rooted = grouped(docs, width, hot)
    named = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    found = rooted.join(named, "root").select("fp", "component_id")
    return fps.join(found, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, width: int = 3) -> DataFrame:
    """``docs`` with one document of each group, the one with the smallest id.

    Nulls, ties, repeated rows, empty tables and clashing names are as in
    ``near_duplicates`` and ``keep_least``.
    """
    fps, rooted = grouped(docs, width)
    rows = fps.join(rooted.select("fp", F.col("root").alias("grp")), "fp").select("doc_id", "text_key", "grp")
    return keep_least(docs, materialise(rows, "simhash-rows"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
