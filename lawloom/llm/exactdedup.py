"""Exact dedup by progressive refinement: equal length, equal prefix hash, equal full hash.

Texts are equal when identical after lower-casing A-Z.  That changes no length
in bytes, so the first pass writes a narrow row per document, the length and the
hash of a prefix.  Lengths that only one document has end there; of the others
those whose prefix hash meets no second one end too.  Whole texts are hashed in
the second pass, for the groups that survived both.

Only narrow rows are shuffled, and never those that have ended.  Which rows go
on is told by sieves of bounded size; with very many survivors a sieve lets
more rows pass, so more texts are hashed, and the result stays exact.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns_of, free, marked, materialise, sieve, sifted, table

#: Characters of a text that the second level hashes.
PREFIX = 64


def normal(text: Column) -> Column:
    """What is compared: A-Z in lower case, a null as the empty text."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def _length(text: Column) -> Column:
    return F.coalesce(F.octet_length(text.cast("string")), F.lit(0))


def _head(text: Column) -> Column:
    return F.xxhash64(normal(F.substring(text.cast("string"), 1, PREFIX)))


def survivors(docs: DataFrame) -> DataFrame:
    """``(n_bytes, head)``: lengths and prefix hashes that two rows of ``docs`` share at least."""
    narrow = materialise(docs.select(_length(F.col("text")).alias("n_bytes"), _head(F.col("text")).alias("head")), "exact-narrow")
    lengths = materialise(narrow.groupBy("n_bytes").agg(F.count("*").alias("n")).where("n > 1").select("n_bytes"), "exact-lengths")
    longer = sifted(narrow, [F.col("n_bytes")], sieve(lengths))
    return materialise(longer.groupBy("n_bytes", "head").agg(F.count("*").alias("n")).where("n > 1").select("n_bytes", "head"), "exact-heads")


def _hashed(docs: DataFrame, going_on: DataFrame, every_digest: bool = False) -> tuple[DataFrame, str, str]:
    """``docs`` with a flag for rows that may be in a group, and their digest (of all rows if ``every_digest``); the two names."""
    length, head, hit, digest = free(docs.columns, "length", "head", "hit", "digest")
    told = docs.withColumns({length: _length(F.col("text")), head: _head(F.col("text"))})
    told = marked(told, [F.col(length), F.col(head)], sieve(going_on), hit)
    full = F.sha2(normal(F.col("text")).cast("binary"), 256)
    return told.select(*columns_of(docs), hit, (full if every_digest else F.when(F.col(hit), full)).alias(digest)), hit, digest


def _groups(rows: DataFrame) -> DataFrame:
    """``(digest, group_size, keep)`` of the digests that two rows have at least; ``keep`` has the largest id, of repeated ones any row."""
    return rows.groupBy("digest").agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "row")).alias("keep")).where("group_size > 1")


def mark_copies(docs: DataFrame, every_digest: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of equal texts the row with the largest ``doc_id`` stays.  A null text
    counts as empty, a null ``doc_id`` as smaller than any other.  Of rows that
    repeat both text and the largest id one is ``kept``, any.  Other columns are
    ignored, whatever their names; an empty table gives an empty result; texts
    of any length are one row.  ``text_sha256`` is null where no full hash was
    needed, unless ``every_digest``.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    told, hit, digest = _hashed(narrow, survivors(narrow), every_digest)
    rows = told.select("doc_id", F.monotonically_increasing_id().alias("row"), F.col(hit).alias("hit"), F.col(digest).alias("digest"))
    rows = materialise(rows, "exact-rows")
    groups = materialise(_groups(rows.where("hit")), "exact-groups")  # a table, so that a large group's rows can be split over tasks
    met = rows.where("hit").join(groups, "digest", "left")
    own = F.col("keep").isNull() | (F.col("keep.row") == F.col("row"))
    met = met.select(
        "doc_id",
        F.when(F.col("keep").isNull(), F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        own.alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
    alone = rows.where("not hit").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("digest").alias("text_sha256"))
    return met.union(alone)


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts, the one ``mark_copies`` keeps; of rows that repeat id and text, any one.

    Rows that surely are no lost copy stay where they are, without a shuffle.
    """
    going_on = survivors(docs)
    told, hit, digest = _hashed(docs, going_on)
    own, best, size, ident, text = free(told.columns, "own", "best", "size", "ident", "digest_")
    ids = told.where(F.col(hit)).select(F.col(digest).alias("digest"), F.col("doc_id").cast("long").alias("doc_id"))
    ids = materialise(ids.groupBy("digest", "doc_id").agg(F.count("*").alias("n")), "exact-ids")
    groups = ids.groupBy("digest").agg(F.sum("n").alias("size"), F.max(F.struct("doc_id")).alias("best")).where("size > 1")
    judged = ids.join(materialise(groups, "exact-best"), "digest")
    judged = judged.select("digest", F.xxhash64("doc_id", F.col("doc_id").isNull()).alias("ident"), (~F.col("doc_id").eqNullSafe(F.col("best.doc_id"))).alias("lost"), "n")
    special = materialise(judged.where("lost or n > 1").select("digest", "ident", "lost"), "exact-special")
    keyed = told.withColumn(own, F.xxhash64(F.col("doc_id").cast("long"), F.col("doc_id").isNull()))
    keyed = marked(keyed, [F.coalesce(F.col(digest), F.lit("")), F.col(own)], sieve(special.select("digest", "ident")), size)
    outside = keyed.where(~F.col(size)).select(*columns_of(docs))
    met = keyed.where(F.col(size)).join(special.toDF(text, ident, best), (F.col(digest) == F.col(text)) & (F.col(own) == F.col(ident)), "left")
    single = met.where(F.col(best).isNull()).select(*columns_of(docs))
    repeated = met.where(~F.col(best)).groupBy(digest, own).agg(F.first(F.struct(*columns_of(docs))).alias(best))
    return outside.union(single).union(repeated.select(f"{best}.*"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group, kept row and digest of every document."""
    return mark_copies(table(spark, sf_dir, "documents"), every_digest=True)


_X = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
OP12_SQL = f"""
WITH said AS (SELECT doc_id, {_X} AS x FROM documents)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY x) AS keep_id,
       count(*) OVER (PARTITION BY x) AS group_size,
       row_number() OVER (PARTITION BY x ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(x) AS text_sha256
FROM said
"""
