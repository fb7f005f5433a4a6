"""One document of each group: the rest of the rows go, without a shuffle of the texts that stay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_of, free, materialise, sieve, sifted


def text_key(text: F.Column) -> F.Column:
    """Tells one text from another; a null has a key of its own."""
    return F.xxhash64(text.cast("string"), text.isNull())


def keep_least(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of ``rows(doc_id, text_key, grp)``, of which there is one per row of ``docs``.

    The document with the smallest ``doc_id`` stays (of several texts of that
    id in one group, one).  Rows of one id whose texts are in different groups
    are different documents.  Rows without an id stay, once per text.  Of rows
    that repeat an id and a text one stays; if other columns differ, any one.

    Lost and repeated rows are found in a sieve of bounded size.  Rows outside
    it stay where they are; only those inside meet the exact list.
    """
    counted = rows.groupBy("grp", "doc_id", "text_key").agg(F.count("*").alias("n"))
    best = rows.where("doc_id is not null").groupBy("grp").agg(F.min(F.struct("doc_id", "text_key")).alias("best"))
    best = materialise(best, "keeping-best")  # so that a large group can be split over tasks
    lost = F.col("doc_id").isNotNull() & (F.struct("doc_id", "text_key") != F.col("best"))
    judged = counted.join(best, "grp", "left").select("doc_id", "text_key", lost.alias("lost"), "n")
    special = materialise(judged.where("lost or n > 1").select("doc_id", "text_key", "lost"), "keeping-special")
    own_id, own_text, i, t, gone = free(docs.columns, "own_id", "own_text", "i", "t", "gone")
    keyed = docs.withColumns({own_id: F.col("doc_id").cast("long"), own_text: text_key(F.col("text"))})
    keys, words = [F.col(own_id), F.col(own_text)], sieve(special.select("doc_id", "text_key"))
    outside = sifted(keyed, keys, words, inside=False).select(*columns_of(docs))
    met = sifted(keyed, keys, words).join(
        special.toDF(i, t, gone), F.col(own_id).eqNullSafe(F.col(i)) & (F.col(own_text) == F.col(t)), "left"
    )
    single = met.where(F.col(gone).isNull()).select(*columns_of(docs))
    repeated = met.where(~F.col(gone)).groupBy(own_id, own_text).agg(F.first(F.struct(*columns_of(docs))).alias(gone))
    return outside.union(single).union(repeated.select(f"{gone}.*"))
