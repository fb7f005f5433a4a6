"""An edge table stored for lookups: blocks of hypotheses as folders, each clustered and sorted by pair.

``hyp % blocks`` names the folder, so a lookup of few pairs prunes the table to
their blocks while it runs; inside a block, files are clustered by the pair and
sorted, so a lookup of many pairs joins without moving the table, and one hot
hypothesis is spread over all files of its block.  It is a plain partitioned and
bucketed Parquet table with a path of its own; its name lives in the session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCKS = 64
BUCKETS = 16
#: Pairs up to this many (24 bytes each, some 25 MB) are sent to all executors; more are shuffled to the table's buckets.
BROADCAST_PAIRS = 1_000_000


def _block(hyp: Column, blocks: int) -> Column:
    return F.pmod(hyp.cast("long"), F.lit(blocks)).cast("int")


def write_edge_index(edges: DataFrame, path: str, name: str, blocks: int = BLOCKS, buckets: int = BUCKETS) -> None:
    """Store ``(hyp, concl, status)`` at ``path`` as table ``name``.

    A pair that comes more than once is stored once if it has one status, and
    refused if it has several: the job stops, since one of them is wrong.  Rows with a null are no edges.  An empty
    table is stored as an empty table.
    """
    whole = edges.select(F.col("hyp").cast("long").alias("hyp"), F.col("concl").cast("long").alias("concl"), F.col("status").cast("int").alias("status")).na.drop()
    once = whole.groupBy("hyp", "concl").agg(F.min("status").alias("status"), F.max("status").alias("__other"))
    clash = F.raise_error(F.concat(F.lit("two statuses of the pair "), F.concat_ws(", ", "hyp", "concl")))
    told = once.withColumn("status", F.when(F.col("status") == F.col("__other"), F.col("status")).otherwise(clash.cast("int"))).drop("__other")
    # As many partitions as buckets, by the buckets' own hash: each task writes one file in each block.
    placed = told.withColumn("block", _block(F.col("hyp"), blocks)).repartition(buckets, "hyp", "concl")
    written = placed.write.mode("overwrite").option("path", path).format("parquet")
    written.partitionBy("block").bucketBy(buckets, "hyp", "concl").sortBy("hyp", "concl").saveAsTable(name)


def lookup(spark: SparkSession, name: str, pairs: DataFrame, hyp: str, concl: str, out: str = "status", blocks: int = BLOCKS, most: int = BROADCAST_PAIRS) -> DataFrame:
    """``pairs`` with the status that the table ``name`` has for them, null if it has none; ``blocks`` as it was written.

    Distinct pairs are looked up and told to their rows again.  Up to ``most``
    of them are broadcast, and only their blocks are read; more go to the table
    by its own buckets.  Either way the table is not shuffled.
    """
    asked = pairs.select(F.col(hyp).cast("long").alias("__h"), F.col(concl).cast("long").alias("__c")).na.drop().distinct()
    asked = asked.withColumn("__b", _block(F.col("__h"), blocks)).where(F.col("__b") >= 0)
    few = asked.limit(most + 1).count() <= most
    # The table's columns get names of their own, so that those of ``pairs`` can be any.
    table = spark.table(name).select(F.col("hyp").alias("__th"), F.col("concl").alias("__tc"), F.col("block").alias("__tb"), F.col("status").alias("__s"))
    on = (F.col("__th") == F.col("__h")) & (F.col("__tc") == F.col("__c"))
    met = pairs.withColumns({"__h": F.col(hyp).cast("long"), "__c": F.col(concl).cast("long")})
    if few:
        found = table.join(F.broadcast(asked), on & (F.col("__tb") == F.col("__b"))).select("__th", "__tc", "__s")
        told = met.join(F.broadcast(found), on, "left")
    else:
        told = met.join(table.hint("merge"), on, "left")
    return told.withColumn(out, F.col("__s")).drop("__h", "__c", "__th", "__tc", "__tb", "__s")
