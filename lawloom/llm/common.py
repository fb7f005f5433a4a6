"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship

CHECKPOINT_DIR = "spark.checkpoint.dir"
#: A sieve has so many words of 64 bits at most: 16 MB, whatever it is made of.
SIEVE_WORDS = 1 << 20
_written: dict[str, list[str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the supplied tables, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it.

    Only where the session names none and runs on this machine alone (tests,
    notebooks) a folder of this machine is set instead.
    """
    named = spark.sparkContext.getConf().get(CHECKPOINT_DIR) or spark.conf.get(CHECKPOINT_DIR, None)
    if not named:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError(f"{CHECKPOINT_DIR} must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="lawloom-")
        spark.conf.set(CHECKPOINT_DIR, named)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(named)
    return named


def free(taken: list[str], *wanted: str) -> list[str]:
    """The ``wanted`` names, each with as many underscores added as it takes to clash with no ``taken`` one, whatever the case."""
    used, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def columns_of(df: DataFrame) -> list[F.Column]:
    """All columns, quoted, so that any name will do."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def map_arrow(df: DataFrame, run: Callable, schema: T.StructType) -> DataFrame:
    """``mapInArrow`` for any column names: inside, columns are called c0, c1, ... by place, in and out."""
    inner = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(schema)])
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))).mapInArrow(run, inner).toDF(*schema.names)


def stored(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """As ``materialise``, with the path that ``remove`` takes."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage of ``df``: write it to the shared folder, read it back.

    Parquet in the shared folder survives lost executors; nothing computed
    upstream (Python passes above all) runs twice.
    """
    return stored(df, label)[0]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that ``stored`` wrote and that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    paths = _written.get(spark.sparkContext.applicationId, [])
    if path in paths:
        paths.remove(path)


def _spot(keys: list[F.Column]) -> F.Column:
    return F.pmod(F.xxhash64(*keys), F.lit(SIEVE_WORDS * 64))


def sieve(keys: DataFrame) -> DataFrame:
    """``(word, bits)``: a bit for each row of ``keys``, placed by the hash of its columns.

    SIEVE_WORDS rows at most, so it can be broadcast whatever the number of
    keys.  Of rows that are no keys it lets 1 - exp(-keys / 67 million) pass: a
    tenth with 7 million keys, nearly all beyond 300 million.  What passes is
    settled by a join then, so results stay exact and cost one shuffle more.
    """
    spots = keys.select(_spot(columns_of(keys)).alias("at"))
    bits = spots.select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bit"))
    return bits.groupBy("word").agg(F.bit_or("bit").alias("bits"))


def marked(df: DataFrame, keys: list[F.Column], words: DataFrame, name: str) -> DataFrame:
    """``df`` with a flag ``name``: whether the row may be among the keys of a sieve (true for all keys and few others)."""
    at, word, bits = free([*df.columns, name], "at", "word", "bits")
    held = df.withColumn(at, _spot(keys)).join(F.broadcast(words.toDF(word, bits)), F.shiftright(at, 6) == F.col(word), "left")
    hit = F.coalesce(F.expr(f"shiftrightunsigned({bits}, cast({at} & 63 as int)) & 1 = 1"), F.lit(False))
    return held.select(*columns_of(df), hit.alias(name))


def sifted(df: DataFrame, keys: list[F.Column], words: DataFrame, inside: bool = True) -> DataFrame:
    """Rows of ``df`` that may be among the keys of a sieve, or those that surely are not."""
    (hit,) = free(df.columns, "hit")
    return marked(df, keys, words, hit).where(F.col(hit) == inside).select(*columns_of(df))


def discard(spark: SparkSession) -> int:
    """Delete the tables this application wrote to the shared folder, when no result that reads them is needed any more."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        remove(spark, path)
    return len(paths)


def arrow_batches(spark: SparkSession, rows: int = 1000, megabytes: int = 16) -> None:
    """Before a Python pass: workers get the package, and Arrow batches stay small for long texts, by rows and by bytes."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(megabytes << 20))


def crc32_fold(doc_id: F.Column, folds: int = 5) -> F.Column:
    """``crc32(doc_id as text) mod folds``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds)).cast("int")
