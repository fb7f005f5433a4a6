"""Writers of catalogues, matrices and reports.

Catalogues have a few thousand rows and a fixed order, so the single-file
formats are written from one sorted partition; large results go to Parquet.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.notations import LeanStyle, Notation
from ..operators.evidence import STATUSES, status_counts


def _one_text(df: DataFrame, line: str, path: str) -> None:
    df.coalesce(1).select(line).write.mode("overwrite").text(path)


def write_catalogue(rows: DataFrame, form: Notation, path: str, verified: bool = True) -> None:
    """``equations`` (JSON lines) and ``meta`` (one row) under ``path``; the rendering is named after its notation."""
    body = rows.select("node", "formal", F.col("rendering").alias(form.name), "order", "variables").orderBy("node")
    body.coalesce(1).write.mode("overwrite").json(f"{path}/equations")
    count = rows.count()
    meta = {
        "generator": "lawloom", "source": "generated", "count": count, "representation": form.name,
        "generated_at": dt.datetime.now(dt.UTC).strftime("%Y-%m-%dT%H:%M:%SZ"), "style": str(form.style), "verified": verified,
    }
    rows.sparkSession.createDataFrame([tuple(meta.values())], list(meta)).coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def json_document(rows: DataFrame, form: Notation, verified: bool = True) -> DataFrame:
    """One row, one column: the whole catalogue as a JSON document ``{meta, equations}``."""
    each = F.struct("node", "formal", F.col("rendering").alias(form.name), "order", "variables")
    every = rows.agg(F.array_sort(F.collect_list(each)).alias("equations"), F.count("*").alias("count"))
    told = {"generator": "lawloom", "source": "generated", "representation": form.name, "style": str(form.style)}
    meta = F.struct(
        *(F.lit(v).alias(k) for k, v in told.items()), "count", F.date_format(F.to_utc_timestamp(F.now(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("generated_at"),
        F.lit(verified).alias("verified"),
    )
    return every.select(F.to_json(F.struct(meta.alias("meta"), "equations")).alias("value"))


def write_listing(rows: DataFrame, path: str, multiline: bool = False) -> None:
    """``N. text`` a line, or a commented block for each rendering of several lines."""
    number = F.col("node").cast("string")
    line = F.concat(F.lit("# "), number, F.lit("\n"), F.col("rendering"), F.lit("\n")) if multiline else F.concat(number, F.lit(". "), F.col("rendering"))
    _one_text(rows.orderBy("node").select(line.alias("value")), "value", path)


def _framed(rows: DataFrame, line, head: str, tail: str) -> DataFrame:
    """Lines in order of ``node`` between a head and a tail."""
    spark = rows.sparkSession
    ends = spark.createDataFrame([(0, head), (1 << 30, tail)], "node int, value string")
    return rows.select("node", line.alias("value")).union(ends).orderBy("node")


def write_tex(rows: DataFrame, path: str, operator: str = r"\diamond") -> None:
    """A document that compiles, with every law as a numbered item."""
    head = "\\documentclass{article}\n\\usepackage{amsmath,amssymb}\n\\begin{document}\n\\noindent"
    line = F.concat(F.lit("Equation "), F.col("node").cast("string"), F.lit(": $"), F.col("rendering"), F.lit("$\\\\"))
    _one_text(_framed(rows, line, head, "\\end{document}"), "value", path)


def write_lean(rows: DataFrame, path: str, style: LeanStyle) -> None:
    """A file that stands alone; the star universe needs a library and is refused."""
    if style.universe == "star":
        raise ValueError("Type* needs a library, so the file would not stand alone")
    head = "universe u\n\nclass Magma (α : Type _) where\n  op : α → α → α\n\ninfix:65 \" ◇ \" => Magma.op\n"
    _one_text(_framed(rows, F.col("rendering"), head, ""), "value", path)


def write_matrix(matrix: DataFrame, path: str) -> None:
    """The packed matrix as Parquet, and its counts as one row of ``meta``."""
    matrix.write.mode("overwrite").parquet(f"{path}/matrix")
    counts = status_counts(matrix).groupBy().pivot("name", list(STATUSES)).agg(F.first("n_pairs"))
    counts.withColumn("orientation", F.lit("row = hypothesis, column = conclusion")).coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def write_matrix_file(matrix: DataFrame, path: str) -> None:
    """The packed matrix as a flat file, one byte per ordered pair, a row per hypothesis.

    A single file in row order, so it is put together on the driver; its size
    (22 MB) is fixed by the catalogue.  Raises if a row is missing.
    """
    spark = matrix.sparkSession
    row = F.encode(F.array_join(F.transform("statuses", lambda s: F.char(s.cast("long"))), ""), "ISO-8859-1")
    held = matrix.select("hyp", row.alias("bytes")).orderBy("hyp").toArrow()
    if held["hyp"].to_pylist() != list(range(1, len(held) + 1)):
        raise ValueError("the matrix lacks rows")
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        for piece in held["bytes"].to_pylist():
            out.write(bytearray(piece))
    finally:
        out.close()


def write_records(rows: DataFrame, path: str) -> None:
    """JSON lines, nulls spelled out."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_edges(edge_rows: DataFrame, path: str, buckets: int = 16) -> None:
    """The edge table, partitioned by ranges of hypotheses so that lookups read few files.

    A range is written by as many tasks as its size asks for: there are ten ranges, however many edges.
    """
    keyed = edge_rows.withColumn("hyp_range", F.floor(F.col("hyp") / F.lit(512)).cast("int"))
    keyed.hint("rebalance", buckets, "hyp_range").write.mode("overwrite").partitionBy("hyp_range").parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    """A drift report as CSV with a header."""
    report.write.mode("overwrite").csv(path, header=True)
