"""Readers of law lists, published outcomes, edge lists and selections."""

from __future__ import annotations

import io
import json
import os
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import clean
from ..operators.catalogue import CATALOGUE_SIZE
from ..operators.evidence import OUTCOMES
from ..shipping import ship

DEFAULT_SELECTION = (1, 2, 43, 4512, 168)
UNSHAPED = "the outcomes are no square matrix of Equation1 to EquationN"


#: Where a law list and published outcomes are if no path is given: a Spark setting, then a variable of the environment.
LAWS_AT, OUTCOMES_AT = ("lawloom.laws", "LAWLOOM_LAWS"), ("lawloom.outcomes", "LAWLOOM_OUTCOMES")


def path_of(spark: SparkSession, given: str | None, names: tuple[str, str]) -> str | None:
    """A path as given, else from the session's settings, else from the environment, else none."""
    setting, variable = names
    return given or spark.conf.get(setting, None) or os.environ.get(variable) or None


def read_laws(spark: SparkSession, path: str) -> DataFrame:
    """``(node, formal)`` of a text with one law per line; the line's number is the law's.

    Blank lines at the end do not count; one in between would shift all numbers
    and is refused.
    """
    whole = spark.read.text(path, wholetext=True)
    body = F.regexp_replace(F.regexp_replace("value", r"\r\n?", "\n"), r"\s+$", "")
    lines = whole.select(F.posexplode(F.split(body, "\n", -1)).alias("p", "line"))
    fine = F.when(F.trim("line") == "", F.raise_error(F.concat(F.lit("blank line "), (F.col("p") + 1).cast("string")))).otherwise(F.trim("line"))
    return lines.select((F.col("p") + 1).alias("node"), fine.alias("formal"))


def outcome_code(outcome):
    """Status code of an outcome word; an unknown word stops the job."""
    known = F.create_map(*(x for k, v in OUTCOMES.items() for x in (F.lit(k), F.lit(v).cast("tinyint"))))
    code = F.try_element_at(known, outcome)
    return F.when(code.isNull(), F.raise_error(F.concat(F.lit("unknown outcome "), F.coalesce(outcome, F.lit("null")))).cast("tinyint")).otherwise(code)


def _archived(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``(p, row)``: the rows of the outcomes document in each archive, a few at a time."""
    for batch in batches:
        for held in batch["content"]:
            with zipfile.ZipFile(io.BytesIO(bytes(held))) as archive:
                members = [m for m in archive.namelist() if m.endswith(".json")]
                if len(members) != 1:
                    raise ValueError(f"expected one JSON file in the archive, found {len(members)}")
                document = json.loads(archive.read(members[0]))
            names, rows = document["equations"], document["outcomes"]
            n = len(names)
            if n == 0 or len(rows) != n or any(len(row) != n for row in rows) or names[0] != "Equation1" or names[-1] != f"Equation{n}":
                raise ValueError(UNSHAPED)
            for at in range(0, n, 64):
                yield pd.DataFrame({"p": range(at, min(at + 64, n)), "row": rows[at : at + 64]})


def read_outcomes(spark: SparkSession, path: str) -> DataFrame:
    """The packed matrix of an outcomes document ``{equations, outcomes}``, plain or as the only JSON file of a zip archive.

    Spark reads no zip archives, so a task unpacks each and hands its rows on, a
    row per hypothesis; nothing of it passes through the driver.
    """
    schema = "equations array<string>, outcomes array<array<string>>"
    if path.endswith(".zip"):
        ship(spark)
        rows = spark.read.format("binaryFile").load(path).select("content").mapInPandas(_archived, "p int, row array<string>")
        return rows.select((F.col("p") + 1).cast("int").alias("hyp"), F.transform("row", outcome_code).alias("statuses"))
    document = spark.read.schema(T.StructType.fromDDL(schema)).json(path, multiLine=True)
    n = F.size("equations")
    shaped = (
        (F.size("outcomes") == n)
        & F.forall("outcomes", lambda row: F.size(row) == n)
        & (F.get("equations", F.lit(0)) == "Equation1")
        & (F.element_at("equations", -1) == F.concat(F.lit("Equation"), n.cast("string")))
    )
    checked = document.select(F.when(shaped, F.col("outcomes")).otherwise(F.raise_error(F.lit(UNSHAPED)).cast("array<array<string>>")).alias("outcomes"))
    rows = checked.select(F.posexplode("outcomes").alias("p", "row"))
    return rows.select((F.col("p") + 1).cast("int").alias("hyp"), F.transform("row", outcome_code).alias("statuses"))


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """``(hyp, concl, outcome, status)`` of an edge list with a header, ids written ``Equation7`` or ``7``."""
    raw = spark.read.schema("source string, target string, outcome string").csv(path, header=True)
    number = lambda c: F.regexp_replace(F.trim(c), "^Equation", "").cast("int")
    return raw.select(number("source").alias("hyp"), number("target").alias("concl"), "outcome", outcome_code(F.trim("outcome")).alias("status"))


def read_matrix(spark: SparkSession, path: str, size: int = CATALOGUE_SIZE) -> DataFrame:
    """The packed matrix of a flat file, one byte per ordered pair, a row per hypothesis."""
    held = spark.read.format("binaryFile").load(path).select("content", "length")
    fine = F.when(F.col("length") != size * size, F.raise_error(F.lit("the file does not hold a square matrix")).cast("array<int>"))
    fine = fine.otherwise(F.sequence(F.lit(0), F.lit(size - 1)))
    # The file is cut into rows before it is made into rows, which would each hold all of it.
    parts = F.transform(fine, lambda i: F.substr(F.col("content"), i * size + 1, F.lit(size)))
    rows = held.select(F.posexplode(parts).alias("p", "part")).select((F.col("p") + 1).alias("hyp"), "part")
    codes = F.transform(F.split(F.decode("part", "ISO-8859-1"), ""), lambda c: F.ascii(c).cast("tinyint"))
    return rows.repartition("hyp").select(F.col("hyp").cast("int").alias("hyp"), codes.alias("statuses"))


def read_lean(spark: SparkSession, path: str) -> DataFrame:
    """``(node, formal)`` of ``equation N := law`` lines in Lean sources; copies of a law must agree."""
    lines = spark.read.text(path)
    pattern = r"^\s*equation\s+([0-9]+)\s*:=\s*(.*?)\s*(?:--.*)?$"
    found = lines.where(F.rlike("value", F.lit(pattern))).select(
        F.regexp_extract("value", pattern, 1).cast("int").alias("node"), F.regexp_extract("value", pattern, 2).alias("formal")
    )
    each = found.groupBy("node").agg(F.count_distinct("formal").alias("n"), F.min("formal").alias("formal"))
    same = F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("differing copies of equation "), F.col("node").cast("string")))).otherwise(F.col("formal"))
    return each.select("node", same.alias("formal"))


def read_selection(spark: SparkSession, path: str | None = None) -> DataFrame:
    """``(id)`` of a selection file, or of a small built-in selection."""
    if path is None:
        return spark.createDataFrame([(n,) for n in DEFAULT_SELECTION], "id int")
    return spark.read.csv(path, header=True).select(F.col("id").cast("int").alias("id"))


def specs(spark: SparkSession, values: list[str]) -> DataFrame:
    """``specs_of`` the words of a command line."""
    return specs_of(spark.createDataFrame([(v,) for v in values], "raw string"), "raw")


def specs_of(words: DataFrame, column: str) -> DataFrame:
    """``(spec, dual)`` of a column of words: brackets and commas go, a leading star asks for the dual."""
    bare = clean.strip(F.regexp_replace(column, r"[\[\],]", ""))
    return words.select(F.regexp_replace(bare, r"^\*\s*", "").alias("spec"), F.startswith(bare, F.lit("*")).alias("dual")).where("spec <> ''")
