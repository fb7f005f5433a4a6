"""From equation text to the catalogue's number."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parse, terms
from .catalogue import CATALOGUE_SIZE, MAX_ORDER, law_number, law_of_number, laws

MAPPED, INTERNAL = "mapped", "internal-error"
#: Reasons as users know them.  Fixed values.
TOO_LARGE = "valid magma identity, but order {} > 4: not in the ETP catalogue"
MISSING = "order <= 4 identity missing from the exhaustive catalogue — normalizer bug, please report"
TAUTOLOGY = "both sides are the same term: a tautology, which the catalogue leaves out"
OUT_OF_RANGE = f"equation number out of range 1..{CATALOGUE_SIZE}"


def map_texts(df: DataFrame, column: str, out: str = "mapped") -> DataFrame:
    """``df`` with ``struct<status, input_text, normalized, node, order, reason>`` for an equation text.

    Status is mapped, parse-failure, outside-fragment or internal-error; the
    last only for tautologies, which are identities without a number.
    """
    spark = df.sparkSession
    keys = laws(spark).select(F.col("canonical_key").alias("__key"), F.col("node").alias("__node"))
    found = parse.analyzed(df, column, "__a")
    # 4694 keys, a size fixed by the catalogue.
    joined = found.join(F.broadcast(keys), F.col("__a.canonical_key") == F.col("__key"), "left")
    a = F.col("__a")
    large = a["ok"] & (a["order"] > MAX_ORDER)
    missing = a["ok"] & ~large & F.col("__node").isNull()
    head, tail = TOO_LARGE.split("{}")
    status = F.when(~a["ok"], a["error"]).when(large, parse.OUTSIDE).when(missing, INTERNAL).otherwise(MAPPED)
    reason = (
        F.when(~a["ok"], a["reason"])
        .when(large, F.concat(F.lit(head), a["order"].cast("string"), F.lit(tail)))
        .when(missing & (a["lhs"] == a["rhs"]), TAUTOLOGY)
        .when(missing, MISSING)
    )
    result = F.struct(
        status.alias("status"), F.col(column).alias("input_text"), a["normalized"].alias("normalized"),
        F.when(status == MAPPED, F.col("__node")).alias("node"), a["order"].alias("order"), reason.alias("reason"),
    )
    return joined.withColumn(out, result).drop("__a", "__key", "__node")


def resolve(df: DataFrame, column: str, out: str = "mapped") -> DataFrame:
    """As ``map_texts``, where a text of digits is a law's number.

    Numbers beyond the catalogue are a parse failure.
    """
    spark = df.sparkSession
    text = F.col(column).cast("string")
    number = F.regexp_extract(text, r"^\s*([0-9]+)\s*$", 1)
    known = laws(spark).select(F.col("node").cast("string").alias("__n"), F.col("formal").alias("__formal"))
    digits = F.regexp_replace(number, "^0+(?=.)", "")
    spec = df.withColumns({"__digits": F.when(number != "", digits)}).join(F.broadcast(known), F.col("__digits") == F.col("__n"), "left")
    spec = spec.withColumn("__spec", F.when(F.col("__digits").isNull(), text).otherwise(F.coalesce("__formal", F.lit(""))))
    found = map_texts(spec, "__spec", "__m")
    outside = F.col("__digits").isNotNull() & F.col("__formal").isNull()
    m = F.col("__m")
    result = F.struct(
        F.when(outside, parse.FAILURE).otherwise(m["status"]).alias("status"),
        F.when(outside, text).otherwise(m["input_text"]).alias("input_text"),
        m["normalized"].alias("normalized"), m["node"].alias("node"), m["order"].alias("order"),
        F.when(outside, OUT_OF_RANGE).otherwise(m["reason"]).alias("reason"),
    )
    return found.withColumn(out, result).drop("__digits", "__n", "__formal", "__spec", "__m")


def law_text(df: DataFrame, node: str, out: str = "formal") -> DataFrame:
    """``df`` with the text of the law whose number is in column ``node``; null beyond the catalogue."""
    known = laws(df.sparkSession).select(F.col("node").alias("__node"), F.col("formal").alias(out))
    return df.join(F.broadcast(known), F.col(node) == F.col("__node"), "left").drop("__node")


def lookup_key(df: DataFrame, key: str, out: str = "node") -> DataFrame:
    """``df`` with the number of the law that has the canonical key in column ``key``; null if none has."""
    known = laws(df.sparkSession).select(F.col("canonical_key").alias("__key"), F.col("node").alias(out))
    return df.join(F.broadcast(known), F.col(key) == F.col("__key"), "left").drop("__key")


def _oriented(lhs: Column, rhs: Column) -> Column:
    """The catalogue's spelling: smaller order, then smaller shape, then smaller rhyme on the left."""
    spelled = terms.renumber(lhs, rhs), terms.renumber(rhs, lhs)

    def rank(term: Column) -> Column:
        # Preorder bits of a given order sort by left argument first, and a smaller left argument has its 0 sooner.
        return F.struct(terms.order(term).alias("o"), terms.shape_bits(term).alias("b"))

    def rhyme(t: Column) -> Column:
        return F.concat(terms.leaves(t["lhs"]), terms.leaves(t["rhs"]))

    swap = (rank(rhs) < rank(lhs)) | ((rank(rhs) == rank(lhs)) & (rhyme(spelled[1]) < rhyme(spelled[0])))
    return F.when(swap, spelled[1]).otherwise(spelled[0])


def _numbers(lhs: pd.Series, rhs: pd.Series) -> pd.Series:
    return pd.Series([None if a is None else law_number(tuple(a), tuple(b)) for a, b in zip(lhs, rhs, strict=True)], dtype="Int64")


def normalize_dialect(df: DataFrame, column: str, out: str = "normalized") -> DataFrame:
    """``df`` with ``struct<status, normalized, etp_id, error>`` of a text in the second dialect.

    Status is invalid, outside_fragment or in_fragment; a tautology has id 0.
    """
    from ..shipping import ship

    spark = df.sparkSession
    ship(spark)
    texts = df.select(F.col(column).alias("__text")).distinct().withColumn("p", parse.parsed_dialect(F.col("__text")))
    names = F.transform(F.sequence(F.lit(0), F.greatest(F.size("p.names") - 1, F.lit(0))), terms.dialect_name)
    found = texts.select("__text", "p", _oriented(F.col("p.lhs"), F.col("p.rhs")).alias("t"), names.alias("n"))
    found = found.select(
        "__text", "p", "t", terms.render(F.col("t.lhs"), F.col("t.rhs"), F.col("n")).alias("spelled"),
        terms.canonical_key(F.col("t.lhs"), F.col("t.rhs")).alias("key"), (F.col("t.lhs") == F.col("t.rhs")).alias("same"),
        (terms.order(F.col("t.lhs")) + terms.order(F.col("t.rhs"))).alias("o"),
    )
    keyed = lookup_key(found, "key", "__node")
    # Laws beyond the catalogue are rare; only they are numbered in Python.
    beyond = (F.col("o") > MAX_ORDER) & ~F.col("same")
    number = F.pandas_udf(_numbers, "long")
    keyed = keyed.withColumn("beyond", number(F.when(beyond, F.col("t.lhs")), F.when(beyond, F.col("t.rhs"))))
    ok = F.col("p.ok")
    result = F.struct(
        F.when(~ok, "invalid").when(F.col("__node").isNull(), "outside_fragment").otherwise("in_fragment").alias("status"),
        F.when(ok, F.col("spelled")).alias("normalized"),
        F.when(ok, F.coalesce(F.col("__node").cast("long"), F.when(F.col("same"), F.lit(0)), F.col("beyond"))).alias("etp_id"),
        F.when(~ok, F.col("p.reason")).alias("error"),
    )
    return df.join(keyed.select("__text", result.alias(out)), df[column].eqNullSafe(F.col("__text"))).drop("__text")


def _sides(numbers: pd.Series) -> pd.DataFrame:
    rows = [([], []) if pd.isna(n) or n < 1 else tuple(map(list, law_of_number(int(n)))) for n in numbers]
    return pd.DataFrame(rows, columns=["lhs", "rhs"])


def laws_by_number(df: DataFrame, column: str, out: str = "law") -> DataFrame:
    """``df`` with ``struct<lhs, rhs, formal>`` of the law with that number, of any order; null below 1.

    Numbers within the catalogue are looked up in it elsewhere (``law_text``);
    this counts them out, once per distinct number.
    """
    from ..shipping import ship

    ship(df.sparkSession)
    udf = F.pandas_udf(_sides, "lhs array<int>, rhs array<int>")
    each = df.select(F.col(column).alias("__n")).distinct().withColumn("t", udf(F.col("__n").cast("long")))
    lhs, rhs = F.col("t.lhs"), F.col("t.rhs")
    size = F.size(terms.variables(lhs, rhs))
    names = F.transform(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0))), terms.dialect_name)
    law = F.when(F.size(lhs) > 0, F.struct(lhs.alias("lhs"), rhs.alias("rhs"), terms.render(lhs, rhs, names).alias("formal")))
    return df.join(each.select("__n", law.alias(out)), df[column].eqNullSafe(F.col("__n"))).drop("__n")


def find(specs_df: DataFrame, out: str = "found") -> DataFrame:
    """``specs_df(spec, dual)`` with the number of each law, or of its dual where asked for; null if it has none."""
    from .catalogue import dual

    told = resolve(specs_df, "spec", "__told")
    other = dual(laws(specs_df.sparkSession)).select(F.col("node").alias("__node"), "dual_node")
    met = told.join(F.broadcast(other), F.col("__told.node") == F.col("__node"), "left")
    return met.withColumn(out, F.when(F.col("dual"), F.col("dual_node")).otherwise(F.col("__told.node"))).drop("__told", "__node", "dual_node")
