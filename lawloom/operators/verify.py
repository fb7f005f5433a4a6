"""Building a notation's catalogue, and the gates it has to pass first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parse, terms
from ..functions.notations import NOTATIONS, Notation, notation
from . import magmas
from .catalogue import laws

PURE_TEXT = r"^[a-z]+(?:[, ][a-z]+)*$"


class GateFailure(ValueError):
    """A catalogue that must not be written."""


def build_rows(spark: SparkSession, form: Notation | str, limit: int | None = None) -> DataFrame:
    """``node, formal, rendering, order, variables`` for every law, or the first ``limit``."""
    form = notation(form) if isinstance(form, str) else form
    source = laws(spark)
    if limit is not None:
        source = source.where(F.col("node") <= limit)  # numbers have no gaps, so this is the first `limit` rows
    text = form.rendered(F.col("lhs"), F.col("rhs"), F.col("names"), F.col("node"))
    return source.select("node", "formal", text.alias("rendering"), F.col("ord").alias("order"), "variables", "lhs", "rhs", "names")


def check_rows(rows: DataFrame, form: Notation | str) -> DataFrame:
    """``rows`` with ``canonical_ok`` (the law's text is its own normal form), ``trip_ok``, ``variables_ok`` and ``text_ok``."""
    form = notation(form) if isinstance(form, str) else form
    lhs, rhs, names = F.col("lhs"), F.col("rhs"), F.col("names")
    back = form.read_back(F.col("rendering"), F.col("node"))
    read = rows.withColumn("__back", back)
    trip = (F.col("__back.lhs") == lhs) & (F.col("__back.rhs") == rhs)
    if form.match == "exact":
        trip = trip & (F.col("__back.names") == F.col("variables"))
    pure = F.rlike("rendering", F.lit(PURE_TEXT)) if form.name in ("text", "text2") else F.lit(True)
    return read.withColumns(
        {
            "canonical_ok": terms.normalized(lhs, rhs) == F.col("formal"),
            "trip_ok": F.coalesce(trip, F.lit(False)),
            # The binders by name and in order where the notation keeps names, else as many of them.
            "variables_ok": F.col("__back.names") == F.col("variables") if form.match == "exact" else F.size("__back.names") == F.size(names),
            "text_ok": pure,
        }
    ).drop("__back")


def semantics_ok(rows: DataFrame, form: Notation | str) -> DataFrame:
    """``rows`` with ``semantics_ok``: what is read back decides the law as the law itself does, in six fixed tables."""
    form = notation(form) if isinstance(form, str) else form
    back = form.read_back(F.col("rendering"), F.col("node"))
    read = rows.withColumn("__back", back).withColumns({"__l": F.col("__back.lhs"), "__r": F.col("__back.rhs")})
    return read.withColumn("semantics_ok", F.coalesce(magmas.agrees(read, "lhs", "rhs", "__l", "__r"), F.lit(False))).drop("__back", "__l", "__r")


def repeats(rows: DataFrame, column: str = "rendering") -> DataFrame:
    """``(rendering, node, n)`` of texts that more than one law has, with the first such law."""
    return rows.groupBy(column).agg(F.min("node").alias("node"), F.count("*").alias("n")).where("n > 1")


def verified(rows: DataFrame, form: Notation | str) -> DataFrame:
    """``rows`` if every gate holds; raises before anything is written otherwise."""
    checked = check_rows(rows, form).cache()
    gates = ("canonical_ok", "trip_ok", "variables_ok", "text_ok")
    failed = [F.sum((~F.coalesce(F.col(g), F.lit(False))).cast("int")).alias(g) for g in gates]
    failed.append((F.count("rendering") - F.count_distinct("rendering")).alias("repeated"))
    found = checked.agg(*failed).first().asDict()
    if any(found.values()):
        raise GateFailure(f"rows that fail: {found}")
    return checked.drop(*gates)


def count_by_order(rows: DataFrame, column: str = "order") -> DataFrame:
    return rows.groupBy(F.col(column).alias("order")).agg(F.count("*").alias("n_laws"))


def length_stats(rows: DataFrame, measure: Column | None = None) -> DataFrame:
    """Least, mean (one decimal) and greatest length of the renderings, in characters or another measure."""
    size = F.length("rendering") if measure is None else measure
    return rows.agg(F.min(size).alias("least"), F.round(F.avg(size), 1).alias("mean"), F.max(size).alias("most"))


def words(column: str = "rendering") -> Column:
    return F.size(F.split(F.trim(F.col(column)), r"\s+"))


def all_lengths(laws_df: DataFrame) -> DataFrame:
    """``(notation, least, mean, most)`` over the seventeen notations in one pass over the laws."""
    lhs, rhs, names = F.col("lhs"), F.col("rhs"), F.col("names")
    each = F.array(*(F.struct(F.lit(n).alias("notation"), F.length(notation(n).rendered(lhs, rhs, names)).alias("size")) for n in NOTATIONS))
    sizes = laws_df.select(F.explode(each).alias("e")).select("e.*")
    return sizes.groupBy("notation").agg(F.min("size").alias("least"), F.round(F.avg("size"), 1).alias("mean"), F.max("size").alias("most"))


def crosscheck(own: DataFrame, upstream: DataFrame) -> DataFrame:
    """``(check, n)``: laws that ``upstream(node, formal)`` lacks or spells otherwise, and those it has beyond."""
    missing = own.join(upstream, "node", "left_anti").agg(F.count("*").alias("n")).select(F.lit("missing").alias("check"), "n")
    other = upstream.select("node", F.col("formal").alias("theirs"))
    differing = own.join(other, "node").where("formal <> theirs").agg(F.count("*").alias("n")).select(F.lit("differing").alias("check"), "n")
    extra = upstream.join(own, "node", "left_anti").agg(F.count("*").alias("n")).select(F.lit("extra").alias("check"), "n")
    return missing.union(differing).union(extra)


def same_laws(one: DataFrame, two: DataFrame, first: Notation | str, second: Notation | str) -> DataFrame:
    """``(node, same)``: two catalogues read back and compared law by law."""
    a, b = (notation(f) if isinstance(f, str) else f for f in (first, second))
    left = one.select("node", a.read_back(F.col("rendering")).alias("x"))
    right = two.select("node", b.read_back(F.col("rendering")).alias("y"))
    return left.join(right, "node").select("node", F.coalesce((F.col("x.lhs") == F.col("y.lhs")) & (F.col("x.rhs") == F.col("y.rhs")), F.lit(False)).alias("same"))


def analyzed_rendering(df: DataFrame, column: str, form: Notation | str, out: str = "rendered") -> DataFrame:
    """``df`` with ``struct<ok, rendering, error, reason>``: an equation text written in a notation.

    The error is the parser's, or says that the notation cannot spell a name.
    """
    form = notation(form) if isinstance(form, str) else form
    target = {"lean": "lean", "py_lambda": "python", "py_cayley_table": "python"}.get(form.name, form.name)
    read = parse.analyzed(df, column, "__a")
    a = F.col("__a")
    text = F.when(a["ok"], form.rendered(a["lhs"], a["rhs"], a["names"]))
    unspoken = a["ok"] & text.isNull()
    result = F.struct(
        (a["ok"] & text.isNotNull()).alias("ok"),
        text.alias("rendering"),
        F.when(unspoken, f"{target}-unrepresentable").otherwise(a["error"]).alias("error"),
        F.when(unspoken, "a variable's name cannot be used in this notation").otherwise(a["reason"]).alias("reason"),
    )
    return read.withColumn(out, result).drop("__a")


def same_equation(a: Column, b: Column, renamed: bool = False) -> Column:
    """Whether two encoded equations are one tree, with the same names or up to renaming."""
    one, two = terms.renumber(a["lhs"], a["rhs"]), terms.renumber(b["lhs"], b["rhs"])
    same = (one["lhs"] == two["lhs"]) & (one["rhs"] == two["rhs"])
    if renamed:
        return same
    named = lambda e: F.transform(terms.variables(e["lhs"], e["rhs"]), lambda t: F.get(e["names"], t))
    return same & (named(a) == named(b))
