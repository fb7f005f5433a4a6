"""The drift pipeline: a law, its description, the equation made from that, and how far it went astray.

The texts come from elsewhere, as a table ``intended_id, nl_description,
generated_equation_raw``; one DataFrame plan reads, routes, labels and explains
all rows at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parse
from .evidence import with_status
from .magmas import brute_force
from .mapping import law_text, normalize_dialect
from .verdicts import relation

COLUMNS = (
    "intended_id", "intended_equation", "nl_description", "generated_equation_raw", "normalized_equation",
    "generated_status", "generated_etp_id", "oracle_used", "label", "explanation",
)
#: What each label means for the reader.  Fixed values.
MEANINGS = {
    "equivalent": "NONE -- the LLM's translation preserved the intended meaning exactly.",
    "stronger": "STRENGTHENING -- the generated equation implies the intended one, but not vice versa. "
    "The LLM's translation added a constraint that was not present in the original.",
    "weaker": "WEAKENING -- the intended equation implies the generated one, but not vice versa. "
    "The LLM's translation dropped a constraint that was present in the original.",
    "incomparable": "INCOMPARABLE -- neither equation implies the other. The LLM's translation describes a genuinely "
    "different, unrelated law, even though it may be syntactically valid.",
    "unknown": "UNKNOWN -- the available oracle could not determine the relationship within its search bounds.",
}
NO_ORACLE, TABLES, GRAPH = "none (parse failure)", "brute_force", "implication_graph"


def explanation(intended_id: Column, intended: Column, nl: Column, raw: Column, status: Column, normalized: Column, etp_id: Column, label: Column, oracle: Column) -> Column:
    """The row's story, its parts joined by a bar."""
    cat = lambda *p: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in p))
    head = [
        cat("Intended theory: E", intended_id, ' = "', intended, '"'),
        cat('NL description generated: "', F.coalesce(nl, F.lit("")), '"'),
        cat("LLM's translation back to a formal equation: \"", F.coalesce(raw, F.lit("")), '"'),
    ]
    meaning = F.lit(None).cast("string")
    for name, text in MEANINGS.items():
        meaning = F.when(label == name, text).otherwise(meaning)
    failed = [
        F.lit("Normalization failed: the LLM's output could not be parsed as a valid equation."),
        F.lit("Semantic drift: UNRESOLVABLE -- no comparison possible, the translation step itself failed."),
    ]
    known = F.when(status == "in_fragment", cat(" (matches ETP E", etp_id, ")")).otherwise(" (not a catalogued ETP law)")
    told = [
        cat('Normalized form: "', normalized, '"', known),
        cat("Comparison method used: ", oracle),
        cat("Semantic drift: ", F.coalesce(meaning, cat(label, " (unrecognized label -- inspect manually)."))),
    ]
    return F.when(status == "invalid", F.concat_ws(" | ", *head, *failed)).otherwise(F.concat_ws(" | ", *head, *told))


def run(df: DataFrame, matrix: DataFrame, max_size: int = 3) -> DataFrame:
    """The ten columns of a drift report for every row of ``df``.

    Unreadable output is invalid; a law of the catalogue is looked up in the
    evidence; anything larger is held against all tables up to ``max_size``,
    which can only tell that neither side implies the other.
    """
    named = normalize_dialect(law_text(df, "intended_id", "intended_equation"), "generated_equation_raw", "__n")
    named = named.persist()  # read below by every route; lost parts are computed again
    n = F.col("__n")
    wide = named.withColumns({"__node": F.when(n["status"] == "in_fragment", n["etp_id"].cast("int")), "__beyond": F.when(n["status"] == "outside_fragment", n["normalized"])})
    known = with_status(with_status(wide, matrix, "intended_id", "__node", "__f"), matrix, "__node", "intended_id", "__b")
    graph = relation(F.col("__f"), F.col("__b"))
    # Each distinct pair of a law and an equation beyond the catalogue is searched once.
    pairs = wide.where("__beyond is not null").select(F.col("intended_equation").alias("a"), F.col("__beyond").alias("b")).distinct()
    texts = pairs.select(F.col("b").alias("t")).union(pairs.select("a")).distinct()
    read = parse.analyzed(texts, "t", "p").select("t", F.col("p.lhs").alias("lhs"), F.col("p.rhs").alias("rhs")).where("lhs is not null")
    searched = brute_force(pairs, read, "a", "b", max_size, "t").select(
        F.col("a").alias("__a"), F.col("b").alias("__t"), (F.col("a_implies_b").isNotNull() & F.col("b_implies_a").isNotNull()).alias("__apart")
    )
    met = known.join(searched, (known["intended_equation"] == searched["__a"]) & (known["__beyond"] == searched["__t"]), "left")
    status = n["status"]
    label = (
        F.when(status == "invalid", "invalid")
        .when(status == "in_fragment", graph)
        .when(F.col("__apart"), "incomparable")
        .otherwise("unknown")
    )
    oracle = F.when(status == "invalid", NO_ORACLE).when(status == "in_fragment", GRAPH).otherwise(TABLES)
    out = met.select(
        "intended_id", "intended_equation", "nl_description", "generated_equation_raw", n["normalized"].alias("normalized_equation"),
        status.alias("generated_status"), n["etp_id"].alias("generated_etp_id"), oracle.alias("oracle_used"), label.alias("label"),
    )
    c = F.col
    told = explanation(
        c("intended_id"), c("intended_equation"), c("nl_description"), c("generated_equation_raw"), c("generated_status"),
        c("normalized_equation"), c("generated_etp_id"), c("label"), c("oracle_used"),
    )
    return out.withColumn("explanation", told).select(*COLUMNS)


def summary(report: DataFrame) -> DataFrame:
    """``(label, verdict, n)``: rows by label, and what a label says about drift."""
    verdict = (
        F.when(F.col("label") == "equivalent", "no drift")
        .when(F.col("label").isin("weaker", "stronger"), "directional drift")
        .when(F.col("label") == "incomparable", "mismatch")
        .when(F.col("label") == "invalid", "unreadable")
        .otherwise("inspect")
    )
    return report.groupBy("label", verdict.alias("verdict")).agg(F.count("*").alias("n"))


# -- Prompts: the texts that a model is asked with; asking it is not this engine's part.


def describe_prompt(equation: Column) -> Column:
    """Ask for a description of a law in words."""
    return F.concat(F.lit("Describe the following law of one binary operation in plain English, without symbols.\nLaw: "), equation)


def translate_prompt(description: Column) -> Column:
    """Ask for the law behind a description, without showing it."""
    return F.concat(F.lit("Write the law that the following text describes as one equation with the sign ◇ and nothing else.\nText: "), description)


