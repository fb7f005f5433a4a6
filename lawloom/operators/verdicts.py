"""Labels for pairs of laws: how what was meant relates to what came out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import scratch
from . import models, rewriting
from .evidence import PROOF_FALSE, PROOF_TRUE, STATUSES, UNKNOWN, with_status
from .mapping import MAPPED, resolve

#: What an unmapped side is told, worded as users know it.  Fixed value.
OFF_GRAPH = (
    "{} equation: {}. The implication-graph oracle cannot speak; fall back to Lean / finite-magma search, else label unknown."
)


def _both(forward: Column, backward: Column, f: int, b: int) -> Column:
    return (forward == f) & (backward == b)


def label(intended: Column, generated: Column, forward: Column, backward: Column) -> Column:
    """The label of two law numbers from the statuses of both implications."""
    return (
        F.when(intended == generated, "equal")
        .when(_both(forward, backward, PROOF_TRUE, PROOF_TRUE), "equivalent")
        .when(_both(forward, backward, PROOF_TRUE, PROOF_FALSE), "weaker")
        .when(_both(forward, backward, PROOF_FALSE, PROOF_TRUE), "stronger")
        .when(_both(forward, backward, PROOF_FALSE, PROOF_FALSE), "incomparable")
        .otherwise("unknown")
    )


def relation(forward: Column, backward: Column) -> Column:
    """As ``label`` without knowing the laws: none is equal, and an open side leaves the pair unknown."""
    return label(F.lit(1), F.lit(2), forward, backward)


def status_name(status: Column) -> Column:
    return F.get(F.array(*map(F.lit, STATUSES)), status.cast("int"))


def verdict_pairs(pairs: DataFrame, matrix: DataFrame, intended: str = "intended", generated: str = "generated") -> DataFrame:
    """``pairs`` of law numbers with ``forward, backward`` (statuses) and ``label``; two broadcast lookups, no shuffle."""
    both = with_status(with_status(pairs, matrix, intended, generated, "forward"), matrix, generated, intended, "backward")
    return both.withColumn("label", label(F.col(intended), F.col(generated), F.col("forward"), F.col("backward")))


def _stored(df: DataFrame, label: str) -> DataFrame:
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled_edges(open_pairs: DataFrame, laws_df: DataFrame) -> DataFrame:
    """``(hyp, concl, status, chain, witness)`` of those ``open_pairs(hyp, concl)`` that rewriting proves or a larger table refutes.

    Proofs are tried first; tables are searched for the pairs left over.  A
    proof has its ``chain`` of terms, a refutation its ``witness`` table; both
    were checked by other code than found them, and a pair that fails the check
    is no edge.  Each row of the result is a distinct pair.
    """
    asked = _stored(open_pairs.select("hyp", "concl").where("hyp is not null and concl is not null").distinct(), "open-pairs")
    proved = rewriting.replayed(rewriting.proofs(asked, laws_df), laws_df).where("valid").select("hyp", "concl", "chain")
    proved = _stored(proved, "proved-pairs")
    left = asked.join(proved.select("hyp", "concl"), ["hyp", "concl"], "left_anti")
    found = models.refuted(models.counterexamples(left, laws_df), laws_df).where("valid").select("hyp", "concl", "witness")
    found = found.withColumns({"status": F.lit(PROOF_FALSE), "chain": F.lit(None).cast("array<array<int>>")})
    every = proved.withColumns({"status": F.lit(PROOF_TRUE), "witness": F.lit(None).cast("struct<n:int,tab:array<int>>")})
    return _stored(every.select("hyp", "concl", "status", "chain", "witness").unionByName(found), "settled-pairs")


def settled_pairs(pairs: DataFrame, matrix: DataFrame, laws_df: DataFrame, intended: str = "intended", generated: str = "generated") -> DataFrame:
    """As ``verdict_pairs``, where implications that the matrix leaves open are settled by rewriting or larger tables if they can be.

    Adds ``found_forward, found_backward``: true where the status comes from there.
    """
    told = verdict_pairs(pairs, matrix, intended, generated)
    i, g = F.col(intended).cast("int"), F.col(generated).cast("int")
    ways = F.array(F.struct(i.alias("hyp"), g.alias("concl"), F.col("forward").alias("s")), F.struct(g.alias("hyp"), i.alias("concl"), F.col("backward").alias("s")))
    edges = settled_edges(told.select(F.explode(ways).alias("w")).where(F.col("w.s") == UNKNOWN).select("w.hyp", "w.concl"), laws_df)
    for status, a, b in (("forward", intended, generated), ("backward", generated, intended)):
        edge = edges.select(F.col("hyp").alias("__h"), F.col("concl").alias("__c"), F.col("status").alias("__s"))
        told = told.join(edge, (F.col(a) == F.col("__h")) & (F.col(b) == F.col("__c")), "left")
        told = told.withColumns({f"found_{status}": F.col("__s").isNotNull(), status: F.coalesce("__s", status).cast("tinyint")}).drop("__h", "__c", "__s")
    return told.withColumn("label", label(F.col(intended), F.col(generated), F.col("forward"), F.col("backward")))


def _said(template: str, **values: Column) -> Column:
    """Text with columns put in for names in braces."""
    parts, rest = [], template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [F.lit(before), values[name].cast("string")]
    return F.concat(*parts, F.lit(rest))


def compare(df: DataFrame, intended: str, generated: str, matrix: DataFrame, ingested: bool = False, out: str = "verdict") -> DataFrame:
    """``df`` with a verdict on two columns of equation texts or law numbers.

    ``struct<label, intended, generated, forward, backward, evidence, notes>``.
    ``ingested`` tells that the matrix holds published, formally checked
    results; the evidence of a derived matrix is worded as what it is.
    """
    one = resolve(df, intended, "__i")
    two = resolve(one, generated, "__g")
    spread = two.withColumns({"__in": F.col("__i.node"), "__gn": F.col("__g.node")})
    told = verdict_pairs(spread, matrix, "__in", "__gn")
    i, g = F.col("__i"), F.col("__g")
    off_i, off_g = i["status"] != MAPPED, g["status"] != MAPPED
    lab = F.when(off_i, i["status"]).when(off_g, g["status"]).otherwise(F.col("label"))
    fwd, bwd = status_name(F.col("forward")), status_name(F.col("backward"))
    proof = "Lean proof" if ingested else "derived proof"
    table = "counterexample magma" if ingested else "counterexample table"
    v = {"i": F.col("__in"), "g": F.col("__gn"), "f": fwd, "b": bwd}
    evidence = (
        F.when(F.col("label") == "equal", _said("both map to Equation {i}", **v))
        .when(F.col("label") == "equivalent", _said(proof + "s of Eq{i} => Eq{g} and Eq{g} => Eq{i}", **v))
        .when(F.col("label") == "weaker", _said(proof + " of Eq{i} => Eq{g}; " + table + " refutes Eq{g} => Eq{i}", **v))
        .when(F.col("label") == "stronger", _said(proof + " of Eq{g} => Eq{i}; " + table + " refutes Eq{i} => Eq{g}", **v))
        .when(F.col("label") == "incomparable", F.lit(table + "s refute the implication in both directions"))
        .otherwise(_said("not fully resolved: forward={f}, backward={b}", **v))
    )
    on = ~off_i & ~off_g
    head, middle, tail = OFF_GRAPH.split("{}")
    note = lambda side, r: F.concat(F.lit(head + side + middle), r, F.lit(tail))
    verdict = F.struct(
        lab.alias("label"), i.alias("intended"), g.alias("generated"), F.when(on, fwd).alias("forward"), F.when(on, bwd).alias("backward"),
        F.when(on, evidence).alias("evidence"), F.when(off_i, note("intended", i["reason"])).when(off_g, note("generated", g["reason"])).alias("notes"),
    )
    return told.withColumn(out, verdict).drop("__i", "__g", "__in", "__gn", "forward", "backward", "label")


def histogram(labelled: DataFrame, column: str = "label") -> DataFrame:
    """``(label, n)``."""
    return labelled.groupBy(F.col(column).alias("label")).agg(F.count("*").alias("n"))


def implies(pairs: DataFrame, edge_rows: DataFrame, hyp: str, concl: str, out: str) -> DataFrame:
    """``pairs`` with true, false or null: what an edge list ``(hyp, concl, status)`` proves; a missing edge proves nothing.

    An equi-join on both numbers, for edge tables that are too large or too
    partial for the packed matrix.  Both sides are sorted: an edge table that comes from the packed
    matrix is a thousand times what Spark takes it for, and would be broadcast.
    """
    edge = edge_rows.select(F.col("hyp").alias("__h"), F.col("concl").alias("__c"), F.col("status").alias("__s")).hint("merge")
    told = F.when(F.col("__s") == PROOF_TRUE, True).when(F.col("__s") == PROOF_FALSE, False)
    met = pairs.join(edge, (F.col(hyp) == F.col("__h")) & (F.col(concl) == F.col("__c")), "left")
    return met.withColumn(out, told).drop("__h", "__c", "__s")


def edge_relations(pairs: DataFrame, edge_rows: DataFrame, intended: str = "intended", generated: str = "generated") -> DataFrame:
    """``pairs`` with ``label`` from an edge list in both directions; a law's relation to itself is only what its own edge says."""
    both = implies(implies(pairs, edge_rows, intended, generated, "__f"), edge_rows, generated, intended, "__b")
    code = lambda c: F.when(F.col(c), PROOF_TRUE).when(~F.col(c), PROOF_FALSE)
    return both.withColumn("label", relation(code("__f"), code("__b"))).drop("__f", "__b")
