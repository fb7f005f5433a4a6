"""The engine as SQL: views and table functions for plain SQL texts.

``register`` makes temporary views ``laws`` and ``implications`` and temporary
functions in the session: ``law(node)``, ``law_rendering(node, notation)`` and
``law_verdict(intended, generated)``.  They are SQL functions over the views, so
a call in a ``LATERAL`` is planned as a join with tables of the catalogue's
size, and nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.notations import NOTATIONS, notation
from .operators.catalogue import laws

FUNCTIONS = (
    """law(wanted INT COMMENT 'number of a law') RETURNS TABLE (formal STRING, canonical_key STRING, ord INT, n_vars INT)
       RETURN SELECT formal, canonical_key, ord, n_vars FROM laws WHERE node = wanted""",
    """law_rendering(wanted INT, form STRING COMMENT 'name of a notation') RETURNS TABLE (rendering STRING)
       RETURN SELECT rendering FROM law_renderings WHERE node = wanted AND notation = form""",
    """law_verdict(intended INT, generated INT) RETURNS TABLE (label STRING, forward INT, backward INT)
       RETURN SELECT label, forward, backward FROM (
         SELECT i.node AS i, g.node AS g, get(i.statuses, g.node - 1) AS forward, get(g.statuses, i.node - 1) AS backward,
           {label} AS label FROM (SELECT hyp AS node, statuses FROM implications) i, (SELECT hyp AS node, statuses FROM implications) g
         WHERE i.node = intended AND g.node = generated)""",
)


def _label_sql() -> str:
    f, b = "get(i.statuses, g.node - 1)", "get(g.statuses, i.node - 1)"
    named = ((1, 1, "equivalent"), (1, 0, "weaker"), (0, 1, "stronger"), (0, 0, "incomparable"))
    cases = " ".join(f"WHEN {f} = {x} AND {b} = {y} THEN '{w}'" for x, y, w in named)
    return f"CASE WHEN i.node = g.node THEN 'equal' {cases} ELSE 'unknown' END"


def register(spark: SparkSession, matrix: DataFrame) -> None:
    """Views and functions in this session; ``matrix`` is the packed evidence that verdicts rest on."""
    every = laws(spark)
    every.createOrReplaceTempView("laws")
    matrix.createOrReplaceTempView("implications")
    each = F.array(*(F.struct(F.lit(n).alias("notation"), notation(n).rendered(F.col("lhs"), F.col("rhs"), F.col("names")).alias("rendering")) for n in NOTATIONS))
    every.select("node", F.explode(each).alias("e")).select("node", "e.*").createOrReplaceTempView("law_renderings")
    for said in FUNCTIONS:
        spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION " + said.replace("{label}", _label_sql()))
