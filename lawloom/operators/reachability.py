"""Closure of an edge list of any size: strong components first, then semi-naive joins between them.

Laws that imply each other are one component; inside it everything reaches
everything, so only components are joined.  A node without an edge in or out is
a component of its own and goes first.  The others' components come from colours: every
node takes the largest number that reaches it, and what reaches that number
back along edges of one colour is its component.  The closure grows by what is
new only: each round extends the last round's pairs by one edge and drops the
pairs already known.

Each round is written to the shared folder and read back, so lineage stays
short and a lost executor costs one round; nothing meets on the driver but
counts.  A node with many edges meets its one row in a join that adaptive
execution can split, since that row comes from a table.  Rounds grow with the
longest path; the result, as any closure, can be as large as all pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import scratch


def _stored(df: DataFrame, label: str) -> DataFrame:
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _clean(edges: DataFrame, u: str, v: str) -> DataFrame:
    return edges.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")).where("u is not null and v is not null").distinct()


def _nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()


def _coloured(edges: DataFrame) -> DataFrame:
    """``(node, colour)``: the largest number that reaches the node, its own included."""
    colours = _stored(_nodes(edges).withColumn("colour", F.col("node")).withColumn("fresh", F.lit(True)), "colours")
    while True:
        # Only nodes that changed in the last round tell their successors.
        told = edges.join(colours.where("fresh").select(F.col("node").alias("u"), "colour"), "u").groupBy(F.col("v").alias("node")).agg(F.max("colour").alias("said"))
        grown = colours.join(told, "node", "left").select(
            "node", F.greatest("colour", F.coalesce("said", "colour")).alias("colour"), F.coalesce(F.col("said") > F.col("colour"), F.lit(False)).alias("fresh")
        )
        colours = _stored(grown, "colours")
        if colours.where("fresh").isEmpty():
            return colours.select("node", "colour")


def strong_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """``(node, component)`` of all nodes of the edges; ``component`` is the largest node that reaches the node and is reached by it.

    Rows with a null end are no edges; repeats and loops are allowed; an empty
    table gives an empty result.
    """
    return _components(_stored(_clean(edges, u, v), "edges"))


def _between(edges: DataFrame) -> DataFrame:
    """Edges that can be on a cycle as far as their ends tell: something leads to ``u``, and ``v`` leads on."""
    led = edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi")
    return led.join(led.select(F.col("u").alias("v")).distinct(), "v", "left_semi").select("u", "v")


def _components(every: DataFrame) -> DataFrame:
    """``strong_components`` of stored edges without nulls and repeats."""
    left, parts = _stored(_between(every.where("u <> v")), "edges-left"), []
    while not left.isEmpty():
        colours = _coloured(left)
        one, two = colours.toDF("u", "cu"), colours.toDF("v", "cv")
        # Only edges of one colour can be inside a component.
        same = _stored(left.join(one, "u").join(two, "v").where("cu = cv").select("u", "v", F.col("cu").alias("colour")), "edges-coloured")
        found = fresh = _stored(colours.where("node = colour"), "component")
        while not fresh.isEmpty():
            back = same.join(fresh.select(F.col("node").alias("v")), "v").select(F.col("u").alias("node"), "colour").distinct()
            fresh = _stored(back.join(found.select("node"), "node", "left_anti"), "component")
            found = _stored(found.union(fresh), "component-found")
        parts.append(found.select("node", F.col("colour").alias("component")))
        gone = found.select("node")
        rest = same.select("u", "v").join(gone.toDF("u"), "u", "left_anti").join(gone.toDF("v"), "v", "left_anti")
        left = _stored(_between(rest), "edges-left")
    out = _nodes(every).withColumn("component", F.col("node"))
    if parts:
        named = parts[0]
        for p in parts[1:]:
            named = named.union(p)
        out = out.select("node").join(named, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    return _stored(out, "components")


def closure(edges: DataFrame, u: str = "u", v: str = "v") -> tuple[DataFrame, DataFrame]:
    """``(node, component)``, and ``(above, below)``: which components reach which by one edge or more.

    A component reaches itself if it has more than one node or a loop.
    """
    own = _stored(_clean(edges, u, v), "edges")
    components = _components(own)
    # Only nodes that are called by another's number are looked up, and only steps that something leads to are taken.
    other = _stored(components.where("node <> component"), "components-other")
    a, b = other.toDF("u", "a"), other.toDF("v", "b")
    named = own.join(a, "u", "left").join(b, "v", "left").select(F.coalesce("a", "u").alias("above"), F.coalesce("b", "v").alias("below"))
    links = _stored(named.distinct(), "links")
    met = _stored(links.select(F.col("below").alias("mid")).distinct(), "links-met")
    steps = links.where("above <> below").select(F.col("above").alias("mid"), F.col("below").alias("next"))
    steps = _stored(steps.join(met, "mid", "left_semi"), "links-steps")
    known = fresh = links
    while True:
        grown = fresh.where("above <> below").join(steps, F.col("below") == F.col("mid")).select("above", F.col("next").alias("below")).distinct()
        fresh = _stored(grown.join(known, ["above", "below"], "left_anti"), "closure-new")
        if fresh.isEmpty():
            return components, known
        known = _stored(known.union(fresh), "closure-known")


def reached(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """``(u, v)``: all pairs of nodes of which the first reaches the second by one edge or more."""
    components, pairs = closure(edges, u, v)
    a, b = components.toDF("u", "above"), components.toDF("v", "below")
    return pairs.join(a, "above").join(b, "below").select("u", "v")


def reach_counts(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """``(node, component_size, n_reached)``, without making the pairs of nodes."""
    components, pairs = closure(edges, u, v)
    sizes = _stored(components.groupBy("component").agg(F.count("*").alias("size")).where("size > 1"), "component-sizes")
    one = F.lit(1).cast("long")
    below = pairs.join(sizes.toDF("below", "n"), "below", "left").groupBy(F.col("above").alias("component")).agg(F.sum(F.coalesce("n", one)).alias("n_reached"))
    told = components.join(sizes, "component", "left").join(_stored(below, "component-reach"), "component", "left")
    return told.select("node", F.coalesce("size", one).alias("component_size"), F.coalesce("n_reached", F.lit(0)).cast("long").alias("n_reached"))
