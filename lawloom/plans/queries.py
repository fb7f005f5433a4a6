"""The engine's queries over the supplied tables, one per operator or group of operators.

Laws, pairs of laws and equation texts are derived from the tables' keys, so
that real operators run on the given data.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clean, terms
from ..functions.notations import NOTATIONS, notation
from ..operators import ambiguous, catalogue, drift, evidence, magmas, mapping, metrics, models, mutations, nearby, neighbours, orienting, reachability, rewriting, verdicts, verify
from ..operators.catalogue import CATALOGUE_SIZE, laws
from ..sources import edge_index
from ..sources.scratch import scratch
from ..sql import register
from ..streaming import streams
from . import files

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _node(key: Column) -> Column:
    """A law's number from a key."""
    return (1 + key % CATALOGUE_SIZE).cast("int")


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(node, n_orders)``: the laws that orders' keys name, and how many name each; the catalogue bounds its size."""
    return _table(spark, sf_dir, "orders").groupBy(_node(F.col("o_orderkey")).alias("node")).agg(F.count("*").alias("n_orders"))


def _named_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue's rows of laws that orders name."""
    return laws(spark).join(F.broadcast(_named(spark, sf_dir).select("node")), "node", "left_semi")


def _laws_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The law of every order, a row per order."""
    return _table(spark, sf_dir, "orders").select(_node(F.col("o_orderkey")).alias("node")).join(F.broadcast(laws(spark)), "node")


def counted(query: Query, key: str = "node") -> Query:
    """A query with rows per law, and how many orders name the law."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out, named = query(spark, sf_dir), _named(spark, sf_dir).withColumnRenamed("node", "__named")
        met = out.join(F.broadcast(named), F.col(key) == F.col("__named"), "left")
        return met.select(*out.columns, F.coalesce("n_orders", F.lit(0)).cast("long").alias("n_orders"))

    return run


def shape_enumeration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All trees, and how many orders' laws have one as their left side."""
    sides = _laws_of_orders(spark, sf_dir).groupBy(terms.shape_bits(F.col("lhs")).alias("bits")).agg(F.count("*").alias("n"))
    return catalogue.shapes(spark).join(F.broadcast(sides), "bits", "left").select("ord", "rank", "bits", F.coalesce("n", F.lit(0)).cast("long").alias("n_orders"))


def rhyme_enumeration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rhymes of up to six leaves, and how many orders' laws have each."""
    out = None
    for n in range(1, 7):
        part = catalogue.rhymes(spark, n).select(F.lit(n).alias("length"), F.array_join(F.transform("rhyme", lambda x: x.cast("string")), ",").alias("rhyme"))
        out = part if out is None else out.union(part)
    own = F.array_join(F.transform(F.concat(terms.leaves(F.col("lhs")), terms.leaves(F.col("rhs"))), lambda x: x.cast("string")), ",")
    uses = _laws_of_orders(spark, sf_dir).groupBy(own.alias("rhyme")).agg(F.count("*").alias("n"))
    return out.join(F.broadcast(uses), "rhyme", "left").select("length", "rhyme", F.coalesce("n", F.lit(0)).cast("long").alias("n_orders"))


def catalog_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return laws(spark).select("node", "formal", "canonical_key", "ord", "n_vars")


def catalog_generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``catalog_all``, by the distributed generator."""
    return catalogue.spelled(catalogue.generated(spark)).select("node", "formal", "canonical_key", "ord", "n_vars")


def catalog_by_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by the order of their laws."""
    return verify.count_by_order(_laws_of_orders(spark, sf_dir), "ord")


def catalog_by_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by the number of their laws' variables."""
    return _laws_of_orders(spark, sf_dir).groupBy("n_vars").agg(F.count("*").alias("n_laws"))


def law_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many laws an order of the catalogue has, where they begin, and how many orders name one."""
    uses = verify.count_by_order(_laws_of_orders(spark, sf_dir), "ord").toDF("ord", "n")
    return catalogue.law_counts(spark).join(F.broadcast(uses), "ord", "left").select("ord", "n_laws", "first_node", F.coalesce("n", F.lit(0)).cast("long").alias("n_orders"))


def catalog_dual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.dual(laws(spark))


def render_of(name: str) -> Query:
    """The laws that the parts' keys reach, in a notation."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        used = _table(spark, sf_dir, "part").select(_node(F.col("p_partkey")).alias("node")).distinct()
        return verify.build_rows(spark, name).join(used, "node", "left_semi").select("node", "rendering")

    return run


def catalogue_of(name: str) -> Query:
    """The whole catalogue in a notation, written only after every gate holds."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return verify.verified(verify.build_rows(spark, name), name).select("node", "formal", "rendering", "order")

    return run


def render_length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.all_lengths(_named_laws(spark, sf_dir))


def _every_rendering(named: DataFrame) -> DataFrame:
    lhs, rhs, names = F.col("lhs"), F.col("rhs"), F.col("names")
    each = F.array(*(F.struct(F.lit(n).alias("notation"), notation(n).rendered(lhs, rhs, names).alias("rendering")) for n in NOTATIONS))
    return named.select("node", F.explode(each).alias("e")).select("node", "e.*")


def distinct_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = _every_rendering(_named_laws(spark, sf_dir))
    return every.groupBy("notation").agg(F.count("*").alias("n_laws"), F.count_distinct("rendering").alias("n_distinct"))


def round_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for n in NOTATIONS:
        ok = notation(n).round_trip(F.col("lhs"), F.col("rhs"), F.col("names"), F.col("node"))
        part = _named_laws(spark, sf_dir).where(ok).agg(F.count("*").alias("n_ok")).select(F.lit(n).alias("notation"), "n_ok")
        out = part if out is None else out.union(part)
    return out


def words_per_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for n in ("text", "text2"):
        rows = verify.build_rows(spark, n).join(F.broadcast(_named(spark, sf_dir)), "node", "left_semi")
        part = verify.length_stats(rows, verify.words()).select(F.lit(n).alias("notation"), "*")
        out = part if out is None else out.union(part)
    return out


def canonical_key_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Laws renamed and turned round, found again by their keys; each law's key is made once."""
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", _node(F.col("o_orderkey")).alias("law"))
    reverse = lambda t: F.transform(t, lambda x: F.when(x == terms.OP, x).otherwise(20 - x))
    keyed = laws(spark).select(F.col("node").alias("law"), terms.canonical_key(reverse(F.col("rhs")), reverse(F.col("lhs"))).alias("key"))
    found = mapping.lookup_key(keyed, "key", "found")
    return orders.join(F.broadcast(found.select("law", "found")), "law").select("o_orderkey", F.col("found").alias("node"))


def resolve_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = _table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") * 61).cast("string").alias("spec"))
    return mapping.resolve(given, "spec").select("s_suppkey", "mapped.status", F.coalesce("mapped.node", F.lit(0)).alias("node"))


def magma2_satisfaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return magmas.masks(laws(spark)).select("node", F.col("mask").cast("long").alias("mask"))


def magma3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many of the 19683 tables of size 3 each law holds."""
    return magmas.holding_tables(laws(spark), 3)


def refutations_per_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many laws each law is told apart from by a table of size 2 in which only it holds."""
    told = magma2_satisfaction(spark, sf_dir)
    kinds = magmas.refuted_pairs(told).groupBy("hyp_mask").agg(F.sum("n_pairs").alias("n"))
    own = told.groupBy(F.col("mask").alias("hyp_mask")).agg(F.count("*").alias("n_laws"))
    each = own.join(kinds, "hyp_mask", "left").select(F.col("hyp_mask").alias("mask"), (F.coalesce("n", F.lit(0)) / F.col("n_laws")).cast("long").alias("n_refuted"))
    return told.join(F.broadcast(each), "mask").select("node", "n_refuted")  # 65536 masks at most


def refuted_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks of orders' laws of which the first refutes the second, and how many pairs of orders have them."""
    masks = magma2_satisfaction(spark, sf_dir)
    return magmas.refuted_pairs(_laws_of_orders(spark, sf_dir).select("node").join(F.broadcast(masks), "node"))


def _witnesses(spark: SparkSession, sf_dir: str, max_size: int) -> DataFrame:
    """The first table in which the law of an order holds and that of its customer does not; -1 if none."""
    orders = _table(spark, sf_dir, "orders")
    pairs = orders.select(_node(F.col("o_orderkey")).alias("a"), _node(F.col("o_custkey")).alias("b")).distinct()
    found = magmas.brute_force(pairs, laws(spark), max_size=max_size)
    none = lambda c: F.coalesce(F.col(f"witness_a_not_b.{c}"), F.lit(-1)).alias(c)
    return found.select("a", "b", none("n"), none("magma_id"))


def first_witness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _witnesses(spark, sf_dir, 3)


def first_witness_size2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _witnesses(spark, sf_dir, 2)


def _line_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem")
    return lines.select(_node(F.col("l_orderkey")).alias("intended"), _node(F.col("l_partkey")).alias("generated"))


def verdict_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.histogram(verdicts.verdict_pairs(_line_pairs(spark, sf_dir), evidence.plain(spark)))


def verdict_histogram_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``verdict_histogram``, with tables of size 3 and all proof rules."""
    return verdicts.histogram(verdicts.verdict_pairs(_line_pairs(spark, sf_dir), evidence.derive(spark)))


def _open_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(hyp, concl)``: implications between the laws of orders and their customers that tables of sizes 2 and 3 and one-step rules leave open."""
    told = verdicts.verdict_pairs(_order_pairs(spark, sf_dir).select("intended", "generated").distinct(), evidence.derive(spark))
    one = told.where(F.col("forward") == evidence.UNKNOWN).select(F.col("intended").alias("hyp"), F.col("generated").alias("concl"))
    return one.union(told.where(F.col("backward") == evidence.UNKNOWN).select("generated", "intended")).distinct()


def rewriting_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open implications that rewriting proves, with the length of the chain and whether it replays."""
    proved = rewriting.proofs(_open_edges(spark, sf_dir), laws(spark)).where("proved")
    return rewriting.replayed(proved, laws(spark)).select("hyp", "concl", F.col("steps").cast("long").alias("steps"), "valid")


def model_counterexamples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open implications that a linear table or a searched table of size 4 refutes, the table, and whether it does."""
    found = models.counterexamples(_open_edges(spark, sf_dir), laws(spark)).where("witness is not null")
    told = models.refuted(found, laws(spark))
    return told.select("hyp", "concl", F.col("witness.n").alias("n"), F.array_join(F.transform("witness.tab", lambda x: x.cast("string")), "").alias("tab"), "valid")


def verdict_settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of all orders' pairs on the whole evidence: matrix, rewriting and larger tables; and how many rest on the latter two."""
    told = verdicts.settled_pairs(_order_pairs(spark, sf_dir), evidence.derive(spark), laws(spark))
    return told.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("found_forward") | F.col("found_backward")).alias("n_settled"))


def verdict_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").select(
        "o_orderpriority", _node(F.col("o_orderkey")).alias("intended"), _node(F.col("o_custkey")).alias("generated")
    )
    told = verdicts.verdict_pairs(orders, evidence.plain(spark))
    return told.groupBy("o_orderpriority", "label").agg(F.count("*").alias("n"))


def status_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses of all implications from laws that orders name."""
    return evidence.status_counts(evidence.plain(spark).join(F.broadcast(_named(spark, sf_dir)), F.col("hyp") == F.col("node"), "left_semi"))


def evidence_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates over the rows of the full matrix that orders name."""
    return evidence.checks(evidence.derive(spark).join(F.broadcast(_named(spark, sf_dir)), F.col("hyp") == F.col("node"), "left_semi"))


def strip_noise_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(clean.strip_noise(F.col("text"))).alias("cleaned_md5"))


def strip_noise_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", F.md5(clean.strip_noise(F.col("html"))).alias("cleaned_md5"))


def tokenize_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _table(spark, sf_dir, "benchmark").select("item_id", clean.tokens(F.col("text")).alias("t"))
    n = lambda test: F.size(F.filter("t", test)).cast("long")
    return found.where(F.size("t") > 0).select(
        "item_id", F.size("t").cast("long").alias("n_tokens"), n(lambda t: t["kind"] == "IDENT").alias("n_names"),
        n(lambda t: t["value"].isin(".", ";")).alias("n_stops"), n(lambda t: t["kind"] == "COMMA").alias("n_commas"),
    )


def messy_texts(orders: DataFrame) -> DataFrame:
    """``kind, text``: a law of each order's key, dressed up or broken in one of ten ways."""
    told = mapping.law_text(orders.select((F.col("o_orderkey") % 10).cast("int").alias("kind"), _node(F.col("o_orderkey")).alias("law")), "law")
    formal = F.col("formal")
    sides = F.split(formal, " = ")
    renamed = F.translate(formal, "xyzwuv", "abcdef")
    ways = [
        formal,
        renamed,
        F.concat(F.get(sides, F.lit(1)), F.lit(" = "), F.get(sides, F.lit(0))),
        F.concat(F.lit(r"\("), F.replace(formal, F.lit("◇"), F.lit(r"\circ")), F.lit(r"\)")),
        F.concat(F.lit("(a * b * c) = "), F.get(sides, F.lit(0))),
        F.concat(F.lit("a * b = b + "), F.lit("a")),
        F.concat(formal, F.lit(" = x")),
        F.concat(F.lit("x = 1 ◇ "), F.lit("x")),
        F.concat(F.lit("("), F.get(sides, F.lit(0)), F.lit(" = "), F.get(sides, F.lit(1))),
        F.concat(F.lit("for all x y z w u v, "), formal, F.lit(".")),
    ]
    text = ways[0]
    for k, way in enumerate(ways[1:], 1):
        text = F.when(F.col("kind") == k, way).otherwise(text)
    return told.select("kind", text.alias("text"))


def parse_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = messy_texts(_table(spark, sf_dir, "orders"))
    told = mapping.map_texts(texts, "text")
    return told.groupBy("kind", F.col("mapped.status").alias("status")).agg(F.count("*").alias("n"))


def metric_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part").select("p_partkey", _node(F.col("p_partkey")).alias("a"), _node(F.floor(F.col("p_partkey") / 2)).alias("b"))
    both = mapping.law_text(mapping.law_text(part, "a", "ta"), "b", "tb")
    plain = lambda c: F.replace(F.col(c), F.lit("◇"), F.lit("*"))
    told = metrics.with_normalized_match(both, "ta", "tb")
    return told.select(
        "p_partkey", metrics.exact_match(F.col("ta"), F.col("tb")).alias("exact_match"), "normalized_match",
        metrics.edit_distance(plain("ta"), plain("tb")).cast("long").alias("distance"),
    )


def embedding_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    two = one.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return one.join(two, "vec_id").select("vec_id", F.round(metrics.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.unit(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five vectors most like each vector, by the index."""
    units = _units(spark, sf_dir)
    found = neighbours.nearest(units, units, 5, neighbours.fit_centres(units))
    return found.select(F.col("id").alias("vec_id"), "rank", F.col("other").alias("neighbour"), F.round("cosine", 6).alias("cosine"))


def nearest_vectors_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five vectors most like each vector whose id is divisible by 50, against all vectors, exactly."""
    units = _units(spark, sf_dir)
    found = neighbours.nearest(units.where("id % 50 = 0"), units, 5)
    return found.select(F.col("id").alias("vec_id"), "rank", F.col("other").alias("neighbour"), F.round("cosine", 6).alias("cosine"))


def neighbour_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the exact neighbours the index finds."""
    units = _units(spark, sf_dir)
    queries = units.where("id % 50 = 0")
    return neighbours.recall(neighbours.nearest(queries, units, 5, neighbours.fit_centres(units)), neighbours.nearest(queries, units, 5))


def dialect_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = mapping.law_text(_table(spark, sf_dir, "customer").select("c_custkey", _node(F.col("c_custkey")).alias("law")), "law")
    text = F.concat(F.lit(r"\["), F.when(F.col("c_custkey") % 2 == 0, F.replace("formal", F.lit("◇"), F.lit("."))).otherwise(F.replace("formal", F.lit("◇"), F.lit(r"\star"))), F.lit(r"\]"))
    told = mapping.normalize_dialect(given.select("c_custkey", text.alias("raw")), "raw")
    return told.select("c_custkey", "normalized.status", "normalized.etp_id")


def drift_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drift pipeline on laws named by parts: every third text is broken, the others are another law's."""
    part = _table(spark, sf_dir, "part").select("p_partkey", _node(F.col("p_partkey")).alias("intended_id"), _node(F.col("p_partkey") * 7).alias("g"))
    told = mapping.law_text(part, "g", "other")
    raw = F.when(F.col("p_partkey") % 3 == 0, "no law").otherwise(F.replace("other", F.lit("◇"), F.lit("*")))
    source = told.select("intended_id", F.concat(F.lit("part "), F.col("p_partkey").cast("string")).alias("nl_description"), raw.alias("generated_equation_raw"))
    return drift.run(source, evidence.plain(spark))


def drift_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.regexp_extract("nl_description", "([0-9]+)$", 1).cast("long")
    return drift_report(spark, sf_dir).select(key.alias("p_partkey"), "label", "explanation")


def law_mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = mapping.lookup_key(mutations.mutated(laws(spark)), "mutant_key", "mutant")
    return made.select("node", "kind", "text", F.coalesce("mutant", F.lit(0)).alias("mutant"))


def _order_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", _node(F.col("o_orderkey")).alias("intended"), _node(F.col("o_custkey")).alias("generated"))


def _settled_edges(spark: SparkSession) -> DataFrame:
    return evidence.edges(evidence.plain(spark)).where("status <> 4")


def implication_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an edge list says on each pair, by an equi-join on both numbers."""
    told = verdicts.implies(_order_pairs(spark, sf_dir), _settled_edges(spark), "intended", "generated", "told")
    word = F.when(F.col("told"), "true").when(~F.col("told"), "false").otherwise("open")
    return told.select("o_orderkey", word.alias("implies"))


def edge_index_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settled implications that line items name, stored as an index; what it says on each order's pair."""
    lines = _table(spark, sf_dir, "lineitem").select(_node(F.col("l_orderkey")).alias("hyp"), _node(F.col("l_suppkey")).alias("concl")).distinct()
    edges = evidence.with_status(lines, evidence.plain(spark), "hyp", "concl", "status").where(F.col("status") != evidence.UNKNOWN)
    name = f"edge_index_{uuid.uuid4().hex}"
    edge_index.write_edge_index(edges, scratch(spark, "edge-index"), name)
    asked = _table(spark, sf_dir, "orders").select("o_orderkey", _node(F.col("o_orderkey")).alias("hyp"), _node(F.col("o_custkey") % 10).alias("concl"))
    told = edge_index.lookup(spark, name, asked, "hyp", "concl")
    word = F.when(F.col("status") == evidence.PROOF_TRUE, "true").when(F.col("status") == evidence.PROOF_FALSE, "false").otherwise("open")
    return told.select("o_orderkey", "hyp", "concl", word.alias("implies"))


def edge_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and suppliers as nodes of one graph, an edge per line item: each node's component and how many nodes it reaches."""
    lines = _table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
    return reachability.reach_counts(lines, "l_partkey", "l_suppkey")


def edge_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = verdicts.edge_relations(_order_pairs(spark, sf_dir), _settled_edges(spark))
    return told.groupBy("label").agg(F.count("*").alias("n"))


def verdict_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole verdicts on pairs given as text and number; each distinct pair is told once."""
    pairs = _order_pairs(spark, sf_dir).select("intended", "generated").distinct()
    spoken = mapping.law_text(pairs, "generated", "text").select("intended", "generated", F.col("intended").cast("string").alias("i"), "text")
    told = verdicts.compare(spoken, "i", "text", evidence.plain(spark))
    v = F.col("verdict")
    return told.select("intended", "generated", v["label"].alias("label"), v["forward"].alias("forward"), v["backward"].alias("backward"), v["evidence"].alias("evidence"))


def drift_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.summary(drift_report(spark, sf_dir))


def _part_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = _table(spark, sf_dir, "part").select(_node(F.col("p_partkey")).alias("node")).distinct()
    return laws(spark).join(F.broadcast(named), "node", "left_semi")  # 4694 numbers at most


def ambiguous_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bracket-free text of each law that a part names, in how many ways it reads, and as which laws."""
    said = _part_laws(spark, sf_dir).select("node", ambiguous.flat(F.col("lhs"), F.col("rhs"), F.col("names")).alias("text"))
    told = ambiguous.ambiguity(said, "text")
    numbers = F.array_join(F.transform("laws", lambda x: x.cast("string")), ",")
    return said.join(told, "text").select("node", "text", "n_readings", numbers.alias("laws"))


def oriented_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each law that a part names as a rewrite rule, or that it has no direction."""
    return orienting.rules(_part_laws(spark, sf_dir)).select("node", "direction", F.coalesce("rule", F.lit("")).alias("rule"))


def nearby_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many laws are one and two tree edits away from each law that a customer names, the sum of their numbers, and how many customers name it."""
    named = _table(spark, sf_dir, "customer").groupBy(_node(F.col("c_custkey")).alias("node")).agg(F.count("*").alias("n_customers"))
    asked = laws(spark).join(F.broadcast(named.select("node")), "node", "left_semi")  # 4694 numbers at most
    found = nearby.within(asked, laws(spark), 2).where("distance > 0 and id <> other")
    told = found.groupBy(F.col("id").alias("node"), F.col("distance").cast("long").alias("distance")).agg(F.count("*").alias("n_laws"), F.sum("other").alias("laws_sum"))
    return told.join(F.broadcast(named), "node")


def metric_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two metrics against the label, by relation, by priority, by both and in all: counts, unresolved, false equivalences, missed ones."""
    orders = _table(spark, sf_dir, "orders").select("o_orderpriority", _node(F.col("o_orderkey")).alias("i"), _node(F.col("o_orderkey") % 7 + F.col("o_custkey") % 97).alias("g"))
    told = verdicts.verdict_pairs(orders, evidence.plain(spark), "i", "g")
    spoken = mapping.law_text(mapping.law_text(told, "i", "ti"), "g", "tg")
    plain = lambda c: F.replace(F.col(c), F.lit("◇"), F.lit("*"))
    near = metrics.edit_distance(plain("ti"), plain("tg")) <= 4
    found = metrics.by_relation(spoken.withColumns({"same": F.col("i") == F.col("g"), "near": near}), ("same", "near"), "o_orderpriority")
    return found.select(F.coalesce("o_orderpriority", F.lit("all")).alias("o_orderpriority"), F.coalesce("label", F.lit("all")).alias("label"), *found.columns[2:])


def sql_interface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plain SQL text over the customers, with the engine's views and table functions."""
    register(spark, evidence.plain(spark))
    _table(spark, sf_dir, "customer").createOrReplaceTempView("lawloom_customer")
    return spark.sql(
        """
        SELECT c.c_custkey, l.formal, r.rendering, v.label
        FROM lawloom_customer c, LATERAL law(CAST(1 + c.c_custkey % 4694 AS INT)) l, LATERAL law_rendering(CAST(1 + c.c_custkey % 4694 AS INT), 'rpn') r,
          LATERAL law_verdict(CAST(1 + c.c_custkey % 4694 AS INT), CAST(1 + c.c_custkey * 13 % 4694 AS INT)) v
        """
    )


def metric_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often equal normal forms agree with the label, by relation."""
    pairs = _order_pairs(spark, sf_dir).withColumn("same", F.col("intended") == F.col("generated"))
    return metrics.accuracy(verdicts.verdict_pairs(pairs, evidence.plain(spark)), "same")


def crosscheck_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue against a list that has only some laws, every fifth of them misspelled, and one too many."""
    used = _table(spark, sf_dir, "part").select(_node(F.col("p_partkey")).alias("node")).distinct()
    own = laws(spark).select("node", "formal")
    other = own.join(used, "node").select("node", F.when(F.col("node") % 5 == 0, F.concat("formal", F.lit("?"))).otherwise(F.col("formal")).alias("formal"))
    extra = spark.range(1).select(F.lit(CATALOGUE_SIZE + 1).cast("int").alias("node"), F.lit("x = x").alias("formal"))
    return verify.crosscheck(own, other.union(extra))


def broken_renderings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many renderings without their last character are refused, by notation.

    Under adversarial names a shorter name is still a name; there the first
    operator goes, or the equality sign if there is none.
    """
    out = None
    for n in NOTATIONS:
        form = notation(n)
        text = F.expr("substring(t, 1, length(t) - 1)")
        if n == "confusable_vars":
            text = F.when(F.contains("t", F.lit("◇")), F.regexp_replace("t", "^([^◇]*) ◇ ", "$1 ")).otherwise(F.replace("t", F.lit("="), F.lit("")))
        cut = _named_laws(spark, sf_dir).select(form.rendered(F.col("lhs"), F.col("rhs"), F.col("names"), F.col("node")).alias("t")).select(text.alias("t"))
        refused = F.sum(form.read_back(F.col("t")).isNull().cast("long"))
        part = cut.agg(F.count("*").alias("n"), refused.alias("n_refused")).select(F.lit(n).alias("notation"), "n", "n_refused")
        out = part if out is None else out.union(part)
    return out


def laws_beyond(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Laws of five operations by their numbers, and their numbers again by their texts; suppliers whose number is a larger law's name none."""
    last = CATALOGUE_SIZE + catalogue.law_count(5)
    given = _table(spark, sf_dir, "supplier").select("s_suppkey", (4695 + F.col("s_suppkey") * 57).alias("number")).where(F.col("number") <= last)
    spoken = mapping.laws_by_number(given, "number").select("s_suppkey", "number", F.col("law.formal").alias("formal"))
    told = mapping.normalize_dialect(spoken, "formal")
    return told.select("s_suppkey", "number", "formal", F.col("normalized.etp_id").alias("again"))


def stream_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of law pairs, labelled batch by batch; the counts are kept in memory."""
    schema = _table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")  # a pattern, as the table can be one file
    pairs = events.select(_node(F.col("event_id")).alias("intended"), _node(F.col("user_id")).alias("generated"))
    told = streams.labelled_stream(pairs, evidence.plain(spark)).groupBy("label").agg(F.count("*").alias("n"))
    name = f"stream_labels_{uuid.uuid4().hex}"
    query = told.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


#: Queries of all laws, with the column that has the law's number: orders are counted to each row.
COUNTED = dict.fromkeys(
    (
        "catalog_all", "catalog_generated", "catalog_dual", "catalogue_text", "catalogue_text2", "magma2_satisfaction", "magma3_counts", "refutations_per_law",
        "law_mutations", "file_law_list", "file_lean_source", "file_catalogue", "file_json_document", "limited_rows", "same_catalogues", "named_table_laws",
    ),
    "node",
) | {"file_matrix": "hyp"}

def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of law pairs, labelled and counted by the hour; only hours that the watermark has closed are told."""
    schema = _table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")
    pairs = events.select(F.col("ts").cast("timestamp").alias("ts"), _node(F.col("event_id")).alias("intended"), _node(F.col("user_id")).alias("generated"))
    told = streams.windowed_labels(streams.labelled_stream(pairs, evidence.plain(spark)), "ts")
    path = scratch(spark, "windows")
    flat = told.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("hour"), "label", "n")
    query = flat.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{path}/mark").option("path", f"{path}/out").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema("hour string, label string, n long").parquet(f"{path}/out")


QUERIES: dict[str, Query] = {
    q.__name__: q
    for q in (
        shape_enumeration, rhyme_enumeration, catalog_all, catalog_generated, catalog_by_order, catalog_by_variables, law_counts, catalog_dual,
        render_length_stats, distinct_check, round_trips, words_per_law, canonical_key_lookup, resolve_numbers,
        magma2_satisfaction, magma3_counts, refutations_per_law, refuted_pairs, first_witness, first_witness_size2, verdict_histogram,
        verdict_histogram_derived, rewriting_proofs, model_counterexamples, verdict_settled, verdict_by_priority, status_histogram, evidence_checks, strip_noise_documents,
        strip_noise_pages, tokenize_benchmark, parse_status_counts, metric_pairs, embedding_cosine, nearest_vectors, nearest_vectors_exact, neighbour_recall, dialect_lookup,
        drift_explanations, law_mutations, implication_lookup, edge_index_lookup, edge_closure, edge_relations, verdict_evidence, drift_summary,
        metric_accuracy, ambiguous_readings, oriented_rules, nearby_laws, metric_report, sql_interface, crosscheck_catalogue, broken_renderings, laws_beyond, stream_labels, stream_windows,
    )
} | files.QUERIES | {f"catalogue_{n}": catalogue_of(n) for n in ("text", "text2")} | {f"render_{n}": render_of(n) for n in NOTATIONS}
QUERIES |= {name: counted(QUERIES[name], key) for name, key in COUNTED.items()}
