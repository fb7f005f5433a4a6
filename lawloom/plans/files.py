"""Queries that write with each writer and read the files again, over whole tables or the whole catalogue."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.notations import LeanStyle, notation
from ..operators import drift, evidence, magmas, mapping, verdicts, verify
from ..operators.catalogue import CATALOGUE_SIZE, laws
from ..operators.evidence import OUTCOMES
from ..sources import readers, sinks
from ..sources.scratch import scratch

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _node(key: Column) -> Column:
    return (1 + key % CATALOGUE_SIZE).cast("int")


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers of laws that orders name, 4694 at most."""
    return F.broadcast(_table(spark, sf_dir, "orders").select(_node(F.col("o_orderkey")).alias("node")).distinct())


def _outcome(key: Column) -> Column:
    """One of the nine outcome words by a key."""
    return F.element_at(F.array(*map(F.lit, OUTCOMES)), (1 + key % len(OUTCOMES)).cast("int"))


def file_law_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A law on each line, read back by line number."""
    path = scratch(spark, "law-list")
    laws(spark).orderBy("node").coalesce(1).select("formal").write.text(path)
    return readers.read_laws(spark, path)


def file_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered lines of two listings."""
    out = None
    for name in ("text", "text2"):
        path = scratch(spark, f"listing-{name}")
        sinks.write_listing(verify.build_rows(spark, name).join(_named(spark, sf_dir), "node", "left_semi"), path)
        part = spark.read.text(path).select(F.lit(name).alias("notation"), F.col("value").alias("line"))
        out = part if out is None else out.union(part)
    return out


def file_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue's rows, with what its meta row says."""
    path, form = scratch(spark, "catalogue"), notation("tptp")
    sinks.write_catalogue(verify.build_rows(spark, form), form, path)
    meta = spark.read.schema("generator string, count long, representation string, verified boolean").json(f"{path}/meta").first()
    rows = spark.read.schema("node int, formal string, tptp string, `order` int, variables array<string>").json(f"{path}/equations")
    told = [F.lit(meta[k]).alias(k) for k in ("generator", "count", "representation", "verified")]
    return rows.select("node", "formal", "tptp", "order", F.array_join("variables", ",").alias("variables"), *told)


def file_json_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue as one JSON document, taken apart again."""
    path, form = scratch(spark, "document"), notation("polish")
    sinks.json_document(verify.build_rows(spark, form), form).write.text(path)
    kind = "meta struct<generator: string, source: string, representation: string, count: long, verified: boolean>, equations array<struct<node: int, formal: string, polish: string>>"
    held = spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("d")).select("d.meta", F.explode("d.equations").alias("e"))
    return held.select("e.*", "meta.*")


def file_tex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the document, one for each law and its frame."""
    path = scratch(spark, "tex")
    sinks.write_tex(verify.build_rows(spark, "latex").join(_named(spark, sf_dir), "node", "left_semi"), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


def file_lean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations of the file that stands alone."""
    path = scratch(spark, "lean")
    sinks.write_lean(verify.build_rows(spark, "lean").join(_named(spark, sf_dir), "node", "left_semi"), path, LeanStyle())
    return spark.read.text(path).where(F.startswith("value", F.lit("example"))).select(F.col("value").alias("line"))


def file_lean_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered equations among other lines of a source, every third twice."""
    path = scratch(spark, "lean-source")
    said = F.concat(F.lit("  equation "), F.col("node").cast("string"), F.lit(" := "), F.col("formal"), F.lit("  -- law"))
    each = F.explode(F.when(F.col("node") % 3 == 0, F.array(said, F.lit("theorem t : True"), said)).otherwise(F.array(said, F.lit(""))))
    laws(spark).select(each.alias("line")).write.text(path)
    return readers.read_lean(spark, path)


def file_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An outcomes document over the nations, read as a packed matrix."""
    path = scratch(spark, "outcomes")
    keys = _table(spark, sf_dir, "nation").agg(F.array_sort(F.collect_list("n_nationkey")).alias("k"))
    names = F.transform("k", lambda x: F.concat(F.lit("Equation"), (x + 1).cast("string")))
    words = F.transform("k", lambda a: F.transform("k", lambda b: _outcome(a * 31 + b * 17)))
    keys.select(names.alias("equations"), words.alias("outcomes")).write.json(path)
    return evidence.edges(readers.read_outcomes(spark, path)).select("hyp", "concl", F.col("status").cast("int").alias("status"))


def file_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge list with a header from line items, read back, then through the edge table; counts by status."""
    path, table = scratch(spark, "edge-list"), scratch(spark, "edge-table")
    lines = _table(spark, sf_dir, "lineitem")
    named = lambda c: F.concat(F.when(F.col(c) % 2 == 0, "Equation").otherwise(""), _node(F.col(c)).cast("string"))
    said = lines.select(named("l_orderkey").alias("source"), named("l_partkey").alias("target"), _outcome(F.col("l_suppkey") + F.col("l_linenumber")).alias("outcome"))
    said.write.csv(path, header=True)
    sinks.write_edges(readers.read_edges(spark, path), table)
    held = spark.read.parquet(table)
    return held.groupBy("hyp", F.col("status").cast("int").alias("status")).agg(F.count("*").alias("n"), F.sum(F.col("concl").cast("long")).alias("concl_sum"))


def file_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole matrix as Parquet and as a flat file; what is in a row of each, and the counts of the meta row."""
    parquet, flat = scratch(spark, "matrix"), scratch(spark, "matrix-file")
    told = evidence.plain(spark)
    sinks.write_matrix(told, parquet)
    sinks.write_matrix_file(told, flat)
    having = lambda k: F.size(F.filter("statuses", lambda s: s == k)).cast("long")
    one = spark.read.parquet(f"{parquet}/matrix").select("hyp", having(0).alias("n_false"), having(1).alias("n_true"))
    two = readers.read_matrix(spark, flat).select("hyp", having(0).alias("flat_false"), having(1).alias("flat_true"))
    meta = spark.read.json(f"{parquet}/meta").first()
    return one.join(two, "hyp").select("*", F.lit(meta["proof_false"]).alias("all_false"), F.lit(meta["unknown"]).alias("all_unknown"))


def file_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A selection file of the customers' laws, with their texts; and the built-in selection."""
    path = scratch(spark, "selection")
    _table(spark, sf_dir, "customer").select(_node(F.col("c_custkey")).alias("id"), "c_name").write.csv(path, header=True)
    chosen = readers.read_selection(spark, path).select(F.lit("file").alias("source"), "id")
    every = chosen.union(readers.read_selection(spark).select(F.lit("built-in"), "id"))
    return mapping.law_text(every, "id").select("source", "id", "formal")


def file_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drift report on suppliers as CSV, read back; every third text is beyond the catalogue, every fifth no law."""
    path = scratch(spark, "report")
    told = _table(spark, sf_dir, "supplier").select("s_suppkey", _node(F.col("s_suppkey")).alias("intended_id"), _node(F.col("s_suppkey") * 11).alias("g"))
    said = mapping.law_text(told, "g", "other")
    text = F.concat(F.lit("x = x * (x * (x * (x * (x * x"), F.lit("))))"))
    raw = F.when(F.col("s_suppkey") % 5 == 0, "no law").when(F.col("s_suppkey") % 3 == 0, text).otherwise(F.replace("other", F.lit("◇"), F.lit("*")))
    source = said.select("intended_id", F.concat(F.lit("supplier "), F.col("s_suppkey").cast("string")).alias("nl_description"), raw.alias("generated_equation_raw"))
    sinks.write_report(drift.run(source, evidence.plain(spark)), path)
    held = spark.read.csv(path, header=True)
    key = F.regexp_extract("nl_description", "([0-9]+)$", 1).cast("long")
    return held.select(key.alias("s_suppkey"), F.col("intended_id").cast("int").alias("intended_id"), "generated_status", "oracle_used")


def file_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts as JSON lines, read back."""
    path = scratch(spark, "records")
    pairs = _table(spark, sf_dir, "customer").select("c_custkey", _node(F.col("c_custkey")).cast("string").alias("i"), _node(F.col("c_custkey") * 13).alias("g"))
    said = mapping.law_text(pairs, "g", "text")
    sinks.write_records(verdicts.compare(said, "i", "text", evidence.plain(spark)).select("c_custkey", "verdict.*"), path)
    kind = "c_custkey long, label string, intended struct<node: int, status: string>, generated struct<node: int, status: string>, forward string, backward string"
    held = spark.read.schema(kind).json(path)
    return held.select("c_custkey", "label", F.col("intended.node").alias("intended"), F.col("generated.node").alias("generated"), "forward", "backward")


def cli_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' keys as the words of a command line, resolved to numbers; a star asks for the dual."""
    key = F.col("s_suppkey").cast("string")
    ways = [F.concat(F.lit("["), key, F.lit(",")), F.concat(F.lit("*"), key), F.concat(F.lit("* "), key, F.lit("]")), F.concat(F.lit("4695"), key), F.lit(" "), F.lit("*x = x * y")]
    word = F.element_at(F.array(*ways), (1 + F.col("s_suppkey") % len(ways)).cast("int"))
    words = _table(spark, sf_dir, "supplier").select(word.alias("word"))
    found = mapping.find(readers.specs_of(words, "word").distinct())
    return found.select("spec", "dual", F.coalesce("found", F.lit(0)).alias("found"))


def named_table_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In which of the six fixed tables each law holds."""
    return magmas.satisfaction(laws(spark), magmas.named_tables(spark).withColumnRenamed("name", "table")).select("node", "table", "holds")


def describe_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompts for each part's law, as digests."""
    told = mapping.law_text(_table(spark, sf_dir, "part").select("p_partkey", _node(F.col("p_partkey")).alias("law")), "law")
    return told.select("p_partkey", F.contains(drift.describe_prompt(F.col("formal")), F.col("formal")).alias("names_law"), F.contains(drift.translate_prompt(F.col("formal")), F.col("formal")).alias("names_text"))


def substring_of_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The equation in a wordy answer, through the second dialect's retry."""
    told = mapping.law_text(_table(spark, sf_dir, "customer").select("c_custkey", _node(F.col("c_custkey")).alias("law")), "law")
    answer = F.concat(F.lit("The equation is: "), F.col("formal"), F.lit(", I think!"))
    told = mapping.normalize_dialect(told.select("c_custkey", answer.alias("raw")), "raw")
    return told.select("c_custkey", "normalized.status", "normalized.etp_id")


def limited_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred rows of a build with that limit, which is the operator."""
    return verify.build_rows(spark, "rpn", 100).select("node", "formal", "order")


def same_catalogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two notations of the whole catalogue read back and compared law by law."""
    one, two = (verify.build_rows(spark, n) for n in ("rpn", "smtlib"))
    return verify.same_laws(one, two, "rpn", "smtlib")


def analyzed_renderings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Laws and broken texts of orders through four notations' analysis, counted; orders are counted to their texts first, 9388 at most."""
    orders = _table(spark, sf_dir, "orders").groupBy((F.col("o_orderkey") % 4).alias("kind"), _node(F.col("o_orderkey")).alias("law")).agg(F.count("*").alias("n"))
    told = mapping.law_text(orders, "law")
    text = F.when(F.col("kind") == 1, F.concat("formal", F.lit(" = x"))).when(F.col("kind") == 2, F.concat(F.lit("("), "formal")).otherwise(F.col("formal"))
    texts, out = told.select("kind", "n", text.alias("text")), None
    for n in ("latex", "lean", "text", "json_ast"):
        part = verify.analyzed_rendering(texts, "text", n).groupBy("kind", "rendered.ok", "rendered.error").agg(F.sum("n").alias("n"))
        part = part.select(F.lit(n).alias("notation"), F.col("kind").cast("int").alias("kind"), "ok", F.coalesce("error", F.lit("")).alias("error"), "n")
        out = part if out is None else out.union(part)
    return out


QUERIES: dict[str, Query] = {
    q.__name__: q
    for q in (
        file_law_list, file_listing, file_catalogue, file_json_document, file_tex, file_lean, file_lean_source, file_outcomes, file_edges,
        file_matrix, file_selection, file_report, file_records, cli_words, named_table_laws, describe_prompts, substring_of_answers,
        limited_rows, same_catalogues, analyzed_renderings,
    )
}
