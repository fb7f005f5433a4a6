"""Finite models, evidence, verdicts and the drift pipeline."""

from __future__ import annotations

import json
import random
import zipfile
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from lawloom.operators import catalogue, drift, evidence, magmas, mapping, metrics, mutations, verdicts
from lawloom.sources import readers, sinks


def test_size_two_models(spark):
    masks = magmas.masks(catalogue.laws(spark).where("node in (1, 2, 4, 43, 4512)"))
    got = {r["node"]: bin(r["mask"]).count("1") for r in masks.collect()}
    assert got == {1: 16, 2: 0, 4: 1, 43: 8, 4512: 8}


def test_fold_and_arrays_agree(spark):
    some = catalogue.laws(spark).where("node % 203 = 0")
    folds = {r["node"]: r["mask"] for r in magmas.masks(some).collect()}
    for r in magmas.signatures(some, (2,), classes=False).collect():
        bits = np.unpackbits(np.frombuffer(r["signature"], np.uint8))[:16]
        assert sum(1 << i for i in np.flatnonzero(bits).tolist()) == folds[r["node"]]


def test_isomorphism_classes():
    assert [len(magmas.distinct_tables(n)) for n in (1, 2, 3)] == [1, 10, 3330]


def test_witnesses_refute(spark):
    pairs = spark.createDataFrame([(3, 4), (43, 4512), (2, 7)], "a int, b int")
    got = {(r["a"], r["b"]): r for r in magmas.brute_force(pairs, catalogue.laws(spark)).collect()}
    assert got[3, 4]["a_implies_b"] is False and got[3, 4]["b_implies_a"] is None
    assert got[3, 4]["witness_a_not_b"]["tab"] == [0, 0, 0, 1]
    assert got[43, 4512]["a_implies_b"] is False and got[43, 4512]["b_implies_a"] is False
    assert got[2, 7]["a_implies_b"] is None and got[2, 7]["b_implies_a"] is None


def _plain_holds(lhs, rhs, tab, n):
    """Every value of every variable, by a plain stack."""
    names = max([*lhs, *rhs]) + 1

    def value(term, given):
        stack = []
        for t in term:
            if t < 0:
                b, a = stack.pop(), stack.pop()
                stack.append(tab[a * n + b])
            else:
                stack.append(given[t])
        return stack[0]

    return all(value(lhs, g) == value(rhs, g) for g in product(range(n), repeat=names))


def test_tables_of_size_three_and_first_witnesses_by_trying_all(spark):
    """Counts and witnesses over all 19683 tables in counting order, not only one of each class."""
    some = catalogue.laws(spark).where("node in (3, 4, 5, 8, 43)")
    kept = {r["node"]: (r["lhs"], r["rhs"]) for r in some.select("node", "lhs", "rhs").collect()}
    true = {(node, n): [k for k, tab in enumerate(product(range(n), repeat=n * n)) if _plain_holds(*law, tab, n)] for node, law in kept.items() for n in (2, 3)}
    assert {r["node"]: r["n_tables"] for r in magmas.holding_tables(some, 3).collect()} == {node: len(true[node, 3]) for node in kept}
    pairs = spark.createDataFrame([(a, b) for a in kept for b in kept], "a int, b int")
    for r in magmas.brute_force(pairs, catalogue.laws(spark)).collect():
        first = next(((n, k) for n in (2, 3) for k in true[r["a"], n] if k not in set(true[r["b"], n])), None)
        assert (r["witness_a_not_b"] and (r["witness_a_not_b"]["n"], r["witness_a_not_b"]["magma_id"])) == first


def test_derived_evidence_is_consistent(spark):
    matrix = evidence.derive(spark)
    assert {r["failures"] for r in evidence.checks(matrix).collect()} == {0}
    counts = {r["name"]: r["n_pairs"] for r in evidence.status_counts(matrix).collect()}
    assert sum(counts.values()) == 4694**2
    assert counts["proof_false"] == 13_596_121
    assert counts["proof_true"] == 3_887_709


def test_verdicts(spark):
    """Pairs of numbers, spelled in turn as number and as text, get the label that both signatures and one-step rules give."""
    rng = random.Random(77)
    nodes = [(rng.randrange(1, 4695), rng.randrange(1, 4695)) for _ in range(150)] + [(k, k) for k in (1, 8, 99)] + [(2, k) for k in (1, 6, 77)]
    spoken = mapping.law_text(spark.createDataFrame(nodes, "i int, g int"), "g", "text").withColumn("n", F.col("i").cast("string"))
    got = verdicts.compare(spoken, "n", "text", evidence.derive(spark)).collect()
    assert len(got) == len(nodes)
    rows = {r["hyp"]: r["statuses"] for r in evidence.derive(spark).where(F.col("hyp").isin([x for p in nodes for x in p])).collect()}
    for r in got:
        i, g, v = r["i"], r["g"], r["verdict"]
        f, b = rows[i][g - 1], rows[g][i - 1]
        wanted = "equal" if i == g else {(1, 1): "equivalent", (1, 0): "weaker", (0, 1): "stronger", (0, 0): "incomparable"}.get((f, b), "unknown")
        assert (v["label"], v["intended"]["node"], v["generated"]["node"]) == (wanted, i, g)
        assert (v["evidence"] == f"both map to Equation {i}") == (i == g) and v["notes"] is None


def test_verdicts_off_the_graph(spark):
    rows = [("7", "r ? s ? t = r"), ("r s", "7"), ("7", "r = s = t"), ("7", "r = 1")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = {(r["a"], r["b"]): r["verdict"] for r in verdicts.compare(df, "a", "b", evidence.derive(spark)).collect()}
    assert [got[r]["label"] for r in rows] == ["parse-failure", "parse-failure", "outside-fragment", "outside-fragment"]
    assert got[rows[0]]["notes"].startswith("generated equation: unparenthesized chain") and got[rows[1]]["notes"].startswith("intended equation: ")
    assert all(v["evidence"] is None and v["forward"] is None for v in got.values())


def test_truth_table(spark):
    rows = [(f, b) for f in (0, 1, 4, None) for b in (0, 1, 4, None)]
    df = spark.createDataFrame(rows, "f int, b int")
    got = {(r["f"], r["b"]): r["l"] for r in df.withColumn("l", verdicts.relation(F.col("f"), F.col("b"))).collect()}
    wanted = {(1, 1): "equivalent", (1, 0): "weaker", (0, 1): "stronger", (0, 0): "incomparable"}
    assert got == {p: wanted.get(p, "unknown") for p in rows}


def test_drift(spark):
    rows = [(43, "commutes", r"\( x * y = y * x \)"), (43, "all equal", "x = y"), (43, "noise", "no law"), (4, "large", "x = ((y*x)*(x*z))*(y*(y*x))")]
    df = spark.createDataFrame(rows, "intended_id int, nl_description string, generated_equation_raw string")
    report = drift.run(df, evidence.derive(spark))
    got = {r["nl_description"]: r for r in report.collect()}
    assert report.columns == list(drift.COLUMNS)
    assert got["commutes"]["label"] == "equivalent" and got["commutes"]["oracle_used"] == "implication_graph"
    assert got["all equal"]["label"] == "stronger"
    assert got["noise"]["label"] == "invalid" and "UNRESOLVABLE" in got["noise"]["explanation"]
    assert got["large"]["oracle_used"] == "brute_force" and got["large"]["label"] in ("incomparable", "unknown")
    assert drift.summary(report).count() == len({r["label"] for r in got.values()})


def test_outcomes_are_read(spark, tmp_path):
    doc = {"equations": ["Equation1", "Equation2"], "outcomes": [["implicit_proof_true", "explicit_proof_false"], ["explicit_proof_true", "unknown"]]}
    plain, packed = tmp_path / "o.json", tmp_path / "o.json.zip"
    plain.write_text(json.dumps(doc))
    with zipfile.ZipFile(packed, "w") as z:
        z.write(plain, "o.json")
    for path in (plain, packed):
        got = {r["hyp"]: r["statuses"] for r in readers.read_outcomes(spark, str(path)).collect()}
        assert got == {1: [1, 0], 2: [1, 4]}


def test_bad_archives_are_refused(spark, tmp_path):
    fine = {"equations": ["Equation1", "Equation2"], "outcomes": [["unknown", "unknown"], ["unknown"]]}
    with zipfile.ZipFile(tmp_path / "ragged.zip", "w") as z:
        z.writestr("o.json", json.dumps(fine))
    with zipfile.ZipFile(tmp_path / "two.zip", "w") as z:
        z.writestr("a.json", "{}")
        z.writestr("b.json", "{}")
    for name, said in (("ragged", "no square matrix"), ("two", "expected one JSON file")):
        with pytest.raises(Exception, match=said):
            readers.read_outcomes(spark, str(tmp_path / f"{name}.zip")).collect()


def test_edges_are_read_and_packed(spark, tmp_path):
    (tmp_path / "e.csv").write_text("source,target,outcome\nEquation1,Equation2,explicit_proof_false\n2,1,implicit_proof_true\n")
    edges = readers.read_edges(spark, str(tmp_path / "e.csv"))
    got = {r["hyp"]: r["statuses"] for r in evidence.packed(edges.select("hyp", "concl", "status"), 2).collect()}
    assert got == {1: [4, 0], 2: [1, 4]}
    assert evidence.edges(evidence.packed(edges.select("hyp", "concl", "status"), 2)).count() == 4


def test_flat_matrix_is_read(spark, tmp_path):
    (tmp_path / "m.bin").write_bytes(bytes([1, 0, 1, 4]))
    got = {r["hyp"]: r["statuses"] for r in readers.read_matrix(spark, str(tmp_path / "m.bin"), 2).collect()}
    assert got == {1: [1, 0], 2: [1, 4]}


def test_law_lists(spark, tmp_path):
    (tmp_path / "e.txt").write_text("x = x\nx = y\n\n\n")
    assert [tuple(r) for r in readers.read_laws(spark, str(tmp_path / "e.txt")).orderBy("node").collect()] == [(1, "x = x"), (2, "x = y")]
    (tmp_path / "b.txt").write_text("x = x\n\nx = y\n")
    with pytest.raises(Exception, match="blank line 2"):
        readers.read_laws(spark, str(tmp_path / "b.txt")).collect()
    (tmp_path / "a.lean").write_text("equation 2 := x = y -- note\n  equation 1 := x = x\nequation 2 := x = y\n")
    assert readers.read_lean(spark, str(tmp_path / "a.lean")).count() == 2


def test_sinks(spark, tmp_path):
    from lawloom.functions.notations import LeanStyle, notation
    from lawloom.operators import verify

    form = notation("rpn")
    rows = verify.build_rows(spark, form, 5)
    sinks.write_catalogue(rows, form, str(tmp_path / "c"))
    assert spark.read.json(str(tmp_path / "c/equations")).count() == 5
    sinks.write_listing(rows, str(tmp_path / "l"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "l")).collect()][0] == "1. x x ="
    assert len(json.loads(sinks.json_document(rows, form).first()["value"])["equations"]) == 5
    with pytest.raises(ValueError, match="library"):
        sinks.write_lean(rows, str(tmp_path / "x"), LeanStyle(universe="star"))


def test_metrics(spark):
    df = spark.createDataFrame([("equal", True), ("weaker", True), ("unknown", True), ("equivalent", False)], "label string, m boolean")
    row = metrics.disagreements(df, ("m",)).first()
    assert (row["n"], row["unresolved"], row["m_false"], row["m_missed"]) == (4, 1, 1, 1)
    assert metrics.accuracy(df, "m").where("label = 'equal'").first()["accuracy"] == 1.0
    assert metrics.confusion(df, "m").count() == 4


def test_mutations(spark):
    made = mutations.mutated(catalogue.laws(spark).where("node = 4512"))
    got = {r["kind"]: r["text"] for r in made.collect()}
    assert got["flip_sides"] == "(x ◇ y) ◇ z = x ◇ (y ◇ z)"
    assert got["delete_subtree"] == "x ◇ (y ◇ z) = x ◇ y"
    assert got["merge_variables"] == "x ◇ (y ◇ x) = (x ◇ y) ◇ x"
    assert got["swap_arguments"] == "x ◇ (y ◇ z) = z ◇ (y ◇ x)"


def test_stream(spark, tmp_path):
    from lawloom.streaming import streams

    spark.createDataFrame([(2, 43), (43, 43), (43, 4512)], "intended int, generated int").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("intended int, generated int").parquet(str(tmp_path / "in"))
    told = streams.labelled_stream(stream, evidence.plain(spark))
    query = told.writeStream.format("memory").queryName("told").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r["label"] for r in spark.table("told").collect()} == {"weaker", "equal", "incomparable"}


def test_laws_in_named_tables(spark):
    """All laws in the six fixed tables: the fold against arrays."""
    every = catalogue.laws(spark)
    got = {(r["node"], r["name"]): r["holds"] for r in magmas.satisfaction(every, magmas.named_tables(spark)).collect()}
    sides = [(r["node"], list(r["lhs"]), list(r["rhs"])) for r in every.collect()]
    for name, n, tab in magmas.NAMED_TABLES:
        flat = np.array([tab])
        assert all(got[k, name] == bool(magmas.law_holds(a, b, flat, n)[0]) for k, a, b in sides)


def test_metrics_against_labels(spark):
    rows = [("equal", True, False), ("equivalent", False, False), ("weaker", True, False), ("stronger", False, False), ("unknown", True, True), ("incomparable", False, True)]
    df = spark.createDataFrame(rows, "label string, m boolean, k boolean")
    one = metrics.disagreements(df, ("m", "k")).first().asDict()
    assert one == {"n": 6, "unresolved": 1, "m_false": 1, "m_missed": 1, "k_false": 1, "k_missed": 2}
