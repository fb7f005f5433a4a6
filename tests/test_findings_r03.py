"""Faults that a review of larger tables found."""

from __future__ import annotations

import tracemalloc
from weakref import WeakKeyDictionary

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from jobs import registry, screen_lines
from lawloom.operators import catalogue, evidence, neighbours, reachability, verdicts
from lawloom.plans import files, oracles, queries
from lawloom.sources import sinks

SMALL = "/root/testdata/sf0.01"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_edges_are_never_broadcast(spark):
    """an edge table from the packed matrix is far larger than Spark takes it for."""
    pairs = spark.createDataFrame([(1, 2), (2, 1)], "a int, b int")
    edges = spark.createDataFrame([(1, 2, 0), (2, 1, 1)], "hyp int, concl int, status int")
    told = verdicts.edge_relations(pairs, edges, "a", "b")
    assert "Broadcast" not in _plan(told) and _plan(told).count("SortMergeJoin") == 2
    assert {(r["a"], r["label"]) for r in told.collect()} == {(1, "stronger"), (2, "weaker")}


def test_only_rows_of_laws_reach_the_driver(spark, monkeypatch):
    """F2 to F6: the proved pairs stay in the tasks."""
    kind, seen = type(spark.range(1)), []
    for name in ("toPandas", "collect"):
        plain = getattr(kind, name)

        def counting(self, plain=plain):
            got = plain(self)
            seen.append(len(got))
            return got

        monkeypatch.setattr(kind, name, counting)
    monkeypatch.setattr(evidence, "_kept", WeakKeyDictionary())
    matrix = evidence.derive(spark, (2,))
    assert seen and max(seen) <= catalogue.CATALOGUE_SIZE
    some = [3, 8, 43, 168, 4512]
    pairs = {(r["hyp"], r["concl"]) for r in evidence.proof_rules(spark).where(F.col("hyp").isin(some)).collect()}
    rows = {r["hyp"]: np.unpackbits(np.frombuffer(r["bits"], np.uint8)) for r in evidence.proof_rows(spark).where(F.col("hyp").isin(some)).collect()}
    assert {(h, int(c) + 1) for h, bits in rows.items() for c in np.flatnonzero(bits)} == pairs
    assert {(r["hyp"], c) for r in matrix.where(F.col("hyp").isin(some)).collect() for c, s in enumerate(r["statuses"], 1) if s == evidence.PROOF_TRUE} >= pairs


def test_laws_beyond_are_those_of_five_operations(spark, tmp_path):
    """F8: suppliers beyond the 1015th name larger laws."""
    spark.createDataFrame([(k,) for k in (1, 77, 1015, 1016, 6000)], "s_suppkey long").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    got = queries.laws_beyond(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM read_parquet('{tmp_path}/supplier.parquet/*.parquet')")
    want = con.execute(oracles.ORACLE_SQL["laws_beyond"]).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) == 3


def test_cosines_are_made_in_pieces():
    """F10 to F12: a group of the largest size holds a piece of its cosines only."""
    rng = np.random.default_rng(3)
    vec = rng.normal(size=(neighbours.GROUP, 64))
    group = pd.DataFrame({"id": rng.permutation(neighbours.GROUP), "vec": list(vec / np.linalg.norm(vec, axis=1, keepdims=True))})
    tracemalloc.start()
    got = neighbours.best(group, group, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6 and len(got) == 5 * neighbours.GROUP
    near = np.stack(group["vec"]) @ np.stack(group["vec"]).T
    np.fill_diagonal(near, -2)
    for at in (0, 255, 256, 4095):
        own = got[got["id"] == group["id"][at]]
        assert list(own["other"]) == list(group["id"][np.argsort(-near[at])[:5]])


def test_a_vector_leaves_python_once(spark):
    """the copies for a query's cells are made in the JVM."""
    units = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(20)], "id long, vec array<double>")
    placed = neighbours._placed(units, np.eye(2), 2)
    assert "explode" in _plan(placed) and placed.columns == ["id", "vec", "cell"]
    assert sorted((r["id"], r["cell"]) for r in placed.collect()) == [(k, c) for k in range(20) for c in (0, 1)]


def test_texts_are_analysed_once_per_text(spark, monkeypatch):
    """F16: orders are counted to their texts before any analysis."""
    sizes, plain = [], files.verify.analyzed_rendering
    monkeypatch.setattr(files.verify, "analyzed_rendering", lambda df, *more: sizes.append(df.count()) or plain(df, *more))
    out = files.analyzed_renderings(spark, SMALL)
    assert len(sizes) == 4 and max(sizes) <= 9388 < spark.read.parquet(f"{SMALL}/orders.parquet").count()
    assert out.agg(F.sum("n")).first()[0] == 4 * spark.read.parquet(f"{SMALL}/orders.parquet").count()


def test_edge_table_is_written_by_as_many_tasks_as_it_needs(spark, tmp_path):
    """one range of hypotheses is not one task's work."""
    edges = spark.range(200_000).select(F.lit(1).alias("hyp"), F.col("id").cast("int").alias("concl"), F.lit(0).alias("status"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200k")
    try:
        sinks.write_edges(edges, f"{tmp_path}/edges")
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(list((tmp_path / "edges" / "hyp_range=0").glob("*.parquet"))) > 1
    assert spark.read.parquet(f"{tmp_path}/edges").count() == 200_000


def test_runs_of_dollars_delimit_nothing(spark, tmp_path):
    """a line of a text with runs of dollar signs before a number is no equation, as the SQL has it."""
    texts = ["Of$$$ the&&& password=12ab is", "5$$$ = a", "a$$$ = 5\nThe$$$ token=7c", "x + 5 = y\n$$$"]
    rows = [(k, "en", t) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.job1_screen_lines(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    cursor = con.execute(registry.ORACLE_SQL["job1_screen_lines"])
    columns = [d[0] for d in cursor.description]
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(cursor.fetchall())
    docs = spark.createDataFrame([(1, "en", "a$$$ = 5"), (2, "en", "$$x = y$$")], "doc_id long, part string, text string")
    told = {r["doc_id"]: (r["line"], r["status"], r["reason"]) for r in screen_lines.screened(docs)[1].collect()}
    assert told == {1: ("a$$$ = 5", "parse-failure", "unexpected character '$'"), 2: ("$$x = y$$", "mapped", None)}


def test_nodes_outside_cycles_are_never_coloured(spark, monkeypatch):
    """a part that nothing leads to is a component of its own and costs no round."""
    seen, plain = [], reachability._coloured
    monkeypatch.setattr(reachability, "_coloured", lambda edges: seen.append(edges.count()) or plain(edges))
    edges = spark.createDataFrame([(9, 1), (9, 2), (8, 1), (1, 2), (2, 1), (2, 3), (3, 4), (7, 7), (9, 1)], "u long, v long")
    got = {r["node"]: (r["component_size"], r["n_reached"]) for r in reachability.reach_counts(edges).collect()}
    assert got == {9: (1, 4), 8: (1, 4), 1: (2, 4), 2: (2, 4), 3: (1, 1), 4: (1, 0), 7: (1, 1)}
    assert seen == [3]  # of eight different edges


def test_statuses_leave_a_task_in_pieces(spark, monkeypatch):
    """a task of the packed matrix never holds all its rows as Python numbers."""
    kind, seen = type(spark.range(1)), {}
    plain = kind.mapInPandas

    def recording(self, run, schema, *more):
        seen[schema] = run
        return plain(self, run, schema, *more)

    monkeypatch.setattr(kind, "mapInPandas", recording)
    monkeypatch.setattr(evidence, "_kept", WeakKeyDictionary())
    matrix = evidence.plain(spark)
    numbers = np.arange(1, 588, dtype=np.int32)
    got = list(seen["hyp int, statuses array<tinyint>"](iter([pd.DataFrame({"hyp": numbers})])))
    assert max(map(len, got)) <= 64 and [h for part in got for h in part["hyp"]] == numbers.tolist()
    rows = {int(h): list(s) for part in got for h, s in zip(part["hyp"], part["statuses"], strict=True)}
    assert all(rows[r["hyp"]] == r["statuses"] for r in matrix.where("hyp in (1, 2, 33, 587)").collect()) and matrix.count() == catalogue.CATALOGUE_SIZE
