"""The stored edge table: what a lookup reads and moves, and what it says."""

from __future__ import annotations

import re
import uuid

import pytest
from pyspark.sql import functions as F

from lawloom.sources import edge_index


@pytest.fixture
def stored(spark, tmp_path):
    """A third of all edges leave one hypothesis."""
    n = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 97).alias("hyp"), F.col("id").alias("concl"), (F.col("id") % 5).cast("int").alias("status"))
    name = f"edges_{uuid.uuid4().hex}"
    edge_index.write_edge_index(n.union(n).union(spark.createDataFrame([(None, 1, 0), (1, None, 0), (1, 1, None)], "hyp long, concl long, status int")), str(tmp_path / "edges"), name, 8, 4)
    yield name, {(r["hyp"], r["concl"]): r["status"] for r in n.collect()}
    spark.sql(f"DROP TABLE {name}")


def asked(spark, n):
    pairs = [(7 if i % 3 == 0 else i % 97, i) for i in range(0, 3000, n)] + [(5, 999999), (None, 4), (4, None), (7, 0), (7, 0)]
    return spark.createDataFrame(pairs, "a long, b long").withColumns({"hyp": F.lit(1), "block": F.lit("x")}), pairs


@pytest.mark.parametrize("most", [10**6, 10])
def test_lookup(spark, stored, most):
    name, want = stored
    rows, pairs = asked(spark, 7)
    got = edge_index.lookup(spark, name, rows, "a", "b", "told", 8, most)
    assert sorted(map(repr, got.collect())) == sorted(f"Row(a={a}, b={b}, hyp=1, block='x', told={want.get((a, b))})" for a, b in pairs)


def test_few_pairs_read_only_their_blocks(spark, stored):
    name, want = stored
    told = edge_index.lookup(spark, name, spark.createDataFrame([(7, 0), (15, 112)], "a long, b long"), "a", "b", "told", 8)
    assert {tuple(r) for r in told.collect()} == {(7, 0, 0), (15, 112, want[15, 112])}
    plan = told._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan.lower()
    read = told._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange hashpartitioning\(hyp", read)


def test_many_pairs_leave_the_table_where_it_is(spark, stored):
    name, _ = stored
    rows, _ = asked(spark, 3)
    plan = edge_index.lookup(spark, name, rows.select("a", "b"), "a", "b", "told", 8, 10)._jdf.queryExecution().executedPlan().toString()
    exchanges = re.findall(r"Exchange hashpartitioning\(([a-z_]+)", plan)
    assert exchanges and all(e.startswith("__") for e in exchanges)
    assert "SortMergeJoin" in plan


def test_clash_and_empty(spark, tmp_path):
    two = spark.createDataFrame([(1, 2, 0), (1, 2, 1)], "hyp long, concl long, status int")
    with pytest.raises(Exception, match="two statuses"):
        edge_index.write_edge_index(two, str(tmp_path / "clash"), "clash_" + uuid.uuid4().hex, 2, 2)
    name = "empty_" + uuid.uuid4().hex
    edge_index.write_edge_index(two.limit(0), str(tmp_path / "empty"), name, 2, 2)
    got = edge_index.lookup(spark, name, two.select("hyp", "concl"), "hyp", "concl", "told", 2).collect()
    assert [tuple(r) for r in got] == [(1, 2, None)] * 2
