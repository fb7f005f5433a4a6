"""The registered queries on the supplied tables: SQL, brute force, and held-out accuracy."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from lawloom.llm import registry

SMALL, LARGER = Path("/root/testdata/sf0.001"), Path("/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not LARGER.exists(), reason="no tables here")


def test_all_are_registered():
    numbers = [int(n[2:].split("_")[0]) for n in registry.QUERIES]
    assert sorted(numbers) == list(range(1, 13))
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for p in SMALL.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    cursor = con.execute(registry.ORACLE_SQL[name])
    columns = [d[0] for d in cursor.description]
    theirs = sorted(map(repr, cursor.fetchall()))
    assert sorted(repr(tuple(r[c] for c in columns)) for r in registry.QUERIES[name](spark, str(SMALL)).collect()) == theirs


def test_components_of_all_pairs(spark):
    got = registry.QUERIES["op8_simhash_near_dedup"](spark, str(SMALL)).collect()
    prints = {r["doc_id"]: int(r["fingerprint"], 16) for r in got}
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for i in ids:
        for j in ids:
            if j < i and (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: find(i) for i in ids}


def test_language_on_held_out_rows(spark):
    got = registry.QUERIES["op6_language_id"](spark, str(LARGER)).where("held_out")
    docs = spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "lang")
    rows = got.join(docs, "doc_id").collect()
    assert len(rows) > 100 and sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.97


def test_quality_on_held_out_rows(spark):
    got = registry.QUERIES["op7_quality_rules"](spark, str(LARGER)).where("held_out")
    labels = spark.read.parquet(f"{LARGER}/labels.parquet")
    rows = got.join(labels, "doc_id").collect()
    assert len(rows) > 40 and sum(r["quality"] == r["predicted"] for r in rows) / len(rows) > 0.95


def test_toxicity_on_held_out_rows(spark):
    got = registry.QUERIES["op3_toxicity"](spark, str(LARGER)).where("held_out").withColumnRenamed("toxic", "told")
    labels = spark.read.parquet(f"{LARGER}/labels.parquet")
    rows = got.join(labels, "doc_id").collect()
    assert len(rows) > 40 and sum(bool(r["toxic"]) == r["told"] for r in rows) / len(rows) > 0.9


def test_leaks_by_plain_search(spark):
    """Items whose whole words stand in a document in a row are found, and nothing that shares less than half of them."""
    from lawloom.llm.decontaminate import words_of

    docs = {r["doc_id"]: words_of(r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    items = {r["item_id"]: words_of(r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    got = {(r["doc_id"], r["item_id"]): r["coverage"] for r in registry.QUERIES["op1_decontamination"](spark, str(SMALL)).collect()}
    joined = {d: " " + " ".join(w) + " " for d, w in docs.items()}
    whole = {(d, i) for d, t in joined.items() for i, w in items.items() if len(w) >= 5 and " " + " ".join(w) + " " in t}
    assert whole and whole <= set(got) and all(got[p] == 1.0 for p in whole)
    for d, i in got:
        windows = {tuple(docs[d][k : k + 5]) for k in range(len(docs[d]) - 4)}
        item = items[i]
        covered = {k + j for k in range(len(item) - 4) if tuple(item[k : k + 5]) in windows for j in range(5)}
        assert len(covered) / len(item) >= 0.6
