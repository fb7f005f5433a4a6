"""The catalogue, its numbers and counts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lawloom.operators import catalogue


def test_counts_by_order(spark):
    counts = {r["ord"]: r["count"] for r in catalogue.laws(spark).groupBy("ord").count().collect()}
    assert counts == {0: 2, 1: 5, 2: 39, 3: 364, 4: 4284}
    assert [catalogue.law_count(n) for n in range(5)] == [2, 5, 39, 364, 4284]


def test_keys_are_unique_and_numbers_have_no_gaps(spark):
    row = catalogue.laws(spark).agg(F.count_distinct("canonical_key").alias("k"), F.min("node").alias("a"), F.max("node").alias("b")).first()
    assert tuple(row) == (4694, 1, 4694)


@pytest.mark.parametrize(
    ("node", "text"),
    [(1, "x = x"), (2, "x = y"), (3, "x = x ◇ x"), (4, "x = x ◇ y"), (8, "x = x ◇ (x ◇ x)"), (43, "x ◇ y = y ◇ x"),
     (4512, "x ◇ (y ◇ z) = (x ◇ y) ◇ z")],
)
def test_known_laws(spark, node, text):
    assert catalogue.laws(spark).where(F.col("node") == node).first()["formal"] == text


def test_numbers_agree_with_the_generated_catalogue(spark):
    for r in catalogue.laws(spark).where("node % 97 = 0 or node < 50").collect():
        assert catalogue.law_number(tuple(r["lhs"]), tuple(r["rhs"])) == r["node"]
        assert catalogue.law_of_number(r["node"]) == (tuple(r["lhs"]), tuple(r["rhs"]))


@pytest.mark.parametrize("number", [4695, 62576, 62577, 200_000])
def test_numbers_beyond_the_catalogue_come_back(number):
    assert catalogue.law_number(*catalogue.law_of_number(number)) == number


def test_sides_may_be_given_either_way():
    lhs, rhs = catalogue.law_of_number(50_000)
    assert catalogue.law_number(rhs, lhs) == 50_000


def test_a_tautology_has_number_zero():
    assert catalogue.law_number((0, 1, -1), (0, 1, -1)) == 0


def test_rhymes_and_shapes(spark):
    assert [catalogue.rhymes(spark, n).count() for n in range(1, 7)] == [1, 2, 5, 15, 52, 203]
    assert [catalogue.bell(n) for n in range(1, 7)] == [1, 2, 5, 15, 52, 203]
    assert catalogue.shapes(spark).count() == 23


def test_dual_is_an_involution(spark):
    d = catalogue.dual(catalogue.laws(spark))
    back = d.toDF("dual_node", "again")
    assert d.count() == 4694
    assert d.join(back, "dual_node").where("again <> node").count() == 0
