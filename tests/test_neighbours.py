"""Neighbours by index and by blocks, against all pairs."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pytest

from lawloom.operators import neighbours
from lawloom.plans import queries

LARGER = Path("/root/testdata/sf0.01")


def _table(spark, n, seed=1, hot=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 8))
    points = centres[rng.integers(0, 6, n)] + 0.4 * rng.normal(size=(n, 8))
    points[:hot] = points[0] + 0.01 * rng.normal(size=(hot, 8))
    rows = [(i, p.tolist()) for i, p in enumerate(points)]
    return points, spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def plain(points, k):
    u = points / np.linalg.norm(points, axis=1, keepdims=True)
    near = u @ u.T
    np.fill_diagonal(near, -np.inf)
    return {i: np.argsort(-near[i], kind="stable")[:k].tolist() for i in range(len(u))}


@pytest.mark.parametrize("group", [7, 64, 4096])
def test_exact_blocks_are_all_pairs(spark, group):
    points, df = _table(spark, 150, hot=50)
    units = neighbours.unit(df, "vec_id", "embedding")
    got = {}
    for r in neighbours.nearest(units, units, 4, group=group).collect():
        got.setdefault(r["id"], {})[r["rank"]] = r["other"]
    assert {i: [v[k] for k in sorted(v)] for i, v in got.items()} == plain(points, 4)


def test_index_recall_with_a_hot_cell(spark):
    points, df = _table(spark, 900, seed=2, hot=300)
    units = neighbours.unit(df, "vec_id", "embedding")
    centres = neighbours.fit_centres(units, cells=24)
    found = neighbours.nearest(units, units, 5, centres, probes=8, group=50)
    told = neighbours.recall(found, neighbours.nearest(units.where("id % 50 = 0"), units, 5)).first()
    assert told["n_exact"] == 18 * 5 and told["recall"] >= 0.9
    assert found.groupBy("id").count().where("count <> 5").count() == 0


@pytest.mark.skipif(not LARGER.exists(), reason="no tables here")
def test_recall_of_the_query(spark):
    assert queries.QUERIES["neighbour_recall"](spark, str(LARGER)).first()["recall"] >= 0.9


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [2.0, 0.0]), (None, [1.0, 1.0]), (5, []), (6, [1.0, None]), (4, [0.0, 1.0])]
    units = neighbours.unit(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    assert sorted(r["id"] for r in units.collect()) == [1, 4, 4]
    got = {(r["id"], r["rank"]): r["other"] for r in neighbours.nearest(units, units, 3).collect()}
    assert got[1, 1] == 4 and got[1, 2] == 4 and got[4, 1] == 1
    none = units.where("false")
    assert neighbours.nearest(none, units, 3, neighbours.fit_centres(none)).count() == neighbours.nearest(units, none).count() == 0
