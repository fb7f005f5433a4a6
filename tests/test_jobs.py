"""The jobs: against SQL on the supplied tables, over growing input, run again, and on odd rows."""

from __future__ import annotations

import json
import re
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import metric_report, registry, screen_lines
from jobs.common import configured

SMALL = Path("/root/testdata/sf0.001")
ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.skipif(not SMALL.exists(), reason="no tables here")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_by_sql(spark, name):
    con = duckdb.connect()
    for p in SMALL.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    cursor = con.execute(registry.ORACLE_SQL[name])
    columns = [d[0] for d in cursor.description]
    theirs = sorted(map(repr, cursor.fetchall()))
    got = registry.QUERIES[name](spark, str(SMALL))
    assert sorted(got.columns) == sorted(columns)
    assert sorted(repr(tuple(r[c] for c in columns)) for r in got.collect()) == theirs


def _texts(spark, path, rows, mode="append"):
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.mode(mode).parquet(path)


def _all(df):
    return sorted(repr(tuple(r)) for r in df.select(*sorted(df.columns)).collect())


def test_screening_takes_only_what_is_new(spark, tmp_path):
    config = screen_lines.Config(f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/mark", files_per_batch=1)
    first = [
        (1, "A law of groups:\n$x \\circ y = y \\circ x$\nend", "en"), (2, None, "en"), (3, "", None), (None, "x = y", "de"),
        (4, "5 = y\nx = y = z\nx <> y = z", "en"), (4, "5 = y\nx = y = z\nx <> y = z", "en"), (5, "no sign of it\n" * 1000, "fr"),
    ]
    _texts(spark, config.input, first)
    assert screen_lines.run(spark, config) == {"batches": 1, "documents": 7, "equations": 8}
    rows = {(r["doc_id"], r["lang"]): r for r in screen_lines.output(spark, config, "screened").where("doc_id is null or doc_id <> 4").collect()}
    told = {k: (r["n_lines"], r["n_equalities"], r["n_laws"], r["n_outside"], r["n_failed"]) for k, r in rows.items()}
    assert told == {(1, "en"): (3, 1, 1, 0, 0), (2, "en"): (0, 0, 0, 0, 0), (3, None): (1, 0, 0, 0, 0), (None, "de"): (1, 1, 1, 0, 0), (5, "fr"): (1001, 0, 0, 0, 0)}
    fours = screen_lines.output(spark, config, "screened").where("doc_id = 4").collect()
    assert [(r["n_lines"], r["n_equalities"], r["n_outside"]) for r in fours] == [(3, 3, 3)] * 2
    law = screen_lines.output(spark, config, "equations").where("doc_id = 1").first()
    assert (law["line_no"], law["node"], law["status"]) == (1, 43, "mapped")
    before = _all(screen_lines.output(spark, config, "screened"))
    assert screen_lines.run(spark, config) == {"batches": 0, "documents": 0, "equations": 0}
    assert _all(screen_lines.output(spark, config, "screened")) == before
    files = {p: p.stat().st_mtime_ns for p in Path(config.output).rglob("*.parquet")}
    _texts(spark, config.input, [(9, "x = y ◇ x", "en")])
    _texts(spark, config.input, [(10, "nothing", "en")])
    assert screen_lines.run(spark, config) == {"batches": 2, "documents": 2, "equations": 1}
    assert {p: p.stat().st_mtime_ns for p in files} == files  # what was there is not written again
    whole = screen_lines.output(spark, config, "screened")
    assert whole.count() == 9 and whole.where("doc_id = 9 and n_laws = 1").count() == 1
    # In one go, from the start, the same rows but for batch numbers.
    other = screen_lines.Config(config.input, f"{tmp_path}/out2", f"{tmp_path}/mark2")
    assert screen_lines.run(spark, other)["documents"] == 9
    assert _all(screen_lines.output(spark, other, "screened").drop("batch")) == _all(whole.drop("batch"))


def test_a_batch_that_runs_again_replaces_itself(spark, tmp_path):
    """As after a failure between writing and committing: the log of commits lacks the batch, the output has it."""
    config = screen_lines.Config(f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/mark")
    _texts(spark, config.input, [(k, "x = y\nx", "en") for k in range(20)])
    screen_lines.run(spark, config)
    before = _all(screen_lines.output(spark, config, "equations"))
    for p in (Path(config.checkpoint) / "commits").iterdir():
        if p.name.strip(".").startswith("0"):
            p.unlink()
    assert screen_lines.run(spark, config)["batches"] == 1
    assert _all(screen_lines.output(spark, config, "equations")) == before and len(before) == 20


PAIRS = [
    (1, "43", "a * b = b * a", "g", "2024"), (2, "x = y", "4", "g", "2024"), (3, "4", "2", "g", "2025"), (4, None, "43", "h", "2025"), (5, "43", "5 = y", None, None),
    (6, "4512", "4512", "h", "2025"), (6, "4512", "4512", "h", "2025"), (7, "99999", "1", "h", "2024"), (None, "4", "5", "h", "2024"),
]


def test_report_of_odd_rows_and_periods(spark, tmp_path):
    pairs = spark.createDataFrame(PAIRS, "k long, a string, b string, team string, year string")
    pairs.write.parquet(f"{tmp_path}/in")
    config = metric_report.Config(f"{tmp_path}/in", f"{tmp_path}/out", "k", "a", "b", "team", "year", "plain")
    assert metric_report.run(spark, config)["pairs"] == len(PAIRS)
    rows = metric_report.output(spark, config, "pairs")
    told = {r["id"]: (r["label"], r["exact_match"], r["same_law"], r["distance"]) for r in rows.where("id is not null").collect()}
    assert told[1] == ("equal", False, True, 0) and told[2][0] == "weaker" and told[3][0] == "stronger" and told[4] == ("parse-failure", False, False, None)
    assert told[5] == ("outside-fragment", False, False, None) and told[6] == ("equal", True, True, 0) and told[7][0] == "parse-failure"
    summed = {(r["grp"], r["label"], r["period"]): r for r in metric_report.output(spark, config, "summary").collect()}
    assert summed["h", "equal", "2025"]["n"] == 2 and summed["g", "equal", "2024"]["n_exact"] == 0 and sum(r["n"] for r in summed.values()) == len(PAIRS)
    before = _all(rows), _all(metric_report.output(spark, config, "summary"))
    metric_report.run(spark, config)
    assert (_all(metric_report.output(spark, config, "pairs")), _all(metric_report.output(spark, config, "summary"))) == before
    old = _all(metric_report.output(spark, config, "pairs").where("period = '2024'"))
    # Periods that a run does not read stay as they are, whatever became of the input.
    changed = pairs.withColumn("b", F.lit("1")).where("k <> 6")
    changed.write.parquet(f"{tmp_path}/in2")
    metric_report.run(spark, metric_report.Config(f"{tmp_path}/in2", config.output, "k", "a", "b", "team", "year", "plain", first="2025", last="2025"))
    after = metric_report.output(spark, config, "pairs")
    assert _all(after.where("period = '2024'")) == old and after.where("period = '2025'").count() == 2


def test_settings_come_from_file_and_words(tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"id": "n", "input": "a"}), encoding="utf-8")
    got = configured(screen_lines.Config, str(path), input="b", output="o", checkpoint="c")
    assert (got.id, got.input, got.output) == ("n", "b", "o")
    path.write_text(json.dumps({"colour": 1}), encoding="utf-8")
    with pytest.raises(ValueError, match="colour"):
        configured(screen_lines.Config, str(path), input="b", output="o", checkpoint="c")


def test_jobs_import_no_corpus_operator():
    for p in [*(ROOT / "jobs").glob("*.py"), Path(__file__)]:
        assert not re.search(r"^\s*(?:from|import)\s+(?:\S*\bllm\b|corpus_pipeline)", p.read_text(encoding="utf-8"), re.M), p
