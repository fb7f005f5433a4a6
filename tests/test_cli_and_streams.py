"""The command line, path settings, and streams with late rows."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lawloom.__main__ import main
from lawloom.operators import evidence
from lawloom.operators.catalogue import laws
from lawloom.sources import readers
from lawloom.streaming import streams


def _said(capsys):
    return [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]


def test_words_and_numbers(spark, capsys):
    assert main(["map", "b ⊕ a = a ⊕ b", "4512"]) == 0
    assert {r["node"] for r in _said(capsys)} == {43, 4512}
    assert main(["map", "b ⊕ a = a"]) == 0 and main(["map", "b a = a"]) == 1
    capsys.readouterr()
    assert main(["find", "*4", "x = y"]) == 0
    assert {(r["spec"], r["found"]) for r in _said(capsys)} == {("4", 5), ("x = y", 2)}
    assert main(["normalize", "q = r % q"]) == 0
    assert _said(capsys)[0]["normalized"] == "x = y ◇ x"
    assert main(["render", "rpn", "43"]) == 0
    assert _said(capsys)[0]["rendering"] == "x y ◇ y x ◇ ="


def test_compare_with_given_and_configured_evidence(spark, capsys, tmp_path, monkeypatch):
    path = tmp_path / "outcomes.json"
    words = [["implicit_proof_true", "explicit_proof_false"], ["implicit_proof_true", "implicit_proof_true"]]
    path.write_text(json.dumps({"equations": ["Equation1", "Equation2"], "outcomes": words}))
    assert main(["compare", "--intended", "2", "--generated", "1", "--evidence", str(path)]) == 0
    one = _said(capsys)[0]
    assert one["label"] == "weaker" and "Lean proof" in one["evidence"]
    monkeypatch.setenv(readers.OUTCOMES_AT[1], str(path))
    assert main(["compare", "--intended", "1", "--generated", "2"]) == 0
    assert _said(capsys)[0]["label"] == "stronger"
    assert main(["matrix", "--out", str(tmp_path / "matrix")]) == 0
    assert spark.read.parquet(str(tmp_path / "matrix/matrix")).count() == 2


def test_check_takes_the_list_from_the_first_place_that_names_one(spark, capsys, tmp_path, monkeypatch):
    texts = [r["formal"] for r in laws(spark).where("node <= 20").orderBy("node").collect()]
    for name, shown in (("given", texts), ("set", texts[:10]), ("env", ["x = x"])):
        (tmp_path / name).write_text("\n".join(shown) + "\n", encoding="utf-8")
    with pytest.raises(SystemExit):
        main(["check"])
    monkeypatch.setenv(readers.LAWS_AT[1], str(tmp_path / "env"))
    missing = lambda args: (main(args), {r["check"]: r["n"] for r in _said(capsys)}["missing"])[1]
    assert missing(["check"]) == 4693
    spark.conf.set(readers.LAWS_AT[0], str(tmp_path / "set"))
    try:
        assert missing(["check"]) == 4684
        assert missing(["check", "--laws", str(tmp_path / "given")]) == 4674
    finally:
        spark.conf.unset(readers.LAWS_AT[0])


def test_catalogue_is_written(spark, capsys, tmp_path):
    out = tmp_path / "c"
    assert main(["catalogue", "polish", "--out", str(out), "--listing", str(tmp_path / "l"), "--limit", "50"]) == 0
    assert sum(r["n_laws"] for r in _said(capsys)) == 50
    assert spark.read.json(f"{out}/equations").count() == 50 and spark.read.text(str(tmp_path / "l")).count() == 50


def test_texts_as_a_stream(spark, tmp_path):
    rows = [(1, "b ∘ a = a ∘ b"), (2, "nothing"), (3, None), (4, "x = 1 ◇ x"), (5, "$x = y$")]
    spark.createDataFrame(rows, "k int, t string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k int, t string").parquet(str(tmp_path / "in"))
    query = streams.mapped_stream(stream, "t").writeStream.format("memory").queryName("mapped_texts").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r["k"]: (r["status"], r["node"]) for r in spark.table("mapped_texts").collect()}
    assert got == {1: ("mapped", 43), 2: ("parse-failure", None), 3: ("parse-failure", None), 4: ("outside-fragment", None), 5: ("mapped", 2)}


def test_windows_take_rows_out_of_order_and_leave_late_ones(spark, tmp_path):
    """Four files, a batch each: a row five minutes behind counts, one hours behind the watermark does not."""
    noon = datetime(2024, 5, 1, 12, 0)
    at = lambda minutes: noon + timedelta(minutes=minutes)
    files = [[(at(5), 43, 43), (at(6), 2, 1)], [(at(70), 43, 43), (at(65), 43, 43)], [(at(-200), 43, 43), (at(200), 43, 43)], [(at(400), 43, 43), (at(10), 2, 1)]]
    place = str(tmp_path / "in")
    stream = spark.readStream.schema("ts timestamp, intended int, generated int").option("maxFilesPerTrigger", 1).parquet(place + "*")
    told = streams.windowed_labels(streams.labelled_stream(stream, evidence.plain(spark)), "ts")
    spark.createDataFrame(files[0], "ts timestamp, intended int, generated int").coalesce(1).write.parquet(place)
    query = told.writeStream.outputMode("append").format("memory").queryName("windowed").option("checkpointLocation", str(tmp_path / "mark")).start()
    try:
        query.processAllAvailable()
        for rows in files[1:]:
            spark.createDataFrame(rows, "ts timestamp, intended int, generated int").coalesce(1).write.mode("append").parquet(place)
            query.processAllAvailable()
    finally:
        query.stop()
    got = {(r["start"].hour, r["label"]): r["n"] for r in spark.table("windowed").select(F.col("window.start").alias("start"), "label", "n").collect()}
    assert got == {(12, "equal"): 1, (12, "weaker"): 1, (13, "equal"): 2, (15, "equal"): 1}
