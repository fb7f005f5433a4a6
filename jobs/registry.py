"""The jobs as queries: each runs twice into a new folder that executors share; and SQL for what must stand there then."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lawloom.plans import oracles
from lawloom.sources.scratch import scratch

from . import metric_report, screen_lines


def _settings(name: str) -> dict:
    return json.loads((Path(__file__).parent / f"{name}.json").read_text(encoding="utf-8"))


def job1_screen_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines, screened for laws; the second run finds nothing new."""
    at = scratch(spark, "job1")
    config = screen_lines.Config(f"{sf_dir}/documents.parquet", f"{at}/out", f"{at}/checkpoint", **_settings("screen_lines"))
    for _ in range(2):
        screen_lines.run(spark, config)
    return screen_lines.output(spark, config, "screened").select("doc_id", "lang", "n_lines", "n_equalities", "n_laws", "n_outside", "n_failed")


def job2_metric_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label and metrics of every order's pair of laws, on evidence that SQL can repeat (tables of size 2); the second run replaces the first."""
    at = scratch(spark, "job2")
    config = metric_report.Config(f"{sf_dir}/orders.parquet", f"{at}/out", **(_settings("metric_report") | {"evidence": "plain"}))
    for _ in range(2):
        metric_report.run(spark, config)
    done = metric_report.output(spark, config, "pairs")
    return done.select(F.col("id").alias("o_orderkey"), "grp", "period", "intended", "generated", "label", "exact_match", "same_law", F.col("distance").cast("long").alias("distance"))


#: Operation signs, and signs that put a line outside the fragment.  Fixed values.
SIGNS = "◇⋄⬦◆∘○◦·⋅*∗×+-/&%@#!?^~⊕⊗⊙⊖⊘•★†◁▷⊛⊚□"
RELATIONS = "≠<>≤≥→⇒∧∨¬"


def _screen_sql() -> str:
    """The first token that ends a line's matter tells its fate; the grammar, which a line of plain tokens would need, is not repeated here."""
    names = r"[\p{L}\p{Nl}_][\p{L}\p{N}\p{M}\p{Pc}]*"
    return rf"""
WITH lines AS (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line FROM documents),
stops AS (SELECT doc_id, lang, list_filter(regexp_extract_all(rtrim(line, '.'), '==|[=≡(),]|{names}|\p{{Nd}}+|[^\s]'),
  lambda t: NOT (regexp_matches(t, '^(==|[=≡(),]|{names})$') OR contains('{SIGNS}', t)))[1] AS t
  FROM lines WHERE contains(line, '=') OR contains(line, '≡')),
fates AS (SELECT doc_id, count(*) AS k, count(*) FILTER (WHERE t IS NOT NULL AND (regexp_matches(t, '^\p{{Nd}}+$') OR contains('{RELATIONS}', t))) AS outside FROM stops GROUP BY doc_id)
SELECT d.doc_id, d.lang, coalesce(len(string_split(text, chr(10))), 0) AS n_lines, coalesce(k, 0) AS n_equalities, CAST(0 AS BIGINT) AS n_laws,
  coalesce(outside, 0) AS n_outside, coalesce(k - outside, 0) AS n_failed
FROM documents d LEFT JOIN fates f ON d.doc_id = f.doc_id
"""


def _report_sql() -> str:
    text = oracles.FORMAL_TEXT
    return f"""
WITH RECURSIVE {oracles.LAWS}, {oracles._templates(oracles.FORMAL)}, {oracles.SAT2}, texts AS (SELECT node, replace({text}, '◇', '*') AS t FROM {oracles._join(oracles.FORMAL)}),
named AS (SELECT o_orderkey, o_orderpriority AS grp, strftime(o_orderdate, '%Y') AS period, 1 + o_orderkey % 4694 AS i,
  CASE o_orderkey % 8 WHEN 3 THEN 43 WHEN 5 THEN NULL ELSE 1 + o_custkey % 4694 END AS g, o_orderkey % 8 = 3 AS spelled FROM orders)
SELECT o_orderkey, grp, period, CAST(i AS INT) AS intended, CAST(g AS INT) AS generated,
  CASE WHEN g IS NULL THEN 'parse-failure' ELSE {oracles._label('i', 'g', 'a.mask', 'b.mask')} END AS label,
  coalesce(i = g AND NOT spelled, false) AS exact_match, coalesce(i = g, false) AS same_law, CAST(levenshtein(x.t, y.t) AS BIGINT) AS distance
FROM named JOIN masks a ON a.node = i LEFT JOIN masks b ON b.node = g JOIN texts x ON x.node = i LEFT JOIN texts y ON y.node = g
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"job1_screen_lines": job1_screen_lines, "job2_metric_report": job2_metric_report}
ORACLE_SQL: dict[str, str] = {"job1_screen_lines": _screen_sql(), "job2_metric_report": _report_sql()}
