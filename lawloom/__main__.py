"""Command line: ``python -m lawloom COMMAND ...``; results are JSON lines."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import parse
from .functions.notations import NOTATIONS, notation
from .operators import evidence, mapping, verdicts, verify
from .operators.catalogue import laws
from .sources import readers, sinks


def _matrix(spark: SparkSession, given: str | None) -> tuple[DataFrame, bool]:
    path = readers.path_of(spark, given, readers.OUTCOMES_AT)
    if path is None:
        return evidence.derive(spark), False
    if path.endswith(".csv"):
        return evidence.packed(readers.read_edges(spark, path).select("hyp", "concl", "status")), True
    return readers.read_outcomes(spark, path), True


def _style(pairs: list[str]) -> dict:
    """``name=value`` words; true and false are flags."""
    words = dict(p.split("=", 1) for p in pairs)
    return {k: {"true": True, "false": False}.get(v, v) for k, v in words.items()}


def _emit(df: DataFrame) -> int:
    """Print rows as JSON; 1 if one of them tells of a failure."""
    failed = 0
    for row in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator():
        print(row["j"])
        told = json.dumps(json.loads(row["j"]))
        failed |= '"ok": false' in told or "parse-failure" in told or "outside-fragment" in told
    return int(failed)


def main(args: list[str]) -> int:
    top = argparse.ArgumentParser(prog="lawloom", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    for name, text in (("normalize", "parse equations"), ("map", "find equations in the catalogue"), ("find", "numbers of laws; *LAW asks for the dual")):
        commands.add_parser(name, help=text).add_argument("equations", nargs="*", help="texts or numbers; standard input if none")
    compare = commands.add_parser("compare", help="label a pair of laws")
    compare.add_argument("--intended", required=True)
    compare.add_argument("--generated", required=True)
    compare.add_argument("--evidence", help="outcomes (.json, .zip) or edge list (.csv); derived if not given")
    render = commands.add_parser("render", help="write equations in a notation")
    render.add_argument("notation", choices=NOTATIONS)
    render.add_argument("equations", nargs="+")
    render.add_argument("--style", nargs="*", default=[], metavar="NAME=VALUE")
    build = commands.add_parser("catalogue", help="write the catalogue in a notation")
    build.add_argument("notation", choices=NOTATIONS)
    build.add_argument("--out", required=True)
    build.add_argument("--listing")
    build.add_argument("--limit", type=int)
    build.add_argument("--no-verify", action="store_true")
    build.add_argument("--style", nargs="*", default=[], metavar="NAME=VALUE")
    matrix = commands.add_parser("matrix", help="write the matrix of implications")
    matrix.add_argument("--evidence")
    matrix.add_argument("--out", required=True)
    check = commands.add_parser("check", help="hold the catalogue against a law list")
    check.add_argument("--laws", help="text with one law per line; else where the settings say")
    said = top.parse_args(args)

    spark = SparkSession.builder.appName("lawloom").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    if said.command in ("normalize", "map", "find"):
        words = said.equations or sys.stdin.read().splitlines()
        given = spark.createDataFrame([(w,) for w in words], "text string")
        if said.command == "find":
            return _emit(mapping.find(readers.specs(spark, words)))
        told = parse.analyzed(given, "text", "r") if said.command == "normalize" else mapping.resolve(given, "text", "r")
        return _emit(told.select("r.*"))
    if said.command == "compare":
        pair = spark.createDataFrame([(said.intended, said.generated)], "i string, g string")
        told, ingested = _matrix(spark, said.evidence)
        return _emit(verdicts.compare(pair, "i", "g", told, ingested).select("verdict.*"))
    if said.command == "check":
        path = readers.path_of(spark, said.laws, readers.LAWS_AT)
        if path is None:
            top.error(f"no law list: give --laws, or set {readers.LAWS_AT[0]} or {readers.LAWS_AT[1]}")
        return _emit(verify.crosscheck(laws(spark).select("node", "formal"), readers.read_laws(spark, path)))
    if said.command == "matrix":
        sinks.write_matrix(_matrix(spark, said.evidence)[0], said.out)
        return 0
    form = notation(said.notation, **_style(said.style))
    if said.command == "render":
        given = mapping.resolve(spark.createDataFrame([(w,) for w in said.equations], "spec string"), "spec", "m")
        texts = given.join(F.broadcast(laws(spark).select("node", "formal")), F.col("m.node") == F.col("node"), "left")
        named = texts.select("spec", F.when(F.rlike("spec", F.lit(r"^\s*[0-9]+\s*$")), F.col("formal")).otherwise(F.col("spec")).alias("text"))
        return _emit(verify.analyzed_rendering(named, "text", form).select("spec", "rendered.*"))
    rows = verify.build_rows(spark, form, said.limit)
    rows = rows if said.no_verify else verify.verified(rows, form)
    sinks.write_catalogue(rows, form, said.out, not said.no_verify)
    if said.listing:
        sinks.write_listing(rows, said.listing, form.multiline)
    return _emit(verify.count_by_order(rows).orderBy("order"))


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
