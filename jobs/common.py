"""What the jobs' command lines share."""

from __future__ import annotations

import argparse
import dataclasses
import json
import logging
from collections.abc import Callable

from pyspark.sql import SparkSession


def configured(kind: type, path: str | None, **given):
    """A config of class ``kind`` from its file and the command line, which wins; unknown keys are refused."""
    values = {}
    if path:
        with open(path, encoding="utf-8") as f:
            values = json.load(f)
    values |= {k: v for k, v in given.items() if v is not None}
    unknown = set(values) - {f.name for f in dataclasses.fields(kind)}
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return kind(**values)


def main(run: Callable, kind: type, about: str, paths: tuple[str, ...], argv: list[str] | None = None) -> int:
    """Command line of a job: ``--config`` and a word for each of the ``paths``; starts and stops the session."""
    args = argparse.ArgumentParser(description=about)
    args.add_argument("--config", help="JSON file of settings")
    for p in paths:
        args.add_argument(f"--{p}")
    told = vars(args.parse_args(argv))
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    config = configured(kind, told.pop("config"), **told)
    spark = SparkSession.builder.appName(run.__module__).getOrCreate()
    try:
        print(json.dumps(run(spark, config)))
    finally:
        spark.stop()
    return 0
