"""Folders for results that are written only to be read again."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

FOLDER = "spark.checkpoint.dir"


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder that all executors share; on one machine alone, in a folder of its own if none is named."""
    named = spark.sparkContext.getConf().get(FOLDER) or spark.conf.get(FOLDER, None)
    if not named:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError(f"{FOLDER} must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="lawloom-")
        spark.conf.set(FOLDER, named)
    return f"{named}/{label}-{uuid.uuid4().hex}"
