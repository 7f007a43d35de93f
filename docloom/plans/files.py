"""The folder that driver and executors share, for files that queries write and read."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_own: list[str] = []


def new_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset and Spark is one process, as in tests, under one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[[^]]*\])?", master := spark.sparkContext.master):
            raise ValueError(f"spark.checkpoint.dir is unset: on {master} executors need a folder that they share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="spark-"))
            atexit.register(shutil.rmtree, _own[0], True)
        named = _own[0]
    return f"{named}/files/{uuid.uuid4().hex}"
