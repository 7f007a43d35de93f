"""Session settings that the plans of this library are made for."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Adaptive plans split skewed joins and merge small partitions; scans are cut so that a task's texts fit in memory.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.python.sql.dataFrameDebugging.enabled": "false",  # else each column expression notes where it was written, seconds a plan
}


def configured(builder: SparkSession.Builder, shuffle_partitions: int | None = None) -> SparkSession.Builder:
    """`builder` with the settings, and as many shuffle partitions as given: about one for 128 MB of shuffled data."""
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions)) if shuffle_partitions else builder
