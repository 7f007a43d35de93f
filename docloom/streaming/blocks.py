"""Block tables of streams: each document is parsed as it arrives, without state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.registry import REGISTRY


def stream_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc, text) of files as they appear in a folder, each a document."""
    return spark.readStream.format("text").option("wholetext", "true").load(path).select(F.col("_metadata.file_path").alias("doc"), F.col("value").alias("text"))


def write_blocks(documents: DataFrame, format: str, path: str, checkpoint: str):
    """A running query that appends the blocks of streamed documents to a Parquet table.

    The readers look at the lines of one document in order, so each micro-batch is read as a batch; a
    batch that is repeated after a failure overwrites its own part.
    """
    read = REGISTRY.reader(format)

    def one(batch: DataFrame, number: int) -> None:
        read(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return documents.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
