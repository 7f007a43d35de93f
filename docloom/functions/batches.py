"""Arrow batches of bounded size, and rows made of documents one document at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import IntegerType, StructField, StructType


BATCH_BYTES = 6 << 20
#: So many rows go out of a task at once.
BATCH_ROWS = 5_000
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
_UNITS = {"b": 0, "k": 10, "m": 20, "g": 30, "t": 40, "p": 50}


def small_batches(df: DataFrame) -> DataFrame:
    """The same rows; from now on the session's batches to Python are of about BATCH_BYTES at most, if they were larger."""
    conf = df.sparkSession.conf
    said = conf.get(_LIMIT).strip().lower().removesuffix("b")
    digits = said.rstrip("kmgtp")
    size = int(digits) << _UNITS[said[len(digits) :] or "b"] if digits.lstrip("-").isdigit() else 0
    if size <= 0 or size > BATCH_BYTES:
        conf.set(_LIMIT, str(BATCH_BYTES))
    return df


def rows_of(docs: DataFrame, by: str, content: str, read: Callable[[object], list | None], item: pa.DataType, schema: StructType) -> DataFrame:
    """(doc, n, columns of `schema`): what `read` lists of each document, in order from 0; nothing for None.

    One document is taken apart at a time and its rows leave in batches, so that a task holds no more than that.
    """
    docs = small_batches(docs.select(by, content))
    key = docs.schema[by]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, value in enumerate(batch.column(1)):
                found = read(value.as_py()) or []
                for at in range(0, len(found), BATCH_ROWS):
                    some = pa.array(found[at : at + BATCH_ROWS], item)
                    keys = batch.column(0).take(pa.array([k] * len(some), pa.int64()))
                    yield pa.RecordBatch.from_arrays([keys, pa.array(range(at, at + len(some)), pa.int32()), *some.flatten()], [by, "n", *schema.names])

    return docs.mapInArrow(run, StructType([key, StructField("n", IntegerType()), *schema.fields]))
