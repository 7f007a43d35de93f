"""Column-wise work on Arrow batches inside Spark tasks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

BATCH_BYTES = 6 << 20
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


_UNITS = {"": 1, "b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40, "p": 1 << 50}


def byte_size(setting: str) -> int:
    """The bytes that a setting such as 8388608, 64m or 1gb stands for; none or less means no limit."""
    number, unit = re.fullmatch(r"(-?\d+)\s*([bkmgtp]?)b?", setting.strip().lower()).groups()
    return int(number) * _UNITS[unit] if int(number) > 0 else 1 << 62


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """df.mapInArrow with batches of about BATCH_BYTES at most, however long the texts are.

    The limit is one of the session and stays set.
    """
    conf = df.sparkSession.conf
    if byte_size(conf.get(_LIMIT, str(1 << 30))) > BATCH_BYTES:
        conf.set(_LIMIT, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def small_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about BATCH_BYTES, so that what is made of one stays small."""
    for batch in batches:
        rows = max(1, int(batch.num_rows * BATCH_BYTES / max(batch.nbytes, 1)))
        for k in range(0, max(batch.num_rows, 1), rows):
            yield batch.slice(k, rows)


def with_arrays(df: DataFrame, fields: list[T.StructField], compute: Callable[[pa.RecordBatch], list], keep: list[str] | None = None) -> DataFrame:
    """`df` (or its columns `keep`) with the columns `fields`, which `compute` makes of each batch.

    An input column of the same name (in any case) is visible to `compute` and replaced in the result.
    """
    new = {f.name.lower() for f in fields}
    kept = [f for f in df.schema.fields if f.name.lower() not in new and (keep is None or f.name in keep)]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            made = compute(batch)
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + made, names + [f.name for f in fields])

    return mapped(df, run, T.StructType(kept + list(fields)))
