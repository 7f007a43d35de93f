"""Document fingerprints by a threshold-scaled sketch.

The sketch of a text holds every hash of its five-word shingles below a fixed fraction of the hash range,
and the smallest hash where none is that low. Sketches of parts merge to the sketch of the whole, and
since the fraction is the same for every text, containment of a short text in a long one can be
estimated as well as resemblance.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as tx
from .arrow import mapped, with_arrays

FRACTION = 3 / 4  # high, since a text of ten shingles has to be estimated as well


def thin(hashes: np.ndarray, fraction: float = FRACTION) -> np.ndarray:
    """The sketch of a sorted set of hashes."""
    below = int(np.searchsorted(hashes, np.uint64(int(fraction * 2**64))))
    return hashes[: max(below, 1)]


def merge(a: np.ndarray, b: np.ndarray, fraction: float = FRACTION) -> np.ndarray:
    """The sketch of the union of two texts' shingles."""
    return thin(np.union1d(a, b), fraction)


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


def resemblance(a: np.ndarray, b: np.ndarray) -> float:
    """The estimated Jaccard similarity, 0 to 1; texts without words resemble each other fully."""
    both = _shared(a, b)
    union = len(a) + len(b) - both
    return both / union if union else 1.0


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """The estimated share of a's shingles that b has; an empty text is contained in any."""
    return _shared(a, b) / len(a) if len(a) else 1.0


def sketches(column: pa.Array, fraction: float = FRACTION) -> list[np.ndarray]:
    return [thin(s, fraction) for s in tx.text_sets(column)]


def as_text(sketch: np.ndarray) -> str:
    """16 hex digits a hash, ascending."""
    return sketch.astype(">u8").tobytes().hex()


def from_text(value: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(value), ">u8").astype(np.uint64)


def fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint", fraction: float = FRACTION) -> DataFrame:
    """`df` with `out`, the fingerprint of each text as hex; that of a null, empty or blank text is ''.

    Equal texts have equal fingerprints, in repeated rows too. A column called `out` is replaced.
    """
    return with_arrays(df, [T.StructField(out, T.StringType())], lambda b: [pa.array([as_text(s) for s in sketches(b.column(text), fraction)], pa.string())])


SAMPLED_FOR_A_BOUND = 20


def _bounds(keys: list[tuple], parts: int) -> list[tuple]:
    """At most `parts` - 1 keys that cut the sampled ones into runs of about equal size."""
    keys = sorted(keys)
    return sorted({keys[len(keys) * k // parts] for k in range(1, parts)}) if keys else []


def _key(doc_id, tie: int) -> tuple:
    return doc_id is not None, doc_id, tie  # null ids come first


def with_next(df: DataFrame, parts: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(_part, _extra, doc_id, text), sorted within partitions: ranges of ids, each with its successor.

    Documents go by id, null ids first; documents of one id by the hash of their text, then by text. A range of about
    equal size is a partition, and many rows of one id are several ranges. The first row of each range also goes, as
    `_extra`, to the range before (the first of all to the last), so that every row finds the next one in its own
    partition. Only a sample of the ids, some for each range, and the first id of each range reach the driver.
    """
    rows = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ids = df.select(F.col(doc_id).alias("doc_id"))
    share = min(1.0, SAMPLED_FOR_A_BOUND * parts / max(ids.count(), 1))
    bounds = _bounds([_key(r["doc_id"], 0) for r in ids.sample(share, 7).collect()], parts)
    tie = F.xxhash64("text")
    if len(bounds) < parts - 1:  # few rows, or ids that fill whole ranges
        bounds = _bounds([_key(*r) for r in rows.select("doc_id", tie).sample(share, 7).collect()], parts)

    @F.arrow_udf("int")
    def part_of(ids: pa.Array, ties: pa.Array) -> pa.Array:
        return pa.array([bisect_right(bounds, _key(i, t)) for i, t in zip(ids.to_pylist(), ties.to_pylist(), strict=True)], pa.int32())

    dealt = rows.withColumn("_tie", tie).withColumn("_part", part_of("doc_id", "_tie"))
    firsts = dealt.groupBy("_part").agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id", "_tie")).alias("at")).orderBy("_part").collect()
    before = [(r["_part"], r["at"]["doc_id"], r["at"]["_tie"], firsts[k - 1]["_part"]) for k, r in enumerate(firsts)]
    first = df.sparkSession.createDataFrame(before, T.StructType([T.StructField("_own", T.IntegerType()), T.StructField("_first", ids.schema[0].dataType), T.StructField("_first_tie", T.LongType()), T.StructField("_before", T.IntegerType())]))
    match = (F.col("_part") == F.col("_own")) & F.col("doc_id").eqNullSafe(F.col("_first")) & (F.col("_tie") == F.col("_first_tie"))
    extras = dealt.join(F.broadcast(first), match).select(F.col("_before").alias("_part"), F.lit(True).alias("_extra"), "doc_id", "_tie", "text")
    both = dealt.select("_part", F.lit(False).alias("_extra"), "doc_id", "_tie", "text").unionByName(extras)
    return both.repartitionById(parts, F.col("_part")).sortWithinPartitions("_part", "_extra", "doc_id", "_tie", "text").drop("_tie")


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by as many first characters of the next one."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


RESULT = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(rows: list[tuple], first_after: str, kind: pa.DataType) -> pa.RecordBatch:
    ids, texts = [r[0] for r in rows], [r[1] for r in rows]
    nexts = texts[1:] + [first_after]
    changed = [edited(a, b) for a, b in zip(texts, nexts, strict=True)]
    own = sketches(pa.array([*texts, first_after], pa.large_string()))
    new = sketches(pa.array(changed, pa.large_string()))
    return pa.RecordBatch.from_pydict(
        {
            "doc_id": pa.array(ids, kind),
            "n_chars": pa.array([len(t) for t in texts], pa.int64()),
            "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in changed],
            "fingerprint": [as_text(s) for s in own[:-1]],
            "edited_fingerprint": [as_text(s) for s in new],
            "near_edited": [resemblance(a, b) for a, b in zip(own, new, strict=False)],
            "near_next": [resemblance(a, b) for a, b in zip(own[:-1], own[1:], strict=True)],
        }
    )


def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares each row of a range with the next; holds a few hundred KB of texts at a time."""
    held, size, part = [], 0, None
    waiting = True  # for the extra row that ends a range
    for batch in batches:
        kind = batch.column("doc_id").type
        for p, extra, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("_part", "_extra", "doc_id", "text")), strict=True):
            if p != part:
                part, waiting = p, True
            if extra:
                if waiting and held:
                    yield _compare(held, text, kind)
                held, size, waiting = [], 0, False
                continue
            if size > tx.SLICE_BYTES:
                yield _compare(held, text, kind)
                held, size = [], 0
            held.append((doc_id, text))
            size += len(text)


def compared_with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id and RESULT), a row for each of `docs`: fingerprints of its text and its edited text, and likenesses.

    The next document is that of `with_next`: null ids come first, documents of one id go by the hash of their text,
    and after the last comes the first; a document alone is its own next one. Null texts are empty.
    """
    rows = with_next(docs, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), doc_id, text)
    return mapped(rows, neighbours, T.StructType([rows.schema["doc_id"], *T.StructType.fromDDL(RESULT).fields]))


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared_with_next(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
