"""Language ID by the nearest of several centroids per language.

A text is the square-rooted counts of its hashed byte 1- to 3-grams (letters in lower case, everything
else in ASCII as a blank), weighted by inverse document frequency and brought to length 1. Each language
has a few centroids, found by spherical k-means; a text gets the language of the centroid of the largest
cosine and is rejected if even that one is farther away than the training texts allow.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as tx
from .arrow import mapped, with_arrays
from .shared import saved

BUCKETS = 4096
CENTROIDS = 4
SAMPLE_PER_LANGUAGE = 1500
MOST_LANGUAGES = 1000  # a model has 64 KB for each
UNDETERMINED = "und"
TEXTS_AT_ONCE = 128
FULL_BYTES = 200

_FOLD = tx.LOWER.copy()
_FOLD[:128] = [c if chr(c).isalpha() else 32 for c in _FOLD[:128].tolist()]
_LETTER = np.array([chr(c).isalpha() for c in range(128)] + [False] * 128)


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    owner: np.ndarray  # the language of each centroid
    weights: np.ndarray  # buckets x centroids: idf times unit centroid
    idf: np.ndarray
    least: np.ndarray  # the least accepted cosine of a text of FULL_BYTES or more, by language


def gram_counts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """texts x BUCKETS: square roots of the counts of the hashed 1-, 2- and 3-grams of each text."""
    n = len(off) - 1
    folded = _FOLD[data]
    # the capitals of Latin-1, two bytes each in UTF-8
    accent = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)) + 1
    folded[accent] += 0x20
    of = np.repeat(np.arange(n, dtype=np.int64) * BUCKETS, np.diff(off))
    key = folded.astype(np.uint32)
    total = np.zeros(n * BUCKETS, np.int64)
    for size in (1, 2, 3):
        if size > 1:
            if len(key) < 2:
                break
            key = (key[:-1] << np.uint32(8)) | folded[size - 1 :]
        bucket = (((key + np.uint32(size << 24)) * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64)
        whole = of[: len(key)] == of[size - 1 :]
        total += np.bincount((of[: len(key)] + bucket)[whole], minlength=n * BUCKETS)
    return np.sqrt(total.reshape(n, BUCKETS).astype(np.float32))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def _blocks(column: pa.Array):
    data, off = tx.buffers(column)
    for i, j in tx.slices(off):
        for a in range(i, j, TEXTS_AT_ONCE):
            b = min(j, a + TEXTS_AT_ONCE)
            yield data[off[a] : off[b]], off[a : b + 1] - off[a]


def has_letter(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Whether each text has a letter of any script."""
    sums = np.concatenate([[0], np.cumsum(_LETTER[data])])
    found = sums[off[1:]] > sums[off[:-1]]
    for k in np.flatnonzero(~found & (off[1:] > off[:-1])):
        found[k] = any(c.isalpha() for c in data[off[k] : off[k + 1]].tobytes().decode("utf-8", "replace"))
    return found


def _cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids of unit rows by spherical k-means, seeded by the farthest points."""
    centers = [_unit(x.mean(axis=0))]
    while len(centers) < min(k, len(x)):
        near = (x @ np.stack(centers).T).max(axis=1)
        centers.append(x[int(near.argmin())])
    at = np.stack(centers)
    for _ in range(rounds):
        nearest = (x @ at.T).argmax(axis=1)
        at = np.stack([_unit(x[nearest == c].sum(axis=0)) if (nearest == c).any() else at[c] for c in range(len(at))])
    return at


def sampled(df: DataFrame, text: str, label: str, sample_per_language: int) -> DataFrame | None:
    """(label, text, h): of each label the distinct texts with letters that have the smallest hashes; None without any.

    Copies count once before anything is cut, so a label whose rows are mostly copies keeps its other texts. The share
    of the hash range that is looked at follows the estimated number of distinct texts, with half as many again.
    """
    rows = df.select(F.col(label).cast("string").alias("label"), F.col(text).alias("text")).where("label is not null").where(F.col("text").rlike(r"\p{L}"))
    rows = rows.withColumn("h", F.xxhash64("text", F.lit("language")))
    sizes = rows.groupBy("label").agg(F.approx_count_distinct("h").alias("n")).limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} different labels in {label}")
    if not sizes:
        return None
    shares = df.sparkSession.createDataFrame([(r["label"], min(1.0, 1.5 * sample_per_language / max(r["n"], 1))) for r in sizes], "label string, share double")
    near = rows.join(F.broadcast(shares), "label").where((F.col("h") / F.lit(float(2**64)) + 0.5) <= F.col("share"))
    place = F.row_number().over(Window.partitionBy("label").orderBy("h"))
    first = near.select("label", "h", "text").dropDuplicates(["label", "h"]).withColumn("k", place).where(F.col("k") <= sample_per_language)
    return saved(first.select("label", "text", "h"))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The number of texts, and of those with each bucket."""
    n, total = 0, np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for data, off in _blocks(batch.column(0)):
            total += (gram_counts(data, off) > 0).sum(axis=0)
            n += len(off) - 1
    yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total])], ["n", "total"])


def _centroids_of(idf: np.ndarray, centroids: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("h").combine_chunks()
        x, k = np.empty((len(table), BUCKETS), np.float32), 0
        for data, off in _blocks(table["text"]):
            x[k : k + len(off) - 1] = _unit(gram_counts(data, off) * idf)
            k += len(off) - 1
        at = _cluster(x, centroids)
        # half the cosine of nearly the worst training text
        least = float(np.quantile((x @ at.T).max(axis=1), 0.001)) / 2
        return pa.table({"label": table["label"][:1].cast(pa.string()), "least": [least], "at": pa.array([at.astype(np.float32).tobytes()], pa.binary())})

    return run


def fit(
    df: DataFrame,
    text: str = "text",
    label: str = "lang",
    sample_per_language: int = SAMPLE_PER_LANGUAGE,
    centroids: int = CENTROIDS,
) -> LanguageModel:
    """A model of the labelled texts in `df`; every label that has a text with a letter is a language of it.

    It is fitted to at most `sample_per_language` distinct texts a language, those with the smallest hashes.
    Rows with a null label, a null text or a text without letters teach nothing; rows that repeat teach once.
    Without any usable row the model knows no language and everything is undetermined. The sample stays on
    the executors, a language's in one task; the driver gets the counts of buckets and the centroids alone.
    More than MOST_LANGUAGES labels are an error.
    """
    sample = sampled(df, text, label, sample_per_language)
    if sample is None:
        return LanguageModel([], np.zeros(0, int), np.zeros((BUCKETS, 0), np.float32), np.ones(BUCKETS, np.float32), np.zeros(0))
    counts = mapped(sample.select("text"), _frequencies, "n bigint, total array<bigint>").collect()
    n, having = sum(r["n"] for r in counts), np.sum([r["total"] for r in counts], axis=0)
    idf = (np.log((1 + n) / (1 + having)) + 1).astype(np.float32)
    found = sorted(sample.groupBy("label").applyInArrow(_centroids_of(idf, centroids), "label string, least double, at binary").collect(), key=lambda r: r["label"])
    at = [np.frombuffer(bytes(r["at"]), np.float32).reshape(-1, BUCKETS) for r in found]
    owner = np.repeat(np.arange(len(found)), [len(a) for a in at])
    weights = np.concatenate(at).T * idf[:, None]
    return LanguageModel([r["label"] for r in found], owner, np.ascontiguousarray(weights, np.float32), idf, np.array([r["least"] for r in found]))


def score(model: LanguageModel, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the language or -1, cosine, rejected) of each text."""
    best, cosine, rejected = [], [], []
    for data, off in _blocks(column):
        tf = gram_counts(data, off)
        near = tf @ model.weights / np.maximum(np.linalg.norm(tf * model.idf, axis=1, keepdims=True), 1e-12)
        known = has_letter(data, off) & (near.shape[1] > 0)
        k = near.argmax(axis=1) if near.shape[1] else np.zeros(len(tf), int)
        c = np.where(known, near[np.arange(len(tf)), k] if near.shape[1] else 0, 0).clip(0, 1)
        lang = np.where(known, model.owner[k] if near.shape[1] else 0, -1)
        best.append(lang)
        cosine.append(c)
        # the cosine of a short text falls with the square root of its length
        floor = model.least[lang] * np.sqrt(np.minimum(1, np.diff(off) / FULL_BYTES)) if len(model.least) else np.zeros(len(lang))
        rejected.append((lang < 0) | (c < floor))
    join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
    return join(best, np.int64), join(cosine, np.float64), join(rejected, bool)


def identify(df: DataFrame, model: LanguageModel, text: str = "text", out: str = "language") -> DataFrame:
    """`df` with `<out>` (string), `<out>_score` (the cosine, 0 to 1) and `<out>_rejected` (boolean).

    A null text and a text without a letter are `und` with score 0 and rejected. Other rejected texts
    keep their nearest language, so that a caller can decide. Columns of these names are replaced; rows,
    duplicates included, stay one for one.
    """
    shared = SparkSession.active().sparkContext.broadcast(model)

    def compute(batch: pa.RecordBatch) -> list:
        m = shared.value
        lang, cosine, rejected = score(m, batch.column(text))
        names = np.array([*m.languages, UNDETERMINED], object)
        return [pa.array(names[lang], pa.string()), pa.array(cosine), pa.array(rejected)]

    return with_arrays(df, [T.StructField(out, T.StringType()), T.StructField(f"{out}_score", T.DoubleType()), T.StructField(f"{out}_rejected", T.BooleanType())], compute)


def fold(doc_id: str, parts: int, held: int):
    """Whether crc32 of the id as text falls on the held-out remainder; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % parts == held, F.lit(False))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").withColumn("held_out", fold("doc_id", 4, 2))
    model = fit(docs.where(~F.col("held_out")))
    out = identify(docs.select("doc_id", "held_out", "text"), model, out="lang_pred")
    return out.select("doc_id", "held_out", "lang_pred", F.col("lang_pred_score").alias("score"), F.col("lang_pred_rejected").alias("rejected"))
