"""Quality classifier: histogram gradient-boosted trees over statistics of a text.

The trees are complete and of one depth, so a forest is three arrays (feature, threshold, leaf) and all
texts of a batch go down all trees together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as tx
from .arrow import with_arrays
from .language import fold

SAMPLE_ROWS = 20_000
TREES, DEPTH, BINS, RATE, LEAST_LEAF, L2 = 80, 4, 32, 0.15, 8, 1.0

FEATURES = (
    "log_bytes", "log_words", "word_length", "upper", "digit", "stop", "bang", "bar", "symbol", "space", "high",
    "repeated_next", "distinct_words", "top_length", "line_words", "distinct_lines", "symbol_ended",
)


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_UPPER, _DIGIT = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("0123456789")
_STOP, _BANG, _BAR, _SPACE = _class(".,;:?"), _class("!"), _class("|"), tx.IS_SPACE
_SYMBOL = _class("#$%&*@^~_=+<>/\\{}[]")
_HIGH = np.arange(256) >= 128


def _distinct(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many distinct values each text has."""
    of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((values, of))
    v, o = values[order], of[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    return np.bincount(o[new], minlength=len(first) - 1)


def statistics(column: pa.Array) -> np.ndarray:
    """texts x FEATURES; an empty or null text has zeros and ones like any text without words."""
    data, off = tx.buffers(column)
    parts = []
    for i, j in tx.slices(off):
        d, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
        n = len(o) - 1
        size = np.maximum(np.diff(o), 1)

        def share(table: np.ndarray, d=d, o=o, size=size) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(table[d])])
            return (sums[o[1:]] - sums[o[:-1]]) / size

        starts, ends, first = tx.word_spans(d, o)
        words = np.diff(first)
        some = np.maximum(words, 1)
        hashes = tx.span_hashes(tx.LOWER[d], starts, ends)
        of = np.repeat(np.arange(n), words)
        per = lambda x, of=of, n=n: np.bincount(of, weights=x, minlength=n)
        length = ends - starts
        again = np.zeros(len(hashes), bool)
        again[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
        longest = np.zeros(n)
        np.maximum.at(longest, of, length)
        last = d[ends - 1] if len(ends) else d[:0]
        # lines: runs between newlines, hashed as spans
        breaks = d == 0x0A
        edge = np.zeros(len(d) + 1, bool)
        edge[o] = True
        begins = ~breaks
        begins[1:] &= breaks[:-1] | edge[1:-1]
        stops = ~breaks
        stops[:-1] &= breaks[1:] | edge[1:-1]
        begins, stops = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        line_first = np.searchsorted(begins, o)
        lines = np.diff(line_first)
        parts.append(
            np.stack(
                [
                    np.log1p(np.diff(o)), np.log1p(words), per(length) / some, share(_UPPER), share(_DIGIT), share(_STOP), share(_BANG), share(_BAR), share(_SYMBOL), share(_SPACE), share(_HIGH),
                    per(again) / some, _distinct(hashes, first) / some, np.log1p(longest), words / np.maximum(lines, 1), _distinct(tx.span_hashes(d, begins, stops), line_first) / np.maximum(lines, 1), per(_SYMBOL[last] | _BANG[last]) / some,
                ],
                axis=1,
            )
        )
    return np.concatenate(parts).astype(np.float32) if parts else np.zeros((0, len(FEATURES)), np.float32)


@dataclass(frozen=True)
class Forest:
    base: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray  # trees x inner nodes; larger values go right
    leaf: np.ndarray  # trees x leaves


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Forest:
    """Second-order boosting of the logistic loss on histograms of up to BINS bins a feature."""
    rows, width = x.shape
    mean = (y.sum() + 1) / (rows + 2)
    base = float(np.log(mean / (1 - mean)))
    inner = 2**depth - 1
    feature, threshold, leaf = np.zeros((trees, inner), np.int32), np.full((trees, inner), np.inf, np.float32), np.zeros((trees, 2**depth), np.float32)
    if rows == 0 or y.min() == y.max():
        return Forest(base, feature[:0], threshold[:0], leaf[:0])
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)
    raw = np.full(rows, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(rows, np.int64)
        for level in range(depth):
            at = node - (2**level - 1)
            key = (at[:, None] * width + np.arange(width)) * BINS + binned
            shape = (2**level, width, BINS)
            g, h, c = (np.bincount(key.ravel(), np.repeat(v, width), minlength=np.prod(shape)).reshape(shape).cumsum(axis=2) for v in (grad, hess, np.ones(rows)))
            G, H, C = g[:, :, -1:], h[:, :, -1:], c[:, :, -1:]
            gain = g**2 / (h + L2) + (G - g) ** 2 / (H - h + L2) - G**2 / (H + L2)
            gain[(c < LEAST_LEAF) | (C - c < LEAST_LEAF)] = 0
            for f, cut in enumerate(cuts):
                gain[:, f, len(cut) :] = 0
            flat = gain.reshape(2**level, -1)
            for k in np.flatnonzero(flat.max(axis=1) > 1e-9):
                f, b = divmod(int(flat[k].argmax()), BINS)
                feature[t, 2**level - 1 + k], threshold[t, 2**level - 1 + k] = f, cuts[f][b]
            node = 2 * node + 1 + (x[np.arange(rows), feature[t, node]] > threshold[t, node])
        at = node - inner
        leaf[t] = -rate * np.bincount(at, grad, minlength=2**depth) / (np.bincount(at, hess, minlength=2**depth) + L2)
        raw += leaf[t, at]
    return Forest(base, feature, threshold, leaf)


def probabilities(forest: Forest, x: np.ndarray) -> np.ndarray:
    """All rows go down all trees together."""
    rows, trees = np.arange(len(x))[:, None], np.arange(len(forest.leaf))[None, :]
    node = np.zeros((len(x), len(forest.leaf)), np.int64)
    inner = forest.feature.shape[1] if forest.feature.size else 0
    while inner and len(x) and node[0, 0] < inner:
        node = 2 * node + 1 + (x[rows, forest.feature[trees, node]] > forest.threshold[trees, node])
    raw = forest.base + (forest.leaf[trees, node - inner].sum(axis=1, dtype=np.float64) if inner else 0)
    return 1 / (1 + np.exp(-raw * np.ones(len(x))))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Forest:
    """A forest fitted to at most `sample_rows` labelled documents, those whose ids have the smallest hashes.

    Null ids and labels teach nothing; a document with several labels has their mean, rounded, and an id with
    several texts teaches once, by the smallest of them. Only the sampled ids are broadcast and only the
    statistics of their texts, one row for each, reach the driver. Without both classes the forest is a constant.
    """
    sample = (
        labels.select(F.col(doc_id).alias("id"), F.col(label).cast("double").alias("y"))
        .where("id is not null and y is not null")
        .groupBy("id")
        .agg(F.round(F.avg("y")).alias("y"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(sample_rows)
    )
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(sample), "id").groupBy("id").agg(F.min("text").alias("text"), F.first("y").alias("y")).select("text", "y")
    made = with_arrays(rows, [T.StructField("x", T.ArrayType(T.FloatType()))], lambda b: [pa.array(list(statistics(b.column("text"))), pa.list_(pa.float32()))]).select("x", "y").toArrow()
    if made.num_rows == 0:
        return boost(np.zeros((0, len(FEATURES)), np.float32), np.zeros(0))
    x = np.stack(made["x"].to_numpy(zero_copy_only=False)).astype(np.float32)
    y = made["y"].to_numpy(zero_copy_only=False).astype(np.float64)
    order = np.lexsort((*x.T, y))  # the same forest however Spark returns the rows
    return boost(x[order], y[order])


def classify(df: DataFrame, forest: Forest, text: str = "text", out: str = "score") -> DataFrame:
    """`df` with the column `out`, the probability of label 1; null and empty texts have one as well.

    A column of this name is replaced; rows stay one for one.
    """
    shared = SparkSession.active().sparkContext.broadcast(forest)
    return with_arrays(df, [T.StructField(out, T.DoubleType())], lambda b: [pa.array(probabilities(shared.value, statistics(b.column(text))))])


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    forest = fit(docs, labels.where(~fold("doc_id", 5, 0)))
    scored = classify(docs.withColumn("held_out", fold("doc_id", 5, 0)), forest)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
