"""Benchmark decontamination by spaced-seed hashing.

Words are compared without case and ASCII punctuation. Fixed masks over a few successive words ignore
some of the positions, so that words replaced in a passage leave other masks' hashes as they were. Hashes
that a text shares with a benchmark item give alignments of the two; each is verified word by word over
the whole item.

An item leaks into a text if, in one alignment, a segment has at least 10 equal words (all of a shorter
item's) that make up 4 of 5 words or more of it. An item of fewer than five words leaks only into a text
that consists of just these words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as tx
from .arrow import with_arrays

#: Any 10 words in 10, 11 or 12 places have, for one of these masks, a place where all its words are equal.
MASKS = ((0, 1, 2, 3, 4), (0, 1, 2, 3, 5), (0, 1, 2, 4, 5))
LEAST_WORDS = 10
BLOCK_WORDS = 2_000_000
FILTER_BITS = 22

_KEPT = np.ones(256, bool)
_KEPT[:128] = [chr(c).isalnum() or bool(tx.IS_SPACE[c]) for c in range(128)]


def normal_words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words without case and ASCII punctuation, and each text's first word."""
    kept = _KEPT[data]
    return tx.word_hashes(data[kept], np.concatenate([[0], np.cumsum(kept)])[off])


def _masked(words: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    n = len(words) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for o in mask:
        total = total * tx.STEP + words[o : o + n]
    return tx.mix(total)


class Seeds:
    """The masked hashes of a block of benchmark items, sorted, with the places that they stand for."""

    def __init__(self, item_ids: list, column: pa.Array) -> None:
        data, off = tx.buffers(column)
        self.ids = item_ids
        self.words, self.first = normal_words(data, off)
        size = np.diff(self.first)
        item = np.repeat(np.arange(len(size)), size)
        self.table = []
        for mask in MASKS:
            hashes = _masked(self.words, mask)
            whole = np.flatnonzero(item[: len(hashes)] == item[mask[-1] :]) if len(hashes) else np.zeros(0, np.int64)
            order = np.argsort(hashes[whole], kind="stable")
            keys, place = hashes[whole][order], whole[order]
            maybe = np.zeros(1 << FILTER_BITS, bool)
            maybe[(keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
            self.table.append((mask, keys, place, maybe))
        self.item = item
        self.short = {}
        for k in np.flatnonzero((size > 0) & (size < len(MASKS[0]))):
            self.short.setdefault(self.words[self.first[k] : self.first[k + 1]].tobytes(), []).append(int(k))


def best_segments(equal: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(alignment, equal words, start, end): in each, the segment with the most equal words, 4 in 5 of it or more.

    `equal` lists the places with equal words in order, alignment after alignment; `of` says of which each one is. Of
    equally good segments the first counts. Alignments without equal words are left out.
    """
    if not len(equal):
        return equal, equal, equal, equal
    first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(of))))
    # a segment from the i-th to the j-th place is good if slack[i] <= slack[j] + 1
    slack = 5 * np.arange(len(equal)) - 4 * equal
    apart = group * (2 * int(np.abs(slack).max()) + 4)  # so that a search stays within its alignment
    lowest = np.minimum.accumulate(slack - apart)
    begin = np.searchsorted(-lowest, apart - slack - 1)
    count = np.arange(len(equal)) - begin + 1
    best = np.maximum.reduceat(count * len(equal) - np.arange(len(equal)), first)
    at = -best % len(equal)
    return of[first], count[at], equal[begin[at]], equal[at] + 1


#: Words of alignments that are compared at once.
COMPARED_AT_ONCE = 2_000_000


def leaks_of(seeds: Seeds, data: np.ndarray, off: np.ndarray) -> dict[int, list[tuple]]:
    """By text: (item id, equal words, words of the segment, its first word in the text) of each leaked item."""
    words, first = normal_words(data, off)
    size = np.diff(first)
    text = np.repeat(np.arange(len(size)), size)
    pairs = []
    for mask, keys, place, maybe in seeds.table:
        hashes = _masked(words, mask)
        if not len(hashes) or not len(keys):
            continue
        at = np.flatnonzero(maybe[(hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] & (text[: len(hashes)] == text[mask[-1] :]))
        low, high = np.searchsorted(keys, hashes[at], "left"), np.searchsorted(keys, hashes[at], "right")
        n = high - low
        own = np.repeat(at, n)
        other = place[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        pairs.append(np.stack([text[own], seeds.item[other], own - other], axis=1))
    found: dict[tuple[int, int], tuple] = {}
    hits = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 3), np.int64)
    begin = np.maximum(seeds.first[hits[:, 1]], first[hits[:, 0]] - hits[:, 2])
    length = np.minimum(seeds.first[hits[:, 1] + 1], first[hits[:, 0] + 1] - hits[:, 2]) - begin
    done = np.cumsum(length)
    a = 0
    while a < len(hits):
        b = max(a + 1, int(np.searchsorted(done, done[a] - length[a] + COMPARED_AT_ONCE, "right")))
        of = np.repeat(np.arange(a, b), length[a:b])
        place = begin[of] + np.arange(len(of)) - np.repeat(np.cumsum(length[a:b]) - length[a:b], length[a:b])
        same = seeds.words[place] == words[place + hits[of, 2]]
        row, count, start, end = best_segments(place[same], of[same])
        d, k, shift = hits[row].T
        leaks = np.flatnonzero(count >= np.minimum(LEAST_WORDS, seeds.first[k + 1] - seeds.first[k]))
        for d, k, n, s, e, at in zip(*(x[leaks].tolist() for x in (d, k, count, start, end, start + shift - first[d])), strict=True):
            if (d, k) not in found or n > found[d, k][1]:
                found[d, k] = (seeds.ids[k], n, e - s, at)
        a = b
    for d in np.flatnonzero((size > 0) & (size < len(MASKS[0]))) if seeds.short else []:
        for k in seeds.short.get(words[first[d] : first[d + 1]].tobytes(), []):
            found[int(d), k] = (seeds.ids[k], int(size[d]), int(size[d]), 0)
    out: dict[int, list[tuple]] = {}
    for (d, _), leak in sorted(found.items()):
        out.setdefault(d, []).append(leak)
    return out


def leak_type(item_id: T.DataType) -> T.StructType:
    """What a leak is, for item ids of this type."""
    return T.StructType([T.StructField("item_id", item_id), *(T.StructField(n, T.LongType()) for n in ("equal_words", "segment_words", "first_word"))])


def find_leaks(df: DataFrame, benchmark: DataFrame, text: str = "text", out: str = "leaks", item_id: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """`df` with `out`: the benchmark items that leak into each text, array of leak_type by item; often empty.

    Null and empty texts and items leak nothing; item ids are of any type; one that repeats is an item each
    time; a null item id is reported as null. Of several alignments of one item the one with the most equal words
    counts. A column called `out` is replaced; rows stay one for one.

    The items are broadcast in blocks of about `block_words` words, one pass over the texts for each
    block, so memory stays bounded however large the benchmark is.
    """
    items = benchmark.select(F.col(item_id).alias("item_id"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    words = items.agg(F.sum(F.size(F.split("text", r"\s+"))).alias("n")).first()["n"] or 0
    blocks = max(1, -(-int(words) // block_words))
    leak = leak_type(items.schema["item_id"].dataType)
    fields = [T.StructField(out, T.ArrayType(leak))]
    df = df.select(*[c for c in df.columns if c.lower() != out.lower()], F.array().cast(fields[0].dataType).alias(out))
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).toArrow().sort_by([("item_id", "ascending"), ("text", "ascending")])
        kind = pa.list_(pa.struct([(leak.names[0], block.schema.field("item_id").type), *((n, pa.int64()) for n in leak.names[1:])]))
        shared = SparkSession.active().sparkContext.broadcast(Seeds(block["item_id"].to_pylist(), block["text"].combine_chunks()))

        def compute(batch: pa.RecordBatch, shared=shared, kind=kind) -> list:
            data, off = tx.buffers(batch.column(text))
            rows = batch.column(out).to_pylist()
            for i, j in tx.slices(off):
                for d, leaks in leaks_of(shared.value, data[off[i] : off[j]], off[i : j + 1] - off[i]).items():
                    rows[i + d] = (rows[i + d] or []) + [dict(zip(leak.names, x, strict=True)) for x in leaks]
            return [pa.array(rows, kind)]

        df = with_arrays(df, fields, compute)
    return df


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item that leaks into it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")
