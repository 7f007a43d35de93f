"""Suffix-array dedup: removal of long byte strings that occur elsewhere, by bucket-pointer refinement.

Suffixes are bucketed by their first q bytes, and a bucket is refined by the identifiers of what stands
at later offsets until its members differ or the match is long enough; a bucket of one is done. Three
things make this a Spark job of bounded size.

* Only some suffixes are bucketed. Each window of `LENGTH` bytes has one anchor, the q-gram with the
  smallest hash in it (the leftmost of equals). Equal windows have equal anchors at the same offset, so
  the buckets of anchors, about 1 in 85 suffixes, hold all matches.
* The first refinement is by one identifier: that of all bytes in the windows of an anchor, before and
  after it. Anchors equal in that too are repeats as a whole and leave the recursion with it. Of those that
  meet in one task only one travels to its bucket, so a passage in a third of all texts makes no hot key.
* Only where a bucket holds different surroundings, one member of each kind is refined further, by the
  identifiers of the windows at every offset. Crowded buckets are split before that, by what windows at
  neighbouring offsets have in common: all but a fifth of a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as tx
from .arrow import mapped, small_batches
from .shared import saved

LENGTH = 200
GRAM = 32
_AT = 26  # bits for a place in a part; the others of a key are the hash's
PART_BYTES = 4 << 20  # a longer text is anchored in parts, so that places fit and the working arrays stay small

#: A bucket with more than one in so many of the open members, and with CROWD_LEAST at least, is crowded.
CROWD_PART, CROWD_LEAST = 2000, 1000
#: Runs of offsets by which a crowded bucket is split.
SPLITS = 4

ANCHORS = "route bigint, gram bigint, around bigint, before int, weight int, settled boolean, doc_id {0}, copy int, first int, last int"
FOUND = "doc_id {0}, copy int, gram bigint, first int, last int, before int, whole boolean, open boolean"


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of so many successive values, in three passes."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, off: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, hash of the q-gram, hash of the surroundings, first and last window start, bytes before the q-gram).

    A row for each anchor of each text; window starts count from the text's first byte.
    """
    size = np.diff(off)
    if len(data) > 1 << _AT:
        raise ValueError(f"{len(data)} bytes at once; places have {_AT} bits")
    if not len(size) or size.max() < length:
        none = np.zeros(0, np.int64)
        return none, none.view(np.uint64), none.view(np.uint64), none, none, none
    grams = tx.byte_windows(data, gram)
    place = np.uint64((1 << _AT) - 1)
    keys = (grams & ~place) | np.arange(len(grams), dtype=np.uint64)
    at = (_smallest(keys, length - gram + 1) & place).astype(np.int64)
    # a window start counts if the window ends in its text
    count = np.maximum(size - length + 1, 0)
    text = np.repeat(np.arange(len(size)), count)
    inside = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    p = off[text] + inside
    a = at[p]
    new = np.ones(len(p), bool)
    new[1:] = (a[1:] != a[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(p)) - 1
    first, last, anchor, text = p[begin], p[end], a[begin], text[begin]
    around = tx.mix(tx.span_hashes(data, first, last + length) + (anchor - first).astype(np.uint64))
    return text, grams[anchor], around, first - off[text], last - off[text], anchor - first


def _parts(off: np.ndarray, length: int):
    """(i, j, start, end) for tx.slices, and for one text above PART_BYTES its parts.

    Parts overlap by length - 1 bytes, so that each window stands in one of them and in no other.
    """
    for i, j in tx.slices(off):
        a, b = int(off[i]), int(off[j])
        if j - i > 1 or b - a <= PART_BYTES:
            yield i, j, a, b
            continue
        for start in range(a, b - length + 1, PART_BYTES):
            yield i, j, start, min(start + PART_BYTES + length - 1, b)


def _find_anchors(length: int, gram: int):
    """Anchors by q-gram and surroundings.

    Of the places that a part of a batch has of an anchor, the first goes to its bucket, with their number as
    `weight`; the others are `settled` as repeats and go anywhere.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            data, off = tx.buffers(batch.column(2))
            found = []
            for i, j, start, end in _parts(off, length):
                inner = off[i : j + 1] - off[i] if end - start == off[j] - off[i] else np.array([0, end - start])
                text, grams, around, first, last, before = anchors(data[start:end], inner, length, gram)
                at = start - off[i]  # of a part in its text
                found.append((text + i, grams, around, first + at, last + at, before))
            if not found:
                continue
            text, grams, around, first, last, before = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((around, grams))
            text, grams, around, first, last, before = (x[order] for x in (text, grams, around, first, last, before))
            begin = np.concatenate([[True], (grams[1:] != grams[:-1]) | (around[1:] != around[:-1])])[: len(grams)]
            weight = np.diff(np.append(np.flatnonzero(begin), len(grams)))[np.cumsum(begin) - 1]
            route = np.where(begin, grams, tx.mix(grams + np.arange(len(grams), dtype=np.uint64) + np.uint64(1)))
            rows = pa.array(text)
            ints = lambda x: pa.array(x.astype(np.int32))
            columns = [pa.array(route.view(np.int64)), pa.array(grams.view(np.int64)), pa.array(around.view(np.int64)), ints(before), ints(weight), pa.array(~begin), batch.column(0).take(rows), batch.column(1).take(rows), ints(first), ints(last)]
            yield pa.RecordBatch.from_arrays(columns, ["route", "gram", "around", "before", "weight", "settled", "doc_id", "copy", "first", "last"])

    return run


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Regroups batches sorted by `gram` so that no bucket is split between two."""
    held: list[pa.RecordBatch] = []  # the bucket that isn't at its end yet
    for batch in batches:
        if not batch.num_rows:
            continue
        grams = batch.column("gram").to_numpy()
        cut = int(np.searchsorted(grams, grams[-1]))
        if cut or (held and held[-1].column("gram")[-1].as_py() != int(grams[0])):
            yield pa.concat_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.concat_batches(held)


_FOUND = ["doc_id", "copy", "gram", "first", "last", "before", "whole", "open"]


def _refine_by_surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From anchors sorted by q-gram and surroundings: those of buckets with two or more members.

    `whole`: the same surroundings stand elsewhere. `open`: the bucket has others, and this is the first member with
    these. Of what is still open only the first member of the last kind is held, whatever the size of a bucket.
    """

    def rows(batch: pa.RecordBatch, whole: np.ndarray, opened: np.ndarray) -> pa.RecordBatch:
        kept = np.flatnonzero(whole | opened)
        batch = batch.take(pa.array(kept))
        return pa.RecordBatch.from_arrays([*(batch.column(n) for n in _FOUND[:6]), pa.array(whole[kept]), pa.array(opened[kept])], _FOUND)

    held: pa.RecordBatch | None = None  # one row
    weight_held, earlier = 0, False  # of its kind so far; whether its bucket has an earlier kind
    for batch in batches:
        settled = batch.column("settled").to_numpy(zero_copy_only=False)
        if settled.any():
            own = batch.filter(pa.array(settled))
            yield rows(own, np.ones(own.num_rows, bool), np.zeros(own.num_rows, bool))
            batch = batch.filter(pa.array(~settled))
        if not batch.num_rows:
            continue
        batch = batch if held is None else pa.concat_batches([held, batch])
        gram, around = batch.column("gram").to_numpy(), batch.column("around").to_numpy()
        weight = batch.column("weight").to_numpy().astype(np.int64)
        if held is not None:
            weight[0] = weight_held
        new_bucket = np.concatenate([[True], gram[1:] != gram[:-1]])
        begin = np.flatnonzero(new_bucket | np.concatenate([[True], around[1:] != around[:-1]]))
        count = np.diff(np.append(begin, len(gram)))
        total = np.add.reduceat(weight, begin)
        has_earlier = ~new_bucket[begin]
        has_earlier[0] = held is not None and earlier
        has_later = np.append(gram[begin[1:]] == gram[begin[:-1]], False)
        whole = np.repeat(total > 1, count)
        opened = np.zeros(len(gram), bool)
        opened[begin] = has_earlier | has_later
        last = begin[-1]
        whole[last], opened[last] = False, False  # it is held
        yield rows(batch, whole, opened)
        held, weight_held, earlier = batch.slice(last, 1), int(total[-1]), bool(has_earlier[-1])
    if held is not None:
        yield rows(held, np.array([weight_held > 1]), np.array([earlier]))


def _window_keys(batch: pa.RecordBatch, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in its bytes, key) of all windows of members with their bytes; equal windows of a bucket have equal keys."""
    column = batch.column("bytes").cast(pa.large_binary())
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[off[0] : off[-1]]
    off = off - off[0]
    count = np.maximum(np.diff(off) - length + 1, 0)
    row = np.repeat(np.arange(len(count)), count)
    j = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    hashes = tx.byte_windows(data, length)[off[row] + j] if len(row) else np.zeros(0, np.uint64)
    offset = (batch.column("before").to_numpy()[row] - j).astype(np.uint64)
    return row, j, tx.mix(hashes + tx.mix(batch.column("gram").to_numpy()[row].view(np.uint64) + offset))


def _refine_by_windows(length: int):
    """From open members with their bytes, sorted by q-gram: the windows that another member has as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_bucket(batches):
            row, j, keys = _window_keys(batch, length)
            whole = batch.column("whole").to_numpy(zero_copy_only=False)
            _, which = np.unique(keys, return_inverse=True)
            again = np.bincount(which, weights=1 + whole[row])[which] > 1
            again &= ~whole[row]  # the others are repeats already
            begin = again & ~np.concatenate([[False], again[:-1] & (row[1:] == row[:-1])])[: len(again)]
            end = again & ~np.concatenate([again[1:] & (row[1:] == row[:-1]), [False]])[: len(again)]
            b, e = np.flatnonzero(begin), np.flatnonzero(end)
            rows, first = pa.array(row[b]), batch.column("first").to_numpy()[row[b]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(rows), batch.column("copy").take(rows), pa.array((first + j[b]).astype(np.int32)), pa.array((first + j[e]).astype(np.int32))], ["doc_id", "copy", "first", "last"])

    return run


def _split_buckets(opened: DataFrame, length: int, gram: int) -> DataFrame:
    """Members with their bytes; those with `crowded` once for each run of offsets that their windows have, in buckets of their own.

    All windows at so many neighbouring offsets have the bytes between the last start and the first end of them in
    common. A member with one of the windows has these bytes, and members that share a window agree in them.
    """
    most = length - gram  # the greatest offset of the q-gram in a window
    step = -(-(most + 1) // SPLITS)
    anchor = F.col("first") + F.col("before")
    parts = []
    for r in range(SPLITS):
        low, high = r * step, min((r + 1) * step - 1, most)
        begin, end = F.greatest("first", anchor - high), F.least("last", anchor - low)
        common = F.substring(F.col("bytes"), anchor - low - F.col("first") + 1, F.lit(length - (high - low)))
        own = F.substring(F.col("bytes"), begin - F.col("first") + 1, end - begin + length)
        bucket = F.xxhash64("gram", F.lit(r), common)
        parts.append(F.when(begin <= end, F.struct(bucket.alias("gram"), begin.alias("first"), end.alias("last"), (anchor - begin).alias("before"), own.alias("bytes"))))
    alone = F.array(F.struct("gram", "first", "last", "before", "bytes"))
    split = opened.select("doc_id", "copy", "whole", F.explode(F.when(F.col("crowded"), F.array_compact(F.array(*parts))).otherwise(alone)).alias("x"))
    return split.select("doc_id", "copy", "x.gram", "x.first", "x.last", "x.before", "whole", "x.bytes")


def repeated_windows(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, copy, first, last): runs of starts of windows that start elsewhere too.

    `docs` has doc_id, copy and text; doc_id and copy together name a text.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = mapped(docs, _find_anchors(length, gram), ANCHORS.format(kind)).repartition("route").sortWithinPartitions("gram", "around")
    found = saved(mapped(found, _refine_by_surroundings, FOUND.format(kind)))
    buckets = found.where("open").groupBy("gram").agg(F.count("*").alias("members"))
    members = found.where("open").count()
    crowded = saved(buckets.where(F.col("members") > max(CROWD_LEAST, members / CROWD_PART)).select("gram"))  # fewer than CROWD_PART
    same = F.col("d.doc_id").eqNullSafe(F.col("o.doc_id")) & (F.col("d.copy") == F.col("o.copy"))
    body = F.substring(F.col("text").cast("binary"), F.col("first") + 1, F.col("last") - F.col("first") + length)
    opened = found.where("open").withColumn("crowded", F.lit(False))
    if crowded.count():
        opened = found.where("open").join(F.broadcast(crowded.withColumn("crowded", F.lit(True))), "gram", "left")
    with_bytes = docs.alias("d").join(opened.alias("o"), same).select("o.doc_id", "o.copy", "gram", "first", "last", "before", "whole", "crowded", body.alias("bytes"))
    opened = _split_buckets(with_bytes, length, gram)
    parts = saved(mapped(opened.repartition("gram").sortWithinPartitions("gram"), _refine_by_windows(length), f"doc_id {kind}, copy int, first int, last int"))
    return found.where("whole").select("doc_id", "copy", "first", "last").unionByName(parts)


RESULT = "doc_id {0}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"


def _remove(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = tx.buffers(batch.column("text"))
            sizes, removed, spans, kept = [], [], [], []
            for k, runs in enumerate(batch.column("runs")):
                body = data[off[k] : off[k + 1]]
                edge = np.zeros(len(body) + 1, np.int32)
                if runs.is_valid and len(runs):
                    flat = runs.values
                    first, last = flat.field("first").to_numpy(), flat.field("last").to_numpy()
                    np.add.at(edge, first, 1)
                    np.add.at(edge, last + length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                sizes.append(len(body))
                removed.append(int(gone.sum()))
                spans.append(int((gone & ~np.concatenate([[False], gone[:-1]])[: len(gone)]).sum()))
                kept.append(body[~gone].tobytes())
            ints = lambda x: pa.array(x, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ints(sizes), ints(removed), ints(spans), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def remove_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept), a row for each of `df`.

    `kept` is the text's UTF-8 without the bytes covered by strings of `length` bytes that start anywhere
    else too, in this text or another one; what is a repeat is judged on the input. Null texts are empty.
    Null ids are ids like any other; rows that repeat are repeats of each other. Texts shorter than
    `length` stay whole. Other columns are left out.
    """
    docs = df.select(F.col(doc_id).alias("doc_id"), F.hash(F.coalesce(text, F.lit(""))).alias("copy"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    runs = repeated_windows(docs, length, gram).groupBy("doc_id", "copy").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    same = F.col("d.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("d.copy") == F.col("r.copy"))
    both = docs.alias("d").join(runs.alias("r"), same, "left").select("d.doc_id", "text", "runs")
    return mapped(both, _remove(length), RESULT.format(docs.schema["doc_id"].dataType.simpleString()))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
