"""Token ids in binary files, found by document key through minimal perfect hash indexes.

A folder of ids has

* `ids/*.bin`: shards of raw little-endian ids, one document after the other in ascending order of ids, each with
  an end id; two bytes an id where the vocabulary allows it, else four;
* `index/*.mph`: for each bucket of keys a minimal perfect hash function and, at the place that it gives a key, a
  fingerprint of the key, the shard, the first id's place in it and the number of ids;
* `shards`, `buckets`, `documents`: Parquet tables of the files and of what was written, by Spark;
* `manifest.json`, which is written last: a folder without it isn't whole.

A key is a document's id and the number of the copy, 0 except where documents share an id. The function is a
cascade of bit arrays: a key that no other one meets in the first array sets its bit there, the others go on to the
next, smaller one; the number of set bits before its own is a key's place. A look-up takes a few steps whatever the
number of keys, and keys that were never written are told by their fingerprints.

Tasks name their files by a random number, and the tables name those of tasks that succeeded. So a task that
is lost and run again leaves files that nothing refers to, never half a shard. Ids are written and read through
pyarrow's file systems: the folder is on a disk that is mounted everywhere or in an object store.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import text as tx
from .arrow import mapped
from .shared import folder as shared_folder
from .shared import saved, small

MODEL = "/opt/tokenizers/word_bpe_49k.json"
END_ID = 1
SHARD_IDS = 64 << 20
BUCKET_KEYS = 100_000  # about so many keys share an index file, but there are LEAST_BUCKETS
LEAST_BUCKETS = 16
READ_BYTES = 4 << 20

# --- files -------------------------------------------------------------------------------------------------------


def opened(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder, given as a path or URI, and its path there."""
    if re.match(r"[a-z0-9]+:", folder):
        return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder))
    return pafs.LocalFileSystem(), folder


# --- encoding ----------------------------------------------------------------------------------------------------

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0D]] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in ".,;:!?"]] = True
_PLAIN_END = np.zeros(256, bool)
_PLAIN_END[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True
_ODD = np.zeros(256, bool)
_ODD[[ord("<"), *range(0xC4, 256)]] = True


def chunks(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, starts of chunks): pieces of texts that the tokenizer encodes alike alone and in place.

    It drops blanks, and no token goes over one or from a letter or digit to a mark, so texts are cut behind blanks
    and before the marks that end a word. A-Z become a-z, as it does itself. Both only in words of ASCII and U+0080 to
    U+00FF without '<': others might hold combining marks or the name of a special token.
    """
    n = len(data)
    blank = _BLANK[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    begins = ~blank
    begins[1:] &= blank[:-1] | edge[1:-1]
    ends = ~blank
    ends[:-1] &= blank[1:] | edge[1:-1]
    start, last = np.flatnonzero(begins), np.flatnonzero(ends)
    if not len(start):
        return data, start
    odd_at = np.flatnonzero(_ODD[data])
    odd = np.searchsorted(odd_at, start) < np.searchsorted(odd_at, last, "right")
    low = tx.LOWER[data]
    for k in np.flatnonzero(odd).tolist():
        low[start[k] : last[k] + 1] = data[start[k] : last[k] + 1]
    other = np.maximum.accumulate(np.where(_MARK[data], -1, np.arange(n)))[last]  # the last sign that is no such mark
    inside = (other >= start) & (other < last) & ~odd
    latin = (data[other - 1] == 0xC3) & (data[other] >= 0x80) & (data[other] != 0x97) & (data[other] != 0xB7)
    marks = other[inside & (_PLAIN_END[data[other]] | (latin & (other > start)))] + 1
    return low, np.sort(np.concatenate([start, marks]))


#: Lower-case letters up to U+00FF: such a word is one piece to the tokenizer, which only has to merge its bytes.
_WORD = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
#: Byte-level models write a byte that shows nothing as a sign from U+0100 on, in order.
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_SIGNS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}


# How a tokenizer reads texts for which `chunks` and the way of single words hold.
_READS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


class Encoder:
    """A tokenizer with the ids of chunks that it has seen; equal texts are encoded once, and so are most words.

    Tokenizers that read texts in another way get whole texts.
    """

    MOST = 1_000_000

    def __init__(self, model: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(model)
        self.model = self.tokenizer.model
        told = json.loads(self.tokenizer.to_str())
        self.by_chunks = all(told[k] == v for k, v in _READS.items()) and all(x["content"][0] == "<" and not re.search(r"\s", x["content"]) for x in told["added_tokens"])
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _learn(self, new: list[bytes]) -> None:
        bare = [x.rstrip(b" \t\n\r") for x in new]
        simple = [_WORD.fullmatch(x) is not None for x in bare]
        others = iter(self.tokenizer.encode_batch_fast([x.decode() for x, y in zip(new, simple, strict=True) if not y], add_special_tokens=False))
        ids = [[t.id for t in self.model.tokenize(x.decode("latin-1").translate(_BYTE_SIGNS))] if y else next(others).ids for x, y in zip(bare, simple, strict=True)]
        sizes = np.array([len(x) for x in ids], np.int64)
        total, k = int(sizes.sum()), len(self.known)
        while self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while k + len(new) > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        self.pool[self.used : self.used + total] = [i for x in ids for i in x]
        self.start[k : k + len(new)] = self.used + np.cumsum(sizes) - sizes
        self.size[k : k + len(new)] = sizes
        self.used += total
        self.known.update((x, k + i) for i, x in enumerate(new))

    def encode(self, data: np.ndarray, off: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, an end id after each, and how many each has."""
        if not self.by_chunks:
            raw = data.tobytes()
            found = self.tokenizer.encode_batch_fast([raw[a:b].decode() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], add_special_tokens=False)
            ids = [[*e.ids, end_id] for e in found]
            return np.array([i for x in ids for i in x], np.uint32), np.array([len(x) for x in ids], np.int64)
        if len(self.known) > self.MOST:
            self.clear()
        low, start = chunks(data, off)
        bounds = np.append(start, len(low)).astype(np.int64)
        column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(low))]).dictionary_encode()
        distinct = column.dictionary.to_pylist()
        if new := [x for x in distinct if x not in self.known]:
            self._learn(new)
        slot = np.array([self.known[x] for x in distinct], np.int64)[column.indices.to_numpy()]
        size = self.size[slot]
        texts = len(off) - 1
        doc = np.searchsorted(off, start, "right") - 1
        counts = np.bincount(doc, weights=size, minlength=texts).astype(np.int64)
        total = int(size.sum())
        flat = self.pool[np.repeat(self.start[slot] - (np.cumsum(size) - size), size) + np.arange(total)]
        out = np.full(total + texts, end_id, np.uint32)
        out[np.arange(total) + np.repeat(np.arange(texts), counts)] = flat
        return out, counts + 1


_encoders: dict[str, Encoder] = {}


def encoder(model: str) -> Encoder:
    """The encoder of this worker, which is kept from task to task."""
    if model not in _encoders:
        _encoders.clear()
        _encoders[model] = Encoder(model)
    return _encoders[model]


def id_type(model: str, end_id: int) -> str:
    from tokenizers import Tokenizer

    return "<u2" if max(Tokenizer.from_file(model).get_vocab_size() - 1, end_id) < 1 << 16 else "<u4"


# --- minimal perfect hashing -------------------------------------------------------------------------------------

U64 = np.uint64
MAGIC = b"MPHIDX01"
_PARTS = (("fingerprint", np.uint32), ("shard", np.uint32), ("n_tokens", np.uint32), ("offset", np.uint64))
BITS_PER_KEY = 2
MOST_LEVELS = 64  # each leaves less than half of its keys, so that no more are needed for 2**32 keys


def key_text(doc_id: object, copy: int) -> str:
    """What is hashed of a key; `_key_column` is the same in Spark."""
    return f"{'~' if doc_id is None else f'={doc_id}'}\n{copy}"


def _key_column(doc_id: str, copy: str):
    return F.concat(F.coalesce(F.concat(F.lit("="), F.col(doc_id).cast("string")), F.lit("~")), F.lit("\n"), F.col(copy).cast("string"))


def _halves(digests: pa.Array) -> np.ndarray:
    """16-byte digests as rows of two 64-bit numbers."""
    return np.frombuffer(b"".join(digests.to_pylist()), "<u8").reshape(-1, 2)


def _place(halves: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (tx.mix(halves[:, 0] + tx.mix(halves[:, 1] + U64(level))) % U64(size)).astype(np.int64)


def _fingerprints(halves: np.ndarray) -> np.ndarray:
    return (halves[:, 1] >> U64(32)).astype(np.uint32)


def build_index(halves: np.ndarray, shard: np.ndarray, offset: np.ndarray, n_tokens: np.ndarray) -> bytes:
    """The index file of distinct keys."""
    rest, sizes, arrays = np.arange(len(halves)), [], []
    while len(rest):
        if len(sizes) == MOST_LEVELS:
            raise ValueError(f"{len(rest)} keys can't be told apart: they are not distinct")
        size = -(-max(BITS_PER_KEY * len(rest), 64) // 64) * 64
        at = _place(halves[rest], len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        arrays.append(np.packbits(alone, bitorder="little"))
        rest = rest[~alone[at]]
    bits = np.concatenate([*arrays, np.zeros(0, np.uint8)]).view(np.uint64)
    ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(bits).astype(np.int64))])[:-1].astype(np.uint32)
    index = Index(sizes, bits, ranks, {})
    order = np.empty(len(halves), np.int64)
    order[index.places(halves)] = np.arange(len(halves))
    values = {"fingerprint": _fingerprints(halves), "shard": shard, "n_tokens": n_tokens, "offset": offset}
    head = np.array([len(halves), len(sizes), *sizes], np.uint64)
    blocks = [MAGIC, head.tobytes(), bits.tobytes(), ranks.tobytes(), *(values[name][order].astype(kind).tobytes() for name, kind in _PARTS)]
    return b"".join(b + bytes(-len(b) % 8) for b in blocks)


class Index:
    """A minimal perfect hash function and what it leads to."""

    def __init__(self, sizes: list[int], bits: np.ndarray, ranks: np.ndarray, values: dict[str, np.ndarray]) -> None:
        self.sizes, self.bits, self.ranks, self.values = sizes, bits, ranks, values

    @classmethod
    def from_bytes(cls, data: bytes) -> Index:
        if data[:8] != MAGIC:
            raise ValueError("not an index file")
        at = 8

        def take(count: int, kind: type) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(data, kind, count, at)
            at += -(-found.nbytes // 8) * 8
            return found

        n, levels = take(2, np.uint64).tolist()
        sizes = take(levels, np.uint64).astype(np.int64).tolist()
        bits = take(sum(sizes) // 64, np.uint64)
        ranks = take(len(bits), np.uint32)
        return cls(sizes, bits, ranks, {name: take(n, kind) for name, kind in _PARTS})

    def places(self, halves: np.ndarray) -> np.ndarray:
        """The place of each key, 0 to n - 1; that of a key without an index is any, or -1."""
        found = np.full(len(halves), -1, np.int64)
        rest, before = np.arange(len(halves)), 0
        for level, size in enumerate(self.sizes):
            if not len(rest):
                break
            at = _place(halves[rest], level, size) + before
            word, bit = self.bits[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & U64(1) == 1
            rank = self.ranks[at >> 6] + np.bitwise_count(word & ((U64(1) << bit) - U64(1)))
            found[rest[hit]] = rank[hit]
            rest, before = rest[~hit], before + size
        return found

    def find(self, halves: np.ndarray) -> np.ndarray:
        """The place of each key, -1 for keys that aren't in the index."""
        place = self.places(halves)
        if not len(self.values["fingerprint"]):
            return place
        return np.where((place >= 0) & (self.values["fingerprint"][place] == _fingerprints(halves)), place, -1)


def bucket_of(digest: bytes, buckets: int) -> int:
    return int.from_bytes(digest[:4], "big") % buckets


def _with_bucket(keys: DataFrame, buckets: int) -> DataFrame:
    """`keys` (doc_id, copy, ..) with the digest and the bucket of each."""
    hexed = F.md5(_key_column("doc_id", "copy").cast("binary"))
    return keys.withColumn("_hex", hexed).withColumn("digest", F.unhex("_hex")).withColumn("bucket", (F.conv(F.substring("_hex", 1, 8), 16, 10).cast("bigint") % buckets).cast("int")).drop("_hex")


# --- writing -----------------------------------------------------------------------------------------------------

WRITTEN = "part int, seq int, file string, doc_id {0}, run bigint, offset bigint, n_tokens bigint"


def _write_shards(folder: str, model: str, end_id: int, kind: str, shard_ids: int):
    """Writes a partition's documents to shards, and lists them; `run` counts those of one id within the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = opened(folder)
        part, own = TaskContext.get().partitionId(), encoder(model)
        out, name, seq, offset, last, times = None, "", -1, 0, object(), 0
        try:
            for batch in batches:
                data, off = tx.buffers(batch.column("text"))
                doc_ids = batch.column("doc_id").to_pylist()
                for i, j in tx.slices(off, 1 << 21):
                    ids, counts = own.encode(data[off[i] : off[j]], off[i : j + 1] - off[i], end_id)
                    if out is None or offset >= shard_ids:
                        if out is not None:
                            out.close()
                        seq, offset, name = seq + 1, 0, f"{part:06d}-{seq + 1:04d}-{uuid.uuid4().hex}.bin"
                        out = fs.open_output_stream(f"{path}/ids/{name}")
                    out.write(ids.astype(kind).tobytes())
                    runs = []
                    for x in doc_ids[i:j]:
                        times = times + 1 if x == last or (x != x and last != last) else 0  # NaN is one id
                        last = x
                        runs.append(times)
                    starts = offset + np.cumsum(counts) - counts
                    offset += int(counts.sum())
                    n = j - i
                    columns = [pa.array([part] * n, pa.int32()), pa.array([seq] * n, pa.int32()), pa.array([name] * n), batch.column("doc_id").slice(i, n), pa.array(runs, pa.int64()), pa.array(starts), pa.array(counts)]
                    yield pa.RecordBatch.from_arrays(columns, ["part", "seq", "file", "doc_id", "run", "offset", "n_tokens"])
        finally:
            if out is not None:
                out.close()

    return run


def _shards(written: DataFrame) -> DataFrame:
    """(part, seq, file, documents, ids, shard, start, first_id, copies_before): a row for each shard, in their order.

    `start` is the number of ids before it. `copies_before` is how many documents with the id that its partition
    starts with stand before that partition, where many of one id go over several partitions.
    """
    order = lambda: F.struct(F.col("doc_id").isNotNull(), "doc_id", "run")
    parts = written.groupBy("part").agg(F.min_by("doc_id", order()).alias("first_id"), F.max_by(F.struct("doc_id", "run"), order()).alias("last"))
    by = Window.orderBy("part")
    fresh = ~F.col("first_id").eqNullSafe(F.col("last.doc_id")) | ~F.col("goes_on")  # its last id starts in it
    parts = parts.withColumn("goes_on", F.coalesce(F.col("first_id").eqNullSafe(F.lag("last.doc_id").over(by)) & F.lag("part").over(by).isNotNull(), F.lit(False)))
    parts = parts.withColumn("sum", F.sum(F.col("last.run") + 1).over(by)).withColumn("base", F.max(F.when(fresh, F.col("sum") - F.col("last.run") - 1)).over(by))
    before = F.when(F.col("goes_on"), F.lag(F.col("sum") - F.col("base")).over(by)).otherwise(0)
    parts = parts.select("part", "first_id", before.alias("copies_before"))
    shards = written.groupBy("part", "seq", "file").agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("ids")).join(parts, "part")
    place = Window.orderBy("part", "seq")
    return shards.withColumn("shard", F.row_number().over(place) - 1).withColumn("start", F.sum("ids").over(place) - F.col("ids"))


def _write_index(folder: str):
    def build(table: pa.Table) -> pa.Table:
        fs, path = opened(folder)
        bucket, name = table.column("bucket")[0].as_py(), f"{uuid.uuid4().hex}.mph"
        numbers = (table.column(c).to_numpy() for c in ("shard", "offset", "n_tokens"))
        with fs.open_output_stream(f"{path}/index/{name}") as out:
            out.write(build_index(_halves(table.column("digest").combine_chunks()), *numbers))
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "file": [name], "keys": pa.array([table.num_rows], pa.int64())})

    return build


def write_ids(df: DataFrame, folder: str | None = None, doc_id: str = "doc_id", text: str = "text", model: str = MODEL, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> str:
    """Encodes all texts and writes them to `folder`, by default a new one in the shared folder; gives the folder.

    Documents go by ascending id, null ids first; those of one id as the input gives them, with copy numbers 0, 1, ..
    A null, empty or blank text has the end id alone. Other columns are left out. Ids are split into ranges that
    are cut between documents of one id as well, and a partition starts a new shard after `shard_ids` ids.
    """
    spark = df.sparkSession
    folder = folder or f"{shared_folder(spark)}/docloom/{uuid.uuid4().hex}"
    fs, path = opened(folder)
    for part in ("ids", "index"):
        fs.create_dir(f"{path}/{part}", recursive=True)
    kind = id_type(model, end_id)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("_at", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(parts, "doc_id", "_at").sortWithinPartitions("doc_id", "_at").drop("_at")
    written = saved(mapped(rows, _write_shards(folder, model, end_id, kind, shard_ids), WRITTEN.format(rows.schema["doc_id"].dataType.simpleString())))
    shards = saved(_shards(written))
    copy = F.col("run") + F.when(F.col("doc_id").eqNullSafe(F.col("first_id")), F.col("copies_before")).otherwise(0)
    keys = written.join(small(shards.select("file", "shard", "first_id", "copies_before")), "file").select("doc_id", copy.alias("copy"), "shard", "offset", "n_tokens")
    keys.write.parquet(f"{folder}/documents")
    shards.select("shard", "file", "documents", "ids", "start").coalesce(1).write.parquet(f"{folder}/shards")
    keys = spark.read.schema(keys.schema).parquet(f"{folder}/documents")
    documents = keys.count()
    buckets = max(LEAST_BUCKETS, -(-documents // BUCKET_KEYS))
    index = _with_bucket(keys, buckets).groupBy("bucket").applyInArrow(_write_index(folder), "bucket int, file string, keys bigint")
    index.write.parquet(f"{folder}/buckets")
    manifest = {"format": 1, "ids": kind, "end_id": end_id, "buckets": buckets, "documents": documents, "model": os.path.basename(model)}
    with fs.open_output_stream(f"{path}/manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    return folder


# --- reading -----------------------------------------------------------------------------------------------------


class IdFiles:
    """Keyed access to a folder of ids without Spark, for a data loader."""

    def __init__(self, folder: str) -> None:
        self.fs, self.path = opened(folder)
        self.manifest = json.loads(self._whole("manifest.json"))
        files = lambda t, k: {r[k]: r["file"] for r in pq.read_table(f"{self.path}/{t}", filesystem=self.fs).to_pylist()}
        self.shards, self.buckets = files("shards", "shard"), files("buckets", "bucket")
        self.indexes: dict[int, Index] = {}
        self.open: dict[int, pa.NativeFile] = {}

    def _whole(self, name: str) -> bytes:
        with self.fs.open_input_file(f"{self.path}/{name}") as f:
            return f.read()

    def get(self, doc_id: object, copy: int = 0) -> np.ndarray | None:
        """The ids of a document with its end id; None if it isn't there. An id may also be given as Spark writes it as text."""
        digest = hashlib.md5(key_text(doc_id, copy).encode()).digest()
        bucket = bucket_of(digest, self.manifest["buckets"])
        if bucket not in self.buckets:
            return None
        if bucket not in self.indexes:
            self.indexes[bucket] = Index.from_bytes(self._whole(f"index/{self.buckets[bucket]}"))
        index = self.indexes[bucket]
        place = int(index.find(np.frombuffer(digest, "<u8").reshape(1, 2))[0])
        if place < 0:
            return None
        shard, offset, n = (int(index.values[c][place]) for c in ("shard", "offset", "n_tokens"))
        if shard not in self.open:
            self.open[shard] = self.fs.open_input_file(f"{self.path}/ids/{self.shards[shard]}")
        kind = np.dtype(self.manifest["ids"])
        return np.frombuffer(self.open[shard].read_at(n * kind.itemsize, offset * kind.itemsize), kind)


def _runs(values: list) -> Iterator[tuple[int, int]]:
    """Bounds of the runs of equal values."""
    i = 0
    for j in range(1, len(values) + 1):
        if j == len(values) or values[j] != values[i]:
            yield i, j
            i = j


def _look_up(folder: str):
    """From keys sorted by bucket: the shard, offset and number of ids of those that an index has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = opened(folder)
        held, index = None, None
        for batch in batches:
            names = batch.column("file").to_pylist()
            for i, j in _runs(names):
                if names[i] != held:
                    with fs.open_input_file(f"{path}/index/{names[i]}") as f:
                        held, index = names[i], Index.from_bytes(f.read())
                own = batch.slice(i, j - i)
                place = index.find(_halves(own.column("digest")))
                rows = pa.array(np.flatnonzero(place >= 0))
                values = [pa.array(index.values[c][place[place >= 0]].astype(np.int64)) for c in ("shard", "offset", "n_tokens")]
                yield pa.RecordBatch.from_arrays([own.column("doc_id").take(rows), own.column("copy").take(rows), *values], ["doc_id", "copy", "shard", "offset", "n_tokens"])

    return run


def _read(folder: str, kind: str):
    """From rows sorted by shard and offset: their ids, neighbouring ones by one read of READ_BYTES or one document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = opened(folder)
        width = np.dtype(kind).itemsize
        for batch in batches:
            names = batch.column("file").to_pylist()
            for i, j in _runs(names):
                first = batch.column("offset").to_numpy()[i:j]
                last = first + batch.column("n_tokens").to_numpy()[i:j]
                with fs.open_input_file(f"{path}/ids/{names[i]}") as f:
                    a = 0
                    while a < len(first):
                        b = a + 1
                        while b < len(first) and first[b] <= last[b - 1] and (last[b] - first[a]) * width <= READ_BYTES:
                            b += 1
                        ids = np.frombuffer(f.read_at(int(last[b - 1] - first[a]) * width, int(first[a]) * width), kind).astype("<u4")
                        raw = [ids[x : x + n].tobytes() for x, n in zip((first[a:b] - first[a]).tolist(), (last[a:b] - first[a:b]).tolist(), strict=True)]
                        own = batch.slice(i + a, b - a)
                        yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("copy"), own.column("start"), own.column("n_tokens"), pa.array(raw, pa.binary())], ["doc_id", "copy", "start", "n_tokens", "ids"])
                        a = b

    return run


def read_ids(keys: DataFrame, folder: str) -> DataFrame:
    """(doc_id, copy, start, n_tokens, ids) for each of `keys` (doc_id, copy) that was written to `folder`.

    `ids` are little-endian 32-bit numbers, the end id last; `start` is the number of ids of all documents before.
    Keys are looked up in the index of their bucket, then read shard by shard. Rows of `keys` that repeat are read
    each; a key that wasn't written has no row.
    """
    spark = keys.sparkSession
    fs, path = opened(folder)
    with fs.open_input_file(f"{path}/manifest.json") as f:
        manifest = json.loads(f.read())
    kind = keys.schema["doc_id"].dataType.simpleString()
    buckets, shards = spark.read.parquet(f"{folder}/buckets").select("bucket", "file"), spark.read.parquet(f"{folder}/shards").select("shard", "file", F.col("start").alias("_before"))
    asked = _with_bucket(keys.select("doc_id", "copy"), manifest["buckets"]).join(small(buckets), "bucket")
    asked = asked.repartition("bucket").sortWithinPartitions("bucket").select("doc_id", "copy", "digest", "file")
    found = mapped(asked, _look_up(folder), f"doc_id {kind}, copy bigint, shard bigint, offset bigint, n_tokens bigint")
    placed = found.join(small(shards), "shard").withColumn("start", F.col("_before") + F.col("offset"))
    placed = placed.repartition("shard").sortWithinPartitions("shard", "offset")
    return mapped(placed.select("doc_id", "copy", "start", "n_tokens", "offset", "file"), _read(folder, manifest["ids"]), f"doc_id {kind}, copy bigint, start bigint, n_tokens bigint, ids binary")


def written_keys(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, copy) of all documents in a folder of ids."""
    return spark.read.parquet(f"{folder}/documents").select("doc_id", "copy")


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return read_ids(written_keys(spark, folder), folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
