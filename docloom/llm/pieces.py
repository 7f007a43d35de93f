"""SentencePiece encoding and decoding by batched Viterbi in numpy.

A text is cut where no piece reaches across (before a run of blanks, around characters that no piece
has), and each distinct chunk is encoded once. Chunks of equal length advance together: at each position the hashes of all
substrings that end there are looked up among the sorted hashes of the pieces, and the best admissible
piece is kept with its backpointer. For the byte-pair models at hand the best path is that of the
model's merges, and it is found position by position: a piece may follow another exactly if merging the
two pieces' characters gives back these two pieces. Characters without a piece become bytes.

Long chunks advance as overlapping windows of one length. A backpointer depends on those of the last few
positions alone, so once a window's agree with the true ones over the length of the longest piece, all
later ones do; where they don't, as in a long run of one sign, positions follow one by one until they do.
Of a run of blanks the last one belongs to the word after it; the others, which merge last, fill the
longest blank pieces from the left.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as tx
from .arrow import with_arrays

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
CHUNK_BYTES = 1 << 20
DECODED_AT_ONCE = 1 << 19
CELLS_AT_ONCE = 500_000
#: Chunks longer than 64 characters advance in windows of so many, which overlap by this much.
WINDOW, OVERLAP = 128, 48
#: The length to which chunks of each length up to 64 are padded.
PADDED = [next(p for p in (4, 6, 8, 10, 12, 14, 16, 20, 24, 32, 48, 64) if n <= p) for n in range(65)]
BUCKET_BITS = 20
#: Chunks whose ids a Python worker remembers, in about 40 bytes each; beyond that it starts afresh.
KEPT_CHUNKS = 1_000_000
NONE = -1


def _hash_chars(chars: np.ndarray) -> np.ndarray:
    """Prefix sums of the position-weighted characters along the last axis, from 0 on."""
    n = chars.shape[-1]
    sums = np.zeros((*chars.shape[:-1], n + 1), np.uint64)
    np.cumsum(tx.mix(chars.astype(np.uint64) + np.uint64(1)) * tx.powers(tx.BASE, n), axis=-1, out=sums[..., 1:])
    return sums


@dataclass(frozen=True)
class PieceModel:
    """Ids are the model's; one more id, `unknown`, is a character without a piece."""

    path: str
    texts: list[str]  # of all ids
    byte_ids: np.ndarray  # of the 256 bytes
    keys: np.ndarray  # sorted hashes of the usable pieces
    ids: np.ndarray  # of keys
    bucket: np.ndarray  # the first key with these leading bits, or NONE
    crowd: int  # the most keys in a bucket
    alone: np.ndarray  # of the 256 bytes: ASCII characters in no piece
    length: np.ndarray  # characters, by id
    rank: np.ndarray  # when a piece is merged, by id; 0: a single character
    left: np.ndarray  # the last merge of each piece
    right: np.ndarray
    raw: np.ndarray  # hashes before mixing, by id
    longest: int
    blanks: np.ndarray  # the pieces of 1, 2, .. blanks, or NONE
    surface: np.ndarray  # bytes of all pieces, one after the other
    surface_at: np.ndarray

    @property
    def unknown(self) -> int:
        return len(self.texts)

    def find(self, raw: np.ndarray) -> np.ndarray:
        key = tx.mix(raw)
        out = np.full(len(key), NONE)
        at = self.bucket[(key >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]
        some = np.flatnonzero(at != NONE)
        at, key = at[some], key[some]
        for k in range(self.crowd):
            probe = np.minimum(at + k, len(self.keys) - 1)
            hit = self.keys[probe] == key
            out[some[hit]] = self.ids[probe[hit]]
        return out


def merge_pieces(text: str, score: dict[str, float]) -> list[str]:
    """The pieces of a text when the best-scored pair merges first, the leftmost of equals."""
    part, n = list(text), len(text)
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    heap = [(-score[p], i, p) for i in range(n - 1) if (p := part[i] + part[i + 1]) in score]
    heapq.heapify(heap)
    while heap:
        _, i, p = heapq.heappop(heap)
        j = after[i]
        if not part[i] or j < 0 or part[i] + part[j] != p:
            continue
        part[i], part[j] = p, ""
        after[i] = after[j]
        if after[i] >= 0:
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b >= 0 and (q := part[a] + part[b]) in score:
                heapq.heappush(heap, (-score[q], a, q))
    return [p for p in part if p]


def _blank_run(blanks: np.ndarray, n: int) -> list[int]:
    """The pieces of n blanks: the longest ones from the left."""
    out, size = [], len(blanks)
    while n:
        size = min(size, n)
        if blanks[size - 1] == NONE:
            size -= 1
            continue
        out += [int(blanks[size - 1])] * (n // size)
        n %= size
    return out


@lru_cache(2)
def load(path: str = MODEL) -> PieceModel:
    """Reads a byte-pair model with byte fallback; the file is only read on the driver."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    n = m.vocab_size()
    texts = [m.id_to_piece(i) for i in range(n)]
    plain = [i for i in range(n) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
    if any(BLANK in texts[i].lstrip(BLANK) for i in plain):
        raise ValueError("a piece of this model reaches across a blank")
    score = {texts[i]: m.get_score(i) for i in plain}
    # runs of blanks merge after all else and aren't in the table
    runs = {len(texts[i]): i for i in plain if not texts[i].strip(BLANK)}
    blanks = np.array([runs.get(k, NONE) for k in range(1, max(runs) + 1)])
    merged = [[len(p) for p in merge_pieces(BLANK * k, {BLANK * j: 0.0 for j in runs})] for k in range(1, 3 * len(blanks))]
    if any(BLANK * 2 in texts[i] and texts[i].strip(BLANK) for i in plain) or any(own != [len(texts[i]) for i in _blank_run(blanks, k)] for k, own in enumerate(merged, 1)):
        raise ValueError("blanks of this model don't merge into the longest pieces from the left")
    table = [i for i in plain if BLANK * 2 not in texts[i]]
    id_of = {texts[i]: i for i in table}
    in_order = sorted((i for i in table if len(texts[i]) > 1), key=lambda i: -m.get_score(i))
    rank, left, right = np.zeros(n + 1, np.int64), np.full(n + 1, NONE), np.full(n + 1, NONE)
    rank[in_order] = np.arange(1, len(in_order) + 1)
    usable = [i for i in table if len(texts[i]) == 1]
    for i in in_order:
        without = {k: v for k, v in ((p, score.get(p)) for p in _parts(texts[i])) if v is not None and k != texts[i]}
        halves = merge_pieces(texts[i], without)
        if len(halves) == 2 and all(h in id_of for h in halves):
            left[i], right[i] = id_of[halves[0]], id_of[halves[1]]
            usable.append(i)
    raw = np.zeros(n + 1, np.uint64)
    for i in usable:
        raw[i] = _hash_chars(np.array([ord(c) for c in texts[i]], np.uint32))[-1]
    keys = tx.mix(raw[usable])
    order = np.argsort(keys)
    surfaces = [bytes([int(t[3:5], 16)]) if m.is_byte(i) else b"" if m.is_control(i) else " ⁇ ".encode() if m.is_unknown(i) else t.replace(BLANK, " ").encode() for i, t in enumerate(texts)]
    byte_ids = np.full(256, m.unk_id())
    for i in range(n):
        if m.is_byte(i):
            byte_ids[int(texts[i][3:5], 16)] = i
    length = np.array([*map(len, texts), 1])
    keys = keys[order]
    slot = (keys >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    bucket = np.full(1 << BUCKET_BITS, NONE, np.int64)
    bucket[slot[::-1]] = np.arange(len(keys))[::-1]
    alone = np.zeros(256, bool)
    alone[:128] = True
    alone[[ord(c) for c in set("".join(texts[i] for i in plain)) if ord(c) < 128] + [0x20]] = False
    return PieceModel(path, texts, byte_ids, keys, np.array(usable)[order], bucket, int(np.bincount(slot).max()), alone, length, rank, left, right, raw, int(length[usable].max()), blanks, np.frombuffer(b"".join(surfaces), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in surfaces])]))


def _parts(text: str) -> set[str]:
    return {text[i:j] for i in range(len(text)) for j in range(i + 2, len(text) + 1)}


def may_follow(m: PieceModel, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the pieces b right after the pieces a stay apart.

    The merges that made the two pieces are undone, the latest first (of equals the right one). If, at
    any time, the two that touch would have merged before the merge undone last, the pair isn't stable.
    """
    ok = np.ones(len(a), bool)
    ok_rows = np.flatnonzero((a != m.unknown) & (b != m.unknown))
    x, y, row = a[ok_rows], b[ok_rows], ok_rows
    limit = np.full(len(row), np.iinfo(np.int64).max)
    while len(row):
        joined = m.find(m.raw[x] + m.raw[y] * tx.powers(tx.BASE, m.longest + 1)[m.length[x]])
        early = (joined != NONE) & (m.rank[joined] < limit)
        ok[row[early]] = False
        go = ~early & ((m.rank[x] > 0) | (m.rank[y] > 0))
        x, y, row, limit = x[go], y[go], row[go], limit[go]
        undo = m.rank[x] > m.rank[y]
        limit = np.where(undo, m.rank[x], m.rank[y] + 1)
        x, y = np.where(undo, m.right[x], x), np.where(undo, y, m.left[y])
    return ok


def best_pieces(m: PieceModel, chars: np.ndarray) -> np.ndarray:
    """The last piece on the best path to each position of rows of characters, of one length; NONE without a path."""
    n, size = chars.shape
    sums, inverse = _hash_chars(chars), tx.powers(tx.BASE_INVERSE, size + 1)
    best = np.full((n, size + 1), NONE, np.int32)
    for i in range(1, size + 1):
        for k in range(1, min(i, m.longest) + 1):
            piece = m.find((sums[:, i] - sums[:, i - k]) * inverse[i - k])
            if k == 1:
                piece[piece == NONE] = m.unknown
            can = np.flatnonzero((piece != NONE) & (best[:, i] == NONE) & ((best[:, i - k] != NONE) | (i == k)))
            if i > k and len(can):
                can = can[may_follow(m, best[can, i - k], piece[can])]
            best[can, i] = piece[can]
    return best


def viterbi(m: PieceModel, chars: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pieces, number of pieces) of chunks, rows of characters padded at the end to one length.

    The pieces stand at the end of their row, after NONE. The best path to a position depends on what
    is before it alone, so each row's path is read from its own length. A row whose number is 0 has no
    admissible path.
    """
    n, size = chars.shape
    best = best_pieces(m, chars)
    out, at, count = np.full((n, size), NONE, np.int32), sizes.copy(), np.zeros(n, np.int64)
    rows = np.flatnonzero(best[np.arange(n), sizes] != NONE)
    slot = size - 1
    while len(rows):
        piece = best[rows, at[rows]]
        out[rows, slot] = piece
        at[rows] -= m.length[piece]
        count[rows] += 1
        rows, slot = rows[at[rows] > 0], slot - 1
    return out, count


class Stepper:
    """Best pieces of single positions, for stretches where windows don't fall into step."""

    def __init__(self, m: PieceModel) -> None:
        self.m = m
        self.ids = {m.texts[i]: i for i in m.ids.tolist()}
        self.follows: dict[tuple[int, int], bool] = {}

    def may(self, a: int, b: int) -> bool:
        known = self.follows.get((a, b))
        if known is None:
            if len(self.follows) > KEPT_CHUNKS:
                self.follows.clear()
            known = self.follows[a, b] = bool(may_follow(self.m, np.array([a]), np.array([b]))[0])
        return known

    def step(self, chunk: str, best: np.ndarray, i: int) -> int:
        for k in range(1, min(i, self.m.longest) + 1):
            piece = self.ids.get(chunk[i - k : i], self.m.unknown if k == 1 else NONE)
            before = int(best[i - k])
            if piece != NONE and (i == k or (before != NONE and self.may(before, piece))):
                return piece
        return NONE


_steppers: dict[str, Stepper] = {}


def long_chunks(m: PieceModel, chunks: list[str]) -> list[np.ndarray]:
    """The pieces of chunks of more characters than a window's overlap; empty without an admissible path."""
    if m.path not in _steppers:
        _steppers.clear()
        _steppers[m.path] = Stepper(m)
    stepper, stride = _steppers[m.path], WINDOW - OVERLAP
    counts = [1 + max(0, -(-(len(c) - WINDOW) // stride)) for c in chunks]
    flat = np.frombuffer("".join(c + "\0" * WINDOW for c in chunks).encode("utf-32-le"), np.uint32)
    begins = np.cumsum([0, *(len(c) + WINDOW for c in chunks)])
    starts = np.concatenate([begins[k] + stride * np.arange(n) for k, n in enumerate(counts)])
    step = max(1, CELLS_AT_ONCE // (WINDOW + 1))
    found = np.concatenate([best_pieces(m, flat[starts[s : s + step, None] + np.arange(WINDOW)]) for s in range(0, len(starts), step)])
    out, row = [], 0
    for chunk, n in zip(chunks, counts, strict=True):
        size = len(chunk)
        best = np.full(size + WINDOW + 1, NONE, np.int32)
        best[: WINDOW + 1] = found[row]
        for j in range(1, n):
            own, s = found[row + j], stride * j
            at = s + OVERLAP  # up to here the true ones are known
            same = best[at - m.longest + 1 : at + 1] == own[OVERLAP - m.longest + 1 : OVERLAP + 1]
            run = len(same) if same.all() else int(same[::-1].argmin())
            while run < m.longest and at < min(size, s + WINDOW):
                at += 1
                best[at] = stepper.step(chunk, best, at)
                run = run + 1 if best[at] == own[at - s] else 0
            best[at + 1 : s + WINDOW + 1] = own[at + 1 - s :]
        row += n
        path, at = [], size
        while at > 0 and best[at] != NONE:
            path.append(int(best[at]))
            at -= int(m.length[path[-1]])
        out.append(np.array(path[::-1] if at == 0 else [], np.int32))
    return out


def encode_chunks(m: PieceModel, chunks: list[str]) -> list[np.ndarray]:
    """The ids of each chunk: blanks, if any, before characters other than blanks."""
    words, blanks = [], []
    for c in chunks:
        n = len(c) - len(c.lstrip(BLANK))
        blanks.append(max(0, n - 1))
        words.append(c[blanks[-1] :])
    done: list[np.ndarray] = [np.zeros(0, np.int32)] * len(chunks)
    by_size: dict[int, list[int]] = {}
    for k, c in enumerate(words):
        by_size.setdefault(PADDED[len(c)] if len(c) < len(PADDED) else 0, []).append(k)
    for size, own in by_size.items():
        if not size:
            for k, ids in zip(own, long_chunks(m, [words[k] for k in own]), strict=True):
                done[k] = _with_bytes(m, ids, words[k]) if (ids == m.unknown).any() else ids
            continue
        step = max(1, CELLS_AT_ONCE // (size + 1))
        for s in range(0, len(own), step):
            some = own[s : s + step]
            sizes = np.array([len(words[k]) for k in some])
            chars = np.frombuffer("".join([words[k].ljust(size, "\0") for k in some]).encode("utf-32-le"), np.uint32).reshape(len(some), size)
            found, count = viterbi(m, chars, sizes)
            unknown = (found == m.unknown).any(axis=1).tolist()
            flat = found[np.arange(size) >= size - count[:, None]]
            for r, (k, end, c) in enumerate(zip(some, np.cumsum(count).tolist(), count.tolist(), strict=True)):
                done[k] = _with_bytes(m, flat[end - c : end], words[k]) if unknown[r] else flat[end - c : end]
    lone = int(m.blanks[0])
    for k in [k for k, n in enumerate(blanks) if n]:
        # a word that leaves its blank alone leaves it to the run
        ids, n = done[k], blanks[k]
        done[k] = np.concatenate([_blank_run(m.blanks, n + 1), ids[1:]] if len(ids) and ids[0] == lone else [_blank_run(m.blanks, n), ids]).astype(np.int32)
    lost = [c for c, ids in zip(words, done, strict=True) if c and not len(ids)]
    if lost:
        raise ValueError(f"the merges of this model don't reach all pieces of {lost[0][:40]!r}")
    return done


def _with_bytes(m: PieceModel, ids: np.ndarray, chunk: str) -> np.ndarray:
    ends, out = np.cumsum(m.length[ids]), []
    for i, e in zip(ids.tolist(), ends.tolist(), strict=True):
        out += m.byte_ids[list(chunk[e - 1].encode())].tolist() if i == m.unknown else [i]
    return np.array(out)


class Memo:
    """The ids of the chunks that a worker has met, by the chunks' hashes."""

    def __init__(self) -> None:
        self.keys, self.at, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.int32), 0

    def places(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(hashes), NONE)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, at, NONE)

    def add(self, hashes: np.ndarray, ids: list[np.ndarray]) -> None:
        """Takes in sorted new hashes."""
        counts = np.array([len(x) for x in ids], np.int64)
        end = self.used + int(counts.sum())
        if end > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), end - len(self.pool)), np.int32)])
        if ids:
            self.pool[self.used : end] = np.concatenate(ids)
        where = np.searchsorted(self.keys, hashes)
        self.keys, self.counts = np.insert(self.keys, where, hashes), np.insert(self.counts, where, counts)
        self.at = np.insert(self.at, where, self.used + np.cumsum(counts) - counts)
        self.used = end


_memos: dict[str, Memo] = {}


def _cut(m: PieceModel, data: np.ndarray, off: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A slice of texts, each with a blank before it, and its chunks: (bytes, starts, ends, hashes, first chunk of each text)."""
    raw = data.tobytes()
    if BLANK.encode() in raw:  # stands for a blank, as in the pieces
        texts = [raw[a:b].replace(BLANK.encode(), b" ") for a, b in zip(off[:-1], off[1:], strict=True)]
        raw, off = b"".join(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    some = np.flatnonzero(np.diff(off))
    flat = np.insert(np.frombuffer(raw, np.uint8), off[:-1][some], 0x20)
    begin = off[:-1][some] + np.arange(len(some))
    blank = flat == 0x20
    cut = blank.copy()
    cut[1:] &= ~blank[:-1]
    cut[begin] = True
    cut[1:] |= m.alone[flat[1:]] | m.alone[flat[:-1]]
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], len(flat))[: len(starts)]
    first = np.zeros(len(off), np.int64)
    first[some + 1] = np.diff(np.append(np.searchsorted(starts, begin), len(starts)))
    return flat.tobytes(), starts, ends, tx.span_hashes(flat, starts, ends), np.cumsum(first)


def encode(m: PieceModel, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, offsets) of a column; null and empty texts have no ids."""
    data, off = tx.buffers(column)
    if m.path not in _memos or len(_memos[m.path].keys) > KEPT_CHUNKS:
        _memos.clear()
        _memos[m.path] = Memo()
    memo = _memos[m.path]
    met, new, cuts = np.zeros(0, np.uint64), [], []
    for i, j in tx.slices(off, CHUNK_BYTES):
        whole, starts, ends, hashes, first = _cut(m, data[off[i] : off[j]], off[i : j + 1] - off[i])
        own, at = np.unique(hashes, return_index=True)
        fresh = memo.places(own) == NONE
        own, at = own[fresh], at[fresh]
        fresh = ~np.isin(own, met, assume_unique=True)
        own, at = own[fresh], at[fresh]
        new += [whole[a:b].decode().replace(" ", BLANK) for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
        met = np.concatenate([met, own])
        cuts.append((hashes, first))
    order = np.argsort(met)
    memo.add(met[order], encode_chunks(m, [new[k] for k in order.tolist()]))
    values, sizes = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
    for hashes, first in cuts:
        place = memo.places(hashes)
        n = memo.counts[place]
        done = np.concatenate([[0], np.cumsum(n)])
        values.append(memo.pool[np.repeat(memo.at[place] - done[:-1], n) + np.arange(done[-1])])
        sizes.append(np.diff(done[first]))
    return np.concatenate(values), np.cumsum(np.concatenate(sizes))


def decode(m: PieceModel, ids: np.ndarray, off: np.ndarray) -> list[str]:
    """The texts of runs of ids; the blank that stands before every text is taken off, bad bytes replaced."""
    texts = []
    for i, j in tx.slices(off, DECODED_AT_ONCE):
        own = ids[off[i] : off[j]]
        n = np.diff(m.surface_at)[own]
        done = np.cumsum(n)
        flat = m.surface[np.repeat(m.surface_at[own] - (done - n), n) + np.arange(done[-1] if len(done) else 0)]
        at = np.concatenate([[0], done])[off[i : j + 1] - off[i]]
        texts += [flat[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return [t[1:] if t.startswith(" ") else t for t in texts]


def encode_column(df: DataFrame, model: str = MODEL, text: str = "text", out: str = "piece_ids") -> DataFrame:
    """`df` with `out`, array<int>: the ids of each whole text; empty for null and empty texts.

    A column called `out` is replaced; rows stay one for one. `model` is a file that the driver reads.
    """
    shared = SparkSession.active().sparkContext.broadcast(load(model))  # a vocabulary, of fixed size

    def compute(batch: pa.RecordBatch) -> list:
        ids, off = encode(shared.value, batch.column(text))
        return [pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids, pa.int32()))]

    return with_arrays(df, [T.StructField(out, T.ArrayType(T.IntegerType()))], compute)


def decode_column(df: DataFrame, model: str = MODEL, ids: str = "piece_ids", out: str = "decoded") -> DataFrame:
    """`df` with `out`, the text of each row's ids; '' for null or no ids. A column called `out` is replaced."""
    shared = SparkSession.active().sparkContext.broadcast(load(model))

    def compute(batch: pa.RecordBatch) -> list:
        column = batch.column(ids)
        sizes = pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        return [pa.array(decode(shared.value, flat, np.concatenate([[0], np.cumsum(sizes)])), pa.string())]

    return with_arrays(df, [T.StructField(out, T.StringType())], compute)


def op4_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    both = decode_column(encode_column(docs))
    return both.select(
        "doc_id",
        F.size("piece_ids").cast("long").alias("n_pieces"),
        F.sha2(F.array_join("piece_ids", ","), 256).alias("pieces_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )
