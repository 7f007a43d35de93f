"""Spelling variants: words that one inserted, deleted or replaced character tells apart, by rolling-hash deletions.

Two words are near if they have a string in common that is left of each when at most one character is deleted. For
words of one length, prefix and suffix polynomial hashes give the 64-bit hashes of all these strings as arrays. They
are dealt by their leading bits, sorted, and strings of equal hash are compared as strings. No pair is made:

* Words that leave one string when the character at one place is deleted differ in that character alone, and are all
  near each other; each is told how many the others are and which of them occurs most.
* Words that leave another word as a whole are near to that one; each tells it of itself.

Such a group has at most one word for each character of the alphabet at each place of the word, so none is hot.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as tx
from .arrow import mapped, small_batches
from .shared import free_name, saved

LEAST_CHARS = 5
LEAST_TIMES = 3
TIMES_AS_OFTEN = 2  # a word's form occurs so many times as often as the word, at least

# --- words and their numbers -------------------------------------------------------------------------------------

_ALPHA = np.zeros(256, bool)
_ALPHA[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True
_LEAD = 0xC3  # in UTF-8 the first byte of U+00C0 to U+00FF, and of nothing else


def _pieces(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the maximal runs of letters and of what stands between them, and whether a piece is a run."""
    letter = _ALPHA[data] | (data == _LEAD)
    letter[1:] |= data[:-1] == _LEAD
    edge = np.zeros(len(data), bool)
    edge[off[:-1][off[:-1] < len(data)]] = True
    edge[1:] |= letter[1:] != letter[:-1]
    starts = np.flatnonzero(edge)
    return starts, letter[starts]


_zeros: dict[int, np.ndarray] = {}


def _after(length: int) -> np.ndarray:
    """Four tables of 256 numbers: what `length` more bytes make of each byte of a crc32, which is linear."""
    if length not in _zeros:
        bits = [zlib.crc32(bytes(length), 1 << k) ^ zlib.crc32(bytes(length), 0) for k in range(32)]
        table = np.zeros((4, 256), np.uint32)
        for k in range(32):
            on = (np.arange(256) >> (k % 8)) & 1 == 1
            table[k // 8, on] ^= np.uint32(bits[k])
        _zeros[length] = table
    return _zeros[length]


def checksums(before: np.ndarray, lengths: np.ndarray, own: np.ndarray) -> np.ndarray:
    """crc32 of joined strings, from those of the first ones and the lengths and crc32 of the second ones."""
    out = own.copy()
    for length in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == length)
        table, x = _after(length), before[at]
        out[at] ^= table[0][x & 255] ^ table[1][(x >> 8) & 255] ^ table[2][(x >> 16) & 255] ^ table[3][x >> 24]
    return out


def misspelt(word: str, h: int) -> str:
    """The word without the character at place h % length."""
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def _count_words(misspell: int, least_chars: int):
    """Per slice of a batch: its words and how often each occurs, one in `misspell` changed by `misspelt` (0: none)."""

    def words_of(data: np.ndarray, off: np.ndarray, ids: list) -> tuple[list, np.ndarray]:
        starts, is_run = _pieces(data, off)
        bounds = np.append(starts, len(data))
        runs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
        code = runs.indices.to_numpy()[is_run]
        distinct = runs.dictionary.to_pylist()
        changed = {}
        if misspell:
            before = np.array([0 if i is None else zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
            named = np.array([i is not None for i in ids], bool)
            doc = np.searchsorted(off, starts[is_run], "right") - 1
            size = np.diff(bounds)[is_run]
            h = checksums(before[doc], size, np.array([zlib.crc32(x) for x in distinct], np.uint32)[code])
            hit = (h % np.uint32(misspell) == 0) & named[doc]
            for c, x in zip(code[hit].tolist(), h[hit].tolist(), strict=True):
                word = misspelt(distinct[c].decode(), x)
                changed[word] = changed.get(word, 0) + 1
            code = code[~hit]
        times = np.bincount(code, minlength=len(distinct))
        some = np.flatnonzero(times)
        words = [distinct[k].decode() for k in some.tolist()] + list(changed)
        counts = np.append(times[some], np.array(list(changed.values()), np.int64)).astype(np.int64)
        long = np.array([len(x) >= least_chars for x in words], bool)
        return [x for x, y in zip(words, long.tolist(), strict=True) if y], counts[long]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            data, off = tx.buffers(batch.column(1))
            if not len(data):
                continue
            words, counts = words_of(tx.LOWER[data], off, batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(counts)], ["word", "n"])

    return run


def word_counts(df: DataFrame, doc_id: str = "doc_id", text: str = "text", misspell: int = 0, least_chars: int = LEAST_CHARS, least: int = LEAST_TIMES) -> DataFrame:
    """(word, n): words of at least so many characters that occur at least so often, and how often.

    A word is a maximal run of A-Z, a-z and U+00C0 to U+00FF with A-Z as a-z. With `misspell`, one word in so many, by
    the crc32 of '<doc_id>:<word>', loses a character first; words of documents without an id are not changed. Null
    texts have no words; repeated rows count each.
    """
    found = mapped(df.select(doc_id, text), _count_words(misspell, least_chars), "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


# --- deletion keys -----------------------------------------------------------------------------------------------

U64 = np.uint64
WHOLE = -1  # the place of a key that is of the whole word
KEYS = "key bigint, place int, word string, n bigint"


def deletion_hashes(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words of one length, and of each word without each of its characters: (words), (words, places).

    The hash of c0 c1 .. is the sum of (ci + 1) * BASE**i, scrambled with the length; without place i it is the prefix
    before it and the suffix after it, moved by one.
    """
    count, length = chars.shape
    power = tx.powers(tx.BASE, length)
    terms = tx.mix(chars.astype(U64) + U64(1)) * power
    prefix = np.zeros((count, length + 1), U64)
    np.cumsum(terms, axis=1, out=prefix[:, 1:])
    whole = prefix[:, -1]
    without = prefix[:, :-1] + (whole[:, None] - prefix[:, 1:]) * tx.BASE_INVERSE
    of_length = np.array([length, max(length - 1, 0)], U64) * tx.STEP
    return tx.mix(whole + of_length[0]), tx.mix(without + of_length[1])


KEYS_AT_ONCE = 1 << 18


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        words = batch.column("word").to_pylist()
        length = np.array([len(x) for x in words], np.int64)
        for size in np.unique(length).tolist():
            own = np.flatnonzero(length == size)
            step = max(1, KEYS_AT_ONCE // (size + 1))
            for k in range(0, len(own), step):
                at = own[k : k + step]
                chars = np.frombuffer("".join(words[i] for i in at.tolist()).encode("utf-32-le"), np.uint32).reshape(len(at), size)
                whole, without = deletion_hashes(chars)
                key = np.concatenate([whole[:, None], without], axis=1).ravel()
                rows = pa.array(np.repeat(at, size + 1))
                place = np.tile(np.arange(-1, size, dtype=np.int32), len(at))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(place), batch.column("word").take(rows), batch.column("n").take(rows)], ["key", "place", "word", "n"])


def _whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of rows that are sorted by key, cut between keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column("key").to_numpy()
        cut = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
        if cut or (held and held[-1].column("key")[-1].as_py() != int(key[0])):
            yield pa.concat_batches([*held, batch.slice(0, cut)]) if held or cut else batch.slice(0, 0)
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.concat_batches(held)


def _first_of_its_kind(word: str, place: int) -> bool:
    """Whether deleting an earlier character doesn't leave the same string."""
    return place == 0 or word[place] != word[place - 1]


def _near_in_group(rows: list[tuple[int, str, int]]) -> Iterator[tuple[str, int, int, str]]:
    """(word, number of near words, n of the best of them, it) from the (place, word, n) of one key, each pair once.

    Rows whose strings differ although their hashes agree are told apart here.
    """
    same: dict[str, list[tuple[int, str, int]]] = {}
    for place, word, n in rows:
        same.setdefault(word if place == WHOLE else word[:place] + word[place + 1 :], []).append((place, word, n))
    for string, own in same.items():
        if len(own) < 2:
            continue
        by_place: dict[int, list[tuple[int, str]]] = {}
        for place, word, n in own:
            by_place.setdefault(place, []).append((-n, word))
        center = by_place.pop(WHOLE, None)
        for members in by_place.values():
            if len(members) > 1:
                first, second = sorted(members)[:2]
                for n, word in members:
                    best = second if (n, word) == first else first
                    yield word, len(members) - 1, -best[0], best[1]
        if center:
            longer = [(-n, word) for place, word, n in own if place != WHOLE and _first_of_its_kind(word, place)]
            if longer:
                best = min(longer)
                yield string, len(longer), -best[0], best[1]
                for _, word in longer:
                    yield word, 1, -center[0][0], string


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _whole_keys(batches):
        if not batch.num_rows:
            continue
        key = batch.column("key").to_numpy()
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(start, len(key)))
        shared = np.repeat(size > 1, size)
        batch = batch.filter(pa.array(shared))
        place, word, n = (batch.column(c).to_pylist() for c in ("place", "word", "n"))
        found, at = [], 0
        for many in size[size > 1].tolist():
            found += _near_in_group(list(zip(place[at : at + many], word[at : at + many], n[at : at + many], strict=True)))
            at += many
        columns = list(zip(*found, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string())], ["word", "n_near", "best_n", "best"])


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) from (word, n) with distinct words: of each that has near words their number and
    the one of largest n, of several that which comes first by code points. Null words are left out, '' is near
    to words of one character."""
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = mapped(words.where("word is not null").select("word", "n"), _keys, KEYS)
    leading = F.shiftrightunsigned("key", 64 - 30)  # so many leading bits, of which each part takes a range
    dealt = keys.repartitionById(parts, F.floor(leading * parts / F.lit(1 << 30)).cast("int")).sortWithinPartitions("key")
    found = mapped(dealt, _near, "word string, n_near bigint, best_n bigint, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("top")).select("word", "n_near", (-F.col("top.less")).alias("best_n"), "top.best")


def variants(words: DataFrame, times: int = TIMES_AS_OFTEN) -> DataFrame:
    """(word, form, root, n, n_near, form_n) from (word, n) with distinct words.

    A word's `form` is its near word of largest n if that is at least `times` its own n, else null; `root` is where
    its forms end, the word itself if it has none. Each step to a form multiplies n by `times`, so that there are
    few steps, and the pointers are doubled from round to round.
    """
    words = saved(words)
    near = near_words(words)
    form = F.when(F.col("best_n") >= times * F.col("n"), F.col("best"))
    joined = words.join(near, "word", "left").withColumn("form", form)
    found = saved(joined.select("word", "form", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("form").isNotNull(), F.col("best_n")).alias("form_n")))
    step = saved(found.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        further = step.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        moved = saved(step.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        step = moved.select("word", "root")
        if not moved.where("moved").limit(1).count():
            break
    return found.join(step, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group_variants(df: DataFrame, doc_id: str = "doc_id", text: str = "text", misspell: int = 0) -> DataFrame:
    """`variants` of the words of all texts, see `word_counts`."""
    return variants(word_counts(df, doc_id, text, misspell))


def with_roots(df: DataFrame, groups: DataFrame, word: str = "word", out: str = "root") -> DataFrame:
    """`df` with `out`, the root of each `word`; a word that is in no group, or null, stays as it is."""
    key = free_name(df, "_word")
    roots = groups.where("form is not null").select(F.col("word").alias(key), F.col("root").alias(f"{key}_root"))
    joined = df.join(roots, F.col(word) == F.col(key), "left")
    return joined.select(*[F.col(c) for c in df.columns if c.lower() != out.lower()], F.coalesce(f"{key}_root", word).alias(out))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"), misspell=97)
