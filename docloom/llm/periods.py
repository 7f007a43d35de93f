"""Periodic runs of words by Lyndon arrays, after Ellert and Fischer's linear-time method for ordered alphabets.

A run is a stretch of words with a smallest period q that no neighbouring word extends. Bannai et al. showed that
under one of two opposite orders of the alphabet each first Lyndon root of a run is the longest Lyndon word at its
place, and that word ends where the next smaller suffix begins. `lyndon` finds next smaller suffixes from left to
right, with the length of what each has in common with its place. No suffix structure and no hash of a stretch is
needed, since matched extensions are reused:

* Where a comparison of two places has matched up to `reach`, the later stretch is a copy of the earlier one. A
  comparison inside the copy that its original decides before the end of the copy is taken over; any other one
  matches up to `reach` at least and goes on there. So no word is passed twice by a match.
* Of the places on the stack each knows what it has in common with the one below. If place j agrees less with the
  top, it agrees as much with the one below; if more, just as much as those two agree with each other.

Words that occur less often in a text than a run repeats them stand in no run, so a text is cut at them first.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import with_arrays

LEAST_WORDS = 6
LEAST_POWER = 4  # how often the period goes into a run, at least


def lyndon(w: Sequence[int]) -> tuple[list[int], list[int]]:
    """For each place the start of the next smaller suffix, len(w) if none, and how many items the two have in common.

    A suffix that begins another one is the smaller of the two. Linear in len(w).
    """
    n = len(w)
    following, common = [n] * n, [0] * n
    below, common_below = [-1] * n, [0] * n  # the previous smaller suffix, which is the next place on the stack
    reach, at, shift = 0, 0, 0  # w[at:reach] is a copy of what stands `shift` places before
    for j in range(1, n):
        top, known = j - 1, 0
        while True:
            same = -1
            if j + known < reach:
                if top >= at:
                    k, i = j - shift, top - shift
                    same = common[i] if following[i] == k else common_below[k]
                if j + same >= reach:
                    known, same = reach - j, -1
            if same < 0:
                a, b = top + known, j + known
                while b < n and w[a] == w[b]:
                    a += 1
                    b += 1
                same = b - j
                if b >= reach:
                    reach, at, shift = b, j, j - top
            if j + same < n and w[top + same] < w[j + same]:
                below[j], common_below[j] = top, same
                break
            # j is smaller than the top, and than all below that agree with the top beyond `same`
            while True:
                following[top], common[top] = j, same
                agree, top = common_below[top], below[top]
                if top < 0 or same >= agree:
                    break
            if top < 0:
                break
            if same > agree:
                below[j], common_below[j] = top, agree
                break
            known = same
    return following, common


def _runs_of_order(w: Sequence[int], power: int) -> Iterator[tuple[int, int, int]]:
    n = len(w)
    following, common = lyndon(w)
    for i, after in enumerate(following):
        q = after - i
        if common[i] < (power - 2) * q or after == n:
            continue
        if i >= q and following[i - q] == i and common[i - q] == common[i] + q:
            continue  # not the first root of its run
        begin, end = i, after + common[i]
        while begin and i - begin < q and w[begin - 1] == w[begin - 1 + q]:
            begin -= 1
        yield begin, end - begin, q


def find_runs(w: Sequence[int], least: int = LEAST_WORDS, power: int = LEAST_POWER) -> list[tuple[int, int, int]]:
    """(start, length, period) of each run of `w` with `least` items and `power` periods at least, by start and period."""
    found = set(_runs_of_order(w, power)) | set(_runs_of_order([-x for x in w], power))
    return sorted(r for r in found if r[1] >= max(least, power * r[2]))


def runs_of_words(words: Sequence[bytes], least: int = LEAST_WORDS, power: int = LEAST_POWER) -> list[tuple[int, int, int]]:
    """find_runs over words, cut at those that occur less than `power` times."""
    often = {x for x, n in Counter(words).items() if n >= power}
    if not often:
        return []
    rank = {x: k for k, x in enumerate(sorted(often))}
    found, start, ranks = [], 0, list(map(rank.get, words))
    ranks.append(None)
    for end, r in enumerate(ranks):
        if r is None:
            if end - start >= least:
                found += [(start + a, length, q) for a, length, q in find_runs(ranks[start:end], least, power)]
            start = end + 1
    return found


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run contains after its first period."""
    out, at = [], 0
    for a, b in sorted((start + q, start + length) for start, length, q in runs):
        out += words[at : max(a, at)]
        at = max(at, b)
    return out + words[at:]


RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def with_runs(df: DataFrame, text: str = "text", runs: str = "runs", out: str = "collapsed", least: int = LEAST_WORDS, power: int = LEAST_POWER) -> DataFrame:
    """`df` with `runs`, the periodic runs of words of each text by start and period, and `out`, its kept words joined by blanks.

    Words are `[^\\x20\\x09-\\x0D]+`, numbered from 0. Null, empty and blank texts have no runs and '' as `out`;
    repeated rows have each their own. Columns with the names of the new ones are replaced.
    """
    fields = [T.StructField(runs, T._parse_datatype_string(RUNS)), T.StructField(out, T.StringType())]
    of_runs = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))

    def compute(batch: pa.RecordBatch) -> list:
        found, kept = [], []
        for value in batch.column(text).cast(pa.large_binary()):
            words = (value.as_py() or b"").split()
            own = runs_of_words(words, least, power)
            found.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in own])
            kept.append(b" ".join(collapsed(words, own) if own else words))
        return [pa.array(found, of_runs), pa.array(kept, pa.binary()).cast(pa.string())]

    return with_arrays(df, fields, compute)


def planted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text): one in ten documents, by the checksum of its id, repeats a stretch of its words up to its end.

    With h = crc32(id), g = floor(h / 10), n words and h % 10 = 0, each word i >= a = g % n becomes word
    a + (i - a) % p of the original, where p = 1 + floor((n - a) / (3 + g % 8)). Documents without an id stay.
    """
    h = F.crc32(F.col(doc_id).cast("string"))
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda x: x != "")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("words"))
    rows = rows.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    at = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    repeated = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.element_at("words", (at(i) + 1).cast("int")))
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_runs(planted(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    longest = F.sort_array(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    best = F.try_element_at(longest, F.lit(1))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        (-F.col("best.less")).alias("length"),
        F.col("best.period").alias("period"),
        F.floor(F.lit(-1000) * F.col("best.less") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
