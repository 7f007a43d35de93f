"""Spelling variants against plain Python."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from docloom.llm import variants

from .helpers import docs


def words_by_hand(rows, misspell=97):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{doc_id}:{word}".encode())
            if misspell and doc_id is not None and h % misspell == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            found[word] += 1
    return {x: n for x, n in found.items() if len(x) >= 5 and n >= 3}


def are_near(u, v):
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v, strict=True)) == 1
    u, v = sorted((u, v), key=len)
    return len(v) == len(u) + 1 and any(v[:k] + v[k + 1 :] == u for k in range(len(v)))


def groups_by_hand(words):
    near = {u: [v for v in words if abs(len(u) - len(v)) < 2 and are_near(u, v)] for u in words}
    form = {u: min(near[u], key=lambda v: (-words[v], v), default=None) for u in words}
    form = {u: v if v is not None and words[v] >= 2 * words[u] else None for u, v in form.items()}

    def root(u):
        return u if form[u] is None else root(form[u])

    return {(u, form[u], root(u), n, len(near[u]), None if form[u] is None else words[form[u]]) for u, n in words.items()}


def test_query_equals_brute_force(spark, tiny):
    rows = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()
    got = variants.op11_spelling_variants(spark, tiny).collect()
    assert len(got) > 1000 and any(r.form and r.root != r.form for r in got)
    assert {r.word: r.n for r in got} == words_by_hand(rows)
    want = groups_by_hand({r.word: r.n for r in got if r.word[0] in "aeo"})
    assert want == set(map(tuple, variants.variants(spark.createDataFrame([(w, n) for w, _, _, n, _, _ in want], "word string, n long")).collect()))


@pytest.mark.parametrize("letters", ["ab", "abé漢🎉"])
def test_short_words_with_many_near_ones(spark, letters):
    r = random.Random(letters)
    words = {"".join(r.choice(letters) for _ in range(r.randrange(7))): r.randrange(1, 60) for _ in range(400)}
    got = variants.variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()
    assert set(map(tuple, got)) == groups_by_hand(words)


def test_colliding_hashes_are_told_apart():
    rows = [(1, "abcde", 9), (1, "axcde", 5), (1, "vwxyz", 7), (1, "vqxyz", 8), (variants.WHOLE, "other", 3)]
    got = sorted(variants._near_in_group(rows))
    assert got == [("abcde", 1, 5, "axcde"), ("axcde", 1, 9, "abcde"), ("vqxyz", 1, 7, "vwxyz"), ("vwxyz", 1, 8, "vqxyz")]


def test_deletion_hashes_are_those_of_the_shorter_word():
    for word in ("abcde", "aaaab", "x", "éa🎉"):
        chars = np.array([[ord(c) for c in word]], np.uint32)
        _, without = variants.deletion_hashes(chars)
        for k in range(len(word)):
            rest = np.array([[ord(c) for c in word[:k] + word[k + 1 :]]], np.uint32)
            assert without[0, k] == variants.deletion_hashes(rest)[0][0]


def test_checksums_join():
    r = random.Random(2)
    pairs = [(r.randbytes(r.randrange(12)), r.randbytes(r.randrange(1, 40))) for _ in range(300)]
    crc = lambda x: np.array([zlib.crc32(y) for y in x], np.uint32)
    got = variants.checksums(crc([a for a, _ in pairs]), np.array([len(b) for _, b in pairs]), crc([b for _, b in pairs]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in pairs]


def test_odd_rows(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, clashing columns, no rows."""
    rows = docs(spark).withColumnRenamed("key", "word").withColumnRenamed("score", "n")
    plain = [(r.doc_id, r.text) for r in rows.collect()]
    got = set(map(tuple, variants.group_variants(rows, misspell=97).collect()))
    assert got == groups_by_hand(words_by_hand(plain)) and len(got) > 10
    assert variants.group_variants(rows.limit(0)).count() == 0
    strange = spark.createDataFrame([(1, "Ünïcode ÜNÏCODE ünïcode x×y÷z×x x×y÷z×x X×Y÷Z×X 漢abcde漢abcde abcde"), (2, None)], "doc_id long, text string")
    assert {(r.word, r.n) for r in variants.word_counts(strange).collect()} == set(words_by_hand([tuple(r) for r in strange.collect()], 0).items())
    tied = variants.variants(spark.createDataFrame([("aaaaa", 4), ("aaaab", 8), ("aaaac", 8), ("zzzzz", 1)], "word string, n long"))
    assert {r.word: (r.form, r.root, r.n_near, r.form_n) for r in tied.collect()} == {"aaaaa": ("aaaab", "aaaab", 2, 8), "aaaab": (None, "aaaab", 2, None), "aaaac": (None, "aaaac", 2, None), "zzzzz": (None, "zzzzz", 0, None)}
    mapped = variants.with_roots(spark.createDataFrame([("aaaaa", 1), ("zzzzz", 2), (None, 3), ("none", 4)], "word string, root int"), tied)
    assert sorted(mapped.collect(), key=str) == sorted([("aaaaa", "aaaab"), ("zzzzz", "zzzzz"), (None, None), ("none", "none")], key=str)
