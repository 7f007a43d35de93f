"""Periodic runs against their definition, and the query against plain Python."""

import hashlib
import random
import time
import zlib

from docloom.llm import periods

from .helpers import docs


def brute_runs(w, least=6, power=4):
    found = []
    for q in range(1, len(w) // power + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            own = w[i : j + q]
            if len(own) >= max(least, power * q) and j > i and all(any(own[k] != own[k + p] for k in range(len(own) - p)) for p in range(1, q)):
                found.append((i, len(own), q))
            i = j + 1
    return sorted(found)


def brute_lyndon(w):
    following = [next((j for j in range(i + 1, len(w)) if w[j:] < w[i:]), len(w)) for i in range(len(w))]
    common = [next((k for k in range(len(w)) if j + k >= len(w) or w[i + k] != w[j + k]), 0) for i, j in enumerate(following)]
    return following, common


def some_lists(seed, count):
    r = random.Random(seed)
    for _ in range(count):
        letters = r.choice([1, 2, 2, 3, 5])
        some = lambda n: [r.randrange(letters) for _ in range(r.randrange(n))]  # noqa: B023, E731
        yield some(9) + some(7) * r.randrange(7) + some(9) + some(4) * r.randrange(9)


def test_runs_equal_their_definition():
    for w in some_lists(1, 3000):
        assert periods.lyndon(w) == brute_lyndon(w)
        for least, power in ((6, 4), (2, 2), (3, 3)):
            assert periods.find_runs(w, least, power) == brute_runs(w, least, power)
        assert periods.runs_of_words([str(x).encode() for x in w]) == brute_runs(w)


def test_linear_on_hard_words():
    """Long stretches with nested matches: no pair of places is compared again and again."""
    fibonacci, ruler = [[0], [0, 1]], [0]
    while len(fibonacci[-1]) < 100_000:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    for k in range(1, 17):
        ruler = ruler + ruler[:-1] + [k]
    for w in ([0] * 100_000, fibonacci[-1], ruler, list(range(1000)) * 100, list(range(100_000, 0, -1))):
        began = time.process_time()
        periods.find_runs(w)
        assert time.process_time() - began < 5


def expected(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n and doc_id is not None:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    number = {x: k for k, x in enumerate(dict.fromkeys(words))}
    runs = brute_runs([number[x] for x in words])
    gone = {i for start, length, q in runs for i in range(start + q, start + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()
    return (doc_id, len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), sha(lines), sha(b" ".join(x for i, x in enumerate(words) if i not in gone)))


def test_query_equals_brute_force(spark, tiny):
    rows = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(map(tuple, periods.op12_periodic_runs(spark, tiny).collect()))
    assert len(got) == len(rows)
    want = {r.doc_id: expected(*r) for r in rows if len((r.text or "").split()) < 1500}
    assert len(want) > 190 and [r for r in got if r[0] in want] == sorted(want.values()) and any(r[1] for r in got)


def test_odd_rows(spark):
    """Nulls, empty and long texts, repeated rows, clashing columns, no rows."""
    rows = docs(spark)
    got = periods.with_runs(rows).collect()
    assert len(got) == rows.count() and set(got[0].asDict()) == {*rows.columns, "collapsed"}
    for r in got:
        words = (r.text or "").encode().split()
        number = {x: k for k, x in enumerate(dict.fromkeys(words))}
        assert r.doc_id == 9 or [tuple(x) for x in r.runs] == brute_runs([number[x] for x in words])
        assert r.runs or r.collapsed == b" ".join(words).decode()
    nine = next(r for r in got if r.doc_id == 9)
    assert len(nine.runs) == 1 and nine.collapsed.split() == nine.text.split()[: nine.runs[0].period]
    assert periods.with_runs(rows.limit(0)).count() == 0
    long = spark.createDataFrame([(1, "a b c " * 300_000 + "end"), (2, " ".join(f"w{k}" for k in range(300_000)))], "doc_id long, text string")
    assert {r.doc_id: ([tuple(x) for x in r.runs], len(r.collapsed)) for r in periods.with_runs(long).collect()} == {1: ([(0, 900_000, 3)], 9), 2: ([], len(long.collect()[1].text))}
    planted = {r.doc_id: r.text for r in periods.planted(spark.createDataFrame([(None, "a b c"), (6, None), (6, ""), (5, "x  y")], "doc_id long, text string")).where("text <> ''").collect()}
    assert planted == {None: "a b c", 5: "x  y"}
