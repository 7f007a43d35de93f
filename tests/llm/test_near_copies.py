import random

import pytest

from docloom.llm import jaccard, substrings
from docloom.llm import text as tx
from docloom.llm.shared import components

from .helpers import ODD, docs, shingles


def brute_groups(rows):
    """(id, n, component) by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(k):
        while group[k] != k:
            k = group[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 80 * len(sets[a] | sets[b]):
                group[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least.setdefault(root(k), []).append(i)
    smallest = {r: min((i for i in ids if i is not None), default=None) for r, ids in least.items()}
    return sorted(((i, len(s), smallest[root(k)]) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def near_copies(seed=3):
    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = []
    for g in range(6):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randint(60, 160))]
        for _ in range(rnd.choice([1, 5, 30])):
            own = list(base)
            for _ in range(rnd.randint(0, 6)):
                own[rnd.randrange(len(own))] = rnd.choice(vocabulary)
            rows.append((len(rows) * 3 + g, " ".join(own)))
    passage = [rnd.choice(vocabulary) for _ in range(60)]
    for _ in range(50):
        rows.append((len(rows) * 3, " ".join([rnd.choice(vocabulary) for _ in range(40)] + passage)))
    return rows


@pytest.mark.parametrize("block, hot", [(512, 1000), (8, 6)])
def test_groups_equal_brute_force(spark, monkeypatch, block, hot):
    """Also with several blocks to a class of sizes, and with lists long enough to be hot."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "HOT_LEAST", hot)
    monkeypatch.setattr(jaccard, "HOT_PART", 1000)
    rows = near_copies()
    found = jaccard.groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(((r.id, r.n, r.component) for r in found.collect()), key=str) == brute_groups(rows)


def test_null_ids_lose_no_link(spark):
    words = [f"w{k}" for k in range(100)]
    rows = [(None, " ".join(words)), (None, " ".join([*words[:-2], "x", "y"])), (5, " ".join([*words[:-1], "z"])), (5, "other words " * 9), (7, " ".join(["a", *words[1:]]))]
    found = jaccard.groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(((r.id, r.n, r.component) for r in found.collect()), key=str) == brute_groups(rows)


def test_groups_bear_odd_rows(spark):
    found = jaccard.groups(docs(spark))
    assert sorted(((r.id, r.n, r.component) for r in found.collect()), key=str) == brute_groups([r[:2] for r in ODD])
    assert jaccard.groups(docs(spark, [])).count() == 0


def test_keep_one(spark):
    kept = jaccard.keep_one(docs(spark))
    assert kept.columns == docs(spark).columns
    want = {c for i, n, c in brute_groups([r[:2] for r in ODD]) if n}
    blank = [i for i, n, _ in brute_groups([r[:2] for r in ODD]) if not n]
    assert sorted(r.doc_id for r in kept.collect()) == sorted([*want, *blank])
    assert jaccard.keep_one(docs(spark, [])).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(50)] + [(100, 101), (102, 101), (7, 7), (200, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(51)}, 100: 100, 101: 100, 102: 100}


def brute_repeats(rows, length):
    bodies = [(i, (t or "").encode()) for i, t in rows]
    seen = {}
    for _, b in bodies:
        for p in range(len(b) - length + 1):
            seen[b[p : p + length]] = seen.get(b[p : p + length], 0) + 1
    out = []
    for i, b in bodies:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        out.append((i, len(b), sum(gone), sum(1 for q in range(len(b)) if gone[q] and not (q and gone[q - 1])), kept))
    return sorted(out, key=str)


@pytest.mark.parametrize("crowd", [1000, 4])
def test_repeats_equal_brute_force(spark, monkeypatch, crowd):
    """Also with buckets that count as crowded."""
    monkeypatch.setattr(substrings, "CROWD_LEAST", crowd)
    rnd = random.Random(5)
    rows = [r[:2] for r in ODD if r[0] != 9]
    for k in range(40):
        rows.append((100 + k, "".join(rnd.choice("abc é") for _ in range(rnd.randint(0, 400)))))
    passage = "".join(rnd.choice("abcdefgh") for _ in range(90))
    for k in range(40):
        cut = rnd.randint(0, 40)
        rows.append((200 + k, "".join(rnd.choice("xyz ") for _ in range(30)) + passage[cut : cut + rnd.randint(30, 90)] + "".join(rnd.choice("xyz ") for _ in range(30))))
    for length, gram in ((40, 8), (200, 32)):
        got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=length, gram=gram).collect()
        assert sorted(((*r[:4], bytes(r[4])) for r in got), key=str) == brute_repeats(rows, length)


def test_places_of_long_texts_do_not_wrap(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(substrings, "_AT", 20)  # a text of 3 MB is then too long for its places, as one of 64 MiB is otherwise
    monkeypatch.setattr(substrings, "PART_BYTES", 1 << 19, raising=False)
    rnd = random.Random(7)
    text, passage = bytearray(rnd.choices(b"abcdefgh ", k=3 << 20)), bytes(rnd.choices(b"stuvwxyz", k=1000))
    starts = [100, (1 << 19) - 500, (1 << 20) + 77, 2_900_000]
    for at in starts:
        text[at : at + 1000] = passage
    rows = [(1, 0, "short"), (2, 0, text.decode()), (3, 0, "x" * 150), (4, 0, "y" + passage.decode())]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.string()), strict=True)], ["doc_id", "copy", "text"])
    found = [(r["doc_id"], r["first"], r["last"], r["gram"], r["first"] + r["before"]) for b in substrings._find_anchors(200, 32)([batch]) for r in b.to_pylist()]
    windows = {}
    for doc, first, last, gram, anchor in found:
        for w in range(first, last + 1):
            assert windows.setdefault((doc, w), (gram, anchor - w)) == (gram, anchor - w) and w <= anchor <= w + 168
    assert len(windows) == sum(last - first + 1 for _, first, last, _, _ in found) == len(text) - 199 + 802  # each window once
    for at in starts:
        assert [windows[2, at + k] for k in range(801)] == [windows[4, 1 + k] for k in range(801)]


def test_buckets_may_span_batches():
    """However the anchors of a bucket are dealt out to batches, the same members are found."""
    import pyarrow as pa

    rnd = random.Random(9)
    rows = sorted((rnd.choice([1, 2, 2, 2, 3, 9]), rnd.randrange(4), rnd.choice([1, 1, 2]), k) for k in range(60))
    kinds = {}
    for g, a, w, _ in rows:
        kinds.setdefault(g, {}).setdefault(a, []).append(w)
    want = []
    first_met = set()
    for g, a, _, k in rows:
        whole, opened = sum(kinds[g][a]) > 1, len(kinds[g]) > 1 and (g, a) not in first_met
        first_met.add((g, a))
        if whole or opened:
            want.append((k, whole, opened))
    names = ["gram", "around", "weight", "doc_id", "copy", "first", "last", "before", "settled"]
    for size in (1, 2, 7, 60):
        batches = [pa.RecordBatch.from_pylist([dict(zip(names, (g, a, w, k, 0, 0, 0, 0, False), strict=True)) for g, a, w, k in rows[s : s + size]]) for s in range(0, 60, size)]
        got = [(r["doc_id"], r["whole"], r["open"]) for b in substrings._refine_by_surroundings(iter(batches)) for r in b.to_pylist()]
        assert sorted(got) == sorted(want), size


def test_repeats_bear_odd_rows(spark):
    assert substrings.remove_repeats(docs(spark)).count() == len(ODD)
    assert substrings.remove_repeats(docs(spark, [])).count() == 0


def test_shingle_sets_are_whole():
    import pyarrow as pa

    texts = [r[1] for r in ODD] + ["A b C d E f", "a B c D e F"]
    sets = list(tx.text_sets(pa.array(texts)))
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]
    assert sets[-1].tolist() == sets[-2].tolist()
