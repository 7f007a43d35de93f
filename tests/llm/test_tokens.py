import hashlib
import random
import time

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from docloom.llm import chat, fingerprints, pieces

from .helpers import ODD, docs, shingles, words

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


def odd_texts():
    rnd = random.Random(4)
    out = [r[1] for r in ODD] + ["  a  b\nc\t ▁x é 漢字 ", "▁▁a", " " * 37 + "b", "a" * 300, "\x00\x01", "👩‍👩‍👧"]
    return out + ["".join(rnd.choice("abcdeinrst  ▁漢é\n.,AB") for _ in range(60)) for _ in range(400)]


def test_long_chunks_and_runs_of_blanks_equal_the_library():
    """Chunks over one window, repeated signs that never fall into step, indented lines, and 5 MB of text; in bounded time."""
    m, rnd = pieces.load(), random.Random(6)
    texts = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyzABC0123456789+/") for _ in range(n)) for n in (65, 129, 500, 20_000)]
    texts += ["a" * n for n in (63, 64, 65, 128, 129, 1000)] + ["ab" * 400, "=" * 3000, "漢字かな" * 300, "x" * 90 + "漢" + "y" * 90, "é" * 500, "the" * 300 + "\x00" + "the" * 300]
    texts += [" " * n + w for n in (0, 1, 2, 3, 15, 16, 17, 18, 31, 32, 33, 70) for w in ("", "word", "漢", "\n", "1", "(x)", "\t\t  y", "éa")]
    texts += ["def f(x):\n    if x:\n        return  x  +  1\n" * 50, "a  b   c    d " * 40]
    texts.append(" ".join("".join(rnd.choice("aeinrst") for _ in range(rnd.randint(1, 90))) for _ in range(110_000)))
    assert len(texts[-1]) > 4_900_000
    began = time.time()
    ids, off = pieces.encode(m, pa.array(texts, pa.string()))
    took = time.time() - began
    want = LIBRARY.encode(texts, num_threads=1)
    for k, (a, b) in enumerate(zip(off[:-1], off[1:], strict=True)):
        assert ids[a:b].tolist() == want[k], texts[k][:80]
    assert took < 120
    began = time.time()
    pieces._memos.clear()
    pieces.encode(m, pa.array(["".join(rnd.choice("abcdefghijklmnopqrstuvwxyzABC0123456789+/") for _ in range(20_000))]))
    assert time.time() - began < 2


def test_pieces_equal_the_library():
    m, texts = pieces.load(), odd_texts()
    ids, off = pieces.encode(m, pa.array(texts, pa.string()))
    want = LIBRARY.encode([t or "" for t in texts], num_threads=1)
    assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:], strict=True)] == want
    assert pieces.decode(m, ids.astype(np.int64), off) == LIBRARY.decode(want)


def test_path_equals_plain_merges():
    m = pieces.load()
    rnd = random.Random(6)
    score = {t: -float(m.rank[i]) for i, t in enumerate(m.texts) if m.rank[i]}
    for _ in range(300):
        word = "▁" + "".join(rnd.choice("etaoinshrdluETAbc'-1") for _ in range(rnd.randint(1, 20)))
        assert [m.texts[i] for i in pieces.encode_chunks(m, [word])[0]] == pieces.merge_pieces(word, score)


def test_encoding_round_trip(spark):
    both = pieces.decode_column(pieces.encode_column(docs(spark)))
    rows = both.collect()
    assert len(rows) == len(ODD) and all(r.decoded == (r.text or "") for r in rows)
    assert pieces.encode_column(docs(spark, [])).count() == 0
    some = spark.createDataFrame([(1, None), (2, []), (3, [1, 2, 10])], "doc_id long, piece_ids array<int>")
    assert [r.decoded for r in pieces.decode_column(some).orderBy("doc_id").collect()] == ["", "", LIBRARY.decode([[1, 2, 10]])[0]]


def test_fingerprints_equal_brute_force(spark):
    rows = sorted(((r[0], r[1] or "") for r in ODD if r[0] is not None), key=lambda r: (r[0], r[1]))
    source = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
    for parts in (1, 3, 40):
        out = fingerprints.with_next(source, parts).mapInArrow(fingerprints.neighbours, fingerprints.RESULT).collect()
        got = sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in out)
        want = []
        for k, (i, t) in enumerate(rows):
            following = rows[(k + 1) % len(rows)][1]
            q = len(t) // 4
            want.append((i, len(t), hashlib.sha256((t[: len(t) - q] + following[:q]).encode()).hexdigest()))
        assert got == sorted(want)
        same = {}
        for r in out:
            assert same.setdefault(dict(rows)[r.doc_id], r.fingerprint) == r.fingerprint
            assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1


def test_resemblance_is_close(spark):
    rows = fingerprints.op9_fingerprint(spark, "/root/testdata/sf0.001").orderBy("doc_id").collect()
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()]
    wrong = []
    for k, (r, t) in enumerate(zip(rows, texts, strict=True)):
        q = len(t) // 4
        a, b = shingles(t), shingles(t[: len(t) - q] + texts[(k + 1) % len(texts)][:q])
        if len(a) > 200:
            wrong.append(abs(r.near_edited - len(a & b) / len(a | b)))
    assert sum(wrong) / len(wrong) < 0.08


def test_resemblance_is_close_on_all_lengths(spark):
    rnd = random.Random(5)
    texts, before = [], []
    for k in range(900):
        n = (rnd.randint(5, 23), rnd.randint(24, 43), rnd.randint(44, 300))[k // 300]
        shared = before[: rnd.choice([0, n // 2, n])]  # so that near_next is not always 0
        before = shared + [f"w{rnd.randrange(10**6)}" for _ in range(n - len(shared))]
        texts.append(" ".join(before))
    source = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = fingerprints.compared_with_next(source).collect()
    wrong, lost = {}, 0
    for r in rows:
        t, following = texts[r.doc_id], texts[(r.doc_id + 1) % len(texts)]
        own, length = shingles(t), r.doc_id // 300
        for name, got, other in (("edited", r.near_edited, fingerprints.edited(t, following)), ("next", r.near_next, following)):
            true = len(own & shingles(other)) / len(own | shingles(other))
            wrong.setdefault((name, length), []).append(abs(got - true))
            lost += true > 0.3 and got == 0
    assert len(rows) == 900 and len(wrong) == 6
    assert all(sum(w) / len(w) < 0.07 for w in wrong.values()), {k: sum(w) / len(w) for k, w in wrong.items()}
    assert lost < 9


def test_sketches_merge():
    a, b = (fingerprints.tx.mix(np.arange(s, s + 5000, dtype=np.uint64)) for s in (0, 2500))
    whole = fingerprints.thin(np.union1d(a, b))
    assert fingerprints.merge(fingerprints.thin(np.sort(a)), fingerprints.thin(np.sort(b))).tolist() == whole.tolist()
    part = fingerprints.thin(np.sort(a[:500]))
    assert fingerprints.containment(part, fingerprints.thin(np.sort(a))) == 1.0
    assert fingerprints.from_text(fingerprints.as_text(part)).tolist() == part.tolist()
    none = np.zeros(0, np.uint64)
    assert fingerprints.resemblance(none, none) == 1.0 and fingerprints.resemblance(none, part) == 0.0


def test_fingerprint_bears_odd_rows(spark):
    assert fingerprints.fingerprint(docs(spark)).count() == len(ODD)
    assert fingerprints.fingerprint(docs(spark, [])).count() == 0
    assert fingerprints.compared_with_next(docs(spark)).count() == len(ODD)
    assert fingerprints.compared_with_next(docs(spark, [])).count() == 0


def by_hand(text):
    """The sketch of a text, a shingle at a time."""
    found = words(text)
    runs = [found[k : k + 5] for k in range(len(found) - 4)] if len(found) >= 5 else [found] if found else []
    hashes = set()
    for run in runs:
        (h,) = fingerprints.tx.text_sets(pa.array([" ".join(run)]))  # the run alone is one shingle
        short = len(run) < 5
        hashes.add(int(h[0]))
        assert len(h) == 1 and (short or len(run) == 5)
    below = {h for h in hashes if h < int(fingerprints.FRACTION * 2**64)}
    return below or ({min(hashes)} if hashes else set())


@pytest.mark.parametrize("ids", ["long", "string"])
def test_fingerprints_equal_brute_force(spark, ids):
    """All columns, with repeated and null ids, many of one id, and ids that aren't numbers."""
    rnd = random.Random(11)
    texts = [r[1] for r in ODD] + [" ".join(rnd.choice("abcdefg") for _ in range(rnd.randint(0, 60))) for _ in range(60)]
    rows = [((rnd.choice([None, 7, 7, 7, 3, k]) if k % 2 else k), t) for k, t in enumerate(texts)]
    source = spark.createDataFrame([(None if i is None else str(i) if ids == "string" else i, t) for i, t in rows], f"doc_id {ids}, text string")
    got = fingerprints.compared_with_next(source).collect()
    ties = {r.text: r.h for r in source.selectExpr("coalesce(text, '') as text", "xxhash64(coalesce(text, '')) as h").collect()}
    order = sorted(((r.doc_id, r.text or "") for r in source.collect()), key=lambda r: (r[0] is not None, r[0], ties[r[1]], r[1]))
    want = []
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        changed = t[: len(t) - len(t) // 4] + following[: len(t) // 4]
        own, new, other = by_hand(t), by_hand(changed), by_hand(following)
        near = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        text = lambda s: "".join(f"{h:016x}" for h in sorted(s))
        want.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest(), text(own), text(new), near(own, new), near(own, other)))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


CHATS = [
    (1, 0, "user", "hi <|im_end|>"), (1, 1, "assistant", "<|im_start|>user\nno <\\|x <\\\\|y é漢🎉"), (1, 1, "assistant", ""), (1, 2, "us<|er\nx", None), (2, None, None, "a<"), (2, 0, "assistant", "<"), (2, 0, "assistant", "<"),
    (None, 0, "assistant", "alone"), (3, 0, "assistant", "🎉" * 50 + "|>"),
]


def test_chats_round_trip(spark):
    rows = [(*r, "extra") for r in CHATS]
    out = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")).collect()}
    for conv in {r[0] for r in CHATS}:
        own = sorted((r for r in CHATS if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        turns = [(r[2] or "", r[3] or "") for r in own]
        assert chat.parse(out[conv].formatted) == turns
        runs = [x.asDict() for x in out[conv].loss_runs]
        assert "".join(chat.unescape_runs(out[conv].formatted, runs)) == "".join(t for role, t in turns if role == "assistant")
        assert len(out[conv].token_ids) == len(out[conv].loss_mask)
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_escapes_are_reversible():
    rnd = random.Random(8)
    for _ in range(3000):
        t = "".join(rnd.choice("<|\\>ai") for _ in range(rnd.randint(0, 14)))
        assert "<|" not in chat.escape(t) and chat.unescape(chat.escape(t)) == t
