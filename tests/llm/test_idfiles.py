"""Files of token ids: what is read back, keyed access, and the query against the library."""

import os
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from docloom.llm import idfiles
from docloom.llm import text as tx

from .helpers import docs

LIBRARY = Tokenizer.from_file(idfiles.MODEL)
SIGNS = ["a", "B", "J", "Z", "é", "É", "İ", "ǰ", "̌", "̸", "≠", "=", "<|endoftext|>", "<|ENDOFTEXT|>", "<", "|", ">", " ", "\n", "\t", "\x0b", "\x0c", "\x1c", " ", " ", "'s", "'", "'LL", "1", "٣", ".", ",", "!", "?;", "“", "漢", "🎉", "ß", "×", "÷", "Σ", "\x00", "\x85"]


def ids_of(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, idfiles.END_ID]


def numbers(r):
    return tuple(np.frombuffer(r.ids, "<u4").tolist())


def test_encoder_equals_library():
    r, own = random.Random(3), idfiles.Encoder(idfiles.MODEL)
    every = "".join(chr(c) for c in range(0x20, 0x180))
    words = [f"a{c}b {c}b a{c} {c} {c}{c}" for c in every] + ["naïve straße œuvre ÿ÷ñ été. they're THEY'RE"]
    ids, counts = own.encode(*tx.buffers(pa.array(words)), idfiles.END_ID)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [ids_of(t) for t in words]
    own.MOST = 500  # it forgets now and then
    for _ in range(150):
        texts = ["".join(r.choice(SIGNS) for _ in range(r.randrange(25))) for _ in range(40)]
        ids, counts = own.encode(*tx.buffers(pa.array(texts)), idfiles.END_ID)
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [ids_of(t) for t in texts]


def test_other_tokenizers_get_whole_texts():
    path = "/opt/tokenizers/byte_bpe_50k.json"
    library, own = Tokenizer.from_file(path), idfiles.Encoder(path)
    texts = ["Some words, again.", "", " two  blanks ", "é 漢"]
    ids, counts = own.encode(*tx.buffers(pa.array(texts)), 50256)
    assert idfiles.Encoder(idfiles.MODEL).by_chunks and not own.by_chunks
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [[*library.encode(t, add_special_tokens=False).ids, 50256] for t in texts]


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_index_is_minimal_and_perfect(n):
    r = np.random.default_rng(n)
    keys, values = r.integers(0, 2**63, (n, 2)).astype(np.uint64), np.arange(n)
    index = idfiles.Index.from_bytes(idfiles.build_index(keys, values, values, values))
    assert sorted(index.places(keys).tolist()) == list(range(n))
    assert index.values["offset"][index.find(keys)].tolist() == values.tolist()
    foreign = index.find(r.integers(0, 2**63, (5000, 2)).astype(np.uint64))
    assert (foreign >= 0).sum() <= 1


def test_equal_keys_are_an_error():
    with pytest.raises(ValueError, match="distinct"):
        idfiles.build_index(np.ones((2, 2), np.uint64), *[np.arange(2)] * 3)


def test_query_equals_library(spark, tiny):
    want, start = [], 0
    for r in sorted(spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()):
        ids = ids_of(r.text)
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, idfiles.op13_token_files(spark, tiny).collect())) == want


def test_repeated_ids_nulls_and_small_shards(spark, tmp_path):
    """A third of all rows has one id, over several ranges and shards; copies are numbered without gaps."""
    rows = [(None, "n one"), (None, "n two"), (7, "a"), (5, None), (5, ""), (8, "z z"), (9, " "), *((6, f"copy {k % 3}") for k in range(200)), *((k, f"text {k}") for k in range(20, 300))]
    random.Random(1).shuffle(rows)
    folder = idfiles.write_ids(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), f"file://{tmp_path}/ids", shard_ids=100)
    got = idfiles.read_ids(idfiles.written_keys(spark, folder), folder).orderBy("start").collect()
    assert Counter((r.doc_id, numbers(r)) for r in got) == Counter((i, tuple(ids_of(t))) for i, t in rows)
    assert [(r.doc_id is not None, r.doc_id or 0, r.copy) for r in got] == sorted((r.doc_id is not None, r.doc_id or 0, r.copy) for r in got)
    assert all([r.copy for r in got if r.doc_id == i] == list(range(n)) for i, n in Counter(i for i, _ in rows).items())
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    files = idfiles.IdFiles(folder)
    assert all(tuple(files.get(r.doc_id, r.copy).tolist()) == numbers(r) for r in got)
    assert files.get(6, 200) is None and files.get(10) is None and files.get("7").tolist() == ids_of("a")
    raw = b"".join(open(f"{tmp_path}/ids/ids/{x}", "rb").read() for x in sorted(os.listdir(f"{tmp_path}/ids/ids")))
    assert tuple(np.frombuffer(raw, "<u2").tolist()) == tuple(x for r in got for x in numbers(r))
    asked = spark.createDataFrame([(6, 3), (6, 3), (7, 0), (1000, 0), (None, 1)], "doc_id long, copy long")
    assert sorted((r.doc_id or 0, r.copy) for r in idfiles.read_ids(asked, folder).collect()) == [(0, 1), (6, 3), (6, 3), (7, 0)]


def test_odd_rows(spark):
    """Odd texts, long ones, string ids, clashing columns, and a table without rows."""
    rows = docs(spark).selectExpr("cast(doc_id as string) doc_id", "text", "lang copy", "key ids", "score part", "language file")
    folder = idfiles.write_ids(rows)
    got = idfiles.read_ids(idfiles.written_keys(spark, folder), folder).collect()
    assert Counter((r.doc_id, numbers(r)) for r in got) == Counter((r.doc_id, tuple(ids_of(r.text))) for r in rows.collect())
    long = spark.createDataFrame([(1, "Some words, again. " * 80_000), (2, "x" * 5000)], "doc_id long, text string")
    folder = idfiles.write_ids(long)
    assert {r.doc_id: numbers(r) for r in idfiles.read_ids(idfiles.written_keys(spark, folder), folder).collect()} == {r.doc_id: tuple(ids_of(r.text)) for r in long.collect()}
    empty = idfiles.write_ids(long.limit(0))
    assert idfiles.read_ids(idfiles.written_keys(spark, empty), empty).count() == 0 and idfiles.IdFiles(empty).get(1) is None
