"""Registered queries against their SQL, and the pipeline against its operators."""

import re

import duckdb
import numpy as np
import pytest
import sentencepiece

import corpus_pipeline
from docloom.llm import decontaminate, fingerprints, jaccard, language, licenses, pieces, quality, queries, secrets, substrings

from .helpers import ODD, shingles
from .test_classifiers import grams_by_hand
from .test_near_copies import brute_groups
from .test_scans import brute_leaks, normal

TABLES = ("documents", "labels", "benchmark", "conversations")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, tiny, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{tiny}/{t}.parquet'")
    want = con.execute(queries.ORACLES[name]).df()
    got = queries.QUERIES[name](spark, tiny).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    as_rows = lambda df: sorted(map(tuple, df[columns].astype(str).values.tolist()))
    assert as_rows(got) == as_rows(want)


def spans_by_hand(text):
    """The union of all rules' matches that count, as sorted runs."""
    found = []
    for rule in secrets.RULES:
        found += [m.span() for m in re.finditer(rule.pattern, text) if len(m[rule.group]) >= rule.least]
    out = []
    for a, b in sorted(found):
        if out and a < out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def redacted_by_hand(text):
    at, parts = 0, []
    for a, b in spans_by_hand(text):
        parts += [text[at:a], "[secret]"]
        at = b
    return "".join([*parts, text[at:]])


def leaks_by_hand(text, items):
    """Whether an item leaks; only pairs with enough words in common are looked at place by place."""
    have = set(normal(text))
    likely = [i for i in items if len(have & set(i)) >= 0.75 * min(10, len(set(i)))]
    return bool(brute_leaks(text, likely))


def test_pipeline_equals_brute_force(spark, tiny):
    """Each stage against plain Python, clean documents included, and the whole against its stages."""
    source = spark.read.parquet(f"{tiny}/documents.parquet")
    names = source.columns
    docs, tables = source, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before, docs = docs, jaccard.saved(stage(spark, docs, tiny))
        assert docs.columns == names and docs.dtypes == before.dtypes, k
        tables.append({r.doc_id: r for r in docs.collect()})
    all_rows = {r.doc_id: r for r in source.collect()}
    model = language.fit(source)
    known = set()
    for i, r in all_rows.items():
        x = grams_by_hand(r.text) * model.idf
        near = (model.weights / model.idf[:, None]).T @ x / max(np.linalg.norm(x), 1e-12)
        floor = model.least[model.owner[near.argmax()]] * np.sqrt(min(1, len((r.text or "").encode()) / language.FULL_BYTES))
        if any(c.isalpha() for c in r.text or "") and near.max() >= floor:
            known.add(i)
    assert set(tables[0]) == known and all(tables[0][i] == all_rows[i] for i in known)
    groups = brute_groups([(i, r.text) for i, r in tables[0].items()])
    assert set(tables[1]) == {c for _, n, c in groups if n} | {i for i, n, _ in groups if not n}
    items = [normal(r.text) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()]
    assert set(tables[2]) == {i for i, r in tables[1].items() if not leaks_by_hand(r.text, items)}
    assert {i: (r.text, r.n_chars) for i, r in tables[3].items()} == {i: (t := redacted_by_hand(r.text), len(t)) for i, r in tables[2].items()}
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, tiny).collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    assert {i: (list(r.piece_ids), r.n_pieces) for i, r in out.items()} == {i: (ids := library.encode(r.text), len(ids)) for i, r in tables[3].items()}
    assert len(known) > 190 and len(tables[1]) < len(known) and len(tables[2]) < len(tables[1])


def test_stages_bear_odd_rows(spark, tiny):
    """Nulls in every column, empty and long texts, repeated rows, clashing columns and empty tables."""
    kind = "doc_id long, text string, lang string, source string, n_chars long, language string, leaks string, redact_spans int, best_id string, set_key long, rule_mask int, folded string, piece_ids string"
    some = [(*r[:3], None, len(r[1] or ""), "l", None, 1, "b", 2, 3, "f", "p") for r in ODD] + [(None,) * 13, (90, "password=hunter2secret " * 3000, "en", "s", 1, *(None,) * 8)]
    for rows in (some, []):
        docs = spark.createDataFrame(rows, kind)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, docs, tiny)
            assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
            assert len(kept.collect()) <= len(rows)
        clean = corpus_pipeline.without_secrets(spark, docs, tiny).collect()
        assert len(clean) == len(rows) and not any("hunter2" in (r.text or "") for r in clean)
        assert corpus_pipeline.token_ids(spark, docs, tiny).count() == len(rows)
    assert all(r.text is None or any(c.isalpha() for c in r.text) for r in corpus_pipeline.known_languages(spark, spark.createDataFrame(some, kind), tiny).collect())


LONG = " ".join(f"word{k % 977} and token: secret{k:08d} des" for k in range(45_000))  # above a MB, as one line


@pytest.mark.parametrize("name", ["language", "quality", "license", "pieces", "leaks", "secrets", "repeats", "fingerprint", "groups"])
def test_texts_above_a_megabyte(spark, name):
    """Texts of many slices, two of them near copies, beside short ones."""
    rows = [(1, LONG, "en"), (2, LONG.replace("word5 ", "word6 "), "en"), (3, "short text", "en"), (4, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(LONG) > 1 << 20
    if name == "language":
        assert {r.doc_id: r.language for r in language.identify(docs, language.fit(docs)).collect()} == {1: "en", 2: "en", 3: "en", 4: "und"}
    elif name == "quality":
        labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0)], "doc_id long, quality int")
        assert quality.classify(docs, quality.fit(docs, labels)).count() == 4
    elif name == "license":
        assert licenses.scan(docs).where("license is null").count() == 4
    elif name == "pieces":
        got = {r.doc_id: r for r in pieces.decode_column(pieces.encode_column(docs)).collect()}
        assert all(got[i].decoded == (t or "") for i, t, _ in rows)
    elif name == "leaks":
        bench = spark.createDataFrame([("gsm-1", " ".join(LONG.split(" ")[200_000:200_020])), ("gsm-2", "none of these words is in any of the texts at all here")], "item_id string, text string")
        assert [(r.doc_id, [x.item_id for x in r.leaks]) for r in decontaminate.find_leaks(docs, bench).orderBy("doc_id").collect()] == [(1, ["gsm-1"]), (2, ["gsm-1"]), (3, []), (4, [])]
    elif name == "secrets":
        got = {r.doc_id: r for r in secrets.scan(docs).collect()}
        assert {r.doc_id: r.text for r in secrets.redact(docs).collect()} == {i: t and redacted_by_hand(t) for i, t, _ in rows}
        assert [[s.start, s.end] for s in got[1].secrets] == spans_by_hand(LONG) and len(got[1].secrets) == 45_000
    elif name == "repeats":
        got = {r.doc_id: r for r in substrings.remove_repeats(docs).collect()}
        assert got[1].n_removed > 0.9 * got[1].n_bytes and got[3].n_removed == 0 and got[4].n_bytes == 0
    elif name == "fingerprint":
        got = {r.doc_id: r for r in fingerprints.compared_with_next(docs).collect()}
        a, b = shingles(LONG), shingles(rows[1][1])
        assert abs(got[1].near_next - len(a & b) / len(a | b)) < 0.02 and got[1].n_chars == len(LONG)
    else:
        assert {r.id: r.component for r in jaccard.groups(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_many_items_with_one_stem(spark):
    """Thousands of benchmark items that share a stem cost no more than their words."""
    stem = " ".join(f"s{k}" for k in range(12))
    items = spark.createDataFrame([(k, f"{stem} {' '.join(f'u{k}x{j}' for j in range(12))}") for k in range(5000)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"before {stem} after"), (2, "nothing")], "doc_id long, text string")
    got = {r.doc_id: len(r.leaks) for r in decontaminate.find_leaks(docs, items).collect()}
    assert got == {1: 5000, 2: 0}
