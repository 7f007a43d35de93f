"""What keeps the work of readers in proportion to their input: shuffles, and what a task holds at once."""

import json
from functools import lru_cache

import numpy as np
import pytest

from docloom.functions.batches import BATCH_BYTES
from docloom import file_queries, samples
from docloom.functions import tables, tokens
from docloom.operators.render import render
from docloom.sources import archives, html, interchange, lines, notebooks, prose, rtf
from pyspark.sql import functions as F


@pytest.mark.parametrize("name", ["org", "rst", "mediawiki", "textile", "latex", "markdown"])
def test_lines_are_shuffled_once_before_the_last_numbering(spark, name):
    docs = spark.createDataFrame([(1, "a *b* c")], "doc long, text string")
    plan = lines.read_lines(docs, name)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= (4 if name == "rst" else 3 if name in ("mediawiki", "latex") else 2)


def test_asts_are_taken_apart_one_at_a_time(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    long = '[{"t":"HorizontalRule"}' + ',{"t":"HorizontalRule"}' * 12_000 + "]"
    found = interchange.read_interchange(spark.createDataFrame([(1, long), (2, None), (3, long)], "doc long, text string"))
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) == BATCH_BYTES
    assert {(r["doc"], r["n"], r["least"], r["most"]) for r in found.groupBy("doc").agg(F.count("*").alias("n"), F.min("element_order").alias("least"), F.max("element_order").alias("most")).collect()} == {(1, 12_001, 0, 12_000), (3, 12_001, 0, 12_000)}


def test_inlines_asked_for_in_two_modes_are_taken_apart_once(monkeypatch):
    calls = []
    monkeypatch.setattr(interchange, "_kept_rows", lru_cache(8)(lambda text: calls.append(text) or [("inline", "text", "a", 1, "text", [], 0)]))
    assert interchange.inline_rows('[{"t":"Str","c":"a"}]') == interchange.inline_rows('[{"t":"Str","c":"a"}]')
    assert len(calls) == 1


@pytest.mark.parametrize("format", ["docx", "odt", "epub", "rtf"])
def test_containers_are_made_and_read_in_small_batches(spark, format):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    files = samples.sample_files(spark.createDataFrame([(1, "Ein \\{Satz} “mit” 𝔸\n\n\n\ncode  x y"), (2, None)], "doc long, text string"), format)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) == BATCH_BYTES
    blocks = rtf.read_rtf(files.select("doc", F.col("bytes").cast("string").alias("text"))) if format == "rtf" else archives.read_archives(files, format)
    assert "MapInArrow" in blocks._jdf.queryExecution().executedPlan().toString()
    said = [r["content"] for r in blocks.where("kind = 'block'").orderBy("element_order").collect()]
    assert said[0] == "Ein Satz “mit” 𝔸" and len(said) == 2 and said[1].split() == ["code", "x", "y"]


def test_embedded_tables_are_read_in_small_batches(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    tables.parse_embedded_blocks(spark.createDataFrame([], "doc long, kind string, element_type string, content string, level int, encoding string, attributes map<string,string>, element_order int"))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) == BATCH_BYTES


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("format", ["org", "html", "docx"])
def test_samples_are_made_without_a_shuffle(spark, format):
    docs = spark.createDataFrame([(1, "a\n\n b  c\n"), (2, None), (3, "  ")], "doc long, text string")
    made = samples.sample_files(docs, format) if format == "docx" else samples.sample_texts(docs, format)
    assert "Exchange" not in _plan(made)
    assert {r["doc"]: bool(r[1]) for r in made.collect()} == {1: True, 3: False}


def test_rst_lines_are_sorted_by_what_they_hang_on_once(spark):
    text = "Over\n====\n\nsub\n~~~~\n\nAgain\n=====\n\nIt says::\n\n      deep\n    code\n\nsaid [#]_ and [#]_\n\n.. [#] one\n\n   more\n\n.. [#] two\n"
    blocks = lines.read_lines(spark.createDataFrame([(1, text)], "doc long, text string"), "rst")
    assert _plan(blocks).count("Sort [") <= 8
    rows = blocks.orderBy("element_order").collect()
    assert [(r["content"], r["attributes"]["heading_level"]) for r in rows if r["element_type"] == "heading"] == [("Over", "1"), ("sub", "2"), ("Again", "1")]
    assert [r["content"] for r in rows if r["element_type"] == "code"] == ["  deep\ncode"]
    assert [r["content"] for r in rows if r["element_type"] == "note"] == ["one more", "two"]


def test_notebooks_are_parsed_once(spark):
    cells = notebooks.read_notebooks(spark.createDataFrame([(1, '{"cells":[{"cell_type":"code","source":"x"}],"metadata":{"title":"T"}}'), (2, "no"), (3, None)], "doc long, text string"))
    assert _plan(cells).count("from_json(StructField(cells") == 1
    assert [(r["doc"], r["kind"], r["content"]) for r in cells.orderBy("element_order").collect()] == [(1, "block", None), (1, "block", "x"), (1, "value", None), (1, "inline", "T")]


def test_pages_are_cut_once_and_laid_out_within_their_rows(spark):
    odd = "<table><tr><td>1</table></td>x</ul><hr/><nav id=a><li>no list<ul><pre>\n y </pre><br> <li> <li>b <b>c</b> </ul></nav>"
    blocks = html.read_html(spark.createDataFrame([(1, odd), (2, None), (3, odd)], "doc long, html string"))
    plan = _plan(blocks)
    assert plan.count("(?s)(<!--") == 1 and plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1
    rows = blocks.orderBy("doc", "element_order").collect()
    assert [(r["element_type"], r["content"], r["level"]) for r in rows if r["doc"] == 3] == [
        ("table", '{"headers":[],"rows":[["1"]]}', 1), ("paragraph", "x", 1), ("hr", None, 1), ("section", None, 1), ("paragraph", "no list", 2), ("code", " y", 2), ("paragraph", None, 2), ("text", "b ", 3), ("bold", "c", 3),
    ]
    assert [r[1:] for r in rows if r["doc"] == 1] == [r[1:] for r in rows if r["doc"] == 3] and {r["doc"] for r in rows} == {1, 3}


def test_records_of_pages_are_those_of_each_page(spark):
    rng = np.random.default_rng(1)
    pages = [rng.integers(0, tokens.FIRST_TAG + 8 * (len(tokens.NAMES) + 1), n) for n in (40, 0, 3, 1000)]
    made = tokens._records(np.concatenate(pages), np.array([len(p) for p in pages])).to_pylist()
    assert made == [tokens._records(p, np.array([len(p)])).to_pylist()[0] for p in pages] and len(made[3]) > 50 and made[1] == []


def test_pages_read_back_are_shuffled_and_sorted_few_times(spark):
    page = "<h1>a <b>b</b></h1><ol><li>c<ul><li>d</li></ul></li><li>e</li></ol><title>T</title><p>&lt;f</p>"
    blocks = html.read_html(spark.createDataFrame([(1, page)], "doc long, html string"))
    again = html.read_html(render(blocks, "html"), html="rendered")
    assert _plan(render(blocks, "html")).count("Sort [") <= 3 and _plan(again).count("Exchange hashpartitioning") <= 4
    seen = lambda df: [tuple(r)[1:] for r in df.where("kind <> 'value'").orderBy("element_order").collect()]
    assert len(seen(blocks)) == 9 and seen(again) == seen(blocks)


def test_ast_files_are_smaller_than_their_texts_and_not_sorted(spark, tiny, tmp_path, monkeypatch):
    monkeypatch.setattr(file_queries, "new_folder", lambda _: str(tmp_path / "asts"))
    found = file_queries.ast_files(spark, tiny)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    runs = spark._jsparkSession.sharedState().statusStore().executionsList()
    plan = next(p for k in reversed(range(runs.size())) if "ArrowEvalPython" in (p := runs.apply(k).physicalPlanDescription()))
    assert plan.index("WriteFiles") < plan.index("ArrowEvalPython") < plan.index("Sort")
    written = sum(f.stat().st_size for f in (tmp_path / "asts").glob("doc=*/part-*"))
    texts = spark.read.parquet(f"{tiny}/documents.parquet").where("text is not null").select("doc_id", "text")
    assert 0 < written < texts.agg(F.sum(F.octet_length("text"))).first()[0]
    columns = ["doc", "element_order", "element_type", "content"]
    want = prose.read_prose(file_queries._bundles(spark, tiny)).select(columns)
    assert sorted(map(tuple, found.select(columns).collect())) == sorted(map(tuple, want.collect()))


def test_paragraphs_of_words_are_written_at_once(monkeypatch):
    row = lambda what, content, level=1: {"kind": "block", "element_type": what, "content": content, "level": level, "encoding": "text", "attributes": [], "element_order": 0}
    odd = ["a b", 'q" \\n é\t𝔸', "a  b", " a", "a ", "a\nb", "", None, " "]
    rows = [*(row("paragraph", x) for x in odd), row("blockquote", None), row("plain", "in it", 2), row("plain", "x y")]
    trees = json.loads(interchange.ast_parts(rows)["blocks"])
    assert trees == interchange._block_ast(rows) and [b["t"] for b in trees] == ["Para"] * len(odd) + ["BlockQuote", "Plain"]
    calls = []
    monkeypatch.setattr(interchange, "_words", lambda text: calls.append(text) or [])
    assert interchange.ast_parts([row("paragraph", "a b c")]) == {"meta": "{}", "blocks": '[{"t": "Para", "c": [{"t": "Str", "c": "a"}, {"t": "Space"}, {"t": "Str", "c": "b"}, {"t": "Space"}, {"t": "Str", "c": "c"}]}]'}
    assert not calls
