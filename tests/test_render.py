"""Rendered documents: lists, marks, links, tables, and HTML that reads back as what it was made of."""

import pytest

from docloom.operators.render import render
from docloom.schema import BLOCK_COLUMNS
from docloom.sources import html

SCHEMA = "doc long, kind string, element_type string, content string, level int, encoding string, attributes map<string,string>, element_order int"
PAGE = """<h2>H <em>x</em></h2><p>first</p><ul><li>a <b>x</b> &lt;y&gt;</li><li>b<ol start="9"><li>n</li><li>m<ul><li>deep</li></ul></li></ol></li><li>c</li></ul><p>between</p>
<blockquote><p>q</p><ul><li>in q</li></ul></blockquote><p>see <a href="u?a=1&amp;b=&quot;2&quot;">l</a> <img src="s" alt="t"> e <code>k</code></p><pre>c &amp; d</pre><hr>
<table><thead><tr><th>h</th><th>i</th></tr></thead><tbody><tr><td>1|2</td><td>&lt;3</td></tr></tbody></table><p>end</p>"""


def table(spark, *rows):
    count = {}
    out = []
    for doc, kind, element, content, level, own in rows:
        out.append((doc, kind, element, content, level, "text", own, count.setdefault(doc, 0)))
        count[doc] += 1
    return spark.createDataFrame(out, SCHEMA)


def rendered(blocks, output):
    return {r.doc: r.rendered for r in render(blocks, output).collect()}


LISTS = [
    (1, "block", "list", None, 1, {"ordered": "true", "start": "9"}), (1, "block", "list_item", "nine", 2, {}), (1, "block", "list_item", None, 2, {}), (1, "inline", "text", "ten ", 3, {}), (1, "inline", "bold", "x y", 3, {}),
    (1, "inline", "text", "x ", 4, {}), (1, "inline", "italic", "y", 4, {}), (1, "block", "list", None, 3, {"ordered": "false"}), (1, "block", "list_item", "in & ten", 4, {}), (1, "block", "list_item", "eleven", 2, {}), (1, "block", "paragraph", "after", 1, {}),
    (2, "block", "list_item", "no list", 2, None), (2, "block", "paragraph", None, None, None), (2, "block", "heading", "a b", 1, {"heading_level": "3"}), (2, "inline", "text", "a ", 2, {}), (2, "inline", "link", "b", 2, {"href": 'u"'}),
    (3, "value", "string", "only metadata", 1, {"key": "title"}),
]


def test_lists_and_marks(spark):
    blocks = table(spark, *LISTS).repartition(3)
    assert rendered(blocks, "md") == {1: "9. nine\n10. ten **x *y***\n    - in & ten\n11. eleven\n\nafter", 2: '- no list\n\n### a [b](u")'}
    assert rendered(blocks, "html") == {
        1: '<ol start="9">\n<li>nine</li>\n<li>ten <strong>x <em>y</em></strong>\n\n<ul>\n<li>in &amp; ten</li>\n</ul></li>\n<li>eleven</li>\n</ol>\n\n<p>after</p>',
        2: '<li>no list</li>\n\n<p></p>\n\n<h3>a <a href="u&quot;">b</a></h3>',
    }
    assert rendered(blocks, "text") == {1: "nine\nten x y\nin & ten\neleven\n\nafter", 2: "no list\n\na b"}
    with pytest.raises(ValueError):
        render(blocks, "odd")
    assert render(table(spark, *LISTS).limit(0), "html").count() == 0


def test_tables(spark):
    cells = '{"headers":["a","b|c"],"rows":[["1",null],["<2>","x\\ny"]]}'
    blocks = table(spark, (1, "block", "table", cells, 1, {}), (2, "block", "table", '{"headers":[],"rows":[["1","2"]]}', 1, {}))
    assert rendered(blocks, "md") == {1: "| a | b\\|c |\n| --- | --- |\n| 1 |  |\n| <2> | x y |", 2: "|  |  |\n| --- | --- |\n| 1 | 2 |"}
    assert rendered(blocks, "html")[1] == "<table><thead><tr><th>a</th><th>b|c</th></tr></thead><tbody><tr><td>1</td><td></td></tr><tr><td>&lt;2&gt;</td><td>x\ny</td></tr></tbody></table>"
    assert rendered(blocks, "text") == {1: "a\tb|c\n1\t\n<2>\tx\ny", 2: "1\t2"}


def test_html_reads_back(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, ""), (3, "<ul>" + "<li>x<ul>" * 40 + "<li>y</li>" + "</ul></li>" * 40 + "</ul>")], "doc long, text string")
    blocks = html.read_html(pages, html="text")
    again = html.read_html(render(blocks, "html"), html="rendered")
    seen = lambda df: [tuple(r) for r in df.select("doc", *BLOCK_COLUMNS).orderBy("doc", "element_order").collect()]
    assert len(seen(blocks)) > 100 and seen(again) == seen(blocks)
