"""Readers, the registry and converters on small documents."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from docloom.functions.tables import column_types, parse_embedded, parse_embedded_blocks, read_table
from docloom.functions.text import class_slug, glob_pattern, like_pattern, slug
from docloom.operators import structure as st
from docloom.schema import BLOCK
from docloom.sources import archives, compact, interchange, lines, markups, notebooks, prose
from docloom.sources.html import read_html
from docloom.sources.lines import read_lines
from docloom.sources.registry import REGISTRY, extension_of, read_data, read_documents

ORG = """#+TITLE: My doc
* First *head*
para one
goes on with *bold* text

- item a
  - nested
- item b

#+BEGIN_SRC python
x = 1

y = 2
#+END_SRC
| a | b |
|---+---|
| 1 | 2 |
** Sub
-----
1. one
"""


def rows(spark, text, format):
    out = lines.read_lines(spark.createDataFrame([("d", text)], "doc string, text string"), format).orderBy("element_order")
    return [(r.kind, r.element_type, r.content, r.level) for r in out.collect()]


def test_org(spark):
    got = rows(spark, ORG, "org")
    assert got[:7] == [("block", "heading", "First head", 1), ("inline", "text", "First ", 2), ("inline", "bold", "head", 2), ("block", "paragraph", None, 1), ("inline", "text", "para one goes on with ", 2), ("inline", "bold", "bold", 2), ("inline", "text", " text", 2)]
    assert ("block", "code", "x = 1\n\ny = 2", 1) in got
    assert ("block", "table", '{"headers":["a","b"],"rows":[["1","2"]]}', 1) in got
    assert [g[1:] for g in got if g[1] in ("list", "list_item")] == [("list", None, 1), ("list_item", "item a", 2), ("list", None, 3), ("list_item", "nested", 4), ("list_item", "item b", 2), ("list", None, 1), ("list_item", "one", 2)]
    assert got[-2:] == [("value", "inlines", None, 1), ("inline", "text", "My doc", 2)]
    more = "#+OPTIONS: x\n* A\n:PROPERTIES:\n:CUSTOM_ID: own\n:END:\n#+BEGIN_QUOTE\nsaid\n#+END_QUOTE\n- term :: def\n| 1 | 2 |\n- a\n  goes on\n"
    out = lines.read_lines(spark.createDataFrame([("d", more)], "doc string, text string"), "org").orderBy("element_order").collect()
    assert [(r.element_type, r.content, r.level) for r in out] == [("raw", "#+OPTIONS: x", 1), ("heading", "A", 1), ("blockquote", None, 1), ("paragraph", "said", 2), ("list", None, 1), ("list_item", "term", 2), ("list_item", "def", 2), ("table", '{"headers":[],"rows":[["1","2"]]}', 1), ("list", None, 1), ("list_item", "a goes on", 2)]
    assert out[0].attributes == {"format": "org"} and out[1].attributes["id"] == "own" and out[5].attributes == {"role": "term"}


RST = """Top
---

para ``code`` and::

    literal
      deep

Sub
===

.. note:: careful
   body

.. code-block:: python

   x = 1

.. figure:: b.png

   Caption

.. gone

:Author: me

term
    its definition

* a
  goes on

Again
-----

=====  =====
A      B
=====  =====
1      2
=====  =====

+---+---+
| h | i |
+===+===+
| 1 | 2 |
| x |   |
+---+---+
"""


def test_rst(spark):
    out = lines.read_lines(spark.createDataFrame([("d", RST)], "doc string, text string"), "rst")
    heads = out.where("element_type = 'heading'").orderBy("element_order").select("content", st.heading_rank().alias("rank")).collect()
    assert [tuple(h) for h in heads] == [("Top", 1), ("Sub", 2), ("Again", 1)]
    got = [(r.element_type, r.content, r.level) for r in out.orderBy("element_order").collect()]
    for row in (("code", "literal\n  deep", 1), ("div", "careful", 1), ("paragraph", "body", 2), ("code", "x = 1", 1), ("figure", None, 1), ("caption", None, 2), ("plain", "Caption", 3), ("list_item", "Author", 2), ("list_item", "me", 2), ("list_item", "term", 2), ("list_item", "its definition", 2), ("list_item", "a goes on", 2)):
        assert row in got, row
    assert ("table", '{"headers":["A","B"],"rows":[["1","2"]]}', 1) in got and ("table", '{"headers":["h","i"],"rows":[["1 x","2"]]}', 1) in got
    assert not any("gone" in (c or "") for _, c, _ in got)


def test_other_markups(spark):
    wiki = "== Head ==\ntext '''bold''' and [[Page|link]]<ref name=\"r\">why</ref>\n* a\n** b\n{|\n! x !! y\n|-\n| 1 || 2\n|}\n! no table\n<!-- gone -->\n; t\n: d\n{{Box\n| a = 1\n}}\n[[File:a.png|thumb|Cap]]\n__TOC__\n code\n"
    got = rows(spark, wiki, "mediawiki")
    for row in (("block", "table", '{"headers":["x","y"],"rows":[["1","2"]]}', 1), ("inline", "bold", "bold", 2), ("inline", "link", "link", 2), ("inline", "note", "why", 2), ("block", "list_item", "b", 4), ("block", "paragraph", "! no table", 1), ("block", "list_item", "t", 2), ("block", "raw", "{{Box\n| a = 1\n}}", 1), ("block", "caption", None, 2), ("block", "raw", "__TOC__", 1), ("block", "code", "code", 1)):
        assert row in got, row
    assert not any("gone" in (g[2] or "") for g in got)
    tile = rows(spark, 'h2(c#i). Head\n\n* a\n# b\n\nbq. said\n\n|_. a|_. b|\n|1|2|\n\n"site":http://x.y and @code@ !i.png(alt)!\n\n- t := d\n\nbc.. z\n\nmore\n\np. back\n\n<div>\nraw\n</div>\n', "textile")
    for row in (("block", "blockquote", None, 1), ("inline", "link", "site", 2), ("inline", "image", "alt", 2), ("block", "list_item", "t", 2), ("block", "code", "z\n\nmore", 1), ("block", "paragraph", "back", 1), ("block", "raw", "<div>\nraw\n</div>", 1), ("block", "table", '{"headers":["a","b"],"rows":[["1","2"]]}', 1)):
        assert row in tile, row
    assert tile[0] == ("block", "heading", "Head", 1) and sum(r[1] == "list" for r in tile) == 3
    source = r"""\documentclass{book}
\title{T}
\section{One}\label{own}
Our R\&D grew. Some \textbf{bold \emph{it}}. % no
\begin{itemize}
\item a
  goes on
\begin{enumerate}
\item n
\end{enumerate}
\end{itemize}
\begin{itemize}
\item b
\end{itemize}
\begin{description}
\item[term] def
\end{description}
\begin{tabular}{ll}
\hline
h & R\&D \\
\hline
1 & 2 \\
\end{tabular}
\begin{verbatim}
  raw % x
\end{verbatim}
\begin{theorem}
inside
\end{theorem}
\begin{equation}
x
\end{equation}
"""
    out = lines.read_lines(spark.createDataFrame([("d", source)], "doc string, text string"), "latex").orderBy("element_order").collect()
    tex = [(r.kind, r.element_type, r.content, r.level) for r in out]
    assert tex[0] == ("block", "heading", "One", 1) and out[0].attributes == {"heading_level": "2", "id": "own"}
    for row in (("inline", "text", "Our R&D grew. Some ", 2), ("inline", "italic", "it", 3), ("block", "list_item", "a goes on", 2), ("block", "list_item", "n", 4), ("block", "table", '{"headers":["h","R&D"],"rows":[["1","2"]]}', 1), ("block", "code", "  raw % x", 1), ("block", "div", None, 1), ("block", "paragraph", "inside", 2), ("value", "inlines", None, 1)):
        assert row in tex, row
    assert [r.attributes["list_type"] for r in out if r.element_type == "list"] == ["bullet", "ordered", "bullet", "definition"] and not any(c == "x" for _, _, c, _ in tex)
    md = "Title\n=====\n\n![alt](a.png) **bold *it***\n\n> said\n\n~~~py\n# no\n~~~\n\n<b>raw</b>\n\n1. x\n   goes on\n"
    down = rows(spark, md, "markdown")
    for row in (("block", "heading", "Title", 1), ("inline", "image", "alt", 2), ("inline", "italic", "it", 3), ("block", "blockquote", None, 1), ("block", "code", "# no", 1), ("block", "raw", "<b>raw</b>", 1), ("block", "list_item", "x goes on", 2)):
        assert row in down, row


def test_null_and_empty_documents(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " \n\n")], "doc long, text string")
    for format in markups.FORMATS:
        assert lines.read_lines(docs, format).count() == 0
    assert prose.read_prose(docs).count() == 0 and notebooks.read_notebooks(docs).count() == 0 and prose.read_pages(docs, html="text").count() == 0


def blocks(spark, *some):
    made = [(r[0], r[1], r[2], r[3], r[4], "text", r[5] if len(r) > 5 else {}, k) for k, r in enumerate(some)]
    return spark.createDataFrame(made, f"doc long, {', '.join(f'{f.name} {f.dataType.simpleString()}' for f in BLOCK.fields)}")


def test_metadata_subtrees_are_not_body(spark):
    b = blocks(spark, (1, "block", "heading", "H", 1), (1, "block", "paragraph", "x", 1), (1, "value", "inlines", None, 1, {"key": "author"}), (1, "inline", "text", "me", 2), (1, "block", "metadata", "m", 1), (1, "block", "paragraph", "end", 1))
    assert [r.content for r in st.body(b).orderBy("element_order").collect()] == ["H", "x", "end"]
    assert st.search_sections(b, "me").count() == 0
    assert [r.content for r in st.search_sections(b, "x end").orderBy("element_order").collect()] == ["H", "x", "end"]


def test_match_modes(spark):
    b = blocks(spark, (1, "block", "heading", "100% sure", 1, {"heading_level": "1"}), (1, "block", "heading", "100 things", 1, {"heading_level": "2", "id": "x"}), (1, "block", "heading", "other", 1, {"heading_level": "1"}))
    count = lambda *a: st.section(b, *a).count()
    assert count("100\\%", "contains") == 2 and count("100*s", "glob") == 2 and count("X", "contains") == 0 and count("x") == 1 and count("nothing") == 0
    with pytest.raises(ValueError):
        st.section(b, "x", "fuzzy")
    with pytest.raises(ValueError):
        st.search_sections(b, "x", "exact")
    assert glob_pattern("a*?_%") == "a%_\\_\\%" and like_pattern("back\\slash").endswith("backslash")


def test_preamble_and_empty_pattern(spark):
    b = blocks(spark, (1, "block", "hr", None, 1), (1, "block", "paragraph", "pre", 1), (1, "block", "heading", "H", 1), (2, "block", "paragraph", "no heading", 1))
    assert st.search_sections(b, "").count() == 4 and st.search_sections(b, "PRE").count() == 2 and st.search_sections(b, "no head").count() == 1


def test_repair(spark):
    b = blocks(spark, (1, "block", "list_item", "a", 3), (1, "inline", "text", "deep", 9), (1, "block", "paragraph", "p", 3))
    got = [(r.element_type, r.level) for r in st.repair(b).orderBy("element_order").collect()]
    assert got[-1][1] == 1 and max(x[1] for x in got) <= 3 and [r[1] for r in got][0] == 1


def test_slugs(spark):
    cases = {"Hello World": "hello-world", "1. Introduction": "introduction", "snake_case Field guide": "snake_case-field-guide", "": "section", "123": "section"}
    got = {r.t: r.s for r in spark.createDataFrame([(c,) for c in cases], "t string").select("t", slug(F.col("t")).alias("s")).collect()}
    assert got == cases


def test_embedded_formats():
    assert parse_embedded('a,b\n"x ""y""",2\n\n', "csv") == ('{"headers":["a","b"],"rows":[["x \\"y\\"","2"]]}', None)
    assert parse_embedded('[{"a": 1.50, "b": null}, {"c": [1, "x"]}]', "json")[0] == '{"headers":["a","b","c"],"rows":[["1.50","",""],["","","[1,\\"x\\"]"]]}'
    assert parse_embedded('{"a":1}\n\n{"a":2}', "jsonl")[0] == '{"headers":["a"],"rows":[["1"],["2"]]}'
    for bad, format in (("a,b\n1\n", "csv"), ("[1]", "json"), ("{", "jsonl"), ('"open', "csv"), ("x", "xml")):
        assert parse_embedded(bad, format)[0] is None and parse_embedded(bad, format)[1]


def test_tables(spark):
    csv = "id,x,x,when,ok,code\n1,1.5,a,2024-01-02,true,007\n2,,b,2024-02-03,false,12\n"
    b = blocks(spark, (1, "block", "code", csv, 1, {"language": "csv"}), (1, "block", "code", "a,b\n1", 1, {"language": "csv"}))
    once = parse_embedded_blocks(b)
    twice = parse_embedded_blocks(once)
    assert [r.element_type for r in once.orderBy("element_order").collect()] == ["table", "code"]
    shown = lambda df: sorted(map(str, df.withColumn("attributes", F.array_sort(F.map_entries("attributes"))).collect()))
    assert shown(once) == shown(twice)
    assert {(r.name, r.type) for r in column_types(once).collect()} == {("id", "bigint"), ("x", "double"), ("column_3", "string"), ("when", "date"), ("ok", "boolean"), ("code", "string")}
    table = read_table(once, 1, 0)
    assert [f.dataType.simpleString() for f in table.schema.fields] == ["bigint", "double", "string", "date", "boolean", "string"] and table.count() == 2
    with pytest.raises(ValueError):
        read_table(once, 1, 7)


def test_compact_errors(spark):
    for bad in ('{"t":"P"}', '{"l":1}', '{"t":"!","l":1}', '{"t":"P","l":1,"a":{"zz":"1"}}', "[1]"):
        with pytest.raises(Exception, match="compact lines"):
            compact.read_compact(spark.createDataFrame([(1, 0, bad)], "doc long, n int, line string")).collect()
    good = ['{"@":"4.2.0"}', "", '{"t":"H","c":"x","l":1,"a":{"h":"2","i":"x"},"m":{"own":"1"}}', '{"t":"block:odd","l":2,"e":"j"}']
    got = compact.read_compact(spark.createDataFrame([(1, k, x) for k, x in enumerate(good)], "doc long, n int, line string")).orderBy("element_order").collect()
    assert [(r.element_type, r.attributes, r.encoding) for r in got] == [("heading", {"heading_level": "2", "id": "x", "own": "1"}, "text"), ("odd", {}, "json")]


def test_interchange(spark):
    para = lambda *words: {"t": "Para", "c": [x for k, w in enumerate(words) for x in ([{"t": "Space"}] if k else []) + [{"t": "Str", "c": w}]]}
    ast = {
        "pandoc-api-version": [1, 23, 1],
        "meta": {"title": {"t": "MetaInlines", "c": [{"t": "Str", "c": "T"}]}},
        "blocks": [
            {"t": "Header", "c": [2, ["id", ["k"], []], [{"t": "Str", "c": "H"}]]}, para("a", "b"), {"t": "Para", "c": [{"t": "Str", "c": "x"}, {"t": "Strong", "c": [{"t": "Str", "c": "y"}]}, {"t": "Link", "c": [["", [], []], [{"t": "Str", "c": "l"}], ["u", ""]]}]},
            {"t": "BulletList", "c": [[{"t": "Plain", "c": [{"t": "Str", "c": "i"}]}], [para("p"), para("q")]]}, {"t": "BlockQuote", "c": [para("said")]}, {"t": "CodeBlock", "c": [["", ["py"], []], "z"]}, {"t": "HorizontalRule"}, {"t": "Odd", "c": 1},
        ],
    }
    docs = spark.createDataFrame([(1, json.dumps(ast)), (2, None)], "doc long, text string")
    read = interchange.read_interchange(docs)
    kinds = [r.element_type for r in read.orderBy("element_order").collect()]
    assert kinds == ["heading", "paragraph", "paragraph", "text", "bold", "link", "list", "list_item", "list_item", "paragraph", "paragraph", "blockquote", "paragraph", "code", "hr", "generic", "inlines", "text"]
    back = json.loads(interchange.write_interchange(read).first().text)
    assert back["blocks"] == ast["blocks"]
    deep = {"t": "Para", "c": []}
    for _ in range(140):
        deep = {"t": "BlockQuote", "c": [deep]}
    with pytest.raises(ValueError, match="deeper"):
        interchange.to_rows(json.dumps({"blocks": [deep]}))


def in_order(blocks):
    return [(r.kind, r.element_type, r.content, r.level, {k: v for k, v in r.attributes.items() if k not in ("ordered", "start", "number_style", "number_delim", "id")}) for r in blocks.orderBy("element_order").collect()]


def zipped(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as zf:
        for name, text in members.items():
            zf.writestr(name, text)
    return out.getvalue()


def test_docx(spark):
    names = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:wp="x"'
    p = lambda inner, pr="": f"<w:p><w:pPr>{pr}</w:pPr>{inner}</w:p>"
    t = lambda text, pr="": f'<w:r><w:rPr>{pr}</w:rPr><w:t xml:space="preserve">{text}</w:t></w:r>'
    item = lambda level, number: f'<w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="{number}"/></w:numPr>'
    body = (
        p(t("Head"), '<w:pStyle w:val="H1"/>') + p(t("Sub"), '<w:outlineLvl w:val="1"/>') + p(t("one ") + t("bold", "<w:b/>") + t(" not", '<w:b w:val="0"/>') + '<w:del><w:r><w:delText>gone</w:delText></w:r></w:del><w:hyperlink r:id="l"><w:r><w:t>site</w:t></w:r></w:hyperlink><w:r><w:footnoteReference w:id="2"/></w:r>')
        + p(t("a"), item(0, 1)) + p(t("b"), item(1, 1)) + p(t("c"), item(0, 1)) + p(t("no item"), item(0, 0)) + p(t("q"), '<w:ind w:left="720"/>') + p(t("x = 1"), '<w:pStyle w:val="Code"/>') + p(t("y = 2"), '<w:pStyle w:val="Code"/>') + p("")
        + "<w:tbl><w:tr><w:trPr><w:tblHeader/></w:trPr><w:tc>" + p(t("h")) + "</w:tc><w:tc>" + p(t("i")) + p(t("j")) + "</w:tc></w:tr><w:tr><w:tc>" + p(t("1")) + "</w:tc><w:tc>" + p(t("2")) + "</w:tc></w:tr></w:tbl>"
        + p('<w:r><w:drawing><wp:docPr descr="alt"/><a:blip r:embed="i"/></w:drawing></w:r>') + p(t("styled"), '<w:pStyle w:val="Own"/>')
    )
    style = lambda i, name: f'<w:style w:styleId="{i}"><w:name w:val="{name}"/></w:style>'
    content = zipped({
        "word/document.xml": f"<w:document {names}><w:body>{body}</w:body></w:document>", "word/styles.xml": f"<w:styles {names}>{style('H1', 'heading 1')}{style('Code', 'Source Code')}{style('Own', 'My Style')}</w:styles>",
        "word/numbering.xml": f'<w:numbering {names}><w:abstractNum w:abstractNumId="7"><w:lvl w:ilvl="0"><w:numFmt w:val="bullet"/></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="decimal"/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="7"/></w:num></w:numbering>',
        "word/_rels/document.xml.rels": '<R><R Id="l" Target="http://x.y"/><R Id="i" Target="media/i.png"/></R>', "word/footnotes.xml": f'<w:footnotes {names}><w:footnote w:id="0" w:type="separator"><w:p/></w:footnote><w:footnote w:id="2">{p(t("foot"))}</w:footnote></w:footnotes>',
        "docProps/core.xml": '<c xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>T</dc:title><dc:creator>Me</dc:creator></c>',
    })
    got = in_order(archives.read_archives(spark.createDataFrame([("d", bytearray(content)), ("n", None)], "doc string, bytes binary"), "docx"))
    assert [g[:4] for g in got] == [
        ("block", "heading", "Head", 1), ("block", "heading", "Sub", 1), ("block", "paragraph", None, 1), ("inline", "text", "one ", 2), ("inline", "bold", "bold", 2), ("inline", "text", " not", 2), ("inline", "link", "site", 2), ("inline", "note", "foot", 2),
        ("block", "list", None, 1), ("block", "list_item", "a", 2), ("block", "list", None, 3), ("block", "list_item", "b", 4), ("block", "list_item", "c", 2), ("block", "paragraph", "no item", 1), ("block", "blockquote", None, 1), ("block", "paragraph", "q", 2), ("block", "code", "x = 1\ny = 2", 1),
        ("block", "table", '{"headers":["h","i j"],"rows":[["1","2"]]}', 1), ("block", "paragraph", None, 1), ("inline", "image", "alt", 2), ("block", "paragraph", "styled", 1), ("value", "string", "T", 1), ("value", "string", "Me", 1),
    ]
    assert got[6][4] == {"href": "http://x.y"} and got[10][4] == {"list_type": "ordered"} and got[19][4] == {"src": "media/i.png", "alt": "alt"} and got[20][4] == {"class": "my-style"} and got[-1][4] == {"key": "author"}


def test_odt(spark):
    names = " ".join(f'xmlns:{k}="urn:oasis:names:tc:opendocument:xmlns:{v}:1.0"' for k, v in (("office", "office"), ("text", "text"), ("style", "style"), ("table", "table"), ("fo", "xsl-fo-compatible"), ("draw", "drawing"))) + ' xmlns:xlink="http://www.w3.org/1999/xlink"'
    item = lambda inner: f"<text:list-item>{inner}</text:list-item>"
    body = (
        '<text:h text:outline-level="2">Head</text:h><text:p>a<text:s text:c="2"/>b <text:span text:style-name="B">bold</text:span><text:a xlink:href="u">l</text:a><text:note text:id="n1"><text:note-citation>1</text:note-citation><text:note-body><text:p>foot</text:p></text:note-body></text:note></text:p>'
        f'<text:list text:style-name="L">{item("<text:p>i</text:p><text:list>" + item("<text:p>n</text:p>") + "</text:list>")}</text:list><text:p text:style-name="Q">said</text:p><text:p text:style-name="Preformatted_20_Text">x</text:p><text:p text:style-name="Preformatted_20_Text">y</text:p>'
        '<table:table><table:table-row><table:table-cell><text:p>1 <text:span text:style-name="B">b</text:span></text:p></table:table-cell></table:table-row></table:table><text:p><draw:frame><draw:image xlink:href="Pictures/i.png"/></draw:frame></text:p>'
    )
    styles = '<style:style style:name="B"><style:text-properties fo:font-weight="bold"/></style:style><style:style style:name="Q" style:parent-style-name="Quotations"/><text:list-style style:name="L"><text:list-level-style-bullet text:level="1"/><text:list-level-style-number text:level="2"/></text:list-style>'
    content = zipped({"content.xml": f"<o {names}><office:automatic-styles>{styles}</office:automatic-styles><office:body><office:text>{body}</office:text></office:body></o>", "meta.xml": '<m xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>T</dc:title></m>'})
    got = in_order(archives.read_archives(spark.createDataFrame([("d", bytearray(content))], "doc string, bytes binary"), "odt"))
    assert [g[:4] for g in got] == [
        ("block", "heading", "Head", 1), ("block", "paragraph", None, 1), ("inline", "text", "a  b ", 2), ("inline", "bold", "bold", 2), ("inline", "link", "l", 2), ("inline", "note", "foot", 2), ("block", "list", None, 1), ("block", "list_item", "i", 2), ("block", "list", None, 3), ("block", "list_item", "n", 4),
        ("block", "blockquote", None, 1), ("block", "paragraph", "said", 2), ("block", "code", "x\ny", 1), ("block", "table", '{"headers":[],"rows":[["1 b"]]}', 1), ("block", "paragraph", None, 1), ("inline", "image", None, 2), ("value", "string", "T", 1),
    ]
    assert got[8][4] == {"list_type": "ordered"}


def test_epub(spark):
    page = '<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><body><h1 id="one">One</h1><p>a <span class="bo">bold</span> <a href="../t.xhtml">l</a><img src="../i%20x.png" alt="alt"/></p><ul><li><p>one</p><p>more</p></li><li>two<ol><li>n</li></ol></li></ul><blockquote><p>said</p></blockquote><pre>x\n  y</pre><table><tr><th>h</th></tr><tr><td>1</td></tr></table><section epub:type="chapter"><p>in</p></section><div></div><dl><dt>t</dt><dd>d</dd></dl><hr/></body></html>'
    content = zipped({
        "META-INF/container.xml": '<c><rootfile full-path="x/p.opf"/></c>',
        "x/p.opf": '<package xmlns="i" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>Book</dc:title></metadata><manifest><item id="c" href="s.css" media-type="text/css"/><item id="a" href="t/my%20a.xhtml"/></manifest><spine><itemref idref="a"/></spine></package>',
        "x/t/my a.xhtml": page, "x/s.css": "span.bo { font-weight: 700 } /* p.it { font-style: italic } */",
    })
    got = in_order(archives.read_archives(spark.createDataFrame([("d", bytearray(content))], "doc string, bytes binary"), "epub"))
    assert [g[:4] for g in got] == [
        ("block", "heading", "One", 1), ("block", "paragraph", None, 1), ("inline", "text", "a ", 2), ("inline", "bold", "bold", 2), ("inline", "text", " ", 2), ("inline", "link", "l", 2), ("inline", "image", "alt", 2), ("block", "list", None, 1), ("block", "list_item", "one", 2), ("block", "paragraph", "more", 3),
        ("block", "list_item", "two", 2), ("block", "list", None, 3), ("block", "list_item", "n", 4), ("block", "blockquote", None, 1), ("block", "paragraph", "said", 2), ("block", "code", "x\n  y", 1), ("block", "table", '{"headers":["h"],"rows":[["1"]]}', 1), ("block", "section", None, 1), ("block", "paragraph", "in", 2),
        ("block", "list", None, 1), ("block", "list_item", "t", 2), ("block", "list_item", "d", 2), ("block", "hr", None, 1), ("value", "string", "Book", 1),
    ]
    assert got[6][4] == {"src": "x/i x.png", "alt": "alt"} and got[17][4] == {"class": "chapter", "role": "section"}


def test_html(spark):
    from docloom.sources import html

    page = "<title>T &amp; U</title><style>x</style><!-- c --><nav><ul><li><a href='/a'>Home</a></li></ul></nav><main id=m><h1 id=one>One &#8217; &eacute;</h1><p>a <b>bold</b> <img src=i.png alt=alt> end</p><ul><li>one<ul><li>n</li></ul></li><li><p>two</p><p>more</p></li></ul><blockquote><p>said</p></blockquote><pre>x\n  y</pre><table><tr><th>h</th><th>i</th></tr><tr><td></td><td><b>2</b> z</td></tr></table><hr>loose<dl><dt>t</dt><dd>d</dd></dl></main><script>no</script>"
    got = in_order(html.read_html(spark.createDataFrame([("d", page), ("n", None), ("e", "")], "doc string, html string")))
    assert [g[:4] for g in got] == [
        ("block", "section", None, 1), ("block", "list", None, 2), ("block", "list_item", None, 3), ("inline", "link", "Home", 4), ("block", "section", None, 1), ("block", "heading", "One ’ é", 2), ("block", "paragraph", None, 2), ("inline", "text", "a ", 3), ("inline", "bold", "bold", 3), ("inline", "text", " ", 3), ("inline", "image", "alt", 3), ("inline", "text", " end", 3),
        ("block", "list", None, 2), ("block", "list_item", "one", 3), ("block", "list", None, 4), ("block", "list_item", "n", 5), ("block", "list_item", "two", 3), ("block", "paragraph", "more", 4), ("block", "blockquote", None, 2), ("block", "paragraph", "said", 3), ("block", "code", "x\n  y", 2), ("block", "table", '{"headers":["h","i"],"rows":[["","2 z"]]}', 2),
        ("block", "hr", None, 2), ("block", "paragraph", "loose", 2), ("block", "list", None, 2), ("block", "list_item", "t", 3), ("block", "list_item", "d", 3), ("value", "string", "T & U", 1),
    ]
    assert got[0][4] == {"role": "nav"} and got[3][4] == {"href": "/a"} and got[10][4] == {"src": "i.png", "alt": "alt"}


def test_damaged_containers():
    for content, what in ((b"no zip", "ZIP"), (zipped({"a": ""}), "missing member"), (zipped({"word/document.xml": "<a"}), "malformed"), (zipped({"word/document.xml": "<!DOCTYPE a [<!ENTITY b 'c'>]><a/>"}), "entities")):
        with pytest.raises(ValueError, match=what):
            archives.container_records(content, "docx")


def test_files_of_many_formats(spark, tmp_path):
    (tmp_path / "b.odt").write_bytes(zipped({"content.xml": '<o xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0"><text:h text:outline-level="2">Head</text:h></o>'}))
    (tmp_path / "d.org").write_text(ORG)
    (tmp_path / "e.toml").write_text("a = 1")
    got = read_documents(spark, str(tmp_path / "*"), filename=True)
    assert got.columns[-1] == "filename"
    by_file = {}
    for r in got.orderBy("doc", "element_order").collect():
        by_file.setdefault(r.filename.rsplit("/", 1)[1], []).append((r.element_type, r.content))
    assert by_file["b.odt"] == [("heading", "Head")] and by_file["e.toml"] == [("metadata", "a = 1")] and len(by_file["d.org"]) > 10
    assert st.toc(got).count() == 3


def test_registry_guards(spark, tmp_path):
    assert extension_of("https://x.y/a/b.ORG?x=1.md#f") == "org" and REGISTRY.format_for("a/b.wiki") == "mediawiki" and REGISTRY.can_read("x.ipynb") and not REGISTRY.can_read("x.zim")
    (tmp_path / "a.org").write_text(ORG)
    path = str(tmp_path / "a.org")
    for bad in ([], [str(tmp_path / "*.none")]):
        with pytest.raises(ValueError, match="no files matched"):
            read_documents(spark, bad)
    with pytest.raises(ValueError):
        read_documents(spark, path, format=None)
    (tmp_path / "t.csv").write_text("a\n1")
    with pytest.raises(ValueError, match="rows"):
        read_documents(spark, str(tmp_path / "t.csv"))
    spark.conf.set("spark.docloom.disabledReaders", "org")
    with pytest.raises(PermissionError):
        read_documents(spark, path)
    spark.conf.unset("spark.docloom.disabledReaders")
    # no registration escapes a setting
    own = REGISTRY.copy()
    spark.conf.set("spark.docloom.disabledReaders", "org")
    own.register(spark, "org", "mine", prose.read_prose)
    with pytest.raises(PermissionError):
        read_documents(spark, path, registry=own)
    spark.conf.unset("spark.docloom.disabledReaders")
    own.register(spark, ".note", "note", prose.read_prose, options=[{"intent": "attributes", "value": "all", "param": "by", "argument": "doc"}])
    (tmp_path / "n.note").write_text("One\nand a longer line here")
    note = str(tmp_path / "n.note")
    assert read_documents(spark, note, registry=own).count() == 2 and read_documents(spark, note, registry=own, attributes="all").count() == 2
    for bad in ({"attributes": "none"}, {"attributes": None}, {"reader_params": {"odd": "x"}}, {"reader_params": {"by": None}}, {"pages": "1"}, {"pages": None}, {"filename": None}):
        with pytest.raises(ValueError):
            read_documents(spark, note, registry=own, **bad)
    for bad in ({"param": "a b", "argument": "x"}, {"param": "a", "argument": "x", "type": "integer"}, {"param": "a", "argument": "x", "type": "odd"}):
        with pytest.raises(ValueError):
            own.register(spark, "z", "z", prose.read_prose, options=[{"intent": "i", "value": "v"} | bad])
    assert own.lookup("a.z") is None
    spark.conf.set("spark.docloom.allowRegistration", "false")
    with pytest.raises(PermissionError):
        own.register(spark, "x", "x", prose.read_prose)
    spark.conf.unset("spark.docloom.allowRegistration")


def test_registry_lookups(spark):
    r = REGISTRY.copy()
    assert extension_of("zim://w/A/x") == "zim://" and extension_of("git://a.md?ref=main") == "md" and extension_of("no") == "" and extension_of("notes?v.md") == "md"
    assert (r.format_for("a.html"), r.kind_for("a.csv"), r.provider_for("a.arrow"), r.key_for("a.ORG"), r.format_for("a.none"), r.format_for(None)) == ("html", "table", "pyarrow", ".org", None, None)
    r.register(spark, "org", "mine", prose.read_prose)
    assert r.format_for("a.org") == "mine" and r.builtin_format_for("a.org") == "org" and r.policy_format("a.org") == "org" and r.resolved_format("a.org", "rst") == "rst" and r.policy_format("a.org", "rst") == "rst"
    assert "*.docx" in r.supported_paths() and "*.csv" not in r.supported_paths()
    needed = {x.provider: (x.required_for, x.installed) for x in r.dependencies(spark).collect()}
    assert needed["pyarrow"] == ("arrow", True) and not needed["a decoder"][1]
    assert r.option_for("a.org", "attributes", "default") == {}


def test_data_files(spark, tmp_path):
    import pyarrow as pa

    (tmp_path / "t.csv").write_text("a,b\n1,x\n")
    (tmp_path / "t.tsv").write_text("a\tb\n1\tx\n")
    (tmp_path / "t.jsonl").write_text('{"a": 1, "b": "x"}\n')
    (tmp_path / "t.json").write_text('[{"a": 1,\n "b": "x"}]')
    with pa.ipc.new_file(str(tmp_path / "t.arrow"), pa.schema([("a", pa.int64()), ("b", pa.string())])) as w:
        w.write_table(pa.table({"a": [1], "b": ["x"]}))
    spark.createDataFrame([(1, "x")], "a int, b string").write.parquet(str(tmp_path / "t.parquet"))
    for name in ("csv", "tsv", "jsonl", "json", "arrow", "parquet"):
        assert [(r.a, r.b) for r in read_data(spark, str(tmp_path / f"t.{name}")).collect()] == [(1, "x")], name
    own = REGISTRY.copy()
    own.register_table(spark, "log", lambda s, path: s.read.text(path))
    (tmp_path / "t.log").write_text("one\ntwo")
    assert read_data(spark, str(tmp_path / "t.log"), own).count() == 2
    for bad in ("a.org", "a.none", "a.xlsx"):
        with pytest.raises(ValueError):
            read_data(spark, bad)
    spark.conf.set("spark.docloom.disabledReaders", "data")
    with pytest.raises(PermissionError):
        read_data(spark, str(tmp_path / "t.csv"))
    spark.conf.unset("spark.docloom.disabledReaders")


def test_stream(spark, tmp_path):
    from docloom.streaming.blocks import stream_documents, write_blocks

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.org").write_text(ORG)
    query = write_blocks(stream_documents(spark, str(tmp_path / "in")), "org", str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(rows(spark, ORG, "org"))


def test_markdown_and_expansion(spark):
    md = "# Head\n\ntext with `code`\n\n- a\n- b\n\n```py\nx = 1\n```\n\n| a | b |\n|---|---|\n| 1 | 2 |\n"
    got = rows(spark, md, "markdown")
    assert got[0] == ("block", "heading", "Head", 1) and ("block", "code", "x = 1", 1) in got and ("block", "table", '{"headers":["a","b"],"rows":[["1","2"]]}', 1) in got and ("inline", "code", "code", 2) in got
    nb = {"cells": [{"cell_type": "markdown", "source": ["# Top\n", "\n", "words"]}, {"cell_type": "code", "source": "x", "execution_count": 3, "outputs": [{"output_type": "stream", "text": ["o\n", "p"]}, {"output_type": "error", "ename": "E", "evalue": "bad"}, {"output_type": "display_data", "data": {"image/png": "z"}}]}, {"cell_type": "raw", "source": "r"}], "metadata": {"title": "N", "kernelspec": {"language": "python", "display_name": "Py"}}}
    read = notebooks.read_notebooks(spark.createDataFrame([(1, json.dumps(nb)), (2, "no json")], "doc long, text string"))
    got = [(r.element_type, r.content, r.level, r.attributes.get("source_type")) for r in read.orderBy("element_order").collect()]
    assert got == [
        ("div", None, 1, "markdown"), ("raw", "# Top\n\nwords", 2, None), ("div", None, 1, "code"), ("code", "x", 2, None), ("div", None, 2, "stream"), ("code", "o\np", 3, None), ("div", None, 2, "error"), ("code", "bad", 3, None), ("div", None, 2, "display_data"), ("div", None, 1, "raw"), ("raw", "r", 2, None),
        ("inlines", None, 1, None), ("text", "N", 2, None), ("inlines", None, 1, None), ("text", "Py", 2, None),
    ]
    out = st.expand_embedded(read).orderBy("element_order").collect()
    assert [(r.element_type, r.level, r.element_order) for r in out][:4] == [("div", 1, 0), ("heading", 2, 1), ("paragraph", 2, 2), ("div", 1, 3)]
    assert st.toc(st.expand_embedded(read)).first().title == "Top"


RTF = r"""{\rtf1{\fonttbl{\f0 Arial;}}{\stylesheet{\s0 Normal;}{\s1 heading 1;}}{\info{\title My T}{\author Me}}{\*\listtable{\list{\listlevel\levelnfc23}{\listlevel\levelnfc0}\listid5}}{\*\listoverridetable{\listoverride\listid5\ls1}}
\pard\s1 Styled\par\pard\outlinelevel1 Sub\par\pard caf\'e9 \u233? \{x\} it\u8217\'92s {\b bold} \emdash x{\*\junk no}\par
\pard\ls1\ilvl0 a\par\ls1\ilvl1 b\par
\trowd\trhdr\intbl h1\cell\intbl h2\cell\row\trowd\intbl 1\cell 2\cell\row
\pard end \u-10179?\u-8704? {\pict abc}\par}"""


def test_rtf(spark):
    from docloom.sources.rtf import read_rtf, rtf_records

    got = in_order(read_rtf(spark.createDataFrame([("d", RTF), ("n", None)], "doc string, text string")))
    assert [g[:4] for g in got] == [
        ("block", "heading", "Styled", 1), ("block", "heading", "Sub", 1), ("block", "paragraph", None, 1), ("inline", "text", "café é {x} it’s ", 2), ("inline", "bold", "bold", 2), ("inline", "text", " —x", 2), ("block", "list", None, 1), ("block", "list_item", "a", 2), ("block", "list", None, 3), ("block", "list_item", "b", 4),
        ("block", "table", '{"headers":["h1","h2"],"rows":[["1","2"]]}', 1), ("block", "paragraph", None, 1), ("inline", "text", "end 😀 ", 2), ("inline", "image", None, 2), ("value", "string", "My T", 1), ("value", "string", "Me", 1),
    ]
    assert got[0][4] == {"heading_level": "1"} and got[8][4] == {"list_type": "ordered"}
    for broken in ("}}}{\\par", "{\\rtf1 x", "\\u", "{\\stylesheet", "\\'zz \\"):
        rtf_records(broken)


def test_latex_tokens(spark):
    source = "\\a{b--c} \\% d % e\n  f $x_1$ $$y$$\n\n``q''~\\begin{verbatim}\n % \\x\n\\end{verbatim}$"
    got = [(r.kind, r.text) for r in markups.latex_tokens(spark.createDataFrame([(1, source), (2, None)], "doc long, text string")).orderBy("n").collect()]
    assert got == [
        ("control_word", "a"), ("begin_group", "{"), ("text", "b–c"), ("end_group", "}"), ("text", " "), ("control_symbol", "%"), ("text", " d "), ("text", "f "), ("math_shift", "$"), ("text", "x_1"), ("math_shift", "$"), ("text", " "), ("math_shift", "$$"), ("text", "y"), ("math_shift", "$$"), ("par_break", ""), ("text", "“q”\u00a0"),
        ("control_word", "begin"), ("begin_group", "{"), ("text", "verbatim"), ("end_group", "}"), ("text", "\n % \\x\n"), ("control_word", "end"), ("begin_group", "{"), ("text", "verbatim"), ("end_group", "}"), ("math_shift", "$"),
    ]


def test_page_elements(spark):
    from docloom.sources.elements import page_range, read_elements

    made = [(1, 1, 0, "heading", "Big", 20.0), (1, 1, 1, "text", "words", 10.0), (1, 2, 0, "heading", "Small", 12.0), (1, 2, 1, "list_item", "1. one", 10.0), (1, 2, 2, "list_item", " • two", 10.0), (2, 1, 0, "heading", "Own", 8.0)]
    pages = spark.createDataFrame(made, "doc long, page_number int, element_idx int, element_type string, text string, font_size double")
    got = [(r.doc, r.element_type, r.content, r.attributes) for r in read_elements(pages).orderBy("doc", "element_order").collect()]
    assert got[0] == (1, "page_break", None, {"page_number": "1"}) and got[1] == (1, "heading", "Big", {"heading_level": "1"})
    assert got[4:7] == [(1, "heading", "Small", {"heading_level": "2"}), (1, "list_item", "one", {"list_type": "ordered"}), (1, "list_item", "two", {"list_type": "bullet"})] and got[-1][3] == {"heading_level": "1"}
    second = read_elements(pages.where("doc = 1"), "2").orderBy("element_order").collect()
    assert [r.content for r in second] == [None, "Small", "one", "two"] and second[1].attributes == {"heading_level": "2"}
    assert page_range("3-7") == (3, 7)
    for bad in (None, "x", "1-"):
        with pytest.raises(ValueError, match="N or N-M"):
            page_range(bad)


def test_catalog(spark):
    from docloom.functions import catalog
    from docloom.schema import BLOCK_TYPES, INLINE_TYPES

    rows = catalog.interchange_map(spark).collect()
    assert len(rows) == 35 and {r.status for r in rows} == {"mapped", "planned", "dropped"} and [r.element_type for r in rows if r.constructor == "Null"] == [None]
    assert all(r.element_type in (*BLOCK_TYPES, *INLINE_TYPES) for r in rows if r.status == "mapped")
    formats = {r.format: (r.extensions, r.status) for r in catalog.supported_formats(spark).collect()}
    assert formats["html"] == ([".htm", ".html"], "implemented") and formats["pdf"][1] == "needs a reader" and catalog.spec_at_least(1, 3) and not catalog.spec_at_least(2, 0)


def test_class_slugs(spark):
    cases = {"Block Text": "block-text", "Heading 1": "heading-1", " --x__é! ": "x__é", "!!": "", "": ""}
    assert {r.t: r.s for r in spark.createDataFrame([(c,) for c in cases], "t string").select("t", class_slug(F.col("t")).alias("s")).collect()} == cases


def test_long_segments_are_linear(spark):
    """A segment is put together once, however many rows it has."""
    import time

    def seconds(n):
        rows = spark.range(n).selectExpr("1 as doc", "'block' as kind", "'paragraph' as element_type", "concat('line ', id, if(id % 100 = 0, ' needle in hay', ' and more')) as content", "1 as level", "'text' as encoding", "map() as attributes", "cast(id as int) as element_order").withColumn("attributes", F.create_map().cast("map<string,string>"))
        began = time.time()
        assert st.search_sections(rows, "hay line").count() == n
        return time.time() - began

    seconds(1000)
    assert seconds(40_000) < 8 * max(seconds(5000), 0.5)


def test_nested_metadata_and_deep_ranks(spark):
    b = blocks(spark, (1, "value", "list", None, 1, {"key": "a"}), (1, "value", "inlines", None, 2), (1, "inline", "text", "x", 3), (1, "inline", "text", "y", 2), (1, "block", "div", None, 1), (1, "block", "metadata", "m", 40), (1, "block", "paragraph", "in", 41), (1, "block", "paragraph", "out", 40))
    assert [r.content for r in st.body(b).orderBy("element_order").collect()] == [None, "out"]
    # 128 levels down and up again
    levels = [*range(1, 129), *range(128, 0, -1)]
    many = blocks(spark, *[(1, "block", "metadata" if k % 2 else "div", str(k), k) for k in levels])
    assert st.body(many).count() == 0
    deep = blocks(spark, *[(1, "block", "metadata" if k == 64 else "div", str(k), k) for k in levels])
    # 65 to 128 and back are in the span of the first metadata row, which the second one closes and opens anew
    assert [r.level for r in st.body(deep).orderBy("element_order").collect()] == [*range(1, 64), *range(63, 0, -1)]
    assert [r.level for r in st.repair(many).orderBy("element_order").collect()] == levels
    assert [r.level for r in st.repair(blocks(spark, *[(1, "block", "div", None, 3 * k) for k in levels])).orderBy("element_order").collect()] == levels
    heads = blocks(spark, *[(1, "block", "heading", f"h{k}", 1, {"heading_level": str(k)}) for k in levels])
    assert [r.content for r in st.section(heads, "h100").orderBy("element_order").collect()] == [f"h{k}" for k in [*range(100, 129), *range(128, 100, -1)]]
    parts = blocks(spark, *[(1, "block", "section", str(k), k, {"role": "nav" if k == 50 else "article"}) for k in levels])
    assert [r.level for r in st.reading(parts).orderBy("element_order").collect()] == [*range(1, 50), *range(49, 0, -1)]
    assert st.container(blocks(spark, *[(1, "block", "div", None, k, {"id": str(k)}) for k in levels]), "100").count() == 57


@pytest.mark.parametrize(
    "format, text, inside",
    [
        ("org", "a *b /c _d +e+ f_ c/ b* [[u][l *m*]] *un", ["bold", "italic", "underline", "strikethrough"]),
        ("markdown", "a **b *c ~~d [l `k`](u)~~ c* b** *un", ["bold", "italic", "strikethrough", "link", "code"]),
        ("markdown", "***x `y`***", ["bold", "italic", "code"]),
        ("markdown", "*it **bo `y`***", ["italic", "bold", "code"]),
        ("rst", "a **b *c ``d`` c* b** un*", ["bold", "italic", "code"]),
        ("mediawiki", "''i '''b [[P|l <sup>s</sup>]]''''' un''", ["italic", "bold", "link", "superscript"]),
        ("mediawiki", "'''b ''i <s>x</s>'''''", ["bold", "italic", "strikethrough"]),
        ("textile", 'a *b _c -d "l":http://u- c_ b* said "hi" un*', ["bold", "italic", "strikethrough", "link"]),
        ("latex", r"\textbf{b \emph{c \underline{d \foo{e} \textbf{f}} c} b} un}", ["bold", "italic", "underline", "bold"]),
    ],
)
def test_marks_at_any_depth(spark, format, text, inside):
    rows = read_lines(spark.createDataFrame([(1, text)], "doc long, text string"), format).orderBy("element_order").collect()
    marks = [r for r in rows if r.kind == "inline" and r.element_type != "text"]
    assert [r.element_type for r in marks][: len(inside)] == inside
    assert [r.level for r in marks][: len(inside)] == list(range(2, 2 + len(inside)))


def test_balanced_templates(spark):
    """Templates in templates, over several lines, within a line, and braces that don't pair."""
    deep = "{{d|" * 300 + "x" + "}}" * 300
    text = "{{Box\n| a = {{b|{{{1}}}}}\n| {c}\n}}\n\n}} say {{a|{{b}}|c}} and {{x}} {{open\n\n" + deep
    rows = read_lines(spark.createDataFrame([(1, text)], "doc long, text string"), "mediawiki").orderBy("element_order").collect()
    assert [(r.kind, r.element_type, r.content, r.attributes.get("template_name")) for r in rows] == [
        ("block", "raw", "{{Box\n| a = {{b|{{{1}}}}}\n| {c}\n}}", "Box"), ("block", "paragraph", None, None), ("inline", "text", "}} say ", None), ("inline", "raw", "{{a|{{b}}|c}}", "a"), ("inline", "text", " and ", None),
        ("inline", "raw", "{{x}}", "x"), ("inline", "text", " {{open", None), ("block", "raw", deep, "d"),
    ]


def test_notes_of_rst_have_their_text(spark):
    """Numbered, automatic and named labels; a reference without a footnote keeps its label, and so does a citation."""
    text = (
        "See [1]_ and [#]_ then [#n]_, [#]_ and [*]_ but [9]_ not.\n\n.. [1] one *body* here\n\n.. [#] two\n\n.. [*] star\n\n"
        ".. [#n] named\n\n   further down\n\n.. [#] three\n\n.. [1] again\n\nEnd."
    )
    rows = read_lines(spark.createDataFrame([(1, text), (2, "plain"), (3, "none [1]_")], "doc long, text string"), "rst").orderBy("doc", "element_order").collect()
    notes = [(r.doc, r.attributes["id"], r.content) for r in rows if r.element_type == "note"]
    assert notes[:1] == [(1, "1", "one *body* here")] or notes[:1] == [(1, "1", "one body here")]
    assert notes[1:] == [(1, "#1", "two"), (1, "#n", "named further down"), (1, "#2", "three"), (1, "*1", "star"), (1, "9", "9"), (3, "1", "1")]
    assert [r.attributes["id"] for r in rows if r.element_type == "div"] == ["1", "#1", "*1", "#n", "#2", "1"] and rows[-4].content == "plain"


def test_substitutions_of_rst(spark):
    text = "A |x| and |the *y*|_ or |z|, | not.\n\n* in |x|\n\n::\n\n  |x|\n\n.. |x| replace:: first **bold**\n.. |the *y*| replace:: second\n.. |x| replace:: again\n"
    rows = read_lines(spark.createDataFrame([(1, text), (2, "so |x|")], "doc long, text string"), "rst").orderBy("doc", "element_order").collect()
    assert [(r.element_type, r.content) for r in rows if r.kind == "inline" or r.content] == [
        ("text", "A first "), ("bold", "bold"), ("text", " and second or |z|, | not."), ("text", "in first "), ("bold", "bold"), ("code", "|x|"), ("paragraph", "so |x|"),
    ]


def test_crossing_marks(spark):
    """The mark opened first counts; what is left of the other one is text."""
    rows = read_lines(spark.createDataFrame([(1, "*a /b* c/ *d")], "doc long, text string"), "org").orderBy("element_order").collect()
    assert [(r.element_type, r.content) for r in rows] == [("paragraph", None), ("bold", "a /b"), ("text", " c/ *d")]


HARD = {
    "strays": "** a * b __ _x ' `q [ ] { } ''' <b \\x \\textbf{ $ % ~ + = / 😀é " * 17_000, "emoji": "a😀" * 200_000, "braces": "\\emph{" * 20_000 + "z" + "}" * 20_000, "dashes": "- " * 500_000, "options": "[[File:a" + "|thumb" * 150_000 + "]]",
    "numbers": "12345678901234567890. item\n99999999999) it\n#. one\nA. Smith wrote it.\na) b\n", "entities": "&#1114112;&#xD800;&#0;&#99999999999999;&#x41;&#65; " * 1000, "rules": "\\begin{tabular}{l}\n" + "\\hline " * 100_000 + "\n\\end{tabular}",
}


@pytest.mark.parametrize("format", ["org", "rst", "mediawiki", "textile", "latex", "markdown", "html"])
def test_no_text_is_too_odd(spark, format):
    """Paragraphs of up to a megabyte of stray marks, signs of two widths, nested braces, numbers and entities that are none."""
    docs = spark.createDataFrame(list(HARD.items()), "doc string, text string").repartition(4)
    blocks_ = read_html(docs, html="text") if format == "html" else read_lines(docs, format)
    assert {r.doc for r in blocks_.select("doc").distinct().collect()} == set(HARD)


def test_entities_that_are_no_characters(spark):
    page = spark.createDataFrame([(1, "<p>&#1114112;|&#xD800;|&#0;|&#99999999999999;|&#x000041;|&#65;|&#x1F389;|&bad;</p>")], "doc long, html string")
    assert read_html(page).collect()[0].content == "\ufffd|\ufffd|\ufffd|\ufffd|A|A|🎉|&bad;"


def test_lists_deeper_than_all_limits(spark):
    n = 20
    md = "\n".join("  " * k + f"- i{k}" for k in range(n)) + "\n- last"
    rows = read_lines(spark.createDataFrame([(1, md)], "doc long, text string"), "markdown").orderBy("element_order").collect()
    assert [r.level for r in rows if r.element_type == "list_item"] == [*range(2, 2 * n + 1, 2), 2] and sum(r.element_type == "list" for r in rows) == n
    page = "".join(f"<ul><li>i{k}" if k % 2 else f"<ol><li>i{k}" for k in range(n)) + "".join("</li></ul>" if k % 2 else "</li></ol>" for k in reversed(range(n))) + "<ul><li>last</ul>"
    rows = read_html(spark.createDataFrame([(1, page)], "doc long, html string")).orderBy("element_order").collect()
    assert [r.level for r in rows if r.element_type == "list_item"] == [*range(2, 2 * n + 1, 2), 2]
    assert [r.attributes["list_type"] for r in rows if r.element_type == "list"] == ["ordered", "bullet"] * (n // 2) + ["bullet"]
    tex = "".join("\\begin{%s}\n\\item i%d\n" % (("enumerate", "itemize")[k % 2], k) for k in range(n)) + "".join("\\end{%s}\n" % ("enumerate", "itemize")[k % 2] for k in reversed(range(n)))
    rows = read_lines(spark.createDataFrame([(1, tex)], "doc long, text string"), "latex").orderBy("element_order").collect()
    assert [r.level for r in rows if r.element_type == "list_item"] == list(range(2, 2 * n + 1, 2)) and [r.attributes["list_type"] for r in rows if r.element_type == "list"] == ["ordered", "bullet"] * (n // 2)


def test_ids_and_alts_far_below(spark):
    org = "* Head\n:PROPERTIES:\n" + "".join(f":P{k}: v\n" for k in range(12)) + ":CUSTOM_ID: own\n:END:\n* Next\ntext\n"
    rows = read_lines(spark.createDataFrame([(1, org)], "doc long, text string"), "org").orderBy("element_order").collect()
    assert [(r.content, r.attributes.get("id")) for r in rows] == [("Head", "own"), ("Next", "next"), ("text", None)]
    rst = ".. image:: a.png\n" + "".join(f"   :o{k}: v\n" for k in range(6)) + "   :alt: words\n\n.. image:: b.png\n"
    rows = read_lines(spark.createDataFrame([(1, rst)], "doc long, text string"), "rst").orderBy("element_order").collect()
    assert [(r.attributes.get("src"), r.attributes.get("alt")) for r in rows] == [("a.png", "words"), ("b.png", None)]


def test_table_padding_guard():
    assert parse_embedded('[{"a": 1}, {"b": 2}]', "json")[1] is None
    wide = "\n".join(json.dumps({f"k{i}": 1}) for i in range(1200))
    assert "padding" in parse_embedded(wide, "jsonl")[1]


def test_golden_slugs(spark):
    # Titles and the identifiers that document converters give them.
    cases = {
        "Hello World": "hello-world", "  Leading blanks": "leading-blanks", "1. Introduction": "introduction", "123": "section", "!!! ???": "section", "": "section", "snake_case Field guide": "snake_case-field-guide", "a.b.c": "a.b.c", "Dash - dash": "dash---dash",
        "C++ & Java": "c-java", "ÜBER Größe": "über-größe", "Don't": "dont", "tab\tand  blanks": "tab-and-blanks", "2nd Edition": "nd-edition", "-x-": "x-", "A/B": "ab", "日本 語": "日本-語", "全角\u3000空白\u3000": "全角-空白", "İzmir": "izmir", "Part Ⅻ": "part-ⅻ", "y² and 🦆 z": "y²-and-z", "_private": "private",
    }
    got = {r.t: r.s for r in spark.createDataFrame([(c,) for c in cases], "t string").select("t", slug(F.col("t")).alias("s")).collect()}
    assert got == cases
    assert spark.createDataFrame([("A-b c",)], "t string").select(slug(F.col("t"), "_")).first()[0] == "a_b_c"


def test_inlines(spark):
    from docloom.sources.interchange import ast_blocks, ast_struct, ast_table, inlines_to_rows, inlines_to_text, rows_to_inlines, write_interchange_files

    made = [{"t": "Str", "c": "a"}, {"t": "Space"}, {"t": "Strong", "c": [{"t": "Str", "c": "b"}, {"t": "Emph", "c": [{"t": "Str", "c": "c"}]}]}, {"t": "SoftBreak"}, {"t": "Link", "c": [["", [], []], [{"t": "Str", "c": "l"}], ["u", "t"]]}, {"t": "LineBreak"}, {"t": "Math", "c": [{"t": "InlineMath"}, "x"]}, {"t": "Quoted", "c": [{"t": "SingleQuote"}, [{"t": "Str", "c": "q"}]]}, {"t": "Code", "c": [["", [], []], "k"]}]
    df = spark.createDataFrame([(1, json.dumps(made), "markdown"), (2, json.dumps(made), "text"), (3, None, "text"), (4, "[]", "markdown")], "doc long, j string, mode string")
    got = {r.doc: r for r in df.select("doc", inlines_to_text("j", F.col("mode")).alias("t"), rows_to_inlines(inlines_to_rows("j")).alias("again")).collect()}
    assert got[1].t == "a **b*c***\n[l](u \"t\")  \n$x$'q'`k`" and got[2].t == "a bc l\nx'q'k" and got[3].t is None and got[4].t == ""
    assert json.loads(got[1].again) == made and got[3].again is None
    with pytest.raises(Exception, match="none of"):
        df.select(inlines_to_text("j", F.lit("odd"))).collect()
    b = blocks(spark, (1, "block", "heading", "H", 1, {"heading_level": "2"}), (1, "block", "list_item", "alone", 1), (2, "block", "table", '{"headers":["h"],"rows":[["1"],["2","3"]]}', 1), (2, "value", "string", "T", 1, {"key": "title"}))
    both = st.collected(b).select("doc", ast_struct("blocks").alias("s"), ast_blocks("blocks").alias("b")).orderBy("doc").collect()
    assert both[0].s["pandoc-api-version"] == [1, 23, 1] and json.loads(both[0].b)[1]["t"] == "BulletList" and json.loads(both[1].s.meta) == {"title": {"t": "MetaString", "c": "T"}}
    table = json.loads(both[1].b)[0]
    assert table["t"] == "Table" and len(table["c"][4][0][3]) == 2 and len(table["c"][2]) == 2
    assert [r.n for r in ast_table(b).selectExpr("doc", "variant_get(blocks, '$[0].t', 'string') as n").orderBy("doc").collect()] == ["Header", "Table"]


def test_interchange_files(spark, tmp_path):
    from docloom.sources.interchange import write_interchange_files

    b = blocks(spark, (1, "block", "paragraph", "x", 1), (2, "block", "hr", None, 1))
    write_interchange_files(b, str(tmp_path / "out"))
    texts = spark.read.text(str(tmp_path / "out")).collect()
    assert sorted(json.loads(r.value)["blocks"][0]["t"] for r in texts) == ["HorizontalRule", "Para"]
    from docloom.sources.compact import write_compact_files

    write_compact_files(b, str(tmp_path / "lines"))
    back = compact.read_compact_files(spark, str(tmp_path / "lines"))
    assert sorted(r.element_type for r in back.collect()) == ["hr", "paragraph"]
