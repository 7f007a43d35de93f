"""Sample documents in every format, made from the lines of plain texts: what the registered reader queries read.

The lines of a text become, in turn, a heading, an item, a numbered item, a quote, code, a table and a paragraph with a
mark. Code has a line as it is; elsewhere the signs that a format gives a meaning to are taken out of it, letters,
digits and other punctuation stay.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable
from xml.sax.saxutils import escape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.batches import small_batches

HEADING, ITEM, NUMBERED, QUOTE, CODE, TABLE, MARKED = range(7)
#: Signs that some format gives a meaning to.
SIGNS = r"[\\|\"{}<>\[\]*_`~^$#&%=+@!:;/]"
#: Further ones, in some formats.
MORE_SIGNS = {"textile": "[-]", "latex": "[-']", "mediawiki": "[']"}


def with_lines(docs: DataFrame, format: str, by: str = "doc", text: str = "text") -> DataFrame:
    """(doc, lines): of each document with a text its lines that aren't empty, array<struct<n, k, rank, clean, raw>>.

    `k` is what a line becomes, `clean` and `raw` are its text without and with signs. A document is cut within its row,
    so that nothing is shuffled for it.
    """
    signs = "[" + MORE_SIGNS.get(format, "[]")[1:-1] + SIGNS[1:]
    clean = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, signs, ""), r"[^\S ]\s*| \s+", " "))
    cut = F.transform(F.split(text, "\n"), lambda x, n: F.struct(n.alias("n"), x.alias("raw"), clean(x).alias("clean")))
    rows = docs.where(F.col(text).isNotNull()).select(by, F.filter(cut, lambda x: x["clean"] != "").alias("_cut"))

    def one(x: Column, at: Column) -> Column:
        k, before = x["n"] % 7, F.get("_cut", at - 1)["n"] % 7
        k = F.when((k == CODE) & F.coalesce(before == CODE, F.lit(False)), MARKED).otherwise(k)  # two in a row would be one
        return F.struct(x["n"].alias("n"), k.cast("int").alias("k"), (1 + F.floor(x["n"] / 7) % 2).cast("int").alias("rank"), x["clean"].alias("clean"), F.trim(x["raw"]).alias("raw"))

    return rows.select(by, F.transform("_cut", one).alias("lines"))


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])



_MARKUP: dict[str, Callable[[Column, Column, Column, Column], dict[int, Column]]] = {
    "org": lambda t, raw, rank, n: {
        HEADING: _text(F.repeat(F.lit("*"), rank), " ", t), ITEM: _text("- ", t), NUMBERED: _text("3. ", t), QUOTE: _text("#+BEGIN_QUOTE\n", t, "\n#+END_QUOTE"), CODE: _text("#+BEGIN_SRC python\n", raw, "\n#+END_SRC"),
        TABLE: _text("| key | text |\n|-----+------|\n| ", n, " | ", t, " |"), MARKED: _text("So ", t, " *strong* end"),
    },
    "rst": lambda t, raw, rank, n: {
        HEADING: _text(t, "\n", F.repeat(F.element_at(F.array(F.lit("="), F.lit("-")), rank), F.greatest(F.length(t), F.lit(4)))), ITEM: _text("* ", t), NUMBERED: _text("3. ", t), QUOTE: _text("It says\n\n    ", F.regexp_replace(t, r"^(\w+)([.)]\s)", r"$1\\$2")), CODE: _text(".. code-block:: python\n\n    ", raw),
        TABLE: _text("===  ====\nkey  text\n===  ====\n", n, "  ", t, "\n===  ===="), MARKED: _text("So ", t, " **strong** end"),
    },
    "mediawiki": lambda t, raw, rank, n: {
        HEADING: _text(F.repeat(F.lit("="), rank), " ", t, " ", F.repeat(F.lit("="), rank)), ITEM: _text("* ", t), NUMBERED: _text("# ", t), QUOTE: _text("<blockquote>\n", t, "\n</blockquote>"), CODE: _text('<syntaxhighlight lang="python">\n', raw, "\n</syntaxhighlight>"),
        TABLE: _text("{|\n! key !! text\n|-\n| ", n, " || ", t, "\n|}"), MARKED: _text("So ", t, " '''strong''' end"),
    },
    "textile": lambda t, raw, rank, n: {
        HEADING: _text("h", rank.cast("string"), ". ", t), ITEM: _text("* ", t), NUMBERED: _text("# ", t), QUOTE: _text("bq. ", t), CODE: _text("bc(python). ", raw), TABLE: _text("|_. key|_. text|\n|", n, "|", t, "|"), MARKED: _text("So ", t, " *strong* end"),
    },
    "latex": lambda t, raw, rank, n: {
        HEADING: _text("\\", F.repeat(F.lit("sub"), rank - 1), "section{", t, "}"), ITEM: _text("\\begin{itemize}\n\\item ", t, "\n\\end{itemize}"), NUMBERED: _text("\\begin{enumerate}\n\\item ", t, "\n\\end{enumerate}"), QUOTE: _text("\\begin{quote}\n", t, "\n\\end{quote}"),
        CODE: _text("\\begin{lstlisting}[language=python]\n", raw, "\n\\end{lstlisting}"), TABLE: _text("\\begin{tabular}{ll}\n\\hline\nkey & text \\\\\n\\hline\n", n, " & ", t, " \\\\\n\\end{tabular}"), MARKED: _text("So ", t, " \\textbf{strong} end"),
    },
    "markdown": lambda t, raw, rank, n: {
        HEADING: _text(F.repeat(F.lit("#"), rank), " ", t), ITEM: _text("- ", t), NUMBERED: _text("3. ", t), QUOTE: _text("> ", t), CODE: _text("```python\n", raw, "\n```"), TABLE: _text("| key | text |\n|-----|------|\n| ", n, " | ", t, " |"), MARKED: _text("So ", t, " **strong** end"),
    },
    "html": lambda t, raw, rank, n: {
        HEADING: _text("<h", rank.cast("string"), ">", t, "</h", rank.cast("string"), ">"), ITEM: _text("<ul><li>", t, "</li></ul>"), NUMBERED: _text("<ol><li><p>", t, "</p></li></ol>"), QUOTE: _text("<blockquote><p>", t, "</p></blockquote>"),
        CODE: _text("<pre>", F.replace(F.replace(F.replace(raw, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&#62;")), "</pre>"), TABLE: _text("<table><tr><th>key</th><th>text</th></tr><tr><td>", n, "</td><td>", t, "</td></tr></table>"), MARKED: _text("<p>So ", t, " <b>strong</b> end</p>"),
    },
}


def sample_texts(docs: DataFrame, format: str, by: str = "doc") -> DataFrame:
    """(doc, text): documents in a line format; empty if none of a document's lines has a text."""

    def made(x: Column) -> Column:
        out = F
        for k, form in _MARKUP[format](x["clean"], x["raw"], x["rank"], x["n"].cast("string")).items():
            out = out.when(x["k"] == k, form)
        return out.otherwise("")

    return with_lines(docs, format, by).select(by, F.array_join(F.transform("lines", made), "\n\n").alias("text"))


def _zipped(members: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as zf:
        for name, text in members.items():
            zf.writestr(name, text)
    return out.getvalue()


# Namespaces of the formats.
_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_ODF = " ".join(f'xmlns:{k}="urn:oasis:names:tc:opendocument:xmlns:{v}:1.0"' for k, v in (("office", "office"), ("text", "text"), ("style", "style"), ("table", "table"), ("fo", "xsl-fo-compatible")))


def _docx(lines: list[dict]) -> bytes:
    p = lambda pr, *runs: f"<w:p><w:pPr>{pr}</w:pPr>{''.join(runs)}</w:p>"
    r = lambda text, pr="": f'<w:r><w:rPr>{pr}</w:rPr><w:t xml:space="preserve">{escape(text)}</w:t></w:r>'
    cell = lambda text: f"<w:tc>{p('', r(text))}</w:tc>"
    body = []
    for x in lines:
        t, number = x["clean"], f'<w:numPr><w:ilvl w:val="0"/><w:numId w:val="{x["k"]}"/></w:numPr>'
        body.append({
            HEADING: lambda: p(f'<w:pStyle w:val="Heading{x["rank"]}"/>', r(t)), ITEM: lambda: p(number, r(t)), NUMBERED: lambda: p(number, r(t)), QUOTE: lambda: p('<w:pStyle w:val="Quote"/>', r(t)), CODE: lambda: p('<w:pStyle w:val="SourceCode"/>', r(x["raw"])),
            TABLE: lambda: f"<w:tbl><w:tr><w:trPr><w:tblHeader/></w:trPr>{cell('key')}{cell('text')}</w:tr><w:tr>{cell(str(x['n']))}{cell(t)}</w:tr></w:tbl>", MARKED: lambda: p("", r("So " + t + " "), r("strong", "<w:b/>"), r(" end")),
        }[x["k"]]())
    style = lambda i, name: f'<w:style w:styleId="{i}"><w:name w:val="{name}"/></w:style>'
    level = lambda i, fmt: f'<w:abstractNum w:abstractNumId="{i}"><w:lvl w:ilvl="0"><w:numFmt w:val="{fmt}"/></w:lvl></w:abstractNum>'
    return _zipped({
        "word/document.xml": f"<w:document {_W}><w:body>{''.join(body)}</w:body></w:document>", "word/styles.xml": f"<w:styles {_W}>{style('Heading1', 'heading 1')}{style('Heading2', 'heading 2')}{style('Quote', 'Quote')}{style('SourceCode', 'Source Code')}</w:styles>",
        "word/numbering.xml": f'<w:numbering {_W}>{level(1, "bullet")}{level(2, "decimal")}<w:num w:numId="1"><w:abstractNumId w:val="1"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="2"/></w:num></w:numbering>',
    })


def _odt(lines: list[dict]) -> bytes:
    cell = lambda text: f"<table:table-cell><text:p>{escape(text)}</text:p></table:table-cell>"
    body = []
    for x in lines:
        t = escape(x["clean"])
        body.append({
            HEADING: lambda: f'<text:h text:outline-level="{x["rank"]}">{t}</text:h>', QUOTE: lambda: f'<text:p text:style-name="Quotations">{t}</text:p>', CODE: lambda: f'<text:p text:style-name="Preformatted_20_Text">{escape(x["raw"])}</text:p>',
            TABLE: lambda: f"<table:table><table:table-header-rows><table:table-row>{cell('key')}{cell('text')}</table:table-row></table:table-header-rows><table:table-row>{cell(str(x['n']))}{cell(x['clean'])}</table:table-row></table:table>",
            MARKED: lambda: f'<text:p>So {t} <text:span text:style-name="T1">strong</text:span> end</text:p>',
        }.get(x["k"], lambda: f'<text:list text:style-name="L{x["k"]}"><text:list-item><text:p>{t}</text:p></text:list-item></text:list>')())
    styles = '<style:style style:name="T1" style:family="text"><style:text-properties fo:font-weight="bold"/></style:style><text:list-style style:name="L1"><text:list-level-style-bullet text:level="1"/></text:list-style><text:list-style style:name="L2"><text:list-level-style-number text:level="1"/></text:list-style>'
    return _zipped({"content.xml": f"<office:document-content {_ODF}><office:automatic-styles>{styles}</office:automatic-styles><office:body><office:text>{''.join(body)}</office:text></office:body></office:document-content>"})


def _epub(lines: list[dict]) -> bytes:
    body = []
    for x in lines:
        t = escape(x["clean"])
        body.append({
            HEADING: lambda: f"<h{x['rank']}>{t}</h{x['rank']}>", ITEM: lambda: f"<ul><li><p>{t}</p></li></ul>", NUMBERED: lambda: f"<ol><li>{t}</li></ol>", QUOTE: lambda: f"<blockquote><p>{t}</p></blockquote>", CODE: lambda: f"<pre>{escape(x['raw'])}</pre>",
            TABLE: lambda: f"<table><thead><tr><th>key</th><th>text</th></tr></thead><tbody><tr><td>{x['n']}</td><td>{t}</td></tr></tbody></table>", MARKED: lambda: f"<p>So {t} <strong>strong</strong> end</p>",
        }[x["k"]]())
    half = len(body) // 2
    page = lambda some: f'<html xmlns="http://www.w3.org/1999/xhtml"><head><title>x</title></head><body>{"".join(some)}</body></html>'
    package = '<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>Book</dc:title></metadata><manifest><item id="b" href="text/two%20b.xhtml"/><item id="a" href="text/a.xhtml"/></manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></package>'
    return _zipped({"META-INF/container.xml": '<container><rootfiles><rootfile full-path="OPS/package.opf"/></rootfiles></container>', "OPS/package.opf": package, "OPS/text/a.xhtml": page(body[:half]), "OPS/text/two b.xhtml": page(body[half:])})


#: Signs that RTF has no other way to write.
_NOT_RTF = re.compile(r"[^ -\x7f]+|[\\{}]+")


def _rtf(lines: list[dict]) -> bytes:
    def plain(text: str) -> str:
        return _NOT_RTF.sub(lambda m: "".join(map(escaped, m[0])), text)

    def escaped(sign: str) -> str:
        if sign in "\\{}":
            return f"\\{sign}"
        units = sign.encode("utf-16-le")
        return "".join(f"\\u{int.from_bytes(units[k : k + 2], 'little', signed=True)}?" for k in range(0, len(units), 2))

    body = []
    for x in lines:
        t = plain(x["clean"])
        body.append({
            HEADING: lambda: f"\\pard\\outlinelevel{x['rank'] - 1} {t}\\par", ITEM: lambda: f"\\pard\\ls1\\ilvl0 {t}\\par", NUMBERED: lambda: f"\\pard\\ls2\\ilvl0 {t}\\par", TABLE: lambda: f"\\trowd\\trhdr\\intbl key\\cell text\\cell\\row\\trowd\\intbl {x['n']}\\cell {t}\\cell\\row",
            MARKED: lambda: f"\\pard So {t} {{\\b strong}} end\\par",
        }.get(x["k"], lambda: f"\\pard {t}\\par")())
    head = "{\\rtf1\\ansi{\\fonttbl{\\f0 Arial;}}{\\info{\\title Book}}{\\*\\listtable{\\list{\\listlevel\\levelnfc23}\\listid1}{\\list{\\listlevel\\levelnfc0}\\listid2}}{\\*\\listoverridetable{\\listoverride\\listid1\\ls1}{\\listoverride\\listid2\\ls2}}"
    return (head + "\n".join(body) + "}").encode()


_FILES = {"docx": _docx, "odt": _odt, "epub": _epub, "rtf": _rtf}


def sample_files(docs: DataFrame, format: str, by: str = "doc") -> DataFrame:
    """(doc, bytes): documents as files of a container format or RTF; null if none of a document's lines has a text."""

    @F.arrow_udf("binary")  # made on the driver, for this format
    def made(lines: pa.Array) -> pa.Array:
        cut = lines.flatten()
        fields = [cut.field(k) for k in range(cut.type.num_fields)]
        names, bounds = [f.name for f in cut.type], [0, *np.cumsum(lines.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist()]
        of = lambda a, b: [dict(zip(names, x, strict=True)) for x in zip(*(f.slice(a, b - a).to_pylist() for f in fields), strict=True)]
        return pa.array((_FILES[format](of(a, b)) if b > a else None for a, b in zip(bounds, bounds[1:])), pa.binary())  # one document at a time

    return small_batches(with_lines(docs, format, by)).select(by, made("lines").alias("bytes"))


# the rows that readers must find, in SQL


def sample_sql(format: str) -> str:
    """SQL for (doc, kind, element_type, content, level, element_order, heading_level, language, list_type) of the samples."""
    more = f", '{MORE_SIGNS[format].replace(chr(39), chr(39) * 2)}', '', 'g')" if format in MORE_SIGNS else ""
    signs = SIGNS.replace("'", "''")
    clean = f"{'regexp_replace(' if more else ''}regexp_replace(raw, '{signs}', '', 'g'){more}"
    own_lists = format in ("latex", "epub", "html")  # each list is an element of its own
    opens = "true" if own_lists else "coalesce(before <> k, true)"
    rank = "dense_rank() over (partition by doc, k = 0 order by first)" if format == "rst" else "rank"
    quote = [("block", "blockquote", "null", 1), ("block", "paragraph", "clean", 2)]
    if format == "rst":
        quote = [("block", "paragraph", "'It says'", 1), *quote]
    if format == "rtf":
        quote = [("block", "paragraph", "clean", 1)]
    code = [("block", "code", "raw", 1)] if format != "rtf" else [("block", "paragraph", "clean", 1)]
    table = """'{"headers":["key","text"],"rows":[["' || n || '",' || to_json(clean)::varchar || ']]}'"""
    made = {
        HEADING: [("block", "heading", "clean", 1)], ITEM: [("block", "list", "null", 1), ("block", "list_item", "clean", 2)], NUMBERED: [("block", "list", "null", 1), ("block", "list_item", "clean", 2)], QUOTE: quote, CODE: code, TABLE: [("block", "table", table, 1)],
        MARKED: [("block", "paragraph", "null", 1), ("inline", "text", "'So ' || clean || ' '", 2), ("inline", "bold", "'strong'", 2), ("inline", "text", "' end'", 2)],
    }
    parts = []
    for k, rows in made.items():
        for sub, (kind, what, content, level) in enumerate(rows):
            where = f"k = {k}" + (f" and {opens}" if what == "list" else "")
            list_type = f"'{'ordered' if k == NUMBERED else 'bullet'}'" if what == "list" else "null"
            language = "'python'" if what == "code" and format not in ("docx", "odt", "epub", "html") else "null"
            parts.append(f"select doc, n, {sub} as sub, '{kind}' as kind, '{what}' as element_type, {content} as content, {level} as level, {'title_rank::varchar' if what == 'heading' else 'null'} as heading_level, {language} as language, {list_type} as list_type from t where {where}")
    meta = ["string"] if format in ("epub", "rtf") else []
    for what in meta:
        parts.append(f"select distinct doc, 1000000000, 0, 'value', '{what}', 'Book', 1, null, null, null from t")
    return f"""with l as (select doc_id as doc, unnest(string_split(text, chr(10))) as raw, unnest(range(len(string_split(text, chr(10))))) as n from documents where text is not null),
c as (select doc, n, raw, trim(regexp_replace({clean}, '\\s+', ' ', 'g')) as clean from l),
v as (select doc, n, trim(raw) as raw, clean, n % 7 as k0, (1 + (n // 7) % 2)::int as rank, lag(n % 7) over (partition by doc order by n) as k1 from c where clean <> ''),
w as (select *, case when k0 = {CODE} and k1 = {CODE} then {MARKED} else k0 end as k from v),
u as (select *, lag(k) over (partition by doc order by n) as before, min(n) over (partition by doc, k = 0, rank) as first from w),
t as (select *, {rank} as title_rank from u),
r as ({" union all ".join(parts)})
select doc, kind, element_type, content, level, (row_number() over (partition by doc order by n, sub) - 1)::int as element_order, heading_level, language, list_type from r"""
