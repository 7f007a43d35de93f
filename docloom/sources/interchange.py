"""The interchange AST of document converters: JSON to blocks and back.

An AST nests without bound, which from_json can't describe, so one document's tree is flattened, or built, by
small recursive helpers in Arrow UDFs; all else is DataFrame code over block rows. What is read is written
back: attributes, tables with their whole tuple, figures, definition lists, notes and metadata.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.batches import rows_of, small_batches
from ..operators.structure import collected
from ..schema import BLOCK, BLOCK_COLUMNS, PANDOC_API_VERSION, SECTION_NAMES

DEEPEST = 128
TEXT_MODES = ("markdown", "text")

# Constructors of the AST and the inline types that they are.
INLINES = {"Strong": "bold", "Emph": "italic", "Strikeout": "strikethrough", "Superscript": "superscript", "Subscript": "subscript", "SmallCaps": "smallcaps", "Underline": "underline"}
_CONSTRUCTORS = {v: k for k, v in INLINES.items()}
_PLAIN = ("Str", "Space", "SoftBreak")
_BLANKS = {"Space": " ", "SoftBreak": " "}
_NO_ATTR = ["", [], []]
#: Attributes of a block that say what it is; the others go with it as they are.
_OWN = {"id", "class", "heading_level", "language", "format", "list_type", "ordered", "start", "number_style", "number_delim", "role", "source_type", "pandoc_ast", "short_caption", "href", "src", "title", "alt", "display", "quote_type", "key", "citations"}


def flat_text(inlines: list) -> str:
    """The plain text of inlines."""
    out = []
    for x in inlines:
        t, c = x["t"], x.get("c")
        if t == "Str":
            out.append(c)
        elif t in ("Space", "SoftBreak", "LineBreak"):
            out.append(" ")
        elif t in ("Code", "Math", "RawInline"):
            out.append(c[1])
        elif t in INLINES:
            out.append(flat_text(c))
        elif t in ("Link", "Image", "Quoted", "Span", "Cite"):
            out.append(flat_text(c[1]))
    return "".join(out)


def _words_text(inlines: list) -> str | None:
    """The text of words and blanks; null if there is anything else."""
    try:
        return "".join([x["c"] if x["t"] == "Str" else _BLANKS[x["t"]] for x in inlines])
    except KeyError:
        return None


def _attr(a: list) -> dict:
    own = {"id": a[0], "class": " ".join(a[1])} | dict(a[2])
    return {k: v for k, v in own.items() if v}


def _cells(row: list) -> list[str]:
    return [" ".join(filter(None, (flat_text(b["c"]) if b["t"] in ("Para", "Plain") else "" for b in cell[4]))) for cell in row[1]]


class _Flat:
    """Collects the rows of one document."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def row(self, kind, what, content, level, attributes=None, encoding="text") -> None:
        if level > DEEPEST:
            raise ValueError(f"nested deeper than {DEEPEST}")
        self.rows.append((kind, what, content or None, level, encoding, [(k, str(v)) for k, v in (attributes or {}).items()], len(self.rows)))

    def text(self, what: str, inlines: list, level: int, attributes=None) -> None:
        said = _words_text(inlines)
        if said is not None:
            self.row("block", what, said, level, attributes)
        else:
            self.row("block", what, flat_text(inlines) if what == "heading" else None, level, attributes)
            self.inlines(inlines, level + 1)

    def inlines(self, inlines: list, level: int) -> None:
        said: list[str] = []
        for x in [*inlines, {"t": "End"}]:
            t = x["t"]
            if t == "Str":
                said.append(x.get("c"))
            elif t == "Space":
                said.append(" ")
            else:
                if text := "".join(said):
                    self.row("inline", "text", text, level)
                said.clear()
                if t != "End":
                    self.inline(t, x.get("c"), level, x)

    def inline(self, t: str, c, level: int, whole: dict) -> None:
        if t in ("LineBreak", "SoftBreak"):
            self.row("inline", t.lower(), None, level)
        elif t in INLINES:
            self.holder(INLINES[t], c, level, {})
        elif t == "Code":
            self.row("inline", "code", c[1], level, _attr(c[0]))
        elif t == "Math":
            self.row("inline", "math", c[1], level, {"display": "block" if c[0]["t"] == "DisplayMath" else "inline"})
        elif t == "RawInline":
            self.row("inline", "raw", c[1], level, {"format": c[0]})
        elif t == "Link":
            self.holder("link", c[1], level, _attr(c[0]) | {"href": c[2][0]} | ({"title": c[2][1]} if c[2][1] else {}))
        elif t == "Image":
            alt = flat_text(c[1])
            self.row("inline", "image", alt, level, _attr(c[0]) | {"src": c[2][0]} | ({"title": c[2][1]} if c[2][1] else {}) | ({"alt": alt} if alt else {}))
        elif t == "Quoted":
            self.holder("quoted", c[1], level, {"quote_type": c[0]["t"].removesuffix("Quote").lower()})
        elif t == "Cite":
            self.holder("cite", c[1], level, {"citations": json.dumps(c[0], ensure_ascii=False)})
        elif t == "Span":
            self.holder("span", c[1], level, _attr(c[0]))
        elif t == "Note":
            self.row("inline", "note", None, level, {"block_count": len(c)} if len(c) > 1 else {})
            self.blocks(c, level + 1)
        else:
            self.row("inline", "generic", json.dumps(whole, ensure_ascii=False), level, {"source_type": t}, "json")

    def holder(self, what: str, inlines: list, level: int, attributes: dict) -> None:
        """An inline around others: flat if they are text alone."""
        simple = all(y["t"] in ("Str", "Space") for y in inlines)
        self.row("inline", what, flat_text(inlines) if simple else None, level, attributes)
        if not simple:
            self.inlines(inlines, level + 1)

    def blocks(self, blocks: list, level: int) -> None:
        for b in blocks:
            make = getattr(self, f"read_{b['t']}", None)
            if make is None:
                self.row("block", "generic", json.dumps(b, ensure_ascii=False), level, {"source_type": b["t"]}, "json")
            else:
                make(b.get("c"), level)

    def read_Null(self, c, level) -> None:
        """Nothing at all."""

    def read_Header(self, c, level) -> None:
        self.text("heading", c[2], level, {"heading_level": c[0]} | _attr(c[1]))

    def read_Para(self, c, level) -> None:
        self.text("paragraph", c, level)

    def read_Plain(self, c, level) -> None:
        self.text("plain", c, level)

    def read_CodeBlock(self, c, level) -> None:
        self.row("block", "code", c[1].rstrip("\r\n"), level, ({"language": c[0][1][0]} if c[0][1] else {}) | _attr(c[0]))

    def read_RawBlock(self, c, level) -> None:
        self.row("block", "raw", c[1], level, {"format": c[0]})

    def read_HorizontalRule(self, c, level) -> None:
        self.row("block", "hr", None, level)

    def read_LineBlock(self, c, level) -> None:
        lines = [x for line in c for x in [*line, {"t": "LineBreak"}]][:-1]
        if all(x["t"] in (*_PLAIN, "LineBreak") for x in lines):
            self.row("block", "lineblock", "\n".join(map(flat_text, c)), level)
        else:
            self.row("block", "lineblock", None, level)
            self.inlines(lines, level + 1)

    def read_BlockQuote(self, c, level) -> None:
        self.row("block", "blockquote", None, level)
        self.blocks(c, level + 1)

    def read_Div(self, c, level) -> None:
        own = _attr(c[0])
        named = own.get("role") or next((k for k in c[0][1] if k in SECTION_NAMES or k == "page"), "")
        what = "section" if named in SECTION_NAMES else "page_break" if named == "page" else "div"
        self.row("block", what, None, level, own | ({"role": named} if what != "div" else {}))
        self.blocks(c[1], level + 1)

    def items(self, kind: str, items: list, level: int, attributes: dict) -> None:
        self.row("block", "list", None, level, {"list_type": kind, "ordered": "true" if kind == "ordered" else "false"} | attributes)
        for item, own in items:
            if len(item) == 1 and item[0]["t"] == "Plain":
                self.text("list_item", item[0]["c"], level + 1, own)
            else:
                self.row("block", "list_item", None, level + 1, own)
                self.blocks(item, level + 2)

    def read_BulletList(self, c, level) -> None:
        self.items("bullet", [(x, {}) for x in c], level, {})

    def read_OrderedList(self, c, level) -> None:
        (start, style, delim), items = c
        self.items("ordered", [(x, {}) for x in items], level, {"start": start, "number_style": style["t"], "number_delim": delim["t"]})

    def read_DefinitionList(self, c, level) -> None:
        items = [x for term, bodies in c for x in [([{"t": "Plain", "c": term}], {"role": "term"}), *((body, {"role": "definition"}) for body in bodies)]]
        self.items("definition", items, level, {})

    def read_Table(self, c, level) -> None:
        head = _cells(c[3][1][0]) if c[3][1] else []
        body = [_cells(r) for r in c[3][1][1:]] + [_cells(r) for part in c[4] for r in [*part[2], *part[3]]] + [_cells(r) for r in c[5][1]]
        own = _attr(c[0]) | {"pandoc_ast": json.dumps(c, ensure_ascii=False, separators=(",", ":"))}
        self.row("block", "table", table_content(head, body), level, own, "json")

    def read_Figure(self, c, level) -> None:
        attr, (short, caption), inner = c
        self.row("block", "figure", None, level, _attr(attr))
        self.blocks(inner, level + 1)
        if caption or short:
            self.row("block", "caption", None, level + 1, {"short_caption": flat_text(short)} if short else {})
            self.blocks(caption, level + 2)

    def value(self, key: str | None, value: dict, level: int) -> None:
        """A metadata value, named by `key` unless it stands in a list."""
        t, c = value["t"].removeprefix("Meta"), value.get("c")
        own = {} if key is None else {"key": key}
        if t == "Bool":
            self.row("value", "bool", "true" if c else "false", level, own)
        elif t == "String":
            self.row("value", "string", c, level, own)
        elif t == "Inlines":
            self.row("value", "inlines", None, level, own)
            self.inlines(c, level + 1)
        elif t == "Blocks":
            self.row("value", "blocks", None, level, own)
            self.blocks(c, level + 1)
        elif t in ("List", "Map"):
            self.row("value", t.lower(), None, level, own)
            for k, x in c.items() if t == "Map" else ((None, x) for x in c):
                self.value(k, x, level + 1)
        else:
            self.row("value", "generic", json.dumps(value, ensure_ascii=False), level, own, "json")


def table_content(headers: list[str], rows: list[list[str]]) -> str:
    return json.dumps({"headers": headers, "rows": rows}, ensure_ascii=False, separators=(",", ":"))


def to_rows(text: str | None) -> list[tuple] | None:
    """The block rows of one AST, or of an array of its blocks; null for null. Metadata follows as value rows."""
    if text is None:
        return None
    ast = json.loads(text)
    flat = _Flat()
    flat.blocks(ast["blocks"] if isinstance(ast, dict) else ast, 1)
    for key, value in (ast.get("meta", {}) if isinstance(ast, dict) else {}).items():
        flat.value(key, value, 1)
    return flat.rows


def inline_rows(text: str | None) -> list[tuple] | None:
    """The inline rows of an array of inlines; null for null."""
    if text is None:
        return None
    return list(_kept_rows(text) if len(text) < KEPT_LENGTH else _inline_rows(text))


def _inline_rows(text: str) -> list[tuple]:
    flat = _Flat()
    found = json.loads(text)
    flat.inlines(found if isinstance(found, list) else [found], 1)
    return flat.rows


#: Texts that are asked for in several ways in one batch are taken apart once; longer ones than this aren't kept.
KEPT_LENGTH = 1 << 15
_kept_rows = lru_cache(1024)(_inline_rows)


_ARROW_BLOCKS = pa.list_(pa.struct([("kind", pa.string()), ("element_type", pa.string()), ("content", pa.string()), ("level", pa.int32()), ("encoding", pa.string()), ("attributes", pa.map_(pa.string(), pa.string())), ("element_order", pa.int32())]))


def _as_dicts(rows: list[tuple] | None) -> list[dict] | None:
    return None if rows is None else [dict(zip(BLOCK_COLUMNS, x, strict=True)) for x in rows]


def _as_blocks(rows: Iterable[list[tuple] | None]) -> pa.Array:
    made = [pa.array([_as_dicts(r)], _ARROW_BLOCKS) for r in rows]  # one document at a time
    return pa.concat_arrays(made) if made else pa.array([], _ARROW_BLOCKS)


@F.arrow_udf(T.ArrayType(BLOCK))
def interchange_to_blocks(text: pa.Array) -> pa.Array:
    """The blocks of each AST as an array; null for null."""
    return _as_blocks(to_rows(t.as_py()) for t in text)


@F.arrow_udf(T.ArrayType(BLOCK))
def inlines_to_rows(text: pa.Array) -> pa.Array:
    """The inline rows of each JSON array of inlines; null for null."""
    return _as_blocks(inline_rows(t.as_py()) for t in text)


def read_interchange(docs: DataFrame, by: str = "doc", text: str = "text") -> DataFrame:
    """The block table of documents as ASTs; a null text has no blocks. Nesting deeper than DEEPEST is an error."""
    rows = rows_of(docs, by, text, lambda x: _as_dicts(to_rows(x)), _ARROW_BLOCKS.value_type, BLOCK)
    return rows.select(by, *BLOCK_COLUMNS)


def _subtrees(rows: list[dict]):
    """(row, rows below it) of the topmost rows, whatever their levels are."""
    k = 0
    while k < len(rows):
        end = k + 1
        while end < len(rows) and rows[end]["level"] > rows[k]["level"]:
            end += 1
        yield rows[k], rows[k + 1 : end]
        k = end


def _words(text: str | None) -> list:
    out = []
    for n, line in enumerate((text or "").split("\n")):
        out += [{"t": "SoftBreak"}] if n else []
        for k, w in enumerate(line.split(" ")):
            out += ([{"t": "Space"}] if k else []) + ([{"t": "Str", "c": w}] if w else [])
    return out


def _attributes(row: dict) -> dict:
    return dict(row["attributes"] or [])


def _ast_attr(a: dict, drop: tuple[str, ...] = ()) -> list:
    return [a.get("id", ""), a.get("class", "").split(), [[k, v] for k, v in a.items() if k not in _OWN and k not in drop]]


def _of_kind(rows: list[dict], kind: str) -> list[dict]:
    """The topmost rows of this kind with all that is below them."""
    return [x for r, below in _subtrees(rows) if r["kind"] == kind for x in [r, *below]]


def _inline_ast(rows: list[dict]) -> list:
    out = []
    for r, below in _subtrees(rows):
        kind, a, content = r["element_type"], _attributes(r), r["content"]
        inner = _inline_ast(_of_kind(below, "inline")) or _words(content)
        if kind in _CONSTRUCTORS:
            out.append({"t": _CONSTRUCTORS[kind], "c": inner})
        elif kind == "space":
            out.append({"t": "Space"})
        elif kind in ("linebreak", "softbreak"):
            out.append({"t": "LineBreak" if kind == "linebreak" else "SoftBreak"})
        elif kind == "code":
            out.append({"t": "Code", "c": [_ast_attr(a), content or ""]})
        elif kind == "math":
            out.append({"t": "Math", "c": [{"t": "DisplayMath" if a.get("display") in ("block", "true") else "InlineMath"}, content or ""]})
        elif kind == "raw":
            out.append({"t": "RawInline", "c": [a.get("format", ""), content or ""]})
        elif kind == "link":
            out.append({"t": "Link", "c": [_ast_attr(a), inner, [a.get("href", ""), a.get("title", "")]]})
        elif kind == "image":
            out.append({"t": "Image", "c": [_ast_attr(a), inner or _words(a.get("alt")), [a.get("src", ""), a.get("title", "")]]})
        elif kind == "quoted":
            out.append({"t": "Quoted", "c": [{"t": "SingleQuote" if a.get("quote_type") == "single" else "DoubleQuote"}, inner]})
        elif kind == "cite":
            out.append({"t": "Cite", "c": [json.loads(a.get("citations", "[]")), inner]})
        elif kind == "span":
            out.append({"t": "Span", "c": [_ast_attr(a), inner]})
        elif kind == "note":
            out.append({"t": "Note", "c": _block_ast(below) or [{"t": "Para", "c": inner}]})
        elif kind == "generic" and r["encoding"] == "json" and content:
            out.append(json.loads(content))
        else:
            out += inner
    return out


def _table_ast(row: dict, a: dict) -> dict:
    if "pandoc_ast" in a:
        return {"t": "Table", "c": json.loads(a["pandoc_ast"])}
    try:
        made = json.loads(row["content"] or "{}")
        head, rows = made.get("headers") or [], made.get("rows") or []
    except (ValueError, AttributeError):
        return {"t": "Div", "c": [_ast_attr(a), []]}  # no table; its text isn't made prose of
    width = max([len(head), *map(len, rows)], default=0)
    cell = lambda text: [_NO_ATTR, {"t": "AlignDefault"}, 1, 1, [{"t": "Plain", "c": _words(str(text))}] if text not in (None, "") else []]
    line = lambda cells: [_NO_ATTR, [cell(x) for x in [*cells, *[""] * (width - len(cells))]]]
    columns = [[{"t": "AlignDefault"}, {"t": "ColWidthDefault"}]] * width
    return {"t": "Table", "c": [_ast_attr(a), [None, []], columns, [_NO_ATTR, [line(head)] if head else []], [[_NO_ATTR, 0, [], [line(x) for x in rows]]], [_NO_ATTR, []]]}


def _items_ast(below: list[dict]) -> list[tuple[dict, list]]:
    """(attributes, blocks) of the items of a list."""
    return [(_attributes(r), _text_and_blocks(r, inner)) for r, inner in _subtrees(below)]


def _text_and_blocks(row: dict, below: list[dict]) -> list:
    """The blocks of a row that holds blocks, text or inlines, text before blocks."""
    said = _inline_ast(_of_kind(below, "inline")) or _words(row["content"])
    return ([{"t": "Plain", "c": said}] if said else []) + _block_ast(_of_kind(below, "block"))


def _block_ast(rows: list[dict], noted: frozenset[str] = frozenset()) -> list:
    out = []
    for r, below in _subtrees(rows):
        kind, a = r["element_type"], _attributes(r)
        if r["kind"] != "block" or kind == "metadata":
            continue
        if kind == "document":
            out += _block_ast(below, noted)  # a root says nothing itself
            continue
        if kind == "div" and a.get("source_type") == "footnote" and a.get("id") in noted:
            continue  # its note has it
        said = _inline_ast(_of_kind(below, "inline")) or _words(r["content"])
        if kind == "heading":
            level = a.get("heading_level", "1")
            out.append({"t": "Header", "c": [int(level) if level.lstrip("-").isdigit() else 1, _ast_attr(a), said]})
        elif kind == "code":
            language = [a["language"]] if "language" in a else []
            classes = a.get("class", "").split()
            out.append({"t": "CodeBlock", "c": [[a.get("id", ""), classes if language[:1] == classes[:1] else language + classes, _ast_attr(a)[2]], r["content"] or ""]})
        elif kind == "hr":
            out.append({"t": "HorizontalRule"})
        elif kind == "raw":
            out.append({"t": "RawBlock", "c": [a.get("format", ""), r["content"] or ""]})
        elif kind == "table":
            out.append(_table_ast(r, a))
        elif kind == "lineblock":
            lines: list[list] = [[]]
            for x in _inline_ast(_of_kind(below, "inline")) or [x for n, line in enumerate((r["content"] or "").split("\n")) for x in ([{"t": "LineBreak"}] if n else []) + _words(line)]:
                if x["t"] == "LineBreak":
                    lines.append([])
                else:
                    lines[-1].append(x)
            out.append({"t": "LineBlock", "c": lines})
        elif kind == "blockquote":
            out.append({"t": "BlockQuote", "c": _as_paragraphs(_text_and_blocks(r, below))})
        elif kind in ("div", "section", "page_break"):
            name = {"section": a.get("role", "section"), "page_break": "page"}.get(kind)
            attr = _ast_attr(a, ("page_number",) if kind == "div" else ())
            if name and name not in attr[1]:
                attr = [attr[0], [*attr[1], name], attr[2]]
            elif not name and a.get("role"):
                attr[2].append(["role", a["role"]])
            if kind == "div" and a.get("source_type"):
                attr = [attr[0], [*attr[1], a["source_type"]] if a["source_type"] not in attr[1] else attr[1], attr[2]]
            out.append({"t": "Div", "c": [attr, _as_paragraphs(_text_and_blocks(r, below))]})
        elif kind in ("list", "deflist"):
            items = _items_ast(below)
            if kind == "deflist" or a.get("list_type") == "definition":
                pairs: list[list] = []
                for own, blocks in items:
                    if own.get("role") != "definition" or not pairs:
                        pairs.append([blocks[0]["c"] if blocks and blocks[0]["t"] in ("Plain", "Para") else [], []])
                    else:
                        pairs[-1][1].append(blocks)
                out.append({"t": "DefinitionList", "c": pairs})
            elif a.get("list_type") == "ordered" or a.get("ordered") == "true":
                start = a.get("start", "1")
                style = [int(start) if start.lstrip("-").isdigit() else 1, {"t": a.get("number_style", "Decimal")}, {"t": a.get("number_delim", "Period")}]
                out.append({"t": "OrderedList", "c": [style, [b for _, b in items]]})
            else:
                out.append({"t": "BulletList", "c": [b for _, b in items]})
        elif kind == "figure":
            captions = [(x, own) for x, own in _subtrees(below) if x["element_type"] == "caption"]
            inner = [x for y, own in _subtrees(below) if y["element_type"] != "caption" for x in [y, *own]]
            short = next((_attributes(x).get("short_caption") for x, _ in captions), None)
            out.append({"t": "Figure", "c": [_ast_attr(a), [_words(short) if short else None, [b for x, own in captions for b in _text_and_blocks(x, own)]], _text_and_blocks(r, inner)]})
        elif kind == "image":
            alt = a.get("alt") or r["content"]
            out.append({"t": "Para", "c": [{"t": "Image", "c": [_ast_attr(a), _words(alt), [a.get("src", ""), a.get("title", "")]]}]})
        elif kind == "generic" and r["encoding"] == "json" and r["content"]:
            out.append(json.loads(r["content"]))
        elif kind in ("list_item", "caption"):
            wrapped = _text_and_blocks(r, below)  # without its parent
            out.append({"t": "BulletList", "c": [wrapped]} if kind == "list_item" else {"t": "Figure", "c": [_NO_ATTR, [None, wrapped], []]})
        else:
            out.append({"t": "Plain" if kind == "plain" else "Para", "c": said})
    return out


def _as_paragraphs(blocks: list) -> list:
    """Text that a container holds itself is a paragraph of it."""
    return [{"t": "Para", "c": b["c"]} if k == 0 and b["t"] == "Plain" and len(blocks) == 1 else b for k, b in enumerate(blocks)]


def _value_ast(row: dict, below: list[dict]) -> dict:
    kind = row["element_type"]
    if kind == "bool":
        return {"t": "MetaBool", "c": row["content"] == "true"}
    if kind == "list":
        return {"t": "MetaList", "c": [_value_ast(r, own) for r, own in _subtrees(below) if r["kind"] == "value"]}
    if kind == "map":
        return {"t": "MetaMap", "c": {_attributes(r).get("key", ""): _value_ast(r, own) for r, own in _subtrees(below) if r["kind"] == "value"}}
    if kind == "blocks":
        return {"t": "MetaBlocks", "c": _block_ast(below)}
    if kind == "inlines":
        return {"t": "MetaInlines", "c": _inline_ast(_of_kind(below, "inline")) or _words(row["content"])}
    if kind == "generic" and row["encoding"] == "json" and row["content"]:
        return json.loads(row["content"])
    return {"t": "MetaString", "c": row["content"] or ""}


def _dumped(value) -> str:
    return json.dumps(value, ensure_ascii=False, check_circular=False)  # trees have no circles


def _words_json(text: str | None) -> str:
    """What `_words` gives, as JSON; a line with single blanks is written at once, not word by word."""
    if not text or "\n" in text or "  " in text or text[0] == " " or text[-1] == " ":
        return _dumped(_words(text))
    return '[{"t": "Str", "c": ' + _dumped(text).replace(" ", '"}, {"t": "Space"}, {"t": "Str", "c": "') + "}]"


def _blocks_json(rows: list[dict], noted: frozenset[str]) -> str:
    """What `_block_ast` gives, as JSON, one topmost block at a time."""
    out = []
    for r, below in _subtrees(rows):
        if not below and r["kind"] == "block" and r["element_type"] in ("paragraph", "plain"):
            out.append(f'{{"t": "{"Plain" if r["element_type"] == "plain" else "Para"}", "c": {_words_json(r["content"])}}}')
        else:
            out += map(_dumped, _block_ast([r, *below], noted))
    return f"[{', '.join(out)}]"


def ast_parts(rows: list[dict] | None) -> dict[str, str] | None:
    """meta and blocks of one document's rows in order, as JSON; null for null."""
    if rows is None:
        return None
    noted = frozenset(i for r in rows if r["kind"] == "inline" and r["element_type"] == "note" and (i := _attributes(r).get("id")))
    meta = {_attributes(r).get("key", ""): _value_ast(r, below) for r, below in _subtrees(rows) if r["kind"] == "value" and "key" in _attributes(r)}
    return {"meta": _dumped(meta), "blocks": _blocks_json(rows, noted)}


def _rows_of(array: pa.ListScalar) -> list[dict] | None:
    """The rows of one array of blocks; null for null. Columns are taken as a whole, which is faster than row by row."""
    if not array.is_valid or array.values.null_count:
        return array.as_py()
    names = [f.name for f in array.values.type]
    return [dict(zip(names, x, strict=True)) for x in zip(*[c.to_pylist() for c in array.values.flatten()], strict=True)]


@F.arrow_udf(T.StructType([T.StructField("meta", T.StringType()), T.StructField("blocks", T.StringType())]))
def _parts(blocks: pa.Array) -> pa.Array:
    made = (ast_parts(_rows_of(b)) for b in blocks)  # one document at a time
    return pa.array(made, pa.struct([("meta", pa.string()), ("blocks", pa.string())]))


def ast_struct(blocks: Column | str) -> Column:
    """struct<pandoc-api-version, meta, blocks> of each array of blocks, the last two as JSON text; null for null."""
    version = F.array(*[F.lit(v) for v in PANDOC_API_VERSION])
    parts = _parts(blocks)
    return F.when(parts.isNotNull(), F.struct(version.alias("pandoc-api-version"), parts["meta"].alias("meta"), parts["blocks"].alias("blocks")))


def ast_blocks(blocks: Column | str) -> Column:
    """The JSON array of AST blocks of each array of blocks; null for null."""
    return _parts(blocks)["blocks"]


def blocks_to_interchange(blocks: Column | str) -> Column:
    """The whole AST text of each array of blocks; null for null."""
    parts = _parts(blocks)
    return F.when(parts.isNotNull(), F.concat(F.lit(f'{{"pandoc-api-version": {list(PANDOC_API_VERSION)}, "meta": '), parts["meta"], F.lit(', "blocks": '), parts["blocks"], F.lit("}")))


@F.arrow_udf(T.StringType())
def rows_to_inlines(rows: pa.Array) -> pa.Array:
    """The JSON array of inlines of each array of inline rows; null for null. Flatten nested arrays first."""
    return pa.array((None if not r.is_valid else _dumped(_inline_ast(r.as_py())) for r in rows), pa.string())


# The marks around inlines in the markdown mode.
_MARKS = {"bold": "**", "italic": "*", "strikethrough": "~~", "superscript": "^", "subscript": "~", "code": "`"}


def inline_text(rows: list[dict], mode: str) -> str:
    """The text of inline rows. `markdown` keeps marks, links and hard breaks; `text` has words alone."""
    out = ""
    for r, below in _subtrees(rows):
        kind, a = r["element_type"], _attributes(r)
        inner = inline_text(below, mode) if below else r["content"] or ""
        if kind in ("softbreak", "space"):
            out += " " if mode == "text" or kind == "space" else "\n"
        elif kind == "linebreak":
            out += "\n" if mode == "text" else "  \n"
        elif mode == "text" or kind not in (*_MARKS, "link", "image", "math", "quoted"):
            quote = {"single": "''", "double": '""'}.get(a.get("quote_type", ""), "  ") if kind == "quoted" else None
            out += f"{quote[0]}{inner}{quote[1]}" if quote else inner
        elif kind in _MARKS:
            out += f"{_MARKS[kind]}{inner}{_MARKS[kind]}"
        elif kind == "math":
            out += f"$${inner}$$" if a.get("display") == "block" else f"${inner}$"
        elif kind == "quoted":
            out += f"'{inner}'" if a.get("quote_type") == "single" else f'"{inner}"'
        else:
            title = f' "{a["title"]}"' if a.get("title") else ""
            out += f"{'!' if kind == 'image' else ''}[{inner}]({a.get('src' if kind == 'image' else 'href', '')}{title})"
    return out


@F.arrow_udf(T.StringType())
def _inlines_text(text: pa.Array, mode: pa.Array) -> pa.Array:
    def one(t, m):
        if t is None:
            return None
        if m not in TEXT_MODES:
            raise ValueError(f"inlines_to_text: {m} is none of {', '.join(TEXT_MODES)}")
        return inline_text(_as_dicts(inline_rows(t)), m)

    return pa.array((one(t.as_py(), m.as_py()) for t, m in zip(text, mode, strict=True)), pa.string())


def inlines_to_text(text: Column | str, mode: Column | str = "markdown") -> Column:
    """The text of each JSON array of inlines, in the mode of its own row; null for null."""
    return _inlines_text(text, F.lit(mode) if isinstance(mode, str) else mode)


def write_interchange(blocks: DataFrame, by: str = "doc") -> DataFrame:
    """(doc, text): the AST of each document."""
    return small_batches(collected(blocks, by)).select(by, blocks_to_interchange("blocks").alias("text"))


def ast_table(blocks: DataFrame, by: str = "doc") -> DataFrame:
    """(doc, pandoc-api-version, meta, blocks) with JSON values as variants, a row a document: what JSON sinks take."""
    made = collected(blocks, by).select(by, ast_struct("blocks").alias("ast"))
    return made.select(by, F.col("ast.`pandoc-api-version`"), F.parse_json("ast.meta").alias("meta"), F.parse_json("ast.blocks").alias("blocks"))


def write_interchange_files(blocks: DataFrame, path: str, by: str = "doc", compression: str = "none") -> None:
    """Writes the AST of each document as a text file in a folder of its own, `<by>=<document>`, by the tasks that have it.

    An AST is some seven times as long as its text; with `gzip` the files, `.txt.gz`, are smaller than the text. Documents
    are sorted before their ASTs are made, since a folder each needs an order and ASTs would fill the sort's memory.
    """
    documents = small_batches(collected(blocks, by)).sortWithinPartitions(by)
    made = documents.select(by, blocks_to_interchange("blocks").alias("text"))
    made.write.partitionBy(by).option("lineSep", "\n").option("compression", compression).text(path)
