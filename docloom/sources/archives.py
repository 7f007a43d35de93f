"""DOCX, ODT and EPUB: members of a ZIP container, taken apart into records in tasks, then laid out by Spark.

The Python part only lists what stands in a document, one record after the other: what it is, its runs of text with
their marks, the depth and kind of an item. Which blocks these are, and which lists, quotes and levels they make, is
DataFrame code that all readers share (`assemble`).
"""

from __future__ import annotations

import io
import json
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.batches import rows_of
from ..functions.text import class_slug
from .assemble import assemble

FORMATS = ("docx", "odt", "epub")
#: Members larger than this aren't taken apart.
MOST_BYTES = 1 << 30

# Namespaces, and names of the formats.
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_TEXT = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"
_STYLE = "{urn:oasis:names:tc:opendocument:xmlns:style:1.0}"
_FO = "{urn:oasis:names:tc:opendocument:xmlns:xsl-fo-compatible:1.0}"
_TABLE = "{urn:oasis:names:tc:opendocument:xmlns:table:1.0}"
_DRAW = "{urn:oasis:names:tc:opendocument:xmlns:drawing:1.0}"
_XLINK = "{http://www.w3.org/1999/xlink}"
_DC = "{http://purl.org/dc/elements/1.1/}"
_OPS = "{http://www.idpf.org/2007/ops}"
_META = {"title": "title", "creator": "author", "subject": "subject", "description": "description", "keywords": "keywords", "date": "date", "language": "lang", "publisher": "publisher"}
_HTML_MARKS = {"strong": "bold", "b": "bold", "em": "italic", "i": "italic", "cite": "italic", "var": "italic", "u": "underline", "ins": "underline", "del": "strikethrough", "s": "strikethrough", "strike": "strikethrough", "code": "code", "kbd": "code", "samp": "code", "tt": "code", "sup": "superscript", "sub": "subscript"}
_SECTIONS = ("section", "article", "aside", "nav", "header", "footer", "main")

Run = tuple[str, str, dict]  # type, content, attributes


def record(what: str, runs: list[Run] = (), rank: int = 1, depth: int = 1, kind: str | None = None, base: int = 0, style: str | None = None, ident: str | None = None, **more: str) -> dict:
    """One record; neighbouring runs of one kind are one."""
    merged: list[list] = []
    for t, c, a in runs:
        if merged and merged[-1][0] == t and merged[-1][2] == a and t not in ("image", "note", "linebreak"):
            merged[-1][1] += c
        elif c or t in ("image", "linebreak"):
            merged.append([t, c, a])
    pieces = [{"type": t, "content": c, "attributes": list(a.items()), "depth": 0} for t, c, a in merged]
    return {"what": what, "pieces": pieces, "base": base, "depth": depth, "kind": kind, "rank": rank, "start": None, "style": style, "ident": ident, "more": list(more.items())}


def _words(runs: list[Run]) -> str:
    return " ".join("".join(c for _, c, _ in runs).split())


#: Blanks that aren't a single one.
_BLANKS = re.compile(r"[^\S ]\s*| \s+")


def _single(text: str) -> str:
    """Runs of blanks as one."""
    return _BLANKS.sub(" ", text)


def _table(rows: list[list[str]], headed: bool) -> list[Run]:
    head, body = (rows[0], rows[1:]) if headed and rows else ([], rows)
    return [("text", json.dumps({"headers": head, "rows": body}, ensure_ascii=False, separators=(",", ":")), {})]


def _xml(zf: zipfile.ZipFile, name: str, needed: bool = True) -> ElementTree.Element | None:
    """A member; one that isn't there is an error if it is needed. Declarations of entities are refused."""
    if not needed and name not in zf.namelist():
        return None
    if zf.getinfo(name).file_size > MOST_BYTES:
        raise ValueError(f"{name} is larger than {MOST_BYTES} bytes")
    data = zf.read(name)
    if b"<!ENTITY" in data:
        raise ValueError(f"{name} declares entities")
    return ElementTree.fromstring(data)


def _metadata(root: ElementTree.Element | None) -> Iterator[dict]:
    for x in root.iter() if root is not None else ():
        name = x.tag.rsplit("}", 1)[-1] if isinstance(x.tag, str) else ""
        if name in _META and (x.text or "").strip():
            yield record("meta", [("text", x.text.strip(), {})], ident=_META[name])


def _is_on(node: ElementTree.Element | None) -> bool:
    return node is not None and node.get(f"{_W}val", "true").lower() not in ("0", "false", "off", "none")


class _Docx:
    def __init__(self, zf: zipfile.ZipFile) -> None:
        self.body = _xml(zf, "word/document.xml")
        rels = _xml(zf, "word/_rels/document.xml.rels", False)
        self.targets = {x.get("Id"): x.get("Target", "") for x in rels} if rels is not None else {}
        styles, numbering, notes = (_xml(zf, f"word/{n}.xml", False) for n in ("styles", "numbering", "footnotes"))
        self.styles = {s.get(f"{_W}styleId"): (next((n.get(f"{_W}val", "") for n in s.findall(f"{_W}name")), ""), next((int(o.get(f"{_W}val", "9")) for o in s.iter(f"{_W}outlineLvl")), 9)) for s in styles.iter(f"{_W}style")} if styles is not None else {}
        self.formats: dict[tuple[str, str], str] = {}
        if numbering is not None:
            abstract = {a.get(f"{_W}abstractNumId"): {v.get(f"{_W}ilvl"): next((f.get(f"{_W}val") for f in v.findall(f"{_W}numFmt")), "decimal") for v in a.findall(f"{_W}lvl")} for a in numbering.findall(f"{_W}abstractNum")}
            for n in numbering.findall(f"{_W}num"):
                at = next((x.get(f"{_W}val") for x in n.findall(f"{_W}abstractNumId")), None)
                self.formats |= {(n.get(f"{_W}numId"), level): fmt for level, fmt in abstract.get(at, {}).items()}
            self.known = {n.get(f"{_W}numId") for n in numbering.findall(f"{_W}num")}
        else:
            self.known = None
        self.notes = {}
        for n in notes.findall(f"{_W}footnote") if notes is not None else ():
            if n.get(f"{_W}type") not in ("separator", "continuationSeparator", "continuationNotice"):
                self.notes[n.get(f"{_W}id")] = _words([r for p in n.iter(f"{_W}p") for r in [*self.runs(p), ("text", " ", {})]])
        self.meta = _xml(zf, "docProps/core.xml", False)

    def run(self, r: ElementTree.Element, link: str | None) -> Iterator[Run]:
        pr = r.find(f"{_W}rPr")
        on = lambda tag: pr is not None and _is_on(pr.find(f"{_W}{tag}"))
        align = pr.find(f"{_W}vertAlign").get(f"{_W}val") if pr is not None and pr.find(f"{_W}vertAlign") is not None else ""
        style = pr.find(f"{_W}rStyle").get(f"{_W}val", "") if pr is not None and pr.find(f"{_W}rStyle") is not None else ""
        marks = ((re.search(r"(?i)code|verbatim", style), "code"), (align == "superscript", "superscript"), (align == "subscript", "subscript"), (on("b"), "bold"), (on("i"), "italic"), (on("u"), "underline"), (on("strike"), "strikethrough"))
        kind = "link" if link is not None else next((name for is_on, name in marks if is_on), "text")
        own = {"href": link} if link is not None else {}
        for x in r:
            if x.tag == f"{_W}t":
                yield kind, x.text or "", own
            elif x.tag == f"{_W}tab":
                yield kind, "\t", own
            elif x.tag in (f"{_W}br", f"{_W}cr"):
                yield kind, " ", own
            elif x.tag in (f"{_W}footnoteReference", f"{_W}endnoteReference") and x.get(f"{_W}id") in self.notes:
                yield "note", self.notes[x.get(f"{_W}id")], {"id": x.get(f"{_W}id")}
            elif x.tag in (f"{_W}drawing", f"{_W}pict"):
                for blip in x.iter(f"{_A}blip"):
                    alt = next((d.get("descr", "") for d in x.iter() if d.tag.endswith("}docPr")), "")
                    yield "image", alt, {"src": self.targets.get(blip.get(f"{_R}embed"), "")} | ({"alt": alt} if alt else {})

    def runs(self, p: ElementTree.Element, link: str | None = None) -> Iterator[Run]:
        for x in p:
            if x.tag == f"{_W}r":
                yield from self.run(x, link)
            elif x.tag == f"{_W}hyperlink":
                anchor = x.get(f"{_W}anchor")
                yield from self.runs(x, self.targets.get(x.get(f"{_R}id")) or (f"#{anchor}" if anchor else ""))
            elif x.tag not in (f"{_W}del", f"{_W}pPr"):  # deleted text is gone
                yield from self.runs(x, link)

    def paragraph(self, p: ElementTree.Element) -> dict | None:
        pr = p.find(f"{_W}pPr")
        value = lambda path, key="val": next((x.get(f"{_W}{key}") for x in pr.findall("/".join(f"{_W}{t}" for t in path.split("/")))), None) if pr is not None else None
        style = value("pStyle") or ""
        name, outline = self.styles.get(style, (style, 9))
        own = value("outlineLvl")
        outline = int(own) if own is not None else outline
        titled = re.fullmatch(r"(?i)heading\s*([1-6])", name) or re.fullmatch(r"(?i)heading\s*([1-6])", style)
        rank = outline + 1 if outline < 6 else int(titled[1]) if titled else 0
        runs = list(self.runs(p))
        if not _words(runs) and not any(t in ("image", "note") for t, _, _ in runs):
            return None
        number, level = value("numPr/numId"), value("numPr/ilvl") or "0"
        indent = value("ind", "left") or value("ind", "start") or "0"
        if rank:
            return record("heading", runs, rank)
        if number not in (None, "0") and (self.known is None or number in self.known):
            return record("item", runs, depth=int(level) + 1, kind="bullet" if self.formats.get((number, level), "bullet") in ("bullet", "none") else "ordered")
        if re.search(r"(?i)definition\s*term", name):
            return record("item", runs, kind="definition", role="term")
        if re.search(r"(?i)^definition", name):
            return record("item", runs, kind="definition", role="definition")
        if re.search(r"(?i)source\s*code|preformatted|verbatim|^code", name):
            return record("code", [("text", "".join(c for _, c, _ in runs), {})])
        if re.search(r"(?i)quote|block\s*text", name) or (indent.lstrip("-").isdigit() and int(indent) >= 720):
            return record("quote", runs, style=name or None)
        return record("paragraph", runs, style=None if name.lower() in ("", "normal", "body text", "first paragraph", "compact", "default") else name)

    def cell(self, c: ElementTree.Element) -> str:
        return " ".join(filter(None, (_words(list(self.runs(p))) for p in c.iter(f"{_W}p"))))

    def walk(self, node: ElementTree.Element) -> Iterator[dict]:
        for x in node:
            if x.tag == f"{_W}p":
                if (made := self.paragraph(x)) is not None:
                    yield made
            elif x.tag == f"{_W}tbl":
                rows = x.findall(f"{_W}tr")
                headed = bool(rows) and rows[0].find(f"{_W}trPr") is not None and _is_on(rows[0].find(f"{_W}trPr").find(f"{_W}tblHeader"))
                yield record("table", _table([[self.cell(c) for c in r.findall(f"{_W}tc")] for r in rows], headed))
            elif x.tag in (f"{_W}sdt", f"{_W}sdtContent", f"{_W}ins", f"{_W}customXml", f"{_W}body"):
                yield from self.walk(x)

    def records(self) -> Iterator[dict]:
        yield from self.walk(self.body)
        yield from _metadata(self.meta)


class _Odt:
    def __init__(self, zf: zipfile.ZipFile) -> None:
        self.content, styles = _xml(zf, "content.xml"), _xml(zf, "styles.xml", False)
        self.meta = _xml(zf, "meta.xml", False)
        self.parents, self.marks, self.lists, self.names = {}, {}, {}, {}
        for root in filter(lambda r: r is not None, (styles, self.content)):
            for s in root.iter(f"{_STYLE}style"):
                name = s.get(f"{_STYLE}name", "")
                self.parents[name], self.names[name] = s.get(f"{_STYLE}parent-style-name"), s.get(f"{_STYLE}display-name", name)
                props = s.find(f"{_STYLE}text-properties")
                if props is not None:
                    position = props.get(f"{_STYLE}text-position", "")
                    found = (("code", "mono" in props.get(f"{_STYLE}font-name", "").lower()), ("superscript", position.startswith("super")), ("subscript", position.startswith("sub")), ("bold", props.get(f"{_FO}font-weight") == "bold"), ("italic", props.get(f"{_FO}font-style") == "italic"), ("underline", props.get(f"{_STYLE}text-underline-style", "none") != "none"), ("strikethrough", props.get(f"{_STYLE}text-line-through-style", "none") != "none"))
                    self.marks[name] = next((k for k, on in found if on), None)
            for s in root.iter(f"{_TEXT}list-style"):
                self.lists[s.get(f"{_STYLE}name")] = {x.get(f"{_TEXT}level"): "ordered" if x.tag == f"{_TEXT}list-level-style-number" else "bullet" for x in s}

    def closure(self, style: str | None) -> list[str]:
        """A style and those that it is made from."""
        out: list[str] = []
        while style and style not in out:
            out.append(style)
            style = self.parents.get(style)
        return out

    def mark(self, style: str | None) -> str:
        return next((m for s in self.closure(style) if (m := self.marks.get(s))), "text")

    def runs(self, node: ElementTree.Element, kind: str = "text", own: dict | None = None) -> Iterator[Run]:
        own = own or {}
        if node.text:
            yield kind, _single(node.text), own
        for x in node:
            if x.tag == f"{_TEXT}s":
                yield kind, " " * int(x.get(f"{_TEXT}c", "1")), own
            elif x.tag == f"{_TEXT}tab":
                yield kind, "\t", own
            elif x.tag == f"{_TEXT}line-break":
                yield kind, " ", own
            elif x.tag == f"{_TEXT}note":
                body = x.find(f"{_TEXT}note-body")
                yield "note", _words([r for p in (body if body is not None else ()) for r in [*self.runs(p), ("text", " ", {})]]), {"id": x.get(f"{_TEXT}id", "")}
            elif x.tag == f"{_DRAW}frame":
                alt = next(("".join(d.itertext()) for d in x if d.tag.endswith("}desc") or d.tag.endswith("}title")), "")
                for image in x.iter(f"{_DRAW}image"):
                    yield "image", alt, {"src": image.get(f"{_XLINK}href", "")} | ({"alt": alt} if alt else {})
            elif x.tag == f"{_TEXT}a":
                yield from self.runs(x, "link", {"href": x.get(f"{_XLINK}href", "")})
            elif x.tag == f"{_TEXT}span":
                yield from self.runs(x, kind if kind != "text" else self.mark(x.get(f"{_TEXT}style-name")), own)
            elif not x.tag.endswith("}annotation"):
                yield from self.runs(x, kind, own)
            if x.tail:
                yield kind, _single(x.tail), own

    def paragraph(self, p: ElementTree.Element, depth: int, kind: str) -> dict | None:
        names = [self.names.get(s, s).replace("_20_", " ").lower() for s in self.closure(p.get(f"{_TEXT}style-name"))]
        is_one = lambda pattern: any(re.search(pattern, n) for n in names)
        runs = list(self.runs(p))
        if is_one(r"preformatted|source code|verbatim"):
            return record("code", [("text", "".join(c for _, c, _ in runs), {})])
        if not _words(runs) and not any(t in ("image", "note") for t, _, _ in runs):
            return None
        if depth:
            return record("item", runs, depth=depth, kind=kind)
        if is_one(r"^definition term"):
            return record("item", runs, kind="definition", role="term")
        if is_one(r"^definition"):
            return record("item", runs, kind="definition", role="definition")
        return record("quote" if is_one(r"quot|block text") else "paragraph", runs)

    def walk(self, node: ElementTree.Element, depth: int = 0, style: str | None = None) -> Iterator[dict]:
        for x in node:
            if x.tag == f"{_TEXT}h":
                rank = x.get(f"{_TEXT}outline-level", "1")
                yield record("heading", list(self.runs(x)), int(rank) if rank in "123456" else 1)
            elif x.tag == f"{_TEXT}p":
                if (made := self.paragraph(x, depth, self.lists.get(style, {}).get(str(depth), "bullet"))) is not None:
                    yield made
            elif x.tag == f"{_TEXT}list":
                yield from self.walk(x, depth + 1, x.get(f"{_TEXT}style-name") or style)
            elif x.tag == f"{_TABLE}table":
                heads, rows = x.findall(f"{_TABLE}table-header-rows/{_TABLE}table-row"), [r for r in x.iter(f"{_TABLE}table-row")]
                cell = lambda c: " ".join(filter(None, (_words(list(self.runs(p))) for p in c.iter(f"{_TEXT}p"))))
                yield record("table", _table([[cell(c) for c in r.findall(f"{_TABLE}table-cell")] for r in rows], bool(heads)))
            elif not x.tag.endswith(("}tracked-changes", "}sequence-decls", "}forms")):
                yield from self.walk(x, depth, style)

    def records(self) -> Iterator[dict]:
        body = next((x for x in self.content.iter() if x.tag.endswith("}text") and x.tag.startswith("{urn:oasis:names:tc:opendocument:xmlns:office")), self.content)
        yield from self.walk(body)
        yield from _metadata(self.meta)


_BLOCK_TAGS = ("h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "dt", "dd", "pre", "blockquote", "ul", "ol", "dl", "table", "hr", "div", "figure", "body", *_SECTIONS)


class _Epub:
    def __init__(self, zf: zipfile.ZipFile) -> None:
        self.zf = zf
        package = next((x.get("full-path") for x in _xml(zf, "META-INF/container.xml").iter() if x.tag.endswith("rootfile")), None)
        if package is None:
            raise ValueError("epub: the container names no package")
        self.folder, self.package = posixpath.dirname(package), _xml(zf, package)
        self.classes: dict[str, str] = {}
        self.lists = 0
        items = {x.get("id"): x for x in self.package.iter() if x.tag.endswith("}item") or x.tag == "item"}
        for x in items.values():
            if x.get("media-type") == "text/css" and (name := self.resolved(x.get("href", ""))) in zf.namelist():
                self.read_css(zf.read(name).decode("utf-8", "replace"))
        refs = [x.get("idref") for x in self.package.iter() if x.tag.endswith("}itemref") or x.tag == "itemref"]  # the spine is the reading order
        self.members = [self.resolved(items[r].get("href", "")) for r in refs if r in items]

    def resolved(self, href: str, near: str | None = None) -> str:
        return posixpath.normpath(posixpath.join(self.folder if near is None else posixpath.dirname(near), unquote(href.split("#")[0])))

    @staticmethod
    def format_of(style: str) -> str | None:
        rules = dict(re.findall(r"([\w-]+)\s*:\s*([^;]+)", style.lower()))
        weight = rules.get("font-weight", "").strip()
        if weight == "bold" or (weight.isdigit() and int(weight) >= 600):
            return "bold"
        if rules.get("font-style", "").strip() in ("italic", "oblique"):
            return "italic"
        line = rules.get("text-decoration", "")
        return "underline" if "underline" in line else "strikethrough" if "line-through" in line else None

    def read_css(self, text: str) -> None:
        for names, body in re.findall(r"([^{}]+)\{([^}]*)\}", re.sub(r"(?s)/\*.*?\*/", "", text)):
            for name in names.split(","):
                one = re.fullmatch(r"\s*(?:\w+)?\.([\w-]+)\s*", name)
                if one and (kind := self.format_of(body)):
                    self.classes[one[1]] = kind

    def runs(self, node: ElementTree.Element, kind: str, own: dict, near: str) -> Iterator[Run]:
        """The text of a node up to its first block, and between blocks the caller's."""
        if node.text:
            yield kind, _single(node.text), own
        for x in node:
            tag = _tag(x)
            if tag in _BLOCK_TAGS:
                yield "block", "", {"node": x}
            elif tag == "br":
                yield kind, " ", own
            elif tag == "img" or tag == "image":
                src, alt = x.get("src") or x.get(f"{_XLINK}href") or "", x.get("alt", "")
                src = src if re.match(r"(?:[a-z]+:|/)", src) else self.resolved(src, near)
                yield "image", alt, {"src": src} | ({"alt": alt} if alt else {})
            elif tag not in ("script", "style", "head"):
                made = _HTML_MARKS.get(tag) or next((self.classes[c] for c in x.get("class", "").split() if c in self.classes), None) or self.format_of(x.get("style", ""))
                if kind != "link" and tag == "a" and x.get("href"):
                    yield from self.runs(x, "link", {"href": x.get("href")}, near)
                else:
                    yield from self.runs(x, kind if kind != "text" or not made else made, own, near)
            if x.tail:
                yield kind, _single(x.tail), own

    def content(self, node: ElementTree.Element, near: str, made, base: int, depth: int, kind: str, inherited: bool = False) -> Iterator[dict]:
        """The records of a node's text, as `made` makes them, and of the blocks within it; paragraphs too if `inherited`."""
        held: list[Run] = []
        first = True
        for run in [*self.runs(node, "text", {}, near), ("block", "", {})]:
            if run[0] != "block":
                held.append(run)
                continue
            if _words(held) or any(t == "image" for t, _, _ in held):
                yield made(_trimmed(held), first)
                first = False
            held = []
            if run[2]:
                at_first = first
                own = (lambda runs, f, at_first=at_first: made(runs, f and at_first)) if inherited and _tag(run[2]["node"]) in ("p", "div") else None
                yield from self.block(run[2]["node"], near, base, depth, kind, own)
                first = False

    def block(self, x: ElementTree.Element, near: str, base: int = 0, depth: int = 0, kind: str = "bullet", made=None) -> Iterator[dict]:
        tag, ident = _tag(x), x.get("id")
        classes = list(dict.fromkeys([*x.get("class", "").split(), *x.get(f"{_OPS}type", "").split()]))
        own = {"class": " ".join(classes)} if classes else {}
        if "pagebreak" in classes:
            yield record("page_break", base=base, ident=ident)
        elif re.fullmatch("h[1-6]", tag):
            yield record("heading", _trimmed([r for r in self.runs(x, "text", {}, near) if r[0] != "block"]), int(tag[1]), base=base, ident=ident, **own)
        elif tag == "pre":
            yield record("code", [("text", "".join(x.itertext()).strip("\n"), {})], base=base, ident=ident)
        elif tag == "hr":
            yield record("hr", base=base)
        elif tag == "table":
            rows = [r for r in x.iter() if _tag(r) == "tr"]
            headed = bool(rows) and (any(_tag(p) == "thead" for p in x) or (len(rows[0]) > 0 and all(_tag(c) == "th" for c in rows[0])))
            yield record("table", _table([[" ".join("".join(c.itertext()).split()) for c in r if _tag(c) in ("td", "th")] for r in rows], headed), base=base, ident=ident)
        elif tag in ("ul", "ol", "dl"):
            self.lists += 1
            number = str(self.lists)  # tells this list from the next one
            for item in x:
                inner = "ordered" if tag == "ol" else "bullet"
                role = {"dt": {"role": "term"}, "dd": {"role": "definition"}}.get(_tag(item), {})
                listed = "definition" if tag == "dl" else inner
                at = depth + 1
                entry = lambda runs, first, listed=listed, role=role, at=at: record("item", runs, depth=at, kind=listed, base=base, ident=number, **role) if first else record("paragraph", runs, base=base + 2 * at)
                yield from self.content(item, near, entry, base, at, listed, True)
        elif tag == "blockquote":
            yield from self.content(x, near, lambda runs, first: record("quote", runs, base=base), base, depth, kind, True)
        elif tag in _SECTIONS or tag == "figure" or (tag == "div" and (own or ident)):
            inner = list(self.content(x, near, lambda runs, first: record("paragraph", runs, base=base + 1), base + 1, depth, kind))
            if inner:
                yield record("section" if tag in _SECTIONS else "div", base=base, ident=ident, **(own | ({"role": tag} if tag in _SECTIONS else {"source_type": "figure"} if tag == "figure" else {})))
                yield from inner
        else:
            yield from self.content(x, near, made or (lambda runs, first: record("paragraph", runs, base=base, ident=ident if first else None, **own)), base, depth, kind)

    def records(self) -> Iterator[dict]:
        for member in self.members:
            root = _xml(self.zf, member)
            body = next((x for x in root.iter() if _tag(x) == "body"), root)
            for x in self.content(body, member, lambda runs, first: record("paragraph", runs), 0, 0, "bullet"):
                yield x
        metadata = next((x for x in self.package.iter() if x.tag.endswith("metadata")), self.package)
        yield from _metadata(metadata)


def _tag(x: ElementTree.Element) -> str:
    return x.tag.rsplit("}", 1)[-1].lower() if isinstance(x.tag, str) else ""


def _trimmed(runs: list[Run]) -> list[Run]:
    """Runs with single blanks and none at the ends."""
    out: list[Run] = []
    for t, c, a in runs:
        if t not in ("image", "note") and (not out or out[-1][1].endswith(" ")):
            c = c.lstrip(" ")
        out.append((t, c, a))
    while out and out[-1][0] not in ("image", "note") and not out[-1][1].strip():
        out.pop()
    if out and out[-1][0] not in ("image", "note"):
        out[-1] = (out[-1][0], out[-1][1].rstrip(" "), out[-1][2])
    return out


_READ = {"docx": _Docx, "odt": _Odt, "epub": _Epub}


def container_records(content: bytes | None, format: str) -> list[dict]:
    """The records of one container; what is no container, or lacks a member, is an error that says so."""
    if content is None:
        return []
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as zf:
            return list(_READ[format](zf).records())
    except zipfile.BadZipFile as error:
        raise ValueError(f"{format}: not a ZIP container") from error
    except KeyError as error:
        raise ValueError(f"{format}: missing member: {error}") from error
    except ElementTree.ParseError as error:
        raise ValueError(f"{format}: malformed XML: {error}") from error


_PIECE = pa.struct([("type", pa.string()), ("content", pa.string()), ("attributes", pa.map_(pa.string(), pa.string())), ("depth", pa.int32())])
ARROW_RECORDS = pa.list_(pa.struct([("what", pa.string()), ("pieces", pa.list_(_PIECE)), ("base", pa.int32()), ("depth", pa.int32()), ("kind", pa.string()), ("rank", pa.int32()), ("start", pa.int32()), ("style", pa.string()), ("ident", pa.string()), ("more", pa.map_(pa.string(), pa.string()))]))
_RECORD = "what string, pieces array<struct<type:string,content:string,attributes:map<string,string>,depth:int>>, base int, depth int, kind string, rank int, start int, style string, ident string, more map<string,string>"


def laid_out(docs: DataFrame, content: str, read: Callable[[object], list[dict]], by: str, meta_kind: str = "string") -> DataFrame:
    """The block table of documents whose records `read` lists from their content.

    Code paragraphs in a row are one block; a style's name is a class; a paragraph among the first that only says what
    a metadata field says is left out.
    """
    rows = rows_of(docs, by, content, read, ARROW_RECORDS.value_type, StructType.fromDDL(_RECORD)).withColumn("n", F.col("n").cast("long"))
    order = Window.partitionBy(by).orderBy("n")
    goes_on = (F.col("what") == "code") & (F.lag("what").over(order) == "code") & (F.lag("base").over(order) == F.col("base")) & F.col("ident").isNull()
    rows = rows.withColumn("_run", F.sum(F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).over(order))
    # only code is put together; all else is a run of its own
    line = F.when(F.col("what") == "code", F.struct("n", F.get("pieces", F.lit(0))["content"].alias("c")))
    runs = rows.groupBy(by, "_run").agg(F.min("n").alias("n"), *[F.min_by(c, "n").alias(c) for c in ("what", "pieces", "base", "depth", "kind", "rank", "start", "style", "ident", "more")], F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: F.coalesce(x["c"], F.lit(""))), "\n").alias("_code"))
    empty = F.create_map().cast("map<string,string>")
    code = F.array(F.struct(F.lit("text").alias("type"), F.col("_code").alias("content"), empty.alias("attributes"), F.lit(0).alias("depth")))
    label = F.nullif(class_slug(F.coalesce("style", F.lit(""))), F.lit(""))
    more = F.when(label.isNotNull() & ~F.map_contains_key("more", F.lit("class")), F.map_concat("more", F.create_map(F.lit("class"), label))).otherwise(F.col("more"))
    records = runs.select(by, "n", F.lit(0).alias("sub"), "what", F.when(F.col("what") == "code", code).otherwise(F.col("pieces")).alias("pieces"), "base", "depth", "kind", "rank", "start", "ident", more.alias("more"))
    return assemble(records, by, meta_kind=meta_kind)


def read_archives(docs: DataFrame, format: str, by: str = "doc", content: str = "bytes") -> DataFrame:
    """The block table of containers (doc, bytes) of one format; a null has no blocks, a damaged one is an error."""
    return laid_out(docs, content, lambda x: container_records(x, format), by)
