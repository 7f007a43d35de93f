"""RTF: a text's groups and control words become records in tasks; their blocks are laid out by Spark."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

from .archives import Run, _table, laid_out, record

_TOKEN = re.compile(r"\\([a-zA-Z]+)(-?\d+)? ?|\\'([0-9a-fA-F]{2})|\\([^a-zA-Z])|([{}])|([^\\{}\r\n]+)")
# Destinations whose text is no part of the document, fields of the info group, and signs with names.
_SKIPPED = {"fonttbl", "colortbl", "object", "header", "headerl", "headerr", "footer", "footerl", "footerr", "footnote", "generator", "themedata", "colorschememapping", "latentstyles", "datastore", "xmlnstbl", "rsidtbl", "annotation", "upr"}
_FIELDS = {"title": "title", "author": "author", "subject": "subject", "keywords": "keywords"}
_SIGNS = {"emdash": "—", "endash": "–", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "bullet": "•", "tab": "\t", "line": " ", "emspace": "\u2003", "enspace": "\u2002"}
_MARKS = ("b", "i", "ul", "strike")
_KINDS = {"b": "bold", "i": "italic", "ul": "underline", "strike": "strikethrough"}


@dataclass
class _Group:
    """What holds in a group and is forgotten at its end."""

    marks: frozenset = frozenset()
    fallback: int = 1  # signs after \u that stand in for it
    place: str = "body"  # body, skip, styles, lists, or the name of a field
    new: bool = True


@dataclass
class _Paragraph:
    rank: int = 0
    style: int | None = None
    listed: int | None = None
    level: int = 0
    in_table: bool = False
    runs: list[Run] = field(default_factory=list)


class _Rtf:
    def __init__(self) -> None:
        self.out: list[dict] = []
        self.meta: dict[str, str] = {}
        self.styles: dict[int, str] = {}
        self.list_levels: dict[int, list[int]] = {}  # of each list, the number format of each level
        self.overrides: dict[int, int] = {}
        self.p = _Paragraph()
        self.cells: list[str] = []
        self.rows: list[list[str]] = []
        self.headed = False
        self.reading: dict = {}

    def end_paragraph(self) -> None:
        p, self.p = self.p, replace(self.p, runs=[])
        named = re.fullmatch(r"(?i)heading\s*([1-6])", self.styles.get(p.style, "")) if p.style is not None else None
        rank = p.rank or (int(named[1]) if named else 0)
        if p.in_table:
            self.p.runs = [*p.runs, ("text", " ", {})]  # a cell goes on
            return
        self.end_table()
        runs = _stripped(p.runs)
        if not runs:
            return
        if rank:
            self.out.append(record("heading", runs, rank))
        elif p.listed:
            formats = self.list_levels.get(self.overrides.get(p.listed, p.listed), [])
            number = formats[p.level] if p.level < len(formats) else 23
            self.out.append(record("item", runs, depth=p.level + 1, kind="bullet" if number == 23 else "ordered") if number != 255 else record("paragraph", runs))
        else:
            self.out.append(record("paragraph", runs))

    def end_cell(self) -> None:
        self.cells.append(" ".join("".join(c for _, c, _ in self.p.runs).split()))
        self.p = replace(self.p, runs=[])

    def end_row(self) -> None:
        if self.cells:
            self.rows.append(self.cells)
        self.cells = []

    def end_table(self) -> None:
        self.end_row()
        if self.rows:
            self.out.append(record("table", _table(self.rows, self.headed)))
        self.rows, self.headed = [], False

    def word(self, word: str, number: int | None, g: _Group) -> None:
        """A control word within the body."""
        if word in ("par", "sect", "page"):
            self.end_paragraph()
        elif word == "pard":
            self.p = _Paragraph(runs=self.p.runs)
        elif word == "plain":
            g.marks = frozenset()
        elif word in (*_MARKS, "ulnone", "striked"):
            mark = {"ulnone": "ul", "striked": "strike"}.get(word, word)
            on = word != "ulnone" and number != 0
            g.marks = g.marks | {mark} if on else g.marks - {mark}
        elif word == "outlinelevel":
            self.p.rank = (number or 0) + 1 if (number or 0) < 9 else 0
        elif word == "s":
            self.p.style = number
        elif word == "ls":
            self.p.listed = number
        elif word == "ilvl":
            self.p.level = number or 0
        elif word == "intbl":
            self.p.in_table = True
        elif word == "trowd":
            if not self.p.in_table and not self.rows:
                self.end_paragraph()
            self.end_row()
        elif word == "trhdr":
            self.headed = self.headed or not self.rows
        elif word == "cell":
            self.end_cell()
        elif word == "row":
            self.end_row()
            self.p.in_table = False
        elif word == "uc":
            g.fallback = number or 0
        elif word in _SIGNS:
            self.say(_SIGNS[word], g)

    def listing(self, word: str, number: int | None) -> None:
        """A control word within the tables of lists."""
        r = self.reading
        if word == "list":
            r["levels"] = []
        elif word == "levelnfc":
            r.setdefault("levels", []).append(number or 0)
        elif word == "listid":
            if r.get("override"):
                r["id"] = number
            else:
                self.list_levels[number or 0] = r.get("levels", [])
        elif word == "listoverride":
            r["override"] = True
        elif word == "ls" and r.get("override") and "id" in r:
            self.overrides[number or 0] = r.pop("id")

    def say(self, text: str, g: _Group) -> None:
        if g.place == "body":
            kind = next((_KINDS[m] for m in _MARKS if m in g.marks), "text")
            self.p.runs.append((kind, text, {}))
        elif g.place == "styles":
            self.reading["name"] = self.reading.get("name", "") + text
        elif g.place in _FIELDS:
            self.meta[_FIELDS[g.place]] = self.meta.get(_FIELDS[g.place], "") + text

    def enter(self, word: str, number: int | None, g: _Group) -> bool:
        """Whether the word names the destination of its group."""
        if word in _SKIPPED:
            g.place = "skip"
        elif word == "pict":
            if g.place == "body":
                self.p.runs.append(("image", "", {}))
            g.place = "skip"
        elif word == "info":
            g.place = "info"
        elif g.place == "info" and word in _FIELDS:
            g.place = word
        elif word == "stylesheet":
            g.place = "styles"
        elif word in ("listtable", "listoverridetable"):
            g.place = "lists"
        else:
            return False
        return True

    def read(self, text: str) -> list[dict]:
        g, stack, skip_signs, high = _Group(), [], 0, 0
        for m in _TOKEN.finditer(text):
            word, number, code, sign, brace, plain = m.groups()
            number = int(number) if number else None
            if brace == "{":
                stack.append(g)
                g = replace(g, new=True)
                if g.place == "styles":
                    self.reading = {}
                continue
            if brace == "}":
                if g.place == "styles" and "style" in self.reading:
                    self.styles[self.reading["style"]] = self.reading.get("name", "").rstrip("; ")
                g = stack.pop() if stack else _Group()
                skip_signs = 0
                continue
            if sign == "*":
                g.place = "skip" if not re.match(r"\\\*\\(?:listtable|listoverridetable|shppict|pn\b)", text[m.start() : m.start() + 24]) else g.place
                continue
            if word and g.new and self.enter(word, number, g):
                continue
            g.new = False
            if g.place == "skip":
                continue
            if word == "u" and number is not None:
                point = number % 65536
                if 0xD800 <= point < 0xDC00:
                    high = point
                else:
                    self.say(chr(0x10000 + ((high - 0xD800) << 10) + point - 0xDC00) if high and 0xDC00 <= point < 0xE000 else chr(point) if not 0xD800 <= point < 0xE000 else "\ufffd", g)
                    high = 0
                skip_signs = g.fallback
                continue
            if skip_signs and (code or plain):
                if code:
                    skip_signs -= 1
                    continue
                skip_signs, plain = max(0, skip_signs - len(plain)), plain[skip_signs:]
            if code:
                self.say(bytes.fromhex(code).decode("cp1252", "replace"), g)
            elif sign:
                self.say({"~": "\u00a0", "_": "\u2011", "-": "", "\n": "", "\r": ""}.get(sign, sign), g)
            elif word:
                if g.place == "body":
                    self.word(word, number, g)
                elif g.place == "styles" and word == "s":
                    self.reading["style"] = number or 0
                elif g.place == "lists":
                    self.listing(word, number)
                elif word == "uc":
                    g.fallback = number or 0
            elif plain:
                self.say(plain, g)
        self.p.in_table = False
        self.end_paragraph()
        self.end_table()
        return self.out + [record("meta", [("text", v.strip(), {})], ident=k) for k, v in self.meta.items() if v.strip()]


def _stripped(runs: list[Run]) -> list[Run]:
    """Runs without blanks at the ends; none if only blanks are left."""
    said = "".join(c for _, c, _ in runs)
    if not said.strip() and not any(t == "image" for t, _, _ in runs):
        return []
    runs = list(runs)
    while runs and runs[0][0] != "image" and not runs[0][1].strip():
        runs.pop(0)
    while runs and runs[-1][0] != "image" and not runs[-1][1].strip():
        runs.pop()
    runs[0] = (runs[0][0], runs[0][1].lstrip(), runs[0][2])
    runs[-1] = (runs[-1][0], runs[-1][1].rstrip(), runs[-1][2])
    return runs


def rtf_records(text: str | None) -> list[dict]:
    """The records of one text. Broken RTF gives what can be read; it never fails."""
    return _Rtf().read(text) if text else []


def read_rtf(docs: DataFrame, by: str = "doc", text: str = "text") -> DataFrame:
    """The block table of RTF texts: headings by outline level or style, marked runs, lists, tables, pictures, the info fields."""
    return laid_out(docs, text, rtf_records, by)
