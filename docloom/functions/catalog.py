"""What the library says about itself: versions, formats, and the constructors of the interchange AST."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schema import PANDOC_API_VERSION, SPEC_VERSION

VERSION = "0.1.0"

# The constructors of the AST in order, and the types that the ledger names for them.
_LEDGER = (
    ("block", {
        "Header": "heading", "Para": "paragraph", "Plain": "paragraph", "CodeBlock": "code", "BlockQuote": "blockquote", "BulletList": "list", "OrderedList": "list", "Table": "table", "HorizontalRule": "hr", "RawBlock": "raw", "Div": "div",
        "LineBlock": "pandoc:lineblock", "DefinitionList": "pandoc:deflist", "Figure": "pandoc:figure", "Null": None,
    }),
    ("inline", {
        "Str": "text", "Space": "space", "SoftBreak": "softbreak", "LineBreak": "linebreak", "Strong": "bold", "Emph": "italic", "Strikeout": "strikethrough", "Superscript": "superscript", "Subscript": "subscript", "SmallCaps": "smallcaps",
        "Code": "code", "Math": "math", "Link": "link", "Image": "image", "RawInline": "raw", "Quoted": "quoted", "Cite": "cite", "Note": "note", "Span": "span", "Underline": "underline",
    }),
)
_PLANNED, _DROPPED = ("LineBlock", "DefinitionList", "Figure", "Underline"), ("Null",)
#: Where `interchange` reads something else than the ledger names.
_READ_AS = {"Plain": "plain", "LineBlock": "lineblock", "DefinitionList": "list", "Figure": "figure", "Space": "text"}


def interchange_map(spark: SparkSession) -> DataFrame:
    """(constructor, kind, element_type, status, notes): the ledger of the AST's constructors, a row for each.

    The ledger is older than the reader: `notes` says what a constructor is read as where that differs.
    """
    rows = []
    for kind, names in _LEDGER:
        for name, element_type in names.items():
            status = "planned" if name in _PLANNED else "dropped" if name in _DROPPED else "mapped"
            rows.append((name, kind, element_type, status, f"read as {_READ_AS[name]}" if name in _READ_AS else ""))
    return spark.createDataFrame(rows, "constructor string, kind string, element_type string, status string, notes string")


def supported_formats(spark: SparkSession) -> DataFrame:
    """(format, extensions, kind, status, notes) of every format of the registry."""
    from ..sources.registry import REGISTRY

    found: dict[tuple[str, str], list] = {}
    for e in REGISTRY.entries:
        own = found.setdefault((e.format, e.kind), [set(), True, e.notes])
        own[0] |= {e.key} - {""}
        own[1] = own[1] and (e.reader is not None or e.kind == "table")
    rows = [(f, sorted(x), k, "implemented" if ok else "needs a reader", notes) for (f, k), (x, ok, notes) in sorted(found.items())]
    return spark.createDataFrame(rows, "format string, extensions array<string>, kind string, status string, notes string")


def spec_at_least(major: int, minor: int) -> bool:
    """Whether the block table's vocabulary is of this version or a later one."""
    return tuple(map(int, SPEC_VERSION.split("."))) >= (major, minor)


def versions() -> dict[str, object]:
    return {"library": VERSION, "vocabulary": SPEC_VERSION, "interchange": PANDOC_API_VERSION}
