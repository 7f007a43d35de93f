"""The block table: one row for each block, inline or metadata value of a document, in reading order.

A document is a tree flattened in pre-order: a row's subtree is the rows after it of a greater level.
`element_order` counts from 0 in each document; the key column, `doc` unless named otherwise, says which
document a row belongs to.
"""

from __future__ import annotations

from pyspark.sql import types as T

BLOCK = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("element_type", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("level", T.IntegerType()),
        T.StructField("encoding", T.StringType()),
        T.StructField("attributes", T.MapType(T.StringType(), T.StringType())),
        T.StructField("element_order", T.IntegerType()),
    ]
)
BLOCK_COLUMNS = BLOCK.names

# The closed vocabulary.
BLOCK_TYPES = (
    "document", "heading", "paragraph", "plain", "code", "blockquote", "list", "list_item", "table", "hr", "metadata", "image", "raw", "div", "section", "page_break", "lineblock", "deflist", "figure", "caption", "generic",
)
INLINE_TYPES = (
    "text", "space", "softbreak", "linebreak", "bold", "italic", "strikethrough", "superscript", "subscript", "smallcaps", "underline", "code", "math", "link", "image", "quoted", "cite", "note", "span", "raw", "generic",
)
VALUE_TYPES = ("string", "bool", "list", "map", "inlines", "blocks", "version", "generic")
#: Roles of sections.
SECTION_NAMES = ("section", "article", "aside", "nav", "header", "footer", "main")
ENCODINGS = ("text", "json", "yaml", "html", "xml", "latex", "markdown", "toml")
SPEC_VERSION = "1.4"
PANDOC_API_VERSION = (1, 23, 1)
