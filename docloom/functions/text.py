"""Slugs, patterns and table cells as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def slug(title: Column, separator: str = "-") -> Column:
    """The identifier of a heading: lower case, blanks become separators, other signs go.

    Letters, digits and `_ - .` stay; what is before the first letter goes; nothing left: `section`.
    """
    bare = F.regexp_replace(F.lower(title), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    kept = F.regexp_replace(bare, r"[^\p{L}\p{N}_\-.\s\p{Z}]+", "")
    joined = F.regexp_replace(F.regexp_replace(kept, r"[\s\p{Z}]+", separator), r"^[^\p{L}]+", "")
    joined = F.replace(joined, F.lit("-"), F.lit(separator)) if separator != "-" else joined
    return F.when(title.isNull() | (joined == ""), F.lit("section")).otherwise(joined)


def class_slug(label: Column) -> Column:
    """The class name of a source's own label, such as a paragraph style: ASCII signs but `_` become one `-`; '' if none is left."""
    kept = F.regexp_replace(F.translate(label, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x00-/:-^`{-\x7f]+", "-")
    return F.regexp_replace(kept, "^-|-$", "")


def glob_pattern(glob: str) -> str:
    """A LIKE pattern for a glob of * and ?; a backslash escapes."""
    out = glob.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return out.replace("*", "%").replace("?", "_")


def like_pattern(like: str) -> str:
    """A regular expression that finds a LIKE pattern anywhere, in any case.

    Unlike ILIKE, a backslash before an ordinary character stands for that character.
    """
    out, escaped = "", False
    for c in like:
        if escaped or c not in "\\%_":
            out, escaped = out + re.escape(c), False
        elif c == "\\":
            escaped = True
        else:
            out += ".*" if c == "%" else "."
    return f"(?isu){out}"


#: Strict forms of the types of table columns, narrowest first.
CELL_FORMS = (
    ("bigint", r"^(0|-?[1-9][0-9]{0,17})$"),
    ("double", r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$"),
    ("date", r"^[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])$"),
    ("timestamp", r"^[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])[ T]([01][0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9](\.[0-9]+)?)?$"),
    ("boolean", r"^(?i:true|false)$"),
)
