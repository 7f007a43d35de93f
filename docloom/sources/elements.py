"""Laid-out pages: a table of page elements, as page decoders give it, becomes blocks.

Decoding a page format is left to whatever fills the table (doc, page_number, element_idx, element_type,
text, font_size).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import BLOCK_COLUMNS
from .assemble import attributes as _attributes


def page_range(pages: str | None) -> tuple[int, int | None]:
    """The first and last page of `N` or `N-M`; an empty string is all pages."""
    if pages == "":
        return 1, None
    found = re.fullmatch(r"(\d+)(?:-(\d+))?", pages or "")
    if not found:
        raise ValueError(f"pages must be N or N-M, got {'<NULL>' if pages is None else pages}")
    return int(found[1]), int(found[2] or found[1])


def read_elements(elements: DataFrame, pages: str = "", by: str = "doc") -> DataFrame:
    """The block table of page elements, each page after a page_break that has its number.

    A heading's rank is that of its font size among those of all headings of the document, not only of
    the pages asked for. Bullets and numbers before list items go.
    """
    first, last = page_range(pages)
    is_head = F.col("element_type") == "heading"
    sized = elements.withColumn("rank", F.when(is_head, F.dense_rank().over(Window.partitionBy(by, is_head).orderBy(F.desc("font_size")))))
    asked = sized.where(F.col("page_number") >= first) if last is None else sized.where(F.col("page_number").between(first, last))
    breaks = asked.select(by, "page_number").distinct().select(by, "page_number", F.lit(-1).alias("element_idx"), F.lit("page_break").alias("element_type"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("int").alias("rank"))
    rows = breaks.unionByName(asked.select(*breaks.columns))
    kind = F.col("element_type")
    attributes = _attributes(
        page_number=F.when(kind == "page_break", F.col("page_number")), heading_level=F.when(kind == "heading", F.col("rank")),
        list_type=F.when(kind == "list_item", F.when(F.col("text").rlike(r"^\s*\d+\."), "ordered").otherwise("bullet")),
    )
    order = F.row_number().over(Window.partitionBy(by).orderBy("page_number", "element_idx")) - 1
    return rows.select(
        by,
        F.lit("block").alias("kind"),
        F.when(kind.isin("heading", "list_item", "page_break"), kind).otherwise("paragraph").alias("element_type"),
        F.regexp_replace("text", r"^\s*(•|\d+\.)\s+", "").alias("content"),
        F.lit(1).alias("level"),
        F.lit("text").alias("encoding"),
        attributes.alias("attributes"),
        order.cast("int").alias("element_order"),
    ).select(by, *BLOCK_COLUMNS)
