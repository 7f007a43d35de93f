"""Readers of unmarked text and of web pages, in built-in functions alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import slug
from ..schema import BLOCK_COLUMNS
from .assemble import attributes as _attributes

TITLE_WORDS = 3


def read_prose(docs: DataFrame, by: str = "doc", text: str = "text") -> DataFrame:
    """The block table of plain texts: a line of up to three words is a heading, of that rank; lines with bars are tables.

    Blank lines have no block, nor has a null text.
    """
    lines = docs.select(by, F.posexplode(F.split(text, "\n")).alias("n", "line")).where(F.trim("line") != "")
    words = F.size(F.split(F.trim("line"), " +"))
    titled, barred = words <= TITLE_WORDS, F.contains("line", F.lit(" | "))
    order = F.row_number().over(Window.partitionBy(by).orderBy("n")) - 1
    cells = F.transform(F.split("line", r"\|"), lambda c: F.trim(c))
    table = F.to_json(F.struct(F.array().cast("array<string>").alias("headers"), F.array(cells).alias("rows")))
    return lines.select(
        by,
        F.lit("block").alias("kind"),
        F.when(barred, "table").when(titled, "heading").otherwise("paragraph").alias("element_type"),
        F.when(barred, table).otherwise(F.trim("line")).alias("content"),
        F.lit(1).alias("level"),
        F.when(barred, "json").otherwise("text").alias("encoding"),
        _attributes(heading_level=F.when(titled & ~barred, words), id=F.when(titled & ~barred, slug(F.trim("line")))).alias("attributes"),
        order.cast("int").alias("element_order"),
    )


SECTIONS = ("main", "article", "header", "nav", "aside", "footer")
_TOKEN = r"(?s)(<!--.*?-->|<(?:script|style)\b.*?</(?:script|style)>|<[^<>]*>|[^<]+|<)"


def read_pages(pages: DataFrame, by: str = "doc", html: str = "html") -> DataFrame:
    """The block table of web pages: named sections, headings and paragraphs of text; the title is metadata.

    Sections nest by level. Text counts under the last block tag before it: h1 to h6, li, or else a
    paragraph. Comments, scripts and styles go; entities stay as they are.
    """
    tokens = pages.select(by, F.posexplode(F.regexp_extract_all(F.col(html), F.lit(_TOKEN), F.lit(1))).alias("n", "token"))
    order = Window.partitionBy(by).orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tag = F.lower(F.regexp_extract("token", r"^<(/?[A-Za-z][A-Za-z0-9]*)", 1))
    names = "|".join(SECTIONS)
    opens, closes = tag.rlike(f"^({names})$"), tag.rlike(f"^/({names})$")
    rows = tokens.withColumn("tag", tag).withColumn("depth", F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(order))
    block = F.when(tag.rlike("^/?(h[1-6]|li|p|title|div|article|nav|footer|header|aside|main|td|th|ul|ol|head|body)$"), tag)
    rows = rows.withColumn("block", F.last(block, ignorenulls=True).over(order))
    body = F.trim(F.regexp_replace("token", r"\s+", " "))
    is_text = ~F.col("token").rlike("^<") & (body != "")
    rows = rows.where(is_text | opens)
    head = F.col("block").rlike("^h[1-6]$")
    kinds = F.when(opens, "section").when(F.col("block") == "title", "title").when(head, "heading").when(F.col("block") == "li", "list_item").otherwise("paragraph")
    made = rows.select(by, "n", kinds.alias("what"), F.when(is_text, body).alias("content"), F.greatest(F.when(opens, F.col("depth")).otherwise(F.col("depth") + 1), F.lit(1)).cast("int").alias("level"), F.when(opens, F.col("tag")).alias("role"), F.when(head & is_text, F.substring("block", 2, 1)).alias("rank"))
    titled = F.col("what") == "title"
    place = Window.partitionBy(by).orderBy(titled, "n")
    return made.select(
        by,
        F.when(titled, "value").otherwise("block").alias("kind"),
        F.when(titled, "string").otherwise(F.col("what")).alias("element_type"),
        "content",
        F.when(titled, 1).otherwise(F.col("level")).cast("int").alias("level"),
        F.lit("text").alias("encoding"),
        _attributes(role=F.col("role"), key=F.when(titled, "title"), heading_level=F.col("rank"), id=F.when(F.col("rank").isNotNull(), slug(F.col("content")))).alias("attributes"),
        (F.row_number().over(place) - 1).cast("int").alias("element_order"),
    ).select(by, *BLOCK_COLUMNS)
