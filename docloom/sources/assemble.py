"""From a document's records (headings, paragraphs, items, cells) to its block rows, the same for all readers.

A record is what a reader knows of one block: what it is, its pieces of text and their markup, the depth of an
item. The rows around it follow from its neighbours alone: an item opens a list if the record before it is none, or
one of another depth or kind.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stacks import is_first, ranked_or_equal
from ..functions.text import slug
from ..schema import BLOCK_COLUMNS

#: Runs of text: `depth` 1 stands within the piece before it; `attributes` are those of the inline row.
PIECES = "array<struct<type:string,content:string,attributes:map<string,string>,depth:int>>"
#: The columns of records beside the document's key. `n` and `sub` are their order; `base` the level of what they
#: stand in; `kind` that of an item's list (bullet, ordered, definition); `more` further attributes of the block.
RECORD = f"n bigint, sub int, what string, pieces {PIECES}, base int, depth int, kind string, rank int, start int, ident string, more map<string,string>"


def attributes(**values: Column) -> Column:
    """A map of the values that aren't null."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in values.items()])
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))


def row(kind, what, content, level, encoding="text", own=None) -> Column:
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(
        text(kind).alias("kind"), text(what).alias("element_type"), (F.lit(None).cast("string") if content is None else content).alias("content"), (F.lit(level) if isinstance(level, int) else level).cast("int").alias("level"),
        text(encoding).alias("encoding"), (F.create_map().cast("map<string,string>") if own is None else own).alias("attributes"),
    )


def plain_piece(text: Column) -> Column:
    """The pieces of a text without markup."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("content"), F.create_map().cast("map<string,string>").alias("attributes"), F.lit(0).alias("depth"))).cast(PIECES)


def flat(pieces: Column | str = "pieces") -> Column:
    """The text of pieces, breaks as blanks."""
    said = F.transform(pieces, lambda p: F.when(p["type"].isin("softbreak", "linebreak", "space"), " ").otherwise(F.coalesce(p["content"], F.lit(""))))
    return F.array_join(said, "")


def assemble(records: DataFrame, by: str = "doc", separator: str = "-", meta_kind: str = "inlines", with_pieces: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The block table of records. Metadata (`meta`, with its field in `ident`) follows the body.

    `with_pieces` adds the pieces of records that come without: after the stack along records, for which rows are
    ordered, so that Spark, which knows no partitioning behind a Python function, doesn't shuffle them in between.
    """
    along = Window.partitionBy(by).orderBy("n", "sub")
    is_item = F.col("what") == "item"
    at = F.when(is_item, F.col("base") + 2 * F.col("depth")).otherwise(F.col("base") + 1)
    # an item goes on with a list if the last record that isn't within an item is one of the same list; its ident is
    # that of its list, where a format tells lists apart
    own_list = F.when(is_item, F.shiftrightunsigned(F.xxhash64("depth", "kind", "base", "ident"), 1)).otherwise(F.lit(0))
    records = records.withColumns({"_first": is_first(along), "_rank": at.cast("long"), "_list": own_list})
    before = ranked_or_equal("_first", "_rank", F.lit(True), "_list", F.lit(0).cast("long"))["above"]
    records = records.withColumn("_before", before)
    records = with_pieces(records) if with_pieces else records
    opens = is_item & ~F.col("_before").eqNullSafe(F.col("_list"))
    return laid_out(records.withColumn("_opens", opens), by, separator, meta_kind)


def laid_out(records: DataFrame, by: str = "doc", separator: str = "-", meta_kind: str = "inlines") -> DataFrame:
    """The block table of records that know, as `_opens`, whether they are an item that opens a list."""
    is_item = F.col("what") == "item"
    rows = records.withColumn("_text", flat())
    level, ordered, what, pieces = F.col("base") + 1, F.col("kind") == "ordered", F.col("what"), F.col("pieces")
    none = F.create_map().cast("map<string,string>")
    more = F.coalesce("more", none)
    text = F.nullif(F.col("_text"), F.lit(""))
    listed = attributes(list_type=F.col("kind"), ordered=ordered, start=F.when(ordered, F.coalesce("start", F.lit(1))), number_style=F.when(ordered, F.lit("Decimal")), number_delim=F.when(ordered, F.lit("Period")))
    outer = level + 2 * (F.col("depth") - 1)
    own_id = F.map_concat(attributes(id=F.coalesce("ident", more["id"])), F.map_filter(more, lambda k, v: k != "id"))
    heading = F.map_concat(attributes(heading_level=F.col("rank"), id=F.coalesce("ident", more["id"], slug(F.col("_text"), separator))), F.map_filter(more, lambda k, v: ~k.isin("heading_level", "id")))
    # what a block of marked text is: flat if it has no marks, else without content (a heading keeps it) and its pieces below it
    is_quote, is_figure, is_heading = what == "quote", what == "figure", what == "heading"
    element = F.when(is_heading, "heading").when(is_item, "list_item").when(is_figure | (what == "plain"), "plain").otherwise("paragraph")
    at = F.when(is_item, outer + 1).when(is_quote, level + 1).when(is_figure, level + 2).otherwise(level)
    own = F.when(is_heading, heading).when(is_item | (what == "plain"), more).when(is_quote | is_figure, none).otherwise(own_id)
    simple = (F.coalesce(F.size(pieces), F.lit(0)) == 0) | F.forall(pieces, lambda p: p["type"] == "text")
    under = F.when(~simple, F.transform(pieces, lambda p: row("inline", p["type"], F.nullif(p["content"], F.lit("")), F.col("_at") + 1 + p["depth"], own=p["attributes"]))).otherwise(F.array())
    marked = F.concat(F.array(row("block", F.col("_element"), F.when(simple | is_heading, text), F.col("_at"), own=F.col("_own"))), under)
    # and what stands before it
    shown = F.map_filter(more, lambda k, v: k.isin("src", "alt"))
    figure = F.array(row("block", "figure", None, level, own=F.map_filter(more, lambda k, v: ~k.isin("src", "alt"))), row("block", "plain", None, level + 1), row("inline", "image", more["alt"], level + 2, own=shown))
    before_it = (
        F.when(F.col("_opens"), F.array(row("block", "list", None, outer, own=listed))).when(is_quote, F.array(row("block", "blockquote", None, level, own=more)))
        .when(is_figure, F.when(text.isNotNull(), F.concat(figure, F.array(row("block", "caption", None, level + 1)))).otherwise(figure)).otherwise(F.array())
    )
    is_table, is_raw = what == "table", what == "raw"
    encoding = F.when(is_table, "json").when(is_raw & more["format"].isin("markdown", "html", "latex"), more["format"]).otherwise("text")
    field = attributes(key=F.col("ident"))
    meta = F.array(row("value", "string", text, 1, own=field)) if meta_kind == "string" else F.array(row("value", "inlines", None, 1, own=field), row("inline", "text", text, 2))
    made = (
        F.when(what == "meta", meta)
        .when(what.isin("table", "code", "raw", "lineblock", "hr", "image", "page_break", "div", "section", "metadata"), F.array(row("block", what, text, level, encoding, F.when(is_table, more).otherwise(own_id))))
        .when(is_figure & text.isNull(), before_it).otherwise(F.concat(before_it, marked))
    )
    rows = rows.withColumns({"_element": element, "_at": at.cast("int"), "_own": own})
    laid = rows.select(by, (what == "meta").alias("_meta"), "n", "sub", F.posexplode(made).alias("_at", "_block"))
    place = Window.partitionBy(by).orderBy("_meta", "n", "sub", "_at")
    return laid.withColumn("element_order", (F.row_number().over(place) - 1).cast("int")).select(by, "_block.*", "element_order").select(by, *BLOCK_COLUMNS)
