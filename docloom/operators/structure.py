"""Structural operators over block tables of any number of documents.

All of them follow one order, by document: no joins, and one shuffle by document that operators applied
one after the other share. Nothing runs before the result is asked for, and the source is read once. The
question they have in common is in whose span a row stands, where a span goes from its first row to the next
row of the same or a higher rank. A stack along the rows tells, at any number of ranks; see `functions.stacks`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stacks import is_first, ranked
from ..functions.text import glob_pattern, like_pattern, slug

MODES = ("exact", "contains", "glob")
NAMED_SECTIONS = ("main", "article", "header", "nav", "aside", "footer")
KEPT_METADATA = ("title", "author", "description")


def _running(by: str) -> Window:
    return Window.partitionBy(by).orderBy("element_order").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _whole(by: str) -> Window:
    return Window.partitionBy(by).orderBy("element_order").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def attribute(name: str) -> Column:
    """An attribute's value; null where it is absent."""
    return F.try_element_at("attributes", F.lit(name))


def heading_rank() -> Column:
    """1 to 6 as the attribute says; 1 where it is missing or no number."""
    return F.coalesce(F.expr("try_cast(attributes['heading_level'] as int)"), F.lit(1))


def _with_span(df: DataFrame, by: str, out: str, rank: Column, opens: Column, closes: Column | None = None) -> DataFrame:
    """`df` with `out`: whether a row stands in a span, from a row with `opens` up to the next one that closes it.

    A row closes the spans of its rank and of all lower ones if `closes` holds (for all rows, if not given).
    """
    no = F.lit(False)
    closes = F.lit(True) if closes is None else F.coalesce(closes, no)
    order = Window.partitionBy(by).orderBy("element_order")
    opens = F.coalesce(opens, no)
    rows = df.withColumns({"_first": is_first(order), "_span_rank": rank.cast("long"), "_enters": closes | opens, "_opens": opens.cast("long")})
    rows = rows.withColumn("_open", ranked("_first", "_span_rank", "_enters", F.lit(0).cast("long"), "_opens"))
    return rows.withColumn(out, F.col("_open.total") > 0).drop("_first", "_span_rank", "_enters", "_opens", "_open")


def is_metadata_root() -> Column:
    return F.coalesce((F.col("kind") == "value") | (F.col("element_type") == "metadata"), F.lit(False))


def body(blocks: DataFrame, by: str = "doc") -> DataFrame:
    """The rows outside all metadata: value and metadata rows go, with all that is below them."""
    return _with_span(blocks, by, "_meta", F.coalesce("level", F.lit(1)), is_metadata_root()).where(~F.col("_meta")).drop("_meta")


def _mode(match: str | None, modes: tuple[str, ...], what: str) -> str:
    if match is None or match.lower() not in modes:
        raise ValueError(f"{what} match must be {', '.join(modes[:-1])} or {modes[-1]}; {'<NULL>' if match is None else match} is not one of them")
    return match.lower()


def _like(value: Column, pattern: str, mode: str) -> Column:
    return F.expr("true") if pattern is None else value.rlike(like_pattern(glob_pattern(pattern) if mode == "glob" else pattern))


def toc(blocks: DataFrame, by: str = "doc") -> DataFrame:
    """(doc, level, title, id, indent, element_order) of every heading: the table of contents.

    `level` is the heading's rank and `indent` how far it is below the document's highest one. A heading
    without an id gets the slug of its title.
    """
    heads = blocks.where((F.col("kind") == "block") & (F.col("element_type") == "heading")).withColumn("rank", heading_rank())
    highest = F.min("rank").over(Window.partitionBy(by))
    return heads.select(by, F.col("rank").alias("level"), F.col("content").alias("title"), F.coalesce(attribute("id"), slug(F.col("content"))).alias("id"), (F.col("rank") - highest).alias("indent"), "element_order")


def section(blocks: DataFrame, name: str, match: str = "exact", by: str = "doc") -> DataFrame:
    """In each document, the section under the heading of this title or id, subsections included.

    exact: the first such heading. contains, glob: all headings whose title has the pattern, in any case;
    in `contains`, % and _ are wildcards and a backslash escapes. An id is always compared as a whole.
    Metadata is never part of a section. No such heading: no rows.
    """
    mode = _mode(match, MODES, "section")
    title = F.col("content") == name if mode == "exact" else _like(F.col("content"), name, mode)
    hit = (F.col("element_type") == "heading") & (F.coalesce(title, F.lit(False)) | F.coalesce(attribute("id") == name, F.lit(False)))
    rows = body(blocks, by).withColumn("_rank", heading_rank()).withColumn("_hit", F.coalesce(hit, F.lit(False)))
    if mode == "exact":
        first = F.min(F.when(F.col("_hit"), F.col("element_order"))).over(_whole(by))
        rows = rows.withColumn("_hit", F.coalesce(F.col("element_order") == first, F.lit(False)))
    heading = F.coalesce(F.col("element_type") == "heading", F.lit(False))
    return _with_span(rows, by, "_in", F.col("_rank"), F.col("_hit"), heading).where("_in").select(*blocks.columns)


def segments(blocks: DataFrame, by: str = "doc") -> DataFrame:
    """The body with `segment`, the order of the heading above each row; null before the first one."""
    return body(blocks, by).withColumn("segment", F.max(F.when(F.col("element_type") == "heading", F.col("element_order"))).over(_running(by)))


def segment_text(rows: str = "_rows") -> Column:
    """The content of a segment's rows (structs) joined by one blank; rows without content add nothing."""
    said = F.filter(F.transform(rows, lambda r: F.struct(r["element_order"].alias("at"), r["content"].alias("content"))), lambda r: F.coalesce(r["content"], F.lit("")) != "")
    return F.array_join(F.transform(F.array_sort(said), lambda r: r["content"]), " ")


def search_sections(blocks: DataFrame, pattern: str, match: str = "contains", by: str = "doc") -> DataFrame:
    """The segments, from a heading to the next one of any rank, whose whole text has the pattern in any case.

    A phrase may run across rows. An empty pattern is in every segment. Each segment is put together and looked at
    once, in the task that has its document, and is held as a whole there.
    """
    mode = _mode(match, ("contains", "glob"), "search_sections")
    whole = segments(blocks, by).groupBy(by, "segment").agg(F.collect_list(F.struct(*[c for c in blocks.columns if c != by])).alias("_rows"))
    return whole.where(_like(segment_text(), pattern, mode)).select(by, F.inline("_rows")).select(*blocks.columns)


def container(blocks: DataFrame, id: str, by: str = "doc") -> DataFrame:
    """In each document, the first block with this id and all that is below it."""
    hit = F.min(F.when(F.coalesce(attribute("id") == id, F.lit(False)), F.struct("element_order", "level"))).over(_whole(by))
    rows = blocks.withColumn("_hit", hit).where(F.col("element_order") >= F.col("_hit.element_order"))
    left = F.max((F.col("element_order") > F.col("_hit.element_order")) & (F.coalesce("level", F.lit(1)) <= F.col("_hit.level"))).over(_running(by))
    return rows.withColumn("_left", left).where(~F.coalesce("_left", F.lit(False))).select(*blocks.columns)


def reading(blocks: DataFrame, by: str = "doc") -> DataFrame:
    """Reading mode: the main part (or else the articles, or else everything) without navigation and asides.

    Headers and footers stay within an article only. Of the metadata, title, author and description stay.
    """
    role, rank = attribute("role"), F.coalesce("level", F.lit(1))
    is_section = F.coalesce((F.col("kind") == "block") & (F.col("element_type") == "section"), F.lit(False))
    is_role = lambda *names: is_section & F.coalesce(role.isin(*names), F.lit(False))
    rows = _with_span(_with_span(blocks, by, "_main", rank, is_role("main")), by, "_article", rank, is_role("article"))
    whole = Window.partitionBy(by)
    edge = is_role("header", "footer") & ~F.col("_article")
    rows = _with_span(rows, by, "_chrome", rank, is_role("nav", "aside") | edge)
    rows = rows.withColumn("_has_main", F.max(is_role("main")).over(whole)).withColumn("_has_article", F.max(is_role("article")).over(whole))
    shown = F.when(F.col("_has_main"), F.col("_main")).when(F.col("_has_article"), F.col("_article")).otherwise(True) & ~F.col("_chrome")
    keep = F.when(F.col("kind") == "value", F.coalesce(attribute("key").isin(*KEPT_METADATA), F.lit(False))).otherwise(shown)
    return rows.where(keep).select(*blocks.columns)


def renumber(blocks: DataFrame, base: int = 0, by: str = "doc") -> DataFrame:
    """The same rows with a dense element_order from `base` on in each document."""
    order = F.row_number().over(Window.partitionBy(by).orderBy("element_order")) - 1 + base
    return blocks.withColumn("element_order", order.cast("int")).select(*blocks.columns)


def repair(blocks: DataFrame, by: str = "doc") -> DataFrame:
    """A well-formed tree: levels start at 1, never rise by more than one from row to row, orders are dense.

    An item without a list above it, or a caption without a figure, gets one: an implied parent row.
    """
    parents = F.create_map(*[F.lit(x) for pair in (("list_item", "list"), ("caption", "figure")) for x in pair])
    order = Window.partitionBy(by).orderBy("element_order")
    above = F.lag(F.struct("element_type", "level")).over(order)
    needs = F.try_element_at(parents, F.col("element_type"))
    rank = F.coalesce("level", F.lit(1))
    orphan = needs.isNotNull() & ((rank <= 1) | above.isNull()) & F.coalesce(~F.coalesce(above["element_type"], F.lit("")).isin("list_item", "list", "figure", "caption") | (above["level"] < rank - 1), F.lit(True))
    rows = blocks.withColumn("_needs", F.when(F.coalesce(F.col("kind") == "block", F.lit(False)) & orphan, needs))
    implied = rows.where("_needs is not null").select(by, F.lit("block").alias("kind"), F.col("_needs").alias("element_type"), F.lit(None).cast("string").alias("content"), rank.alias("level"), F.lit("text").alias("encoding"), F.create_map().cast("map<string,string>").alias("attributes"), "element_order", F.lit(0).alias("_first"))
    lowered = rows.withColumn("level", F.when(F.col("_needs").isNotNull(), rank + 1).otherwise(rank)).withColumn("_first", F.lit(1)).select(*implied.columns)
    both = lowered.unionByName(implied)
    place = Window.partitionBy(by).orderBy("element_order", "_first")
    based = both.withColumn("level", F.col("level") - F.min("level").over(Window.partitionBy(by)) + 1).withColumn("element_order", (F.row_number().over(place) - 1).cast("int"))
    # a row's depth is the number of rows of ever lower levels that are still open at it
    rows = based.withColumns({"_top": is_first(order), "_rank": F.col("level").cast("long")})
    zero = F.lit(0).cast("long")
    return rows.withColumn("level", ranked("_top", "_rank", F.lit(True), zero, zero)["depth"].cast("int")).select(*blocks.columns)


def collected(blocks: DataFrame, by: str = "doc") -> DataFrame:
    """(doc, blocks): each document as one array of blocks in order."""
    item = F.struct("element_order", "kind", "element_type", "content", "level", "encoding", "attributes")
    ordered = F.array_sort(F.collect_list(item), lambda a, b: a["element_order"] - b["element_order"])
    return blocks.groupBy(by).agg(ordered.alias("blocks")).select(by, F.transform("blocks", lambda b: F.struct(*[b[c].alias(c) for c in ("kind", "element_type", "content", "level", "encoding", "attributes", "element_order")])).alias("blocks"))


def exploded(documents: DataFrame, by: str = "doc") -> DataFrame:
    """The block rows of documents held as arrays; the inverse of `collected`."""
    return documents.select(by, F.inline("blocks"))


def expand_embedded(blocks: DataFrame, by: str = "doc") -> DataFrame:
    """Raw markdown blocks, such as a notebook's cells, replaced by the blocks that they hold.

    The new rows stand where the raw one stood, their levels count from its level, and each document is
    numbered anew from its smallest element_order.
    """
    from ..sources.lines import read_lines

    is_raw = F.coalesce((F.col("kind") == "block") & (F.col("element_type") == "raw") & (F.coalesce(attribute("format"), F.lit("")) == "markdown"), F.lit(False))
    raw = blocks.where(is_raw).select(F.struct(F.col(by).alias("doc"), F.col("element_order").alias("at"), F.coalesce("level", F.lit(1)).alias("host")).alias("_key"), F.col("content").alias("text"))
    inner = read_lines(raw, "markdown", "_key").select(F.col("_key.doc").alias(by), "kind", "element_type", "content", (F.col("level") + F.col("_key.host") - 1).cast("int").alias("level"), "encoding", "attributes", F.col("_key.at").alias("element_order"), F.col("element_order").alias("_sub"))
    both = blocks.where(~is_raw).withColumn("_sub", F.lit(0)).select(*inner.columns).unionByName(inner)
    place, whole = Window.partitionBy(by).orderBy("element_order", "_sub"), Window.partitionBy(by)
    order = F.row_number().over(place) - 1 + F.min("element_order").over(whole)
    return both.withColumn("element_order", order.cast("int")).select(*blocks.columns)
