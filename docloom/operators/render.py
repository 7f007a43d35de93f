"""Rendering documents to text, markdown and HTML by one ordered aggregate a document.

A row gives what opens it, with its text, at its own place and what closes it before the next row that isn't below it;
stacks along the rows, forwards for the list that an item is of and backwards for where a row ends, tell both at any
depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stacks import is_first, ranked, ranked_or_equal
from .structure import attribute, body, heading_rank

SYNONYMS = {"markdown": "md", "plain": "text"}
FORMATS = ("md", "html", "text")
# What inline rows are in HTML and markdown.
TAGS = {"bold": "strong", "italic": "em", "code": "code", "strikethrough": "del", "superscript": "sup", "subscript": "sub", "underline": "u"}
MARKS = {"bold": "**", "italic": "*", "code": "`", "strikethrough": "~~"}
#: By how much what is in an item of a list is indented in markdown.
BULLET_WIDTH, NUMBER_WIDTH = 2, 4
_LOW = 2**32


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _quoted(name: str) -> Column:
    return F.replace(_escaped(F.coalesce(attribute(name), F.lit(""))), F.lit('"'), F.lit("&quot;"))


def _cells() -> tuple[Column, Column]:
    t = F.from_json("content", "headers array<string>, rows array<array<string>>")
    none = F.array().cast("array<string>")
    return F.coalesce(t["headers"], none), F.coalesce(t["rows"], F.array().cast("array<array<string>>"))


def _table(output: str) -> Column:
    """A table's rows, the header, if there is one, first; null cells are empty."""
    headers, rows = _cells()
    has_header = F.size(headers) > 0
    line = lambda cells, one, between: F.array_join(F.transform(cells, lambda c: one(F.coalesce(c, F.lit("")))), between)
    if output == "text":
        every = F.concat(F.when(has_header, F.array(headers)).otherwise(F.array().cast("array<array<string>>")), rows)
        return F.array_join(F.transform(every, lambda r: line(r, lambda c: c, "\t")), "\n")
    if output == "md":
        one = lambda c: F.regexp_replace(F.replace(c, F.lit("|"), F.lit("\\|")), r"\s*\n\s*", " ")
        shown = lambda r: F.concat(F.lit("| "), line(r, one, " | "), F.lit(" |"))
        # a table needs a header there
        first = F.when(has_header, headers).otherwise(F.array_repeat(F.lit(""), F.size(F.get(rows, F.lit(0)))))
        rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size(first)))
        return F.array_join(F.concat(F.array(shown(first), rule), F.transform(rows, shown)), "\n")
    row = lambda r, tag: F.concat(F.lit("<tr>"), line(r, lambda c: F.concat(F.lit(f"<{tag}>"), _escaped(c), F.lit(f"</{tag}>")), ""), F.lit("</tr>"))
    head = F.when(has_header, F.concat(F.lit("<thead>"), row(headers, "th"), F.lit("</thead>"))).otherwise("")
    return F.concat(F.lit("<table>"), head, F.lit("<tbody>"), F.array_join(F.transform(rows, lambda r: row(r, "td")), ""), F.lit("</tbody></table>"))


def _cases(pairs: list[tuple[Column, Column]], rest: Column) -> Column:
    out = F.when(*pairs[0])
    for condition, value in pairs[1:]:
        out = out.when(condition, value)
    return out.otherwise(rest)


def _both(opens: Column | str, text: Column, closes: Column | str) -> Column:
    """What stands where a row is, and what ends it."""
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(F.concat(lit(opens), text).alias("line"), lit(closes).alias("close"))


def _lines(output: str) -> Column:
    """(line, close) of a row, from `_said`, its text if the rows below it don't say it, and `_of`, the list it is of."""
    text, kind, inline, none = F.col("_said"), F.col("element_type"), F.col("kind") == "inline", F.lit("")
    breaks = [(inline & (kind == "softbreak"), _both("\n", none, "")), (inline & (kind == "space"), _both(" ", none, ""))]
    if output == "text":
        breaks.append((inline & (kind == "linebreak"), _both("\n", none, "")))
        return _cases([*breaks, (~inline & (kind == "table"), _both("", _table("text"), ""))], _both("", text, ""))
    rank, in_list, number = heading_rank().cast("string"), F.col("_of") > 0, F.col("_of") - 3 + F.col("_nth")
    if output == "md":
        by_level = F.repeat(F.lit("  "), F.greatest((F.col("level") - 2) / 2, F.lit(0)).cast("int"))
        own = F.when(F.col("_of") > 1, NUMBER_WIDTH).otherwise(BULLET_WIDTH)
        indent = F.when(in_list, F.repeat(F.lit(" "), (F.col("_width") - own).cast("int"))).otherwise(by_level)
        mark = F.concat(indent, F.when(F.col("_of") > 1, F.concat(number.cast("string"), F.lit(". "))).otherwise("- "))
        to = lambda name: F.concat(F.lit("]("), F.coalesce(attribute(name), none), F.lit(")"))
        return _cases(
            [
                *breaks, *[(inline & (kind == k), _both(m, text, m)) for k, m in MARKS.items()], (inline & (kind == "linebreak"), _both("\\\n", none, "")),
                (kind == "image", _both("![", F.coalesce(attribute("alt"), text), to("src"))), (inline & (kind == "link"), _both("[", text, to("href"))), (inline, _both("", text, "")),
                (kind == "heading", _both(F.concat(F.repeat(F.lit("#"), heading_rank()), F.lit(" ")), text, "")), (kind == "list_item", _both(mark, text, "")), (kind == "hr", _both("---", none, "")),
                (kind == "code", _both(F.concat(F.lit("```"), F.coalesce(attribute("language"), none), F.lit("\n")), text, "\n```")), (kind == "table", _both("", _table("md"), "")),
            ], _both("", text, ""),
        )
    said = _escaped(text)
    tag = lambda name: _both(f"<{name}>", said, f"</{name}>")
    image = F.concat(F.lit('<img src="'), _quoted("src"), F.lit('" alt="'), F.replace(_escaped(F.coalesce(attribute("alt"), text)), F.lit('"'), F.lit("&quot;")), F.lit('">'))
    start = F.expr("try_cast(attributes['start'] as int)")
    numbered = F.when(F.coalesce(start, F.lit(1)) != 1, F.concat(F.lit('<ol start="'), start.cast("string"), F.lit('">'))).otherwise("<ol>")
    ordered = F.coalesce(attribute("ordered"), none) == "true"
    return _cases(
        [
            *breaks, *[(inline & (kind == k), tag(t)) for k, t in TAGS.items()], (inline & (kind == "linebreak"), _both("<br>", none, "")), (kind == "image", _both(image, none, "")),
            (inline & (kind == "link"), _both(F.concat(F.lit('<a href="'), _quoted("href"), F.lit('">')), said, "</a>")), (inline, _both("", said, "")),
            (kind == "heading", _both(F.concat(F.lit("<h"), rank, F.lit(">")), said, F.concat(F.lit("</h"), rank, F.lit(">")))), (kind == "list_item", tag("li")),
            (kind == "list", _both(F.when(ordered, numbered).otherwise("<ul>"), none, F.when(ordered, "\n</ol>").otherwise("\n</ul>"))), (kind == "hr", _both("<hr>", none, "")),
            (kind == "blockquote", tag("blockquote")), (kind == "figure", tag("figure")), (kind == "caption", tag("figcaption")), (kind == "code", tag("pre")), (kind == "table", _both("", _table("html"), "")),
            (kind.isin("section", "div"), _both("", none, "")), (kind == "plain", _both("", said, "")),
        ], tag("p"),
    )


def render(blocks: DataFrame, output: str = "md", by: str = "doc") -> DataFrame:
    """(doc, rendered): the body of each document as md, html or text (or their synonyms).

    Inline rows join the block before them; blocks are set apart by a blank line, list items by a line. A row's own
    text is left out where inline rows below it say it again. In html, lists, items, quotes, figures and marks hold what
    is below them, and sections and divs have no tags. In md, items of ordered lists have numbers and what is in an
    item is indented. A document of metadata alone has no row; null levels count as 1, null texts as empty.
    """
    output = SYNONYMS.get(output.lower(), output.lower())
    if output not in FORMATS:
        raise ValueError(f"render: {output} is none of {', '.join(FORMATS)}")
    order = Window.partitionBy(by).orderBy("element_order")
    level, kind = F.coalesce("level", F.lit(1)).cast("long"), F.col("element_type")
    is_inline = F.coalesce(F.col("kind") == "inline", F.lit(False))
    # the next row is asked for in the order that the stack backwards needs, so that rows aren't sorted once more for it
    back = Window.partitionBy(by).orderBy(F.col("element_order").desc())
    following = F.lag(F.struct(is_inline.alias("inline"), level.alias("level"))).over(back)
    rows = body(blocks, by).withColumns({"_level": level, "_inline": is_inline})
    if output == "text":
        rows = rows.withColumns({"_end": F.lit(None).cast("long"), "_next": following})
    else:
        rows = rows.withColumn("_first", is_first(order))
        is_list, ordered = F.coalesce(kind == "list", F.lit(False)) & ~F.col("_inline"), F.coalesce(attribute("ordered"), F.lit("")) == "true"
        start = F.greatest(F.coalesce(F.expr("try_cast(attributes['start'] as int)"), F.lit(1)), F.lit(0))
        # the low half says which list a row is: none, one of bullets, or one of numbers and its first one
        what = F.when(is_list & ordered, 2 + start).when(is_list, 1).otherwise(0).cast("long")
        width = F.when(is_list & ordered, NUMBER_WIDTH).when(is_list, BULLET_WIDTH).otherwise(0).cast("long")
        rows = rows.withColumns({"_list": F.col("element_order").cast("long") * _LOW + what, "_weight": width})
        rows = rows.withColumn("_up", ranked("_first", "_level", F.lit(True), "_list", "_weight"))
        rows = rows.withColumns({"_of": F.pmod(F.coalesce("_up.above", F.lit(0)), F.lit(_LOW)), "_width": F.col("_up.total")})
        rows = rows.withColumns({"_last": is_first(back), "_next": following, "_place": F.col("element_order").cast("long")})
        rows = rows.withColumn("_end", ranked_or_equal("_last", "_level", F.lit(True), "_place", F.lit(0).cast("long"))["above"])
        # after the stack: Spark swaps windows that follow one another, and the stack needs the order of its own
        siblings = Window.partitionBy(by, "_up.above", kind == "list_item").orderBy("element_order")
        rows = rows.withColumn("_nth", F.row_number().over(siblings))
    rows = rows.withColumn("_holds", F.coalesce(F.col("_next.inline") & (F.col("_next.level") > F.col("_level")), F.lit(False)))
    rows = rows.withColumn("_said", F.when(F.col("_holds") & (kind != "image"), "").otherwise(F.coalesce("content", F.lit(""))))
    gap = F.when(F.col("_inline"), "").when(kind == "list_item", "\n").otherwise("\n\n")
    shown = rows.withColumn("_is", _lines(output))
    opened = F.struct(F.col("element_order").cast("long").alias("at"), F.lit(1).alias("turn"), F.lit(0).cast("long").alias("depth"), gap.alias("gap"), F.col("_is.line").alias("line"), F.col("_holds").alias("holds"))
    closed = F.struct(F.coalesce("_end", F.lit(2**62)).alias("at"), F.lit(0).alias("turn"), (-F.col("_level")).alias("depth"), F.lit("").alias("gap"), F.col("_is.close").alias("line"), F.lit(False).alias("holds"))
    parts = shown.select(by, F.explode(F.filter(F.array(opened, closed), lambda p: (p["line"] != "") | p["holds"] | (p["turn"] == 1))).alias("x"))
    whole = F.filter(F.array_sort(F.collect_list("x")), lambda p: (p["line"] != "") | p["holds"])
    return parts.groupBy(by).agg(F.regexp_replace(F.array_join(F.transform(whole, lambda p: F.concat(p["gap"], p["line"])), ""), r"^\n+", "").alias("rendered"))
