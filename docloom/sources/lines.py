"""Readers of line-based markup as Spark jobs: lines are classified, grouped into records and laid out as blocks.

A document's lines are exploded with their numbers; each format is a list of rules that say what a line is. Running
windows over the lines of a document find fenced regions, the environments that a line stands in and the runs of
lines that make one block; an aggregate by run puts the record together. Nothing holds more than one block of one
document. What formats share is here; `markups` has the formats.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .assemble import assemble, attributes
from .inlines import Marks, with_pieces


@dataclass(frozen=True)
class LineRule:
    """A line that matches `pattern` is of type `what`; the numbers are those of the groups that hold its parts."""

    what: str  # heading item quote table bar hr meta para code raw figure; skip ends a block, gone doesn't
    pattern: str
    text: int = 1
    length: int = 0  # the group whose length is a heading's rank or an item's depth
    rank: int = 0  # the group with the rank as a digit
    fixed: int = 1  # the rank, where no group has it
    kind: str = "bullet"  # of the list of an item
    ident: int = 0  # an id, or a metadata field's name
    css: int = 0
    start: int = 0  # the number of a list's first item
    second: int = 0  # the definition of an item whose text is a term
    extra: tuple[tuple[str, int | str], ...] = ()  # further attributes: a group or a fixed value
    within: str = ""  # only in this environment


@dataclass(frozen=True)
class Fence:
    """A region of lines that are taken as they are."""

    what: str
    opening: str
    closing: str
    name: int = 0  # the group of the opening with the language
    key: str = "language"
    whole: bool = False  # the marks themselves belong to it
    more: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class LineFormat:
    name: str
    rules: tuple[LineRule, ...]
    fences: tuple[Fence, ...] = ()
    alternating: bool = False  # one mark opens and closes a fence in turn
    environments: tuple[tuple[str, str, str], ...] = ()  # (name, opening, closing); they nest
    marks: Marks = Marks()
    table: Callable[[Column], Column] | None = None  # from a run's lines, array<struct<n, what, body>>, to its JSON
    source: Callable[[DataFrame, str], DataFrame] | None = None  # texts (doc, text), before they are cut into lines
    restored: Callable[[Column], Column] | None = None  # what `source` put in the place of signs, undone in contents and attributes
    resolved: Callable[[DataFrame, str], DataFrame] | None = None  # blocks, at the end
    prepared: Callable[[DataFrame, str], DataFrame] | None = None  # classified lines, before they are grouped
    ranks: Callable[[DataFrame, str], DataFrame] | None = None  # records, before they are laid out
    separator: str = "-"
    comments: str = ""
    trailing: str = ""  # comments at the ends of lines outside fences
    shown: Callable[[Column], Column] = lambda text: text  # a text with escapes undone
    item_depth: Callable[[Column], Column] = lambda marks: F.greatest(marks, F.lit(1))
    continues: bool = False  # indented lines go on with the item before them
    order: tuple[str, ...] = ("n",)  # the order of prepared lines: that of `n`, after a column that never falls along it and that windows go by, so that lines aren't sorted again


MERGED = ("para", "quote", "table", "bar", "code", "raw")


def _along(by: str, order: tuple[str, ...] = ("n",)) -> Window:
    return Window.partitionBy(by).orderBy(*order)


def _so_far(by: str, order: tuple[str, ...] = ("n",)) -> Window:
    return _along(by, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _fenced(rows: DataFrame, fmt: LineFormat, by: str) -> DataFrame:
    """With `_fence`: the number of the region that a line stands in, 0 outside; its marks have `_edge`; `_opening`: the region's first line."""
    if not fmt.fences:
        return rows.withColumn("_fence", F.lit(0).cast("long")).withColumn("_edge", F.lit(False)).withColumn("_opening", F.lit(None).cast("string"))
    line = F.col("line")
    opens = line.rlike("|".join(f"(?:{f.opening})" for f in fmt.fences))
    closes = line.rlike("|".join(f"(?:{f.closing})" for f in fmt.fences))
    if fmt.alternating:
        rows = rows.withColumn("_turn", F.sum(F.when(opens, 1).otherwise(0)).over(_so_far(by)) % 2)
        opens, closes = opens & (F.col("_turn") == 1), opens & (F.col("_turn") == 0)
    rows = rows.withColumn("_step", F.when(opens, 1).otherwise(0) - F.when(closes, 1).otherwise(0)).withColumn("_depth", F.sum("_step").over(_so_far(by)))
    # a closing mark too many closes nothing
    least = lambda end: F.least(F.min("_depth").over(_along(by).rowsBetween(Window.unboundedPreceding, end)), F.lit(0))
    rows = rows.withColumns({"_least": least(Window.currentRow), "_least_before": least(-1)})
    rows = rows.withColumn("_in", F.col("_depth") > F.col("_least")).withColumn("_was", F.col("_depth") - F.col("_step") > F.col("_least_before"))
    begins = F.col("_in") & ~F.col("_was")
    rows = rows.withColumn("_region", F.last(F.when(begins, F.struct("n", "line")), ignorenulls=True).over(_so_far(by)))
    rows = rows.withColumn("_edge", F.col("_in") != F.col("_was")).withColumn("_opening", F.col("_region.line"))
    rows = rows.withColumn("_fence", F.when(F.col("_in") | F.col("_was"), F.col("_region.n") + 1).otherwise(0).cast("long"))
    return rows.drop("_step", "_depth", "_least", "_least_before", "_in", "_was", "_region", "_turn")


def classify(docs: DataFrame, fmt: LineFormat, by: str = "doc", text: str = "text") -> DataFrame:
    """(doc, n, line, what, body, marks, rank, kind, start, ident, more, fence): what each line is; blank lines end blocks."""
    source = F.coalesce(F.col(text), F.lit(""))
    source = F.regexp_replace(source, fmt.comments, "") if fmt.comments else source
    texts = docs.select(by, source.alias("_text"))
    texts = fmt.source(texts, by) if fmt.source else texts
    rows = _fenced(texts.select(by, F.posexplode(F.split("_text", "\r?\n")).alias("n", "line")), fmt, by)
    line, outside = F.col("line"), F.col("_fence") == 0
    if fmt.trailing:
        rows = rows.withColumn("line", F.when(outside, F.regexp_replace(line, fmt.trailing, "")).otherwise(line))
    for name, opening, closing in fmt.environments:
        step = F.when(~outside, 0).when(line.rlike(opening), 1).when(line.rlike(closing), -1).otherwise(0)
        rows = rows.withColumn(f"_{name}", F.sum(step).over(_so_far(by)))
    # the first rule that holds is found once; all else is taken out by its number
    which = F.when(~outside, F.lit(-2)).when(line.rlike(r"^\s*$"), F.lit(-1))
    for k, rule in enumerate(fmt.rules):
        which = which.when(line.rlike(rule.pattern) & (F.col(f"_{rule.within}") > 0 if rule.within else F.lit(True)), F.lit(k))
    rows = rows.withColumn("_rule", which.otherwise(F.lit(len(fmt.rules))))

    def by_rule(part: Callable[[LineRule], Column | None], otherwise: Column) -> Column:
        out = None
        for k, rule in enumerate(fmt.rules):
            value = part(rule)
            if value is not None:
                out = F.when(F.col("_rule") == k, value) if out is None else out.when(F.col("_rule") == k, value)
        return otherwise if out is None else out.otherwise(otherwise)

    group = lambda rule, g: F.regexp_extract(line, rule.pattern, g)
    null = F.lit(None).cast("string")
    what = by_rule(lambda r: F.lit(r.what), F.when(F.col("_rule") == -2, "fenced").when(F.col("_rule") == -1, "blank").otherwise("para"))
    taken = lambda r: group(r, min(r.text, re.compile(r.pattern).groups))
    body = by_rule(lambda r: line if r.what in ("bar", "skip") else taken(r) if r.what in ("code", "raw") else F.trim(taken(r)), F.when(F.col("_rule") == -2, line).otherwise(F.trim(line)))
    made = rows.select(
        by, "n", "line", *[f"_{name}" for name, _, _ in fmt.environments], what.alias("what"), body.alias("body"),
        by_rule(lambda r: F.length(group(r, r.length)) if r.length else None, F.lit(1)).alias("marks"),
        by_rule(lambda r: group(r, r.rank).try_cast("int") if r.rank else F.length(group(r, r.length)) if r.length and r.what == "heading" else F.lit(r.fixed) if r.what == "heading" else None, F.lit(1)).alias("rank"),
        by_rule(lambda r: F.lit(r.kind) if r.what == "item" else None, null).alias("kind"),
        by_rule(lambda r: group(r, r.start).try_cast("int") if r.start else None, F.lit(None).cast("int")).alias("start"),
        by_rule(lambda r: F.trim(group(r, r.second)) if r.second else None, null).alias("second"),
        by_rule(lambda r: F.nullif(F.lower(group(r, r.ident)) if r.what == "meta" else group(r, r.ident), F.lit("")) if r.ident else None, null).alias("ident"),
        by_rule(lambda r: attributes(**({"class": F.nullif(group(r, r.css), F.lit(""))} if r.css else {}), **{k: F.lit(v) if isinstance(v, str) else F.nullif(group(r, v), F.lit("")) for k, v in r.extra}) if r.css or r.extra else None, F.lit(None).cast("map<string,string>")).alias("more"),
        F.col("_fence").alias("fence"), F.col("_edge").alias("edge"), "_opening",
    )
    for f in reversed(fmt.fences):
        own = (F.col("what") == "fenced") & F.col("_opening").rlike(f.opening)
        named = {k: F.lit(v) for k, v in f.more} | ({f.key: F.nullif(F.regexp_extract("_opening", f.opening, f.name), F.lit(""))} if f.name else {})
        made = made.withColumn("more", F.when(own, attributes(**named) if named else F.create_map().cast("map<string,string>")).otherwise(F.col("more")))
        made = made.withColumn("what", F.when(own & (F.lit(f.whole) | ~F.col("edge")), F.lit(f.what)).when(own, F.lit("edge")).otherwise(F.col("what")))
    made = made.withColumn("base", F.lit(0)).withColumn("what", F.when(F.col("what") == "fenced", "code").otherwise(F.col("what")))
    if fmt.continues:
        indented = (F.col("what") == "para") & line.rlike(r"^\s")
        anchor = F.last(F.when(~indented, F.col("what")), ignorenulls=True).over(_so_far(by))
        made = made.withColumn("what", F.when(indented & (anchor == "item"), "cont").otherwise(F.col("what")))
    return fmt.prepared(made, by) if fmt.prepared else made


def records(docs: DataFrame, fmt: LineFormat, by: str = "doc", text: str = "text") -> DataFrame:
    """The records of documents in one of the line formats, with texts for pieces: `_text`, and whether it may have marks."""
    rows = classify(docs, fmt, by, text).where("what <> 'gone'")
    order = _along(by, fmt.order)
    same = lambda c: F.coalesce(F.lag(c).over(order) == F.col(c), F.lit(False))
    kindred = F.when(F.col("what") == "bar", "table").otherwise(F.col("what"))
    rows = rows.withColumn("_kin", kindred)
    goes_on = (F.col("what") == "cont") | (F.col("what").isin(*MERGED) & same("_kin") & same("fence") & same("base"))
    rows = rows.withColumn("_run", F.sum(F.when(goes_on | F.col("what").isin("blank", "skip", "edge"), 0).otherwise(1)).over(order)).where(~F.col("what").isin("blank", "skip", "edge"))
    line = F.struct("n", "what", "body")
    first = lambda c: F.min_by(c, "n").alias(c)
    runs = rows.groupBy(by, "_run").agg(F.min("n").cast("long").alias("n"), *[first(c) for c in ("_kin", "marks", "rank", "kind", "start", "second", "ident", "more", "base")], F.array_sort(F.collect_list(line)).alias("lines"))
    runs = runs.withColumnRenamed("_kin", "what")
    bodies = F.transform("lines", lambda x: x["body"])
    verbatim = F.col("what").isin("code", "raw", "lineblock")
    joined = F.when(verbatim, F.regexp_replace(F.array_join(bodies, "\n"), r"\n+$", "")).otherwise(F.trim(F.array_join(bodies, " ")))
    if fmt.table is not None:
        joined = F.when(F.col("what") == "table", fmt.table(F.col("lines"))).otherwise(joined)
    # an item that has its definition with it is two
    runs = runs.withColumn("_text", joined).withColumn("sub", F.explode(F.when(F.col("second").isNotNull(), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    runs = runs.withColumn("_text", F.when(F.col("what") == "hr", F.lit(None)).when(F.col("sub") == 1, F.col("second")).otherwise(F.col("_text")))
    role = F.create_map(F.lit("role"), F.when(F.col("sub") == 1, "definition").otherwise("term"))
    runs = runs.withColumn("more", F.when(F.col("second").isNotNull(), role).otherwise(F.col("more")))
    taken = verbatim | F.col("what").isin("table", "hr", "div", "image")
    runs = runs.drop("_run", "lines", "second").withColumn("_marked", ~taken)
    depth = fmt.item_depth(F.col("marks")).cast("int")
    made = runs.select(by, "n", "sub", "what", "_text", "_marked", "base", depth.alias("depth"), "kind", F.least(F.greatest("rank", F.lit(1)), F.lit(6)).alias("rank"), "start", "ident", "more")
    return fmt.ranks(made, by) if fmt.ranks else made


def read_lines(docs: DataFrame, fmt: LineFormat | str, by: str = "doc", text: str = "text") -> DataFrame:
    """The block table of documents (doc, text) in one of the line formats; a null text has no blocks."""
    if isinstance(fmt, str):
        from .markups import FORMATS

        fmt = FORMATS[fmt]
    blocks = assemble(records(docs, fmt, by, text), by, fmt.separator, with_pieces=lambda rows: with_pieces(rows, fmt.marks, fmt.shown))
    blocks = fmt.resolved(blocks, by) if fmt.resolved else blocks
    if fmt.restored is None:
        return blocks
    own = F.transform_values("attributes", lambda k, v: F.trim(fmt.restored(v)))
    return blocks.withColumns({"content": fmt.restored(F.col("content")), "attributes": own})
