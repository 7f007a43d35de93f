"""The line formats: what their lines, regions and marks look like, and what only one of them has."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import class_slug
from .assemble import attributes
from ..functions.stacks import NESTS, enclosing, is_first, mark_runs
from .inlines import FREE, WORD, Inline, Marks, mark
from .lines import Fence, LineFormat, LineRule, _along, _so_far

# tables: from a run's lines, array<struct<n, what, body>>, to the JSON of headers and rows


def _as_json(headers: Column, rows: Column) -> Column:
    return F.to_json(F.struct(headers.alias("headers"), rows.alias("rows")))


def _no_cells() -> Column:
    return F.array().cast("array<string>")


def _headed(rows: Column, has_header: Column) -> Column:
    """The first of `rows` as headers, if there are any."""
    with_header = _as_json(F.get(rows, F.lit(0)), F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(1))))
    return F.when(has_header & (F.size(rows) > 0), with_header).otherwise(_as_json(_no_cells(), rows))


def _split(line: Column, cell: str) -> Column:
    return F.transform(F.split(line, cell), lambda c: F.trim(c))


def _pipes(lines: Column) -> Column:
    """A row a line; the first is the header if a rule follows it."""
    body = F.filter(lines, lambda x: x["what"] == "table")
    first = F.get(F.filter(F.transform(lines, lambda x, k: F.struct(x["what"].alias("what"), k.alias("k"))), lambda x: x["what"] == "table"), F.lit(0))["k"]
    ruled = F.coalesce(F.get(lines, first + 1)["what"] == "bar", F.lit(False))
    return _headed(F.transform(body, lambda x: _split(x["body"], r"\|")), ruled)


def _by_columns(lines: Column) -> Column:
    """RST: a grid, whose rows may take several lines and end at rules, or columns set apart by two blanks between rules."""
    grid = F.exists(lines, lambda x: (x["what"] == "table") & x["body"].rlike(r"^\|"))
    empty = F.array().cast("array<array<string>>")
    start = F.struct(empty.alias("rows"), _no_cells().alias("held"))

    def step(acc: Column, x: Column) -> Column:
        cells = _split(F.regexp_replace(x["body"], r"^\||\|$", ""), r"\|")
        joined = F.when(F.size(acc["held"]) == 0, cells).otherwise(F.zip_with(acc["held"], cells, lambda a, b: F.trim(F.concat_ws(" ", a, b))))
        ended = F.when(F.size(acc["held"]) > 0, F.concat(acc["rows"], F.array(acc["held"]))).otherwise(acc["rows"])
        return F.when(x["what"] == "bar", F.struct(ended.alias("rows"), _no_cells().alias("held"))).otherwise(F.struct(acc["rows"].alias("rows"), joined.alias("held")))

    whole = F.aggregate(lines, start, step, lambda acc: F.when(F.size(acc["held"]) > 0, F.concat(acc["rows"], F.array(acc["held"]))).otherwise(acc["rows"]))
    double = F.exists(lines, lambda x: (x["what"] == "bar") & x["body"].rlike(r"^\s*\+[=+]+\+"))
    spaced = F.transform(F.filter(lines, lambda x: x["what"] == "table"), lambda x: _split(F.trim(x["body"]), r"\s{2,}"))
    bars = F.size(F.filter(lines, lambda x: x["what"] == "bar"))
    return F.when(grid, _headed(whole, double)).otherwise(_headed(spaced, bars >= 3))


def _wiki_rows(lines: Column) -> Column:
    """Rows end at |- lines; cells stand on lines of their own or beside each other; ! cells in the first row are headers."""
    text = F.array_join(F.transform(lines, lambda x: F.when(x["what"] == "bar", F.lit("\u0001")).otherwise(x["body"])), "\n")
    parts = F.filter(F.transform(F.split(text, "\u0001"), lambda r: F.trim(F.regexp_replace(r, r"^\n+|\n+$", ""))), lambda r: r != "")
    cell = lambda c: F.trim(F.regexp_replace(c, r"^[^|\[{]*=[^|\[{]*\|", ""))
    rows = F.transform(parts, lambda r: F.transform(F.split(F.regexp_replace(r, r"^[|!]", ""), r"\n[|!]|\|\||!!"), cell))
    return _headed(rows, F.coalesce(F.get(parts, F.lit(0)).startswith("!"), F.lit(False)))


def _textile_rows(lines: Column) -> Column:
    """A row a line; the first is the header if all its cells are marked with _."""
    raw = F.transform(lines, lambda x: F.split(x["body"], r"\|"))
    mark = r"^\s*(?:[_<>=^~/\\0-9-]|\([^)]*\)|\{[^}]*\})++\.\s"
    rows = F.transform(raw, lambda r: F.transform(r, lambda c: F.trim(F.regexp_replace(c, mark, ""))))
    return _headed(rows, F.coalesce(F.forall(F.get(raw, F.lit(0)), lambda c: c.rlike(r"^\s*_[^.]*\.\s")), F.lit(False)))


_RULE = r"\\(?:hline|toprule|midrule|bottomrule|cline\{[^}]*\})"


def _tabular(lines: Column) -> Column:
    """Rows end at a double backslash; the first is the header if rules stand before and after it."""
    text = F.array_join(F.transform(lines, lambda x: x["body"]), " ")
    head = F.split(text, r"\\\\", 2)
    headed = F.get(head, F.lit(0)).rlike(rf"^\s*{_RULE}") & F.coalesce(F.get(head, F.lit(1)).rlike(rf"^\s*{_RULE}"), F.lit(False))
    parts = F.filter(F.transform(F.split(F.regexp_replace(text, _RULE, ""), r"\\\\(?:\[[^\]]*\])?"), lambda r: F.trim(r)), lambda r: r != "")
    bare = lambda c: F.trim(_untexed(F.regexp_replace(c, r"\\(?:textbf|textit|emph|texttt|underline|multicolumn\{[^}]*\}\{[^}]*\})\{([^{}]*)\}", "$1")))
    return _headed(F.transform(parts, lambda r: F.transform(F.split(r, r"(?<!\\)&"), bare)), headed)


# org


def _org(rows: DataFrame, by: str) -> DataFrame:
    """Quote blocks hold quotes; a heading takes its id from the drawer right below it."""
    # of a drawer, the number of its region says where it begins
    custom = F.nullif(F.regexp_extract("line", r"^\s*:(?i:CUSTOM_ID):\s*(\S+)", 1), F.lit(""))
    in_drawer = (F.col("fence") > 0) & F.col("_opening").rlike(r"^\s*:(?i:PROPERTIES):\s*$")
    rows = rows.withColumn("_of", F.when(in_drawer, F.col("fence") - 2).otherwise(F.col("n"))).withColumn("_custom", F.when(in_drawer, custom))
    named = F.when((F.col("what") == "heading"), F.max("_custom").over(Window.partitionBy(by, "_of")))
    rows = rows.withColumn("_custom", named).withColumn("ident", F.coalesce("_custom", "ident")).drop("_custom")
    return rows.withColumn("what", F.when((F.col("_quote") > 0) & (F.col("what") == "para"), "quote").otherwise(F.col("what")))


ORG = LineFormat(
    "org",
    (
        LineRule("skip", r"^\s*#\+(?i:begin_quote|end_quote)\b.*$"),
        LineRule("meta", r"^#\+(?i:(title|author|date)):\s*(.*)$", 2, ident=1),
        LineRule("raw", r"^(#\+\S+?:.*)$", extra=(("format", "org"),)),
        LineRule("skip", r"^\s*#(?:\s.*|)$"),
        LineRule("heading", r"^(\*+)\s+(?:(?:TODO|DONE)\s+)?(.*?)(?:\s+:[\w@:]+:)?\s*$", 2, length=1),
        LineRule("hr", r"^\s*-{5,}\s*$", 0),
        LineRule("bar", r"^\s*\|-[-+|]*\s*$"),
        LineRule("table", r"^\s*\|(.*?)\|?\s*$"),
        LineRule("item", r"^(\s*)(?:[-+]|(?<=\s)\*)\s+(.*?)\s+::\s+(.*)$", 2, length=1, kind="definition", second=3),
        LineRule("item", r"^(\s*)(?:[-+]|(?<=\s)\*)\s+(.*)$", 2, length=1),
        LineRule("item", r"^(\s*)(\d+)[.)]\s+(.*)$", 3, length=1, kind="ordered", start=2),
    ),
    (
        Fence("code", r"^\s*#\+(?i:begin_(?!quote)\w+)(?:\s+([\w+-]+))?.*$", r"^\s*#\+(?i:end_(?!quote)\w+)\s*$", 1),
        Fence("skip", r"^\s*:(?!(?i:end):)[\w-]+:\s*$", r"^\s*:(?i:end):\s*$", whole=True),
    ),
    environments=(("quote", r"^\s*#\+(?i:begin_quote)", r"^\s*#\+(?i:end_quote)"),),
    marks=Marks(
        (
            Inline("link", r"\[\[([^\]\[]+)\]\]", 1, 1),
            Inline("code", r"(?<!\w)[=~]([^=~\s](?:[^=~]*[^=~\s])?)[=~](?!\w)"),
            Inline("link", opening=r"\[\[([^\]\[]+)\]\[", closing=r"\]\]", target=1),
            mark("bold", r"\*", (r"[\w*]", r"[\s*]", r"[\s*]", r"\w")),
            mark("italic", "/", (r"[\w/:]", r"[\s/]", r"[\s/]", r"\w")),
            mark("underline", "_", WORD),
            mark("strikethrough", r"\+", WORD),
        ),
        plain=r"[^\[\]*/_=~+]++",
    ),
    table=_pipes, prepared=_org, order=("_of", "n"), continues=True, item_depth=lambda marks: 1 + F.floor(marks / 2),
)


# rst

_ADORNMENT = r"^([=\-~^\"'#*+`:.<>_])\1{2,}\s*$"
_BORDER = r"^=+\s+=[=\s]*$"
_HANGING = ("_hang", "n")


def _rst(rows: DataFrame, by: str) -> DataFrame:
    """Headings by their adornment, and what indented lines are by the line that they hang on."""
    line, order, so_far = F.col("line"), _along(by), _so_far(by)
    blank = F.col("what") == "blank"
    below, above, after = F.lead("line").over(order), F.lag("line").over(order), F.lead("line", 2).over(order)
    is_mark = lambda x: F.coalesce(x.rlike(_ADORNMENT), F.lit(False))
    long_enough = lambda marks, title: F.length(F.rtrim(marks)) >= F.least(F.lit(4), F.length(F.trim(title)))
    titled = line.rlike(r"^\S") & ~is_mark(line) & is_mark(below) & long_enough(below, line)
    over = F.coalesce(titled & is_mark(above) & (F.substring(above, 1, 1) == F.substring(below, 1, 1)), F.lit(False))
    rows = rows.withColumn("_titled", F.coalesce(titled, F.lit(False)) & ~blank).withColumn("_mark", F.when(F.col("_titled"), F.concat(F.substring(below, 1, 1), over.cast("string"))))
    rows = rows.withColumn("_adorns", is_mark(line) & (F.coalesce(F.lag("_titled").over(order), F.lit(False)) | F.coalesce(F.lead("_titled").over(order) & is_mark(after), F.lit(False))))
    # of the marks of a document, the rank is the order of first appearance
    seen = F.collect_set("_mark").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_new", F.when(F.col("_mark").isNotNull() & ~F.array_contains(seen, F.col("_mark")), F.col("_mark"))).withColumn("_marks", F.collect_list("_new").over(so_far))
    rows = rows.withColumn("_rank", F.when(F.col("_mark").isNotNull(), F.array_position("_marks", F.col("_mark")).cast("int"))).drop("_marks", "_new")
    what = F.when(F.col("_titled"), "heading").when(F.col("_adorns"), "skip").when(is_mark(line) & ~blank & ~line.rlike(_BORDER), "hr").otherwise(F.col("what"))
    rows = rows.withColumn("what", what).withColumn("body", F.when(F.col("_titled"), F.trim(line)).otherwise(F.col("body"))).withColumn("rank", F.coalesce("_rank", "rank"))
    # columns between borders
    bordered = F.col("what") == "bar"
    simple = bordered & line.rlike(_BORDER)
    rows = rows.withColumn("_bars", F.sum(F.when(simple, 1).otherwise(0)).over(so_far))
    rows = rows.withColumn("_borders", F.col("_bars") - F.coalesce(F.last(F.when(blank, F.col("_bars")), ignorenulls=True).over(so_far), F.lit(0)))
    in_simple = (F.col("_borders") > 0) & ~F.col("what").isin("bar", "blank")
    rows = rows.withColumn("body", F.when(in_simple, line).otherwise(F.col("body"))).withColumn("what", F.when(in_simple, "table").otherwise(F.col("what")))
    # the line that an indented line hangs on
    indent = F.length(F.regexp_extract(line, r"^(\s*)", 1))
    directive = r"^\.\.\s+([\w:-]+?)::\s*(.*)$"
    name = F.regexp_extract(line, directive, 1)
    note = r"^\.\.\s+\[([^\]]+)\]\s*(.*)$"
    kind = (
        F.when(line.rlike(directive), name).when(line.rlike(note), "note").when(line.rlike(r"^\.\.(?:\s|$)"), "comment").when(F.col("what") == "item", "item").when(F.col("what") == "field", "field")
        .when(line.rlike(r"::\s*$") & (F.col("what") == "para"), "literal").otherwise("text")
    )
    own = F.struct("n", kind.alias("kind"), F.regexp_extract(line, directive, 2).alias("argument"))
    rows = rows.withColumn("_indent", F.when(~blank, indent)).withColumn("_owner", F.last(F.when(~blank & (indent == 0), own), ignorenulls=True).over(so_far))
    # what hangs on one line stands together: from here on windows go by that line first, for one sort more
    rows = rows.withColumn("_hang", F.coalesce("_owner.n", F.lit(-1)))
    order, so_far, of_owner = _along(by, _HANGING), _so_far(by, _HANGING), Window.partitionBy(by, "_hang")
    below = F.lead("line").over(order)
    hangs, owner = ~blank & (F.col("_indent") > 0), F.col("_owner.kind")
    is_code = owner.isin("code-block", "code", "sourcecode", "literal", "parsed-literal", "highlight", "math")
    option = line.rlike(r"^\s+:[\w-]+:(\s|$)")
    is_directive = owner.rlike(r"^[\w:-]+$") & ~owner.isin("text", "item", "literal", "comment", "field")
    top = ~blank & (F.col("_indent") == 0)
    rows = rows.withColumn("_least", F.min(F.when(hangs, F.col("_indent"))).over(of_owner))
    dedented = F.expr("substring(line, _least + 1)")
    item_after = F.last(F.when(~hangs | (F.col("what") == "item") | blank, F.col("what")), ignorenulls=True).over(so_far)
    term = top & (F.col("what") == "para") & F.coalesce(below.rlike(r"^\s+\S"), F.lit(False)) & ~line.rlike(r"::\s*$") & ~line.rlike(r"^\.\.")
    rows = rows.withColumn("_term", term).withColumn("_of_term", F.last(F.when(~blank & (F.col("_indent") == 0), F.col("_term")), ignorenulls=True).over(so_far)).withColumn("_item_after", item_after)
    what = (
        F.when(blank & hangs, "blank")
        .when(top & line.rlike(r"^\.\.\s+image::"), "image").when(top & line.rlike(r"^\.\.\s+figure::"), "figure").when(top & line.rlike(r"^\.\.\s+(?:code-block|code|sourcecode|parsed-literal|highlight|math)::"), "skip")
        .when(top & line.rlike(directive), "div").when(top & line.rlike(note), "div").when(top & line.rlike(r"^\.\."), "skip")
        .when(term, "item")
        .when(hangs & is_code & ~(option & ~(owner == "literal")), "code")
        .when(hangs & is_directive & option, "skip")
        .when(hangs & (owner == "comment"), "skip").when(hangs & (owner == "image"), "skip")
        .when(hangs & (owner == "figure") & (F.col("what") == "para"), "cont")
        .when(hangs & (F.col("what") == "para") & F.col("_of_term"), "item")
        .when(hangs & (F.col("what") == "para") & owner.isin("item", "field") & (F.col("_item_after") == "item"), "cont")
        .when(hangs & (F.col("what") == "para") & (owner == "text"), "quote")
        .when(F.col("what") == "field", "item")
        .otherwise(F.col("what"))
    )
    rows = rows.withColumn("what", what)
    rows = rows.withColumn("what", F.when((F.col("what") == "item") & F.col("_of_term") & ~F.col("_term") & hangs & (F.lag("what").over(order) == "item") & ~F.coalesce(F.lag("_term").over(order), F.lit(False)), "cont").otherwise(F.col("what")))
    rows = rows.withColumn("_defines", (F.col("what") == "item") & (F.col("_term") | (hangs & F.col("_of_term") & F.col("kind").isNull()) | line.rlike(r"^:[^:`]+:(?:\s|$)")))
    defines = F.col("_defines")
    rows = rows.withColumn("kind", F.when(defines, "definition").otherwise(F.col("kind"))).withColumn("marks", F.when(defines, 0).otherwise(F.col("marks")))
    language = F.when(is_code & (F.col("what") == "code"), attributes(language=F.nullif(F.col("_owner.argument"), F.lit(""))))
    target = lambda pattern: F.nullif(F.regexp_extract(line, pattern, 1), F.lit(""))
    own_alt = F.when(hangs, F.nullif(F.regexp_extract(line, r"^\s+:alt:\s*(.*)$", 1), F.lit("")))
    alt = F.min_by(own_alt, F.when(own_alt.isNotNull(), F.col("n"))).over(of_owner)
    shown = F.col("what").isin("image", "figure")
    rows = rows.withColumn("_alt", F.when(shown, alt))
    rows = rows.withColumn(
        "more",
        F.when(F.col("what") == "code", language).when(shown, attributes(src=target(r"^\.\.\s+(?:image|figure)::\s*(\S+)"), alt=F.col("_alt")))
        .when((F.col("what") == "div") & line.rlike(note), attributes(source_type=F.when(line.rlike(r"^\.\.\s+\[[\d#*]"), "footnote").otherwise("citation"), id=target(note)))
        .when(F.col("what") == "div", attributes(source_type=name))
        .when(F.col("_term") & (F.col("what") == "item"), attributes(role=F.lit("term"))).when(defines & F.col("second").isNull(), attributes(role=F.lit("definition"))).otherwise(F.col("more")),
    )
    argument = F.when(line.rlike(note), F.nullif(F.regexp_extract(line, note, 2), F.lit(""))).otherwise(F.nullif(F.regexp_extract(line, directive, 2), F.lit("")))
    rows = rows.withColumn("body", F.when(F.col("what") == "code", dedented).when(F.col("what").isin("image", "figure"), F.lit("")).when(F.col("what") == "div", argument).when((F.col("what") == "para") & line.rlike(r"::\s*$"), F.regexp_replace(F.trim(line), r"\s*::$", ":")).otherwise(F.col("body")))
    rows = rows.withColumn("what", F.when((F.col("what") == "para") & (F.col("body") == ":"), "skip").otherwise(F.col("what")))
    of_item = hangs & owner.isin("item", "field") & F.col("what").isin("para", "quote")
    rows = rows.withColumn("base", F.when(hangs & is_directive & ~is_code & ~F.col("what").isin("skip", "cont"), 1).when(of_item, 2).otherwise(0))
    # what stands for another text is put in its place, wherever in the document that is given; the first of a name counts
    named, said = r"^\.\.\s+\|([^|]+)\|\s+(?:replace|unicode)::\s*(.*?)\s*$", ~F.col("what").isin("code", "blank", "skip")
    given = F.when(line.rlike(named), F.struct(F.regexp_extract(line, named, 1).alias("name"), F.regexp_extract(line, named, 2).alias("text"), "n"))
    rows = rows.withColumn("_given", F.collect_list(given).over(Window.partitionBy(by)))
    wanted = lambda x: F.array_min(F.transform(F.filter("_given", lambda g: F.concat(F.lit("|"), g["name"], F.lit("|")) == x), lambda g: F.struct(g["n"], g["text"])))["text"]
    parts = F.regexp_extract_all("body", F.lit(r"(?s)(\|[^|\s](?:[^|]*[^|\s])?\|_{0,2}+|[^|]++|.)"), F.lit(1))
    replaced = F.array_join(F.transform(parts, lambda x: F.coalesce(wanted(F.rtrim(x, F.lit("_"))), x)), "")
    rows = rows.withColumn("body", F.when(said & (F.size("_given") > 0) & F.contains("body", F.lit("|")), replaced).otherwise(F.col("body"))).drop("_given")
    return rows.withColumn("fence", F.when(F.col("what") == "code", F.col("_owner.n") + 1).otherwise(0))


def _noted(blocks: DataFrame, by: str) -> DataFrame:
    """Notes with the text of their footnotes as content; one without a footnote keeps its label.

    Labels # and * are numbered in order, those of references and of footnotes each for themselves, so that the first
    reference gets the first footnote. A footnote's text is that of all rows under it, a blank between blocks. Of
    footnotes with one label the first counts.
    """
    order = Window.partitionBy(by).orderBy("element_order")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    has = lambda name: F.try_element_at("attributes", F.lit(name))
    is_ref = (F.col("kind") == "inline") & (F.col("element_type") == "note")
    is_body = F.coalesce((F.col("element_type") == "div") & (has("source_type") == "footnote"), F.lit(False))
    rows = blocks.withColumns({"_role": F.when(is_ref, 1).when(is_body, 2), "_label": has("id")})
    auto = F.col("_role").isNotNull() & F.col("_label").isin("#", "*")
    place = F.lit(None).cast("long")
    for role in (1, 2):
        for label in ("#", "*"):
            own = auto & (F.col("_role") == role) & (F.col("_label") == label)
            place = F.when(own, F.sum(F.when(own, 1).otherwise(0)).over(so_far)).otherwise(place)
    rows = rows.withColumn("_place", place).withColumn("_label", F.when(auto, F.concat("_label", F.col("_place").cast("string"))).otherwise(F.col("_label")))
    # the footnote that a row stands under, up to the next row that isn't below it
    rows = rows.withColumn("_div", F.last(F.when(F.col("_role") == 2, F.struct("element_order", "level")), ignorenulls=True).over(so_far))
    below = (F.col("element_order") == F.col("_div.element_order")) | (F.col("level") > F.col("_div.level"))
    rows = rows.withColumn("_out", F.max(F.when(F.coalesce(~below, F.lit(True)), F.col("element_order"))).over(so_far))
    rows = rows.withColumn("_left", F.coalesce(F.col("_out") >= F.col("_div.element_order"), F.col("_div").isNull()))
    rows = rows.withColumn("_block", F.sum(F.when(F.col("kind") == "block", 1).otherwise(0)).over(so_far))
    said = F.collect_list(F.when(~F.col("_left") & F.col("content").isNotNull(), F.struct("element_order", "_block", "content")))
    parts = said.over(Window.partitionBy(by, "_div.element_order"))
    rows = rows.withColumn("_parts", F.when(F.col("_role") == 2, F.array_sort(parts)))
    gap = lambda k: F.when((k > 0) & (F.get("_parts", k - 1)["_block"] != F.get("_parts", k)["_block"]), " ").otherwise("")
    text = F.trim(F.array_join(F.transform("_parts", lambda p, k: F.concat(gap(k), p["content"])), ""))
    rows = rows.withColumn("_body", F.when(F.col("_role") == 2, text))
    key = F.when(F.col("_role").isNotNull(), F.concat(F.lit("="), F.coalesce("_label", F.lit("")))).otherwise(F.col("element_order").cast("string"))
    first = F.min_by("_body", F.when(F.col("_role") == 2, F.col("element_order"))).over(Window.partitionBy(by, "_key"))
    rows = rows.withColumn("_key", key).withColumn("_found", F.nullif(first, F.lit("")))
    named = F.map_concat(F.map_filter("attributes", lambda k, v: k != "id"), F.create_map(F.lit("id"), F.col("_label")))
    return rows.withColumns(
        {
            "content": F.when(F.col("_role") == 1, F.coalesce("_found", "content")).otherwise(F.col("content")),
            "attributes": F.when(F.col("_role").isNotNull() & F.col("_label").isNotNull(), named).otherwise(F.col("attributes")),
        }
    ).select(*blocks.columns)


RST = LineFormat(
    "rst",
    (
        LineRule("bar", r"^\s*\+[-=+]+\+\s*$"), LineRule("bar", _BORDER), LineRule("table", r"^\s*(\|.*\|)\s*$"), LineRule("lineblock", r"^\|\s(.*)$"),
        LineRule("item", r"^(\s*)[-*+•]\s+(.*)$", 2, length=1), LineRule("item", r"^(\s*)(?:(\d+)|#|[a-zA-Z])[.)]\s+(.*)$", 3, length=1, kind="ordered", start=2),
        LineRule("field", r"^:([^:`]+):(?:\s+(.*))?$", 1, kind="definition", second=2),
    ),
    marks=Marks(
        (
            Inline("code", r"``([^`]+)``"),
            Inline("link", r"`([^`<]+?)\s*<([^>`]+)>`__?", 1, 2),
            Inline("superscript", r":sup(?:erscript)?:`([^`]+)`"),
            Inline("subscript", r":sub(?:script)?:`([^`]+)`"),
            Inline("math", r":math:`([^`]+)`"),
            Inline("code", r":(?:code|literal|[\w:+-]+):`([^`]+)`"),
            Inline("link", r"`([^`]+)`_", 1),
            Inline("code", r"`([^`]+)`", more=(("class", "interpreted-text"),)),
            Inline("note", r"\[([\d#*][^\]\s]*)\]_", 1, 1, "id"),
            Inline("link", r"(https?://[^\s<>]+[\w/])", 1, 1),
            mark("bold", r"\*\*"),
            mark("italic", r"\*"),
        ),
        plain=r"[^`*\[\\:]+?(?=https?://|[`*\[\\:]|\z)",
        escapes=r"\\\S",
        twins=("*", 2, 1),
    ),
    table=_by_columns, prepared=_rst, order=_HANGING, resolved=_noted, shown=lambda text: F.regexp_replace(text, r"\\(\S)", "$1"), item_depth=lambda marks: 1 + F.floor(marks / 2),
)


# mediawiki


#: Characters that no text has, for braces and line breaks inside a template.
_STAND_INS = "\ufdd0\ufdd1\ufdd2"


def _balanced(texts: DataFrame, by: str, text: str = "_text") -> DataFrame:
    """Texts with each whole template on one line and without braces inside it; braces that don't pair stay.

    A stack along the pairs of braces of a text finds which close which, at any depth and over any number of lines.
    """
    cut = F.when(F.contains(text, F.lit("{{")), F.regexp_extract_all(text, F.lit(r"(?s)(\{\{|\}\}|[^{}]++|.)"), F.lit(1)))
    none = F.lit(None).cast("int")
    brace = lambda x: F.when(x.isin("{{", "}}"), F.struct(none.alias("what"), F.when(x == "{{", 0).alias("opens"), F.when(x == "}}", 0).alias("closes"), none.alias("twin"), F.lit(NESTS).alias("nests")))
    rows = texts.withColumn("_tokens", cut).withColumn("_runs", mark_runs()(F.transform("_tokens", brace)))
    said = lambda r: F.array_join(F.slice("_tokens", r["start"], r["size"]), "")
    whole = F.array_join(F.transform("_runs", lambda r: F.when(r["depth"] > 0, F.translate(said(r), "{}\n", _STAND_INS)).otherwise(said(r))), "")
    return rows.withColumn(text, F.when(F.size("_tokens") > 0, whole).otherwise(F.col(text))).select(*texts.columns)


def _wiki(rows: DataFrame, by: str) -> DataFrame:
    """Other lines in a table go on with a cell; those in a quote are quoted; term and definition lines share a list."""
    what = F.when((F.col("_table") > 0) & F.col("what").isin("para", "code"), "table").when((F.col("_quote") > 0) & (F.col("what") == "para"), "quote").otherwise(F.col("what"))
    return rows.withColumn("what", what)


MEDIAWIKI = LineFormat(
    "mediawiki",
    (
        LineRule("skip", r"^\s*\{\|.*$"), LineRule("skip", r"^\s*\|\}.*$"), LineRule("skip", r"^\|\+.*$", within="table"), LineRule("bar", r"^\s*\|-.*$", within="table"), LineRule("table", r"^\s*[|!].*$", 0, within="table"),
        LineRule("skip", r"^</?blockquote[^>]*>\s*$"), LineRule("heading", r"^(={1,6})\s*(.*?)\s*\1\s*$", 2, length=1), LineRule("hr", r"^-{4,}\s*$", 0),
        LineRule("item", r"^([*#;:]*\*)\s*(.*)$", 2, length=1), LineRule("item", r"^([*#;:]*#)\s*(.*)$", 2, length=1, kind="ordered"),
        LineRule("item", r"^([*#;:]*;)\s*(.*?)\s+:\s+(.*)$", 2, length=1, kind="definition", second=3), LineRule("item", r"^([*#;:]*;)\s*(.*)$", 2, length=1, kind="definition", extra=(("role", "term"),)),
        LineRule("item", r"^([*#;:]*:)\s*(.*)$", 2, length=1, kind="definition", extra=(("role", "definition"),)),
        LineRule("skip", r"^\[\[(?i:category):.*\]\]\s*$"), LineRule("figure", r"^\[\[(?i:file|image):([^|\]]+)(?:\|(?:thumb|frame|left|right|center|none|upright[^|\]]*|\d+(?:x\d+)?px|alt=[^|\]]*)(?=[|\]]))*+(?:\|([^|\]]*))?\]\]\s*$", 2, extra=(("src", 1),)),
        LineRule("raw", r"^(__[A-Z]+__)\s*$", extra=(("format", "mediawiki"), ("source_type", "behavior_switch"))), LineRule("raw", r"^(\{\{[\s\uFDD2]*([^|{}]+?)[\s\uFDD2]*(?:\|[^{}]*)?\}\})\s*$", extra=(("format", "mediawiki"), ("source_type", "template"), ("template_name", 2))),
        LineRule("code", r"^ (.*\S.*)$"),
    ),
    (
        Fence("code", r"^<(?:pre|syntaxhighlight|source)(?:\s+lang=\"?(\w+)\"?)?[^>]*>\s*$", r"^</(?:pre|syntaxhighlight|source)>\s*$", 1),
    ),
    environments=(("table", r"^\s*\{\|", r"^\s*\|\}"), ("quote", r"^<blockquote[^>]*>\s*$", r"^</blockquote>\s*$")),
    marks=Marks(
        (
            Inline("text", r"<nowiki>(.*?)</nowiki>"),
            Inline("raw", r"(\{\{[\s\uFDD2]*([^|{}]+?)[\s\uFDD2]*(?:\|[^{}]*)?\}\})", 1, 2, "template_name", (("format", "mediawiki"), ("source_type", "template"))),
            Inline("image", r"\[\[(?i:file|image):([^|\]]+)(?:\|[^|\]]*+(?=\|))*+(?:\|([^|\]]*))?\]\]", 2, 1, "src"),
            Inline("link", r"\[\[([^\]|\[]+)\]\]", 1, 1, more=(("link_type", "wikilink"),)),
            Inline("link", r"\[(\w+://[^\s\]]+)\]", 1, 1),
            Inline("code", r"<code>(.*?)</code>"),
            Inline("math", r"<math>(.*?)</math>"),
            Inline("note", opening=r"<ref(?:\s+name=\"?([^\">/]+?)\"?)?\s*>", closing="</ref>", target=1, key="id"),
            Inline("link", opening=r"\[\[([^\]|\[]+)\|", closing=r"\]\]", target=1, more=(("link_type", "wikilink"),), nests=NESTS),
            Inline("link", opening=r"\[(\w+://[^\s\]]+)\s+", closing=r"\]", target=1),
            mark("bold", "'''", FREE),
            mark("italic", "''", FREE),
            Inline("superscript", opening="<sup>", closing="</sup>", nests=NESTS),
            Inline("subscript", opening="<sub>", closing="</sub>", nests=NESTS),
            Inline("strikethrough", opening="<(?:s|del|strike)>", closing="</(?:s|del|strike)>", nests=NESTS),
            Inline("underline", opening="<(?:u|ins)>", closing="</(?:u|ins)>", nests=NESTS),
        ),
        plain=r"[^<\[\]'{}]++",
        twins=("'", 3, 2),
    ),
    table=_wiki_rows, prepared=_wiki, separator="_", comments=r"(?s)<!--.*?-->", source=_balanced, restored=lambda x: F.translate(x, _STAND_INS, "{}\n"),
)


# textile

_SPEC = r"(?:(?:\(([^)#]*)(?:#([^)]*))?\))|\{[^}]*\}|\[[^\]]*\]|[<>=]+)*+"
_BLOCK_TAGS = "div|table|section|article|aside|header|footer|nav|script|style|iframe|object|video|details|form|ul|ol|dl|figure|blockquote"


def _textile(rows: DataFrame, by: str) -> DataFrame:
    """Lines up to the next blank one go on with what a block marker began; after a marker with two dots, up to the next marker."""
    plain = F.col("what").isin("para", "blank")
    marker = F.when(~plain, F.struct("n", "what", F.col("line").rlike(r"^\w+[^.\s]*\.\.\s").alias("extended")))
    rows = rows.withColumn("_marker", F.last(marker, ignorenulls=True).over(_so_far(by))).withColumn("_blanks", F.sum(F.when(F.col("what") == "blank", 1).otherwise(0)).over(_so_far(by)))
    rows = rows.withColumn("_first", F.last(F.when(~plain, F.col("_blanks")), ignorenulls=True).over(_so_far(by)))
    near = F.col("_blanks") == F.col("_first")
    of = F.col("_marker.what")
    what = (
        F.when((F.col("what") == "blank") & (of == "code") & F.col("_marker.extended"), "code")
        .when((F.col("what") == "para") & of.isin("code", "raw") & (near | F.col("_marker.extended")), of)
        .when((F.col("what") == "para") & (of == "quote") & (near | F.col("_marker.extended")), "quote")
        .when((F.col("what") == "para") & of.isin("heading", "item", "marked") & near, "cont").when(F.col("what") == "marked", "para").otherwise(F.col("what"))
    )
    rows = rows.withColumn("_new", what)
    rows = rows.withColumn("body", F.when(F.col("_new").isin("code", "raw") & plain, F.col("line")).otherwise(F.col("body"))).withColumn("what", F.col("_new"))
    return rows.withColumn("fence", F.when(F.col("what").isin("code", "raw") & (F.col("fence") == 0), F.col("_marker.n") + 1).otherwise(F.col("fence")))


TEXTILE = LineFormat(
    "textile",
    (
        LineRule("skip", r"^###\.+\s.*$"), LineRule("heading", rf"^h([1-6]){_SPEC}\.\s+(.*)$", 4, rank=1, css=2, ident=3), LineRule("quote", rf"^bq{_SPEC}\.{{1,2}}(?::\S+)?\s+(.*)$", 3), LineRule("code", rf"^(?:bc|pre){_SPEC}\.{{1,2}}\s(.*)$", 3, extra=(("language", 1),)),
        LineRule("raw", r"^notextile\.{1,2}\s+(.*)$", extra=(("format", "html"),)), LineRule("marked", rf"^p{_SPEC}\.{{1,2}}\s+(.*)$", 3, css=1, ident=2), LineRule("raw", rf"^(<(?:{_BLOCK_TAGS}|hr|br|!--)\b.*)$", extra=(("format", "html"),)),
        LineRule("item", r"^-\s+(.*?)\s*:=\s*(.*?)(?:\s*=:)?$", 1, kind="definition", second=2), LineRule("item", r"^([*#]*\*)\s+(.*)$", 2, length=1), LineRule("item", r"^([*#]*#)\s+(.*)$", 2, length=1, kind="ordered"), LineRule("table", r"^\|(.*)\|\s*$"), LineRule("hr", r"^-{3,}\s*$", 0),
    ),
    (Fence("code", r"^<pre[^>]*>\s*$", r"^</pre>\s*$"), Fence("raw", rf"^<(?:{_BLOCK_TAGS})\b(?!.*</).*$", rf"^.*</(?:{_BLOCK_TAGS})>\s*$", whole=True, more=(("format", "html"),))),
    marks=Marks(
        (
            Inline("image", r"!([^\s!(]+)(?:\(([^)]*)\))?!", 2, 1, "src"),
            Inline("code", r"@([^@]+)@"),
            Inline("superscript", r"\^([^^\s]+)\^"),
            Inline("subscript", r"~([^~\s]+)~"),
            Inline("note", r"\[(\d+)\]", 1, 1, "id"),
            Inline("link", opening='"', closing=r'":(\S*[\w/])', target=1, behind=True, nests=NESTS, flank=("", r"\s", "", "")),
            mark("bold", r"\*\*"),
            mark("italic", "__"),
            mark("cite", r"\?\?"),
            mark("bold", r"\*", WORD),
            mark("italic", "_", WORD),
            mark("strikethrough", "-", (r"[\w-]", r"[\s-]", r"[\s-]", r"[\w-]")),
            mark("underline", r"\+", (r"[\w+]", r"[\s+]", r"[\s+]", r"[\w+]")),
            mark("span", "%"),
        ),
        plain=r"[^!@^~\[\"*_?+%-]++",
        twins=("*", 2, 1),
    ),
    table=_textile_rows, prepared=_textile,
)


# latex

_LISTS, _TABULAR, _QUOTES = "itemize|enumerate|description", r"tabular[*xy]?|longtable|tabularx", "quote|quotation|verse"
_PASSED = "document|table|table\\*|abstract|center|flushleft|flushright|figure|figure\\*|minipage|hyphenrules|otherlanguage"
_DROPPED = "equation|align|gather|multline|displaymath|tikzpicture|eqnarray|comment"
_OTHER = rf"(?!(?:{_LISTS}|{_TABULAR}|{_QUOTES}|{_PASSED}|{_DROPPED}|verbatim|lstlisting|minted|Verbatim)\*?\}})([\w-]+)\*?\}}"


def _untexed(text: Column) -> Column:
    """A text without escapes, ligatures, braces and the names of macros that aren't marks."""
    out = F.regexp_replace(text, r"\\(?:label|index|vspace|hspace|pagestyle|thispagestyle|bibliographystyle|bibliography|setlength|input|include|vskip|hskip|addcontentsline)\*?(?:\[[^\]]*\])?(?:\{[^{}]*\})*+", "")
    out = F.regexp_replace(out, r"\\(?:hypertarget|textcolor|hyperref)(?:\[[^\]]*\])?\{[^{}]*\}", "")
    out = F.regexp_replace(out, r"\\(?:textbackslash|ldots|dots|TeX|LaTeX)\b(?:\{\})?", "…")
    out = F.regexp_replace(F.regexp_replace(out, r"\\\\(?:\[[^\]]*\])?", " "), r"\\[A-Za-z]+\*?(?:\[[^\]]*\])?\s*", "")
    out = F.regexp_replace(F.regexp_replace(out, r"(?<!\\)[{}]", ""), r"(?<!\\)~", "\u00a0")
    for a, b in (("---", "—"), ("--", "–"), ("``", "“"), ("''", "”")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.regexp_replace(out, r"\\([&%$#_{}~^ ])", "$1")


def _latex(rows: DataFrame, by: str) -> DataFrame:
    """Items belong to the innermost list around them; headings rank by the document's class; unknown environments are divs."""
    line, so_far = F.col("line"), _so_far(by)
    named_list = F.regexp_extract(line, rf"^\s*\\(?:begin|end)\{{({_LISTS})\}}", 1)
    outside = F.col("fence") == 0
    step = F.when(outside & line.rlike(rf"^\s*\\begin\{{(?:{_LISTS})\}}"), 1).when(outside & line.rlike(rf"^\s*\\end\{{(?:{_LISTS})\}}"), -1).otherwise(0)
    kinds = _LISTS.split("|")
    number = F.array_position(F.array(*map(F.lit, kinds)), named_list) - 1
    rows = rows.withColumns({"_first": is_first(_along(by)), "_step": step, "_value": F.col("n") * len(kinds) + number})
    rows = rows.withColumn("_which", enclosing("_first", "_step", "_value"))
    inner = F.get(F.array(*map(F.lit, kinds)), (F.col("_which") % len(kinds)).cast("int"))
    kind = F.when(inner == "enumerate", "ordered").when(inner == "description", "definition").otherwise("bullet")
    is_item = F.col("what") == "item"
    label = F.regexp_extract(line, r"^\s*\\item\s*\[([^\]]*)\]", 1)
    defines = is_item & (kind == "definition") & (label != "")
    body = F.col("body")
    rows = rows.withColumn("kind", F.when(is_item, kind)).withColumn("marks", F.when(is_item, F.greatest("_list", F.lit(1))).otherwise(F.col("marks")))
    rows = rows.withColumn("ident", F.when(is_item, F.floor(F.col("_which") / len(kinds)).cast("string")).otherwise(F.col("ident")))
    rows = rows.withColumn("second", F.when(defines, body)).withColumn("body", F.when(defines, label).otherwise(body))
    book = F.max(line.rlike(r"^\s*\\documentclass(?:\[[^\]]*\])?\{(?:book|report|memoir|scrbook|scrreprt)\}").cast("int")).over(Window.partitionBy(by))
    rank = F.when(line.rlike(r"^\s*\\(?:hypertarget\{[^}]*\}\{\s*)?\\?(?:part|chapter)\b"), 1).otherwise(F.col("rank") + book)
    label_of = lambda x: F.nullif(F.regexp_extract(x, r"\\label\{([^}]*)\}", 1), F.lit(""))
    below = F.lead("line").over(_along(by))
    named = F.coalesce(label_of(line), F.when(below.rlike(r"^\s*\\label\{"), label_of(below)))
    heading = F.col("what") == "heading"
    rows = rows.withColumn("_rank", rank).withColumn("_named", named).withColumn("rank", F.when(heading, F.col("_rank")).otherwise(F.col("rank"))).withColumn("ident", F.when(heading, F.col("_named")).otherwise(F.col("ident")))
    quoted = (F.col("_quote") > 0) & (F.col("what") == "para")
    in_table = (F.col("_table") > 0) & F.col("what").isin("para", "rule", "item")
    rows = rows.withColumn("body", F.when(in_table, F.trim(line)).otherwise(F.col("body"))).withColumn("what", F.when(in_table, "table").when(quoted, "quote").when(F.col("what") == "rule", "skip").otherwise(F.col("what")))
    anchor = F.last(F.when(F.col("what") != "para", F.col("what")), ignorenulls=True).over(so_far)
    rows = rows.withColumn("_anchor", anchor).withColumn("what", F.when((F.col("what") == "para") & (F.col("_list") > 0) & F.col("_anchor").isin("item"), "cont").otherwise(F.col("what")))
    other = F.regexp_extract(line, rf"^\s*\\begin\{{{_OTHER}", 1)
    is_div = F.col("what") == "div"
    rows = rows.withColumn("more", F.when(is_div, attributes(**{"class": F.nullif(class_slug(other), F.lit(""))})).otherwise(F.col("more"))).withColumn("body", F.when(is_div, F.lit("")).otherwise(F.col("body")))
    return rows.withColumn("base", F.greatest(F.col("_div") - F.when(is_div, 1).otherwise(0), F.lit(0)).cast("int"))


_HEAD = r"^\s*(?:\\hypertarget\{[^}]*\}\{\s*)?\\"
LATEX = LineFormat(
    "latex",
    (
        LineRule("gone", r"^\s*%.*$"), LineRule("meta", r"^\s*\\(title|author|date)(?:\[[^\]]*\])?\{(.*)\}\s*$", 2, ident=1), LineRule("heading", _HEAD + r"(?:part|chapter|section)\*?(?:\[[^\]]*\])?\{(.*?)\}(?:\s*\}?\s*\\label\{[^}]*\}\s*\}?|\s*\}?)\s*$", fixed=1),
        LineRule("heading", _HEAD + r"subsection\*?(?:\[[^\]]*\])?\{(.*?)\}(?:\s*\}?\s*\\label\{[^}]*\}\s*\}?|\s*\}?)\s*$", fixed=2), LineRule("heading", _HEAD + r"subsubsection\*?(?:\[[^\]]*\])?\{(.*?)\}(?:\s*\}?\s*\\label\{[^}]*\}\s*\}?|\s*\}?)\s*$", fixed=3),
        LineRule("heading", _HEAD + r"(?:paragraph)\*?\{(.*?)\}(?:\s*\\label\{[^}]*\})?\s*$", fixed=4), LineRule("heading", _HEAD + r"subparagraph\*?\{(.*?)\}(?:\s*\\label\{[^}]*\})?\s*$", fixed=5),
        LineRule("item", r"^\s*\\item\b(?:\s*\[[^\]]*\])?\s*(.*)$", 1), LineRule("rule", rf"^\s*(?:{_RULE}\s*)++$"), LineRule("hr", r"^\s*\\(?:hrule|rule\{.*)\s*.*$", 0), LineRule("div", rf"^\s*\\begin\{{{_OTHER}.*$"),
        LineRule("figure", r"^\s*\\includegraphics(?:\[[^\]]*\])?\{([^}]*)\}\s*$", 0, extra=(("src", 1),), within="figure"), LineRule("skip", r"^\s*\\(?:centering|caption)\b.*$", within="figure"),
        LineRule("skip", r"^\s*\\(?:documentclass|usepackage|begin|end|maketitle|tableofcontents|label|newcommand|renewcommand|newpage|clearpage|pagestyle|setcounter|setlength|bibliography\w*|input|include|centering|appendix|frontmatter|mainmatter|backmatter)\b.*$"),
    ),
    (
        Fence("code", r"^\s*\\begin\{(?:verbatim|Verbatim|lstlisting|minted)\*?\}(?:\[(?:[^\]]*?language=)?(\w+)[^\]]*\])?.*$", r"^\s*\\end\{(?:verbatim|Verbatim|lstlisting|minted)\*?\}.*$", 1),
        Fence("skip", rf"^\s*\\begin\{{(?:{_DROPPED})\*?\}}.*$", rf"^\s*\\end\{{(?:{_DROPPED})\*?\}}.*$", whole=True),
    ),
    environments=(
        ("list", rf"^\s*\\begin\{{(?:{_LISTS})\}}", rf"^\s*\\end\{{(?:{_LISTS})\}}"), ("table", rf"^\s*\\begin\{{(?:{_TABULAR})\}}", rf"^\s*\\end\{{(?:{_TABULAR})\}}"), ("quote", rf"^\s*\\begin\{{(?:{_QUOTES})\}}", rf"^\s*\\end\{{(?:{_QUOTES})\}}"),
        ("div", rf"^\s*\\begin\{{{_OTHER}", rf"^\s*\\end\{{{_OTHER}"), ("figure", r"^\s*\\begin\{figure\*?\}", r"^\s*\\end\{figure\*?\}"),
    ),
    marks=Marks(
        (
            Inline("math", r"\$\$([^$]+)\$\$", more=(("display", "block"),)),
            Inline("math", r"\$([^$]+)\$", more=(("display", "inline"),)),
            Inline("math", r"\\\((.+?)\\\)", more=(("display", "inline"),)),
            Inline("math", r"\\\[(.+?)\\\]", more=(("display", "block"),)),
            Inline("code", r"\\verb\|([^|]*)\|"),
            Inline("code", r"\\texttt\{([^{}]*)\}"),
            Inline("link", r"\\url\{([^{}]*)\}", 1, 1),
            Inline("image", r"\\includegraphics(?:\[[^\]]*\])?\{([^{}]*)\}", 1, 1, "src"),
            Inline("cite", r"\\cite\w*(?:\[[^\]]*\]){0,2}+\{([^{}]*)\}"),
            *(
                Inline(kind, opening=opening, closing=r"\}", family="{", target=target, nests=NESTS)
                for kind, opening, target in (
                    ("link", r"\\href\{([^{}]*)\}\s*\{", 1),
                    ("bold", r"\\(?:textbf|textsc)\s*\{", 0),
                    ("italic", r"\\(?:textit|emph|textsl)\s*\{", 0),
                    ("underline", r"\\(?:underline|uline)\s*\{", 0),
                    ("strikethrough", r"\\(?:sout|st)\s*\{", 0),
                    ("superscript", r"\\textsuperscript\s*\{", 0),
                    ("subscript", r"\\textsubscript\s*\{", 0),
                    ("note", r"\\footnote(?:\[[^\]]*\])?\s*\{", 0),
                    ("group", r"\{", 0),
                )
            ),
        ),
        plain=r"[^\\${}]++",
        escapes=r"\\[^A-Za-z(\[]",
    ),
    table=_tabular, prepared=_latex, trailing=r"(?<!\\)%.*$", shown=_untexed,
)


# markdown


def _markdown(rows: DataFrame, by: str) -> DataFrame:
    """A line under a paragraph that consists of = or - makes it a heading."""
    below = F.lead("line").over(_along(by))
    rank = F.when(F.col("what") == "para", F.when(below.rlike(r"^=+\s*$"), 1).when(below.rlike(r"^-{2,}\s*$"), 2))
    rows = rows.withColumn("_rank", rank)
    under = F.coalesce(F.lag("_rank").over(_along(by)).isNotNull(), F.lit(False))
    return rows.withColumn("what", F.when(under, "skip").when(F.col("_rank").isNotNull(), "heading").otherwise(F.col("what"))).withColumn("rank", F.coalesce("_rank", "rank"))


MARKDOWN = LineFormat(
    "markdown",
    (
        LineRule("heading", r"^(#{1,6})\s+(.*?)\s*#*\s*$", 2, length=1), LineRule("hr", r"^\s*(?:-\s*-\s*-[-\s]*|\*\s*\*\s*\*[*\s]*|_\s*_\s*_[_\s]*)$", 0), LineRule("item", r"^(\s*)[-*+]\s+(.*)$", 2, length=1), LineRule("item", r"^(\s*)(\d+)[.)]\s+(.*)$", 3, length=1, kind="ordered", start=2),
        LineRule("quote", r"^\s*>\s?(.*)$"), LineRule("bar", r"^(?=\s*\|?\s*:?-{2,}:?\s*\|\s*:?-{2})[\s|:-]+$"), LineRule("table", r"^\s*\|(.*?)\|?\s*$"), LineRule("raw", r"^(</?[A-Za-z][^>]*>.*|<!--.*)$", extra=(("format", "html"),)),
    ),
    (Fence("code", r"^\s*(?:```+|~~~+)\s*([\w+-]*).*$", r"^\s*(?:```+|~~~+)\s*$", 1),),
    alternating=True,
    marks=Marks(
        (
            Inline("code", r"`([^`]+)`"),
            Inline("image", r"!\[([^\]]*)\]\(([^)\s]*)[^)]*\)", 1, 2, "src"),
            Inline("link", r"<(https?://[^>]+)>", 1, 1),
            Inline("link", opening=r"\[", closing=r"\]\(([^)\s]*)[^)]*\)", target=1, behind=True, nests=NESTS),
            mark("bold", r"\*\*"),
            mark("bold", "__", WORD),
            mark("italic", r"\*"),
            mark("italic", "_", WORD),
            mark("strikethrough", "~~"),
        ),
        plain=r"[^`!\[\]<*_~\\]++",
        escapes=r"\\[\\`*_{}\[\]()#+.!|<>~-]",
        twins=("*", 2, 1),
    ),
    table=_pipes, prepared=_markdown, continues=True, shown=lambda text: F.regexp_replace(text, r"\\([\\`*_{}\[\]()#+.!|<>~-])", "$1"), item_depth=lambda marks: 1 + F.floor(marks / 2),
)

FORMATS = {f.name: f for f in (ORG, RST, MEDIAWIKI, TEXTILE, LATEX, MARKDOWN)}

# The kinds of tokens, and the ligatures of texts.
TOKEN_KINDS = ("text", "control_word", "control_symbol", "begin_group", "end_group", "par_break", "math_shift")
_LIGATURES = (("---", "—"), ("--", "–"), ("``", "“"), ("''", "”"), ("~", "\u00a0"))


def latex_tokens(docs: DataFrame, by: str = "doc", text: str = "text") -> DataFrame:
    """(doc, n, kind, text) of LaTeX texts.

    Comments go with their line break and the blanks after it; a verbatim body and the formula between two math shifts
    are one text each, as they stand; in other texts ligatures are single signs. A blank line is a par_break.
    """
    parts = (
        r"\\begin\{(?:verbatim|lstlisting)\*?\}.*?\\end\{(?:verbatim|lstlisting)\*?\}", r"\$\$[^$]*\$\$", r"\$[^$\n]*\$", r"\\[A-Za-z@]+\*?[ \t]*", r"\\.", r"%[^\n]*(?:\n[ \t]*|$)", r"[{}]", r"[ \t]*\n[ \t]*\n\s*", r"\$\$?", r"[^\\{}$%]+?(?=[\\{}$%]|[ \t]*\n[ \t]*\n|\z)", r".",
    )
    raw = docs.select(by, F.posexplode(F.regexp_extract_all(F.col(text), F.lit("(?s)(" + "|".join(parts) + ")"), F.lit(1))).alias("at", "token")).where(~F.col("token").startswith("%"))
    token = F.col("token")
    one = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("text"))
    shift = F.when(token.startswith("$$"), "$$").otherwise("$")
    inner = F.regexp_replace(token, r"^\$\$?|\$\$?$", "")
    verbatim = r"(?s)^\\begin\{(verbatim|lstlisting)\*?\}(.*)\\end\{\1\*?\}$"
    said = token
    for a, b in _LIGATURES:
        said = F.replace(said, F.lit(a), F.lit(b))
    named = lambda word: [one("control_word", F.lit(word)), one("begin_group", F.lit("{")), one("text", F.regexp_extract(token, verbatim, 1)), one("end_group", F.lit("}"))]
    made = (
        F.when(token.rlike(verbatim), F.array(*named("begin"), one("text", F.regexp_extract(token, verbatim, 2)), *named("end")))
        .when(token.rlike(r"(?s)^\$.+\$$"), F.array(one("math_shift", shift), one("text", inner), one("math_shift", shift)))
        .when(token.rlike(r"^\$"), F.array(one("math_shift", token)))
        .when(token.rlike(r"^\\[A-Za-z@]"), F.array(one("control_word", F.regexp_replace(token, r"^\\|[ \t]+$", ""))))
        .when(token.rlike(r"(?s)^\\."), F.array(one("control_symbol", F.substring(token, 2, 1))))
        .when(token == "{", F.array(one("begin_group", token))).when(token == "}", F.array(one("end_group", token)))
        .when(token.rlike(r"^[ \t]*\n[ \t]*\n"), F.array(one("par_break", F.lit(""))))
        .otherwise(F.array(one("text", said)))
    )
    rows = raw.select(by, "at", F.posexplode(made).alias("sub", "x"))
    order = Window.partitionBy(by).orderBy("at", "sub")
    return rows.select(by, (F.row_number().over(order) - 1).cast("int").alias("n"), "x.kind", "x.text")


