"""The compact line format: one JSON object a line for each block, in built-in functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import BLOCK_COLUMNS, ENCODINGS

# The codes of the format.
VERSION = "4.2.0"
TYPE_CODES = {
    "block": {
        "document": "O", "heading": "H", "paragraph": "P", "plain": "N", "code": "C", "blockquote": "Q", "list": "L", "list_item": "I", "deflist": "E", "lineblock": "B", "table": "T", "hr": "R",
        "page_break": "K", "metadata": "M", "image": "G", "raw": "W", "div": "D", "section": "S", "figure": "F", "caption": "A", "generic": "X",
    },
    "inline": {
        "text": "t", "space": "s", "softbreak": "j", "linebreak": "r", "code": "c", "math": "m", "raw": "w", "bold": "b", "italic": "i", "strikethrough": "k", "superscript": "u", "subscript": "d",
        "smallcaps": "z", "underline": "l", "link": "a", "image": "g", "quoted": "q", "span": "p", "cite": "e", "note": "f", "generic": "x",
    },
    "value": {"string": "$", "bool": "?", "list": "[", "map": "{", "inlines": "~", "blocks": "#", "version": "@", "generic": "*"},
}
ATTRIBUTE_CODES = {
    "class": "c", "id": "i", "source_type": "s", "heading_level": "h", "list_type": "t", "ordered": "o", "key": "k", "role": "r", "href": "w", "format": "f", "src": "u", "language": "g",
    "number_delim": "d", "number_style": "y", "start": "n", "template_name": "m", "alt": "a", "link_type": "l", "pandoc_ast": "p", "execution_count": "x", "title": "e",
}
HEADER = f'{{"@":"{VERSION}"}}'
_LINE = "`@` string, t string, c string, l int, e string, a map<string,string>, m map<string,string>"


def _table(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


_CODES = {f"{kind}:{name}": code for kind, names in TYPE_CODES.items() for name, code in names.items()}


def _renamed(attributes: Column, table: Column) -> Column:
    """The entries whose keys the table has, under their other names; null if there are none."""
    some = F.transform_keys(F.map_filter(attributes, lambda k, v: F.map_contains_key(table, k)), lambda k, v: F.element_at(table, k))
    return F.when(F.size(some) > 0, some)


def write_compact(blocks: DataFrame, by: str = "doc") -> DataFrame:
    """(doc, n, line): the lines of each document, the header first.

    Rows go by element_order, nulls last. A null level, encoding or attribute map is an error, as is the
    encoding `j`, which stands for json.
    """
    name = F.concat_ws(":", "kind", "element_type")
    known = _table(ATTRIBUTE_CODES)
    rest = F.map_filter("attributes", lambda k, v: ~F.map_contains_key(known, k))
    bad = F.when(F.col("level").isNull(), "level").when(F.col("encoding").isNull(), "encoding").when(F.col("attributes").isNull(), "attributes").when(F.col("encoding") == "j", "encoding j")
    record = F.struct(
        F.coalesce(F.try_element_at(_table(_CODES), name), name).alias("t"), F.col("content").alias("c"), F.col("level").alias("l"),
        F.when(F.col("encoding") == "json", "j").when(F.col("encoding") != "text", F.col("encoding")).alias("e"), _renamed(F.col("attributes"), known).alias("a"), F.when(F.size(rest) > 0, rest).alias("m"),
    )
    line = F.when(bad.isNotNull(), F.raise_error(F.concat(F.lit("compact lines: a block without a usable "), bad))).otherwise(F.to_json(record))
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.col("element_order").asc_nulls_last()))
    heads = blocks.select(by).distinct().select(by, F.lit(0).alias("n"), F.lit(HEADER).alias("line"))
    return heads.unionByName(blocks.select(by, place.alias("n"), line.alias("line")))


def read_compact(lines: DataFrame, by: str = "doc", line: str = "line", n: str = "n") -> DataFrame:
    """The block table of lines (doc, n, line); headers and blank lines are skipped, so files concatenate.

    A line that is no object or lacks a level, and a type or attribute code that isn't known, are errors.
    """
    parsed = lines.select(by, n, F.col(line).alias("_line"), F.from_json(line, _LINE).alias("x")).where(F.trim("_line") != "")
    parsed = parsed.where(~F.coalesce(F.col("x.@").isNotNull() & F.col("x.t").isNull(), F.lit(False)))
    types, attributes = _table({code: name for name, code in _CODES.items()}), _table({code: name for name, code in ATTRIBUTE_CODES.items()})
    full = F.coalesce(F.try_element_at(types, F.col("x.t")), F.when(F.contains("x.t", F.lit(":")), F.col("x.t")))
    codes = F.coalesce("x.a", F.create_map().cast("map<string,string>"))
    unknown = F.size(F.map_filter(codes, lambda k, v: ~F.map_contains_key(attributes, k))) > 0
    bad = F.when(F.col("x.t").isNull(), "no type").when(F.col("x.l").isNull(), "no level").when(full.isNull(), "an unknown type").when(unknown, "an unknown attribute code")
    named = F.transform_keys(F.map_filter(codes, lambda k, v: F.map_contains_key(attributes, k)), lambda k, v: F.element_at(attributes, k))
    known = F.split(F.when(bad.isNotNull(), F.raise_error(F.concat(F.lit("compact lines: "), bad, F.lit(" in "), F.substring("_line", 1, 80)))).otherwise(full), ":", 2)
    return parsed.select(
        by,
        known[0].alias("kind"),
        known[1].alias("element_type"),
        F.col("x.c").alias("content"),
        F.col("x.l").alias("level"),
        F.when(F.col("x.e") == "j", "json").otherwise(F.coalesce("x.e", F.lit("text"))).alias("encoding"),
        F.map_concat(named, F.coalesce("x.m", F.create_map().cast("map<string,string>"))).alias("attributes"),
        (F.row_number().over(Window.partitionBy(by).orderBy(n)) - 1).cast("int").alias("element_order"),
    ).select(by, *BLOCK_COLUMNS)


def write_compact_files(blocks: DataFrame, path: str, by: str = "doc") -> None:
    """Writes each document's lines in order to a file in a folder of its own, `<by>=<document>`, by the task that has them."""
    lines = write_compact(blocks, by)
    lines.repartition(by).sortWithinPartitions(by, "n").select(by, "line").write.partitionBy(by).text(path)


def _in_order(lines: DataFrame) -> DataFrame:
    """(doc, n, line) of lines as a scan gives them: by where their part of the file starts, then by their place in the task."""
    return lines.select("doc", F.struct("start", F.monotonically_increasing_id().alias("at")).alias("n"), "line")


def _scanned(files: DataFrame) -> DataFrame:
    return files.select(F.col("_metadata.file_path").alias("doc"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("line"))


def read_compact_files(spark: SparkSession, path: str) -> DataFrame:
    """The block table of compact files, each a document named by its path.

    Files are read by line and in parts, so that the largest one is spread over tasks; what order lines have in
    their file follows from where their part starts.
    """
    return read_compact(_in_order(_scanned(spark.read.option("recursiveFileLookup", "true").text(path, lineSep="\n"))))


def stream_compact_lines(spark: SparkSession, path: str) -> DataFrame:
    """(doc, start, line) of compact files as they appear in a folder; a file's lines are all in one micro-batch."""
    return _scanned(spark.readStream.option("lineSep", "\n").format("text").load(path))


def write_compact_stream(lines: DataFrame, path: str, checkpoint: str):
    """A running query that appends the blocks of `stream_compact_lines` to a Parquet table, repeated batches in their own place."""

    def one(batch: DataFrame, number: int) -> None:
        read_compact(_in_order(batch)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return lines.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


assert "j" not in ENCODINGS
