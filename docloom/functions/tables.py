"""Table blocks: cells from CSV, TSV, JSON and JSON lines, and typed relations from cells."""

from __future__ import annotations

import csv
import io
import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import small_batches
from .text import CELL_FORMS

_CONTENT = "headers array<string>, rows array<array<string>>"
#: So many empty cells may be added to make rows equally long, or as many as there are.
MOST_PADDING = 1_000_000
EMBEDDED_FORMATS = ("csv", "tsv", "json", "jsonl")


class _Number(str):
    """A number as it is written."""


def _encode(value):
    if isinstance(value, _Number):
        return str(value)
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_encode(v)}" for k, v in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_encode, value)) + "]"
    return json.dumps(value, ensure_ascii=False)


def _records(objects: list) -> tuple[list[str], list[list[str]]]:
    if not all(isinstance(o, dict) for o in objects):
        raise ValueError("not an array of objects")
    headers = list(dict.fromkeys(k for o in objects for k in o))
    padded, present = len(headers) * len(objects), sum(map(len, objects))
    if padded - present > max(MOST_PADDING, present):
        raise ValueError(f"padding: {padded - present} empty cells beside {present}")
    show = lambda v: "" if v is None else v if isinstance(v, str) else _encode(v)
    return headers, [[show(o.get(h)) for h in headers] for o in objects]


def _delimited(text: str, separator: str) -> tuple[list[str], list[list[str]]]:
    rows = [r for r in csv.reader(io.StringIO(text), delimiter=separator, strict=True) if r]
    if not rows:
        raise ValueError("no rows")
    if any(len(r) != len(rows[0]) for r in rows):
        raise ValueError(f"ragged: a row has other than {len(rows[0])} cells")
    return rows[0], rows[1:]


def parse_embedded(text: str, format: str) -> tuple[str | None, str | None]:
    """(table content, error) of one short embedded text."""
    numbers = {"parse_float": _Number, "parse_int": _Number}
    try:
        if format in ("csv", "tsv"):
            headers, rows = _delimited(text, "," if format == "csv" else "\t")
        elif format == "json":
            headers, rows = _records(json.loads(text, **numbers))
        elif format == "jsonl":
            headers, rows = _records([json.loads(x, **numbers) for x in text.splitlines() if x.strip()])
        else:
            raise ValueError(f"{format} is none of {', '.join(EMBEDDED_FORMATS)}")
    except (ValueError, TypeError, csv.Error) as error:
        return None, str(error)
    return json.dumps({"headers": headers, "rows": rows}, ensure_ascii=False, separators=(",", ":")), None


@F.arrow_udf(T.StructType([T.StructField("content", T.StringType()), T.StructField("error", T.StringType())]))
def embedded_to_table(text: pa.Array, format: pa.Array) -> pa.Array:
    """struct<content, error> of embedded texts; both null for a null text."""
    made = (parse_embedded(t.as_py(), f.as_py()) if t.is_valid else (None, None) for t, f in zip(text, format, strict=True))  # one text at a time
    return pa.array(({"content": content, "error": error} for content, error in made), pa.struct([("content", pa.string()), ("error", pa.string())]))


def parse_embedded_blocks(blocks: DataFrame, formats: tuple[str, ...] = EMBEDDED_FORMATS) -> DataFrame:
    """Code blocks in one of the formats become table blocks, their text kept in `source_text`.

    One that can't be read stays as it is, with the reason in `parse_error`. Applying it twice is
    applying it once.
    """
    language = F.lower(F.try_element_at("attributes", F.lit("language")))
    is_one = F.coalesce((F.col("kind") == "block") & (F.col("element_type") == "code") & language.isin(*formats) & ~F.map_contains_key("attributes", F.lit("parse_error")), F.lit(False))
    rows = small_batches(blocks).withColumn("_one", is_one).withColumn("_made", embedded_to_table(F.when(F.col("_one"), F.coalesce("content", F.lit(""))), language))
    good, bad = F.col("_one") & F.col("_made.content").isNotNull(), F.col("_one") & F.col("_made.content").isNull()
    more = F.when(good, F.create_map(F.lit("source_text"), "content")).when(bad, F.create_map(F.lit("parse_error"), "_made.error")).otherwise(F.create_map().cast("map<string,string>"))
    own = F.map_filter("attributes", lambda k, v: ~k.isin("source_text", "parse_error") | ~F.col("_one"))
    return rows.select(*[
        F.when(good, "table").otherwise(F.col("element_type")).alias(c) if c == "element_type" else F.when(good, F.col("_made.content")).otherwise(F.col("content")).alias(c) if c == "content"
        else F.when(good, "json").otherwise(F.col("encoding")).alias(c) if c == "encoding" else F.map_concat(own, more).alias(c) if c == "attributes" else F.col(c) for c in blocks.columns
    ])


def table_cells(blocks: DataFrame, by: str = "doc") -> DataFrame:
    """(doc, element_order, row, column, name, value): every cell of every table block.

    Columns without a name, or with one that an earlier column has, are `column_<n>`; the widest row
    says how many columns there are.
    """
    tables = blocks.where((F.col("element_type") == "table") & (F.col("encoding") == "json")).select(by, "element_order", F.from_json("content", _CONTENT).alias("t"))
    rows = tables.select(by, "element_order", F.coalesce("t.headers", F.array()).alias("headers"), F.posexplode("t.rows").alias("row", "cells"))
    cells = rows.select(by, "element_order", "row", "headers", F.posexplode("cells").alias("column", "value"))
    name = F.get("headers", F.col("column"))
    earlier = F.exists(F.slice("headers", F.lit(1), F.col("column")), lambda h: F.lower(h) == F.lower(name))
    plain = F.concat(F.lit("column_"), (F.col("column") + 1).cast("string"))
    return cells.select(by, "element_order", "row", "column", F.when(F.coalesce(name, F.lit("")).isin("") | F.coalesce(earlier, F.lit(False)), plain).otherwise(name).alias("name"), "value")


def cell_type(value: Column) -> Column:
    """The narrowest type that all cells of a group have the form of; empty cells have any."""
    full = F.coalesce(value, F.lit("")) != ""
    kind = F.lit("string")
    for name, form in reversed(CELL_FORMS):
        kind = F.when(F.bool_and(F.when(full, value.rlike(form))), name).otherwise(kind)
    return F.when(F.bool_or(full), kind).otherwise("string")


def column_types(blocks: DataFrame, by: str = "doc") -> DataFrame:
    """(doc, element_order, column, name, type) of every column of every table block."""
    return table_cells(blocks, by).groupBy(by, "element_order", "column", "name").agg(cell_type(F.col("value")).alias("type"))


def read_table(blocks: DataFrame, doc, element_order: int, by: str = "doc") -> DataFrame:
    """One table block as a typed relation, a row for each of its rows; an empty cell is null.

    Only the columns' names and types are looked at beforehand; the rows stay distributed. Rows so unequal that most
    cells would be made up are an error.
    """
    one = blocks.where((F.col(by) == F.lit(doc)) & (F.col("element_order") == element_order))
    found = column_types(one, by).orderBy("column").collect()
    if not found:
        raise ValueError(f"no table at {element_order} of {doc}")
    size = table_cells(one, by).agg(F.count("*").alias("present"), (F.max("row") + 1).alias("rows")).first()
    padded = size["rows"] * (found[-1]["column"] + 1) - size["present"]
    if padded > max(MOST_PADDING, size["present"]):
        raise ValueError(f"padding: {padded} empty cells beside {size['present']}")
    wide = table_cells(one, by).groupBy("row").agg(*[F.max(F.when(F.col("column") == r["column"], F.nullif("value", F.lit("")))).cast(r["type"]).alias(r["name"]) for r in found])
    return wide.orderBy("row").drop("row")
