"""Jupyter notebooks: their JSON is parsed by from_json, cells become divs that hold their source and outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import BLOCK_COLUMNS
from .assemble import attributes, row

_NOTEBOOK = (
    "cells array<struct<cell_type:string,source:string,execution_count:string,outputs:array<struct<output_type:string,text:string,data:map<string,string>,ename:string,evalue:string>>>>, "
    "metadata struct<title:string,authors:array<struct<name:string>>,kernelspec:struct<language:string,name:string,display_name:string>,language_info:struct<name:string>>"
)


def _text(source: Column) -> Column:
    """A cell's source, a string or a list of strings."""
    listed = F.from_json(source, "array<string>")
    return F.when(source.rlike(r"^\s*\["), F.coalesce(F.array_join(listed, ""), source)).otherwise(source)


def read_notebooks(docs: DataFrame, by: str = "doc", text: str = "text") -> DataFrame:
    """The block table of notebooks.

    A cell is a div of its cell_type with its source a level below: code, or raw markdown. An output is a div of its
    output_type in the cell's, with its plain text, or an error's message, as code below it; outputs without either
    have the div alone. A text that is no notebook has no blocks. Title, authors and kernel are metadata after the body.
    """
    parsed = docs.select(by, F.from_json(text, _NOTEBOOK).alias("nb"))
    language = F.coalesce("nb.metadata.kernelspec.language", "nb.metadata.language_info.name")
    authors = F.filter(F.transform("nb.metadata.authors", lambda a: a["name"]), lambda a: a.isNotNull())
    field = lambda key, value: F.when(value.isNotNull() & (value != ""), F.array(row("value", "inlines", None, 1, own=attributes(key=F.lit(key))), row("inline", "text", value, 2))).otherwise(F.array())
    fields = F.concat(field("title", F.col("nb.metadata.title")), field("author", F.array_join(authors, " ")), field("kernel", F.coalesce("nb.metadata.kernelspec.display_name", "nb.metadata.kernelspec.name")))
    # the fields go after the last cell as one part more, so that a notebook is parsed once
    part = lambda number, cell, fields: F.struct(F.lit(number).alias("part"), cell.alias("cell"), fields.alias("fields"))
    listed = F.coalesce(F.transform("nb.cells", lambda c: part(0, c, F.lit(None))), F.array())
    parts = F.concat(listed, F.array(part(1, F.lit(None), fields)))
    cells = parsed.select(by, language.alias("language"), F.posexplode(parts).alias("n", "x")).select(by, "language", "n", "x.part", "x.cell", "x.fields")
    source = F.regexp_replace(_text(F.col("cell.source")), r"\n+$", "")
    kind = F.coalesce("cell.cell_type", F.lit("raw"))
    count = F.nullif(F.col("cell.execution_count"), F.lit("null"))
    head = F.array(row("block", "div", None, 1, own=attributes(source_type=kind, execution_count=F.when(kind == "code", count))))
    body = (
        F.when(kind == "code", row("block", "code", F.nullif(source, F.lit("")), 2, own=attributes(language=F.col("language"))))
        .when(kind == "markdown", row("block", "raw", F.nullif(source, F.lit("")), 2, "markdown", attributes(format=F.lit("markdown"))))
        .otherwise(row("block", "raw", F.nullif(source, F.lit("")), 2, own=attributes(format=F.lit("text"))))
    )
    said = lambda o: F.coalesce(_text(o["text"]), _text(F.try_element_at(o["data"], F.lit("text/plain"))), o["evalue"])
    outputs = F.flatten(
        F.transform(
            F.coalesce("cell.outputs", F.array()),
            lambda o: F.concat(
                F.array(row("block", "div", None, 2, own=attributes(source_type=F.coalesce(o["output_type"], F.lit("output"))))),
                F.when(said(o).isNotNull(), F.array(row("block", "code", F.regexp_replace(said(o), r"\n+$", ""), 3))).otherwise(F.array()),
            ),
        )
    )
    made = F.when(F.col("part") == 1, F.col("fields")).otherwise(F.concat(head, F.array(body), F.when(kind == "code", outputs).otherwise(F.array())))
    blocks = cells.select(by, "part", "n", F.posexplode(made).alias("sub", "block"))
    place = Window.partitionBy(by).orderBy("part", "n", "sub")
    return blocks.select(by, "block.*", (F.row_number().over(place) - 1).cast("int").alias("element_order")).select(by, *BLOCK_COLUMNS)
