"""Web pages as typed blocks: sections, headings, lists, quotes, code, tables, marks.

A page is cut into tags and text within its row; running counts over its tokens say what a text stands in, and the texts
between two block tags are the pieces of one record. What a token is goes to Python as a number, and the places of a
record's tokens come back; texts stay in Spark. `prose.read_pages` is the plainer reader that has text and sections only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tokens as tk
from .assemble import PIECES, attributes, laid_out, plain_piece
from .prose import _TOKEN

# Entities by name.
_ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "mdash": "—", "ndash": "–", "hellip": "…", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "copy": "©", "reg": "®", "trade": "™", "middot": "·", "bull": "•", "laquo": "«", "raquo": "»", "euro": "€", "times": "×", "eacute": "é", "uuml": "ü", "ouml": "ö", "auml": "ä", "szlig": "ß"}


def unescaped(text: Column) -> Column:
    """A text with numeric and the usual named entities undone; others stay. A number that is no character is U+FFFD."""
    def sign(digits: Column, base: int) -> Column:
        digits = F.ltrim(digits, F.lit("0"))
        code = F.when(F.length(digits) <= 7, F.conv(F.concat(F.lit("0"), digits), base, 10).cast("bigint")).otherwise(1 << 30)
        known = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        return F.when(known, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise("\ufffd")

    part = lambda p: (
        F.when(p.rlike(r"^&#[xX][0-9a-fA-F]+;$"), sign(F.regexp_extract(p, r"^&#[xX]([0-9a-fA-F]+);$", 1), 16))
        .when(p.rlike(r"^&#[0-9]+;$"), sign(F.regexp_extract(p, r"^&#([0-9]+);$", 1), 10))
        .otherwise(p)
    )
    numeric = F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"(?s)(&#[xX]?[0-9a-fA-F]+;|[^&]+|&)"), F.lit(1)), part), "")
    named = reduce(lambda x, e: F.replace(x, F.lit(f"&{e[0]};"), F.lit(e[1])), _ENTITIES.items(), F.when(F.contains(text, F.lit("&#")), numeric).otherwise(text))
    return F.when(F.contains(text, F.lit("&")), F.replace(named, F.lit("&amp;"), F.lit("&"))).otherwise(text)


def _attribute(token: Column, name: str) -> Column:
    """The value of an attribute of a tag, quoted or not."""
    found = F.regexp_extract(token, rf"(?is)[\s\"']{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", 1)
    single = F.regexp_extract(token, rf"(?is)[\s\"']{name}\s*=\s*'([^']*)'", 1)
    bare = F.regexp_extract(token, rf"(?is)[\s\"']{name}\s*=\s*([^\s\"'>]+)", 1)
    return F.when(F.contains(token, F.lit("=")), unescaped(F.coalesce(F.nullif(found, F.lit("")), F.nullif(single, F.lit("")), F.nullif(bare, F.lit("")))))


def _tag(token: Column) -> Column:
    return F.lower(F.regexp_extract(token, r"^</?([A-Za-z][A-Za-z0-9]*)", 1))


def _blanks_as_one(text: Column) -> Column:
    return F.when(text.rlike(r"[^\S ]|  "), F.regexp_replace(text, r"\s+", " ")).otherwise(text)


def _code(token: Column) -> Column:
    """The number of a token, as `functions.tokens` reads it."""
    escapes = F.contains(token, F.lit("&"))
    blank = F.when(escapes, F.trim(unescaped(_blanks_as_one(token))) == "").otherwise(~token.rlike(r"\S"))
    spaces = F.trim(F.when(escapes, unescaped(token)).otherwise(token)) == ""
    text = F.when(blank, F.when(spaces, tk.BLANK + tk.SPACES).otherwise(tk.BLANK)).otherwise(0)
    name = F.array_position(F.array(*map(F.lit, tk.NAMES)), _tag(token)).cast("int")
    targeted = F.contains(token, F.lit("=")) & token.rlike(r"^</?[aA](?![A-Za-z0-9])") & _attribute(token, "href").isNotNull()
    bit = lambda condition, value: F.when(condition, value).otherwise(0)
    is_tag = token.startswith("<") & (token != "<")
    return F.when(is_tag, tk.FIRST_TAG + 8 * name + bit(token.startswith("</"), tk.CLOSES) + bit(token.endswith("/>"), tk.ALONE) + bit(targeted, tk.HAS_TARGET)).otherwise(text)


def _token(at: Column) -> Column:
    return F.get("_tokens", at)


def _pieces(found: Column) -> Column:
    """The pieces of a record, blanks at both of its ends, which aren't text, taken off."""
    empty = F.create_map().cast("map<string,string>")
    piece = lambda kind, content, own: F.struct(kind.alias("type"), content.alias("content"), own.alias("attributes"), F.lit(0).alias("depth"))
    cut = lambda x, side: x["p"]["does"].bitwiseAND(F.lit(side)) > 0
    token = F.transform(found, lambda p: F.struct(p.alias("p"), _token(p["at"]).alias("token")))
    said = F.transform(token, lambda x: F.struct(x["p"].alias("p"), x["token"].alias("token"), F.when(x["p"]["how"] == tk.BREAK, " ").when(x["p"]["how"] == tk.IMAGE, _attribute(x["token"], "alt")).when(cut(x, tk.RAW), x["token"]).otherwise(_blanks_as_one(x["token"])).alias("said")))
    said = F.transform(said, lambda x: F.struct(x["p"].alias("p"), x["token"].alias("token"), F.when(x["p"]["how"] == tk.IMAGE, x["said"]).otherwise(unescaped(x["said"])).alias("said")))
    left = lambda x: F.when(cut(x, tk.LEFT), F.ltrim(x["said"])).otherwise(x["said"])
    kinds = F.array(F.lit("text"), *[F.lit(k) for k, _ in tk.MARKS], F.lit("image"), F.lit("text"))
    link = 1 + [k for k, _ in tk.MARKS].index("link")

    def made(x: Column) -> Column:
        how = x["p"]["how"]
        own = F.when(how == tk.IMAGE, attributes(src=_attribute(x["token"], "src"), alt=x["said"])).when(how == link, attributes(href=_attribute(_token(x["p"]["target"]), "href"))).otherwise(empty)
        return piece(F.get(kinds, how), F.when(cut(x, tk.RIGHT), F.rtrim(left(x))).otherwise(left(x)), own)

    return F.transform(said, made).cast(PIECES)


def _cell(texts: Column) -> Column:
    """The text of a cell, from its tokens."""
    token = F.transform(texts, lambda x: F.struct((x % 2 == 1).alias("raw"), _token((x / 2).cast("int")).alias("token")))
    said = F.transform(F.transform(token, lambda x: F.when(x["raw"], x["token"]).otherwise(_blanks_as_one(x["token"]))), unescaped)
    return F.trim(F.regexp_replace(F.array_join(said, ""), r"\s+", " "))


def read_html(pages: DataFrame, by: str = "doc", html: str = "html") -> DataFrame:
    """The block table of web pages.

    Named sections are containers; text in none of the other block tags is a paragraph. Marks don't nest: code goes
    before links, these before bold, and so on. Comments, scripts and styles go; the title is metadata. A null or empty
    page has no blocks.
    """
    cut = pages.select(by, F.regexp_extract_all(F.col(html), F.lit(_TOKEN), F.lit(1)).alias("_tokens"))
    found = cut.withColumn("_found", tk.records_of(F.transform("_tokens", _code)))
    named = lambda names, k: F.get(F.array(*[F.lit(x).cast("string") for x in names]), k)
    nothing = F.lit(None).cast("string")

    def record(r: Column) -> Column:
        what, own = r["what"], _token(r["n"])
        is_item, is_section = what == tk.ITEM, what == tk.SECTION
        ident = F.when(what == tk.META, "title").when(is_item, r["list"].cast("string")).when(~what.isin(tk.TABLE, tk.RULE), _attribute(_token(r["ident"]), "id"))
        more = F.when(is_section, attributes(role=_tag(own), **{"class": _attribute(own, "class")})).when(is_item & (r["role"] > 0), F.create_map(F.lit("role"), named(["term", "definition"], r["role"] - 1)))
        return F.struct(
            r["n"].cast("long").alias("n"), F.lit(0).alias("sub"), named(["meta", "heading", "code", "item", "paragraph", "quote", "table", "section", "hr"], what).alias("what"), r["base"].alias("base"), r["depth"].alias("depth"),
            F.when(is_item, named(["bullet", "ordered", "definition"], r["kind"])).alias("kind"), r["rank"].alias("rank"), F.lit(None).cast("int").alias("start"), ident.alias("ident"), more.alias("more"), r["opens"].alias("_opens"), _pieces(r["pieces"]).alias("pieces"),
            F.transform(r["rows"], lambda x: F.struct(x["head"].alias("head"), F.transform(x["cells"], _cell).alias("cells"))).alias("_rows"),
        )

    records = found.select(by, F.explode(F.transform("_found", record)).alias("_r")).select(by, "_r.*")
    text = F.array_join(F.transform("pieces", lambda p: p["content"]), "")
    headed = F.coalesce(F.get("_rows", F.lit(0))["head"], F.lit(False))
    rows = F.transform("_rows", lambda r: r["cells"])
    table = F.to_json(F.struct(F.when(headed, F.get(rows, F.lit(0))).otherwise(F.array().cast("array<string>")).alias("headers"), F.when(headed, F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(1)))).otherwise(rows).alias("rows")))
    what = F.col("what")
    pieces = F.when(what == "code", plain_piece(F.regexp_replace(text, r"^\n+|\s+$", ""))).when(what == "table", plain_piece(table)).when(what.isin("section", "hr"), plain_piece(nothing)).otherwise(F.col("pieces"))
    return laid_out(records.withColumn("pieces", pieces).drop("_rows"), by, meta_kind="string")
