"""Marked text: which marks pair, what they hold, and the pieces that come of it, at any depth.

Texts are cut into tokens by one expression without repeated groups, so that no text is too long or too odd for it.
What stands before and after a token says whether it may open or close a mark, and a stack along a text's tokens pairs
them; only numbers go to Python for it. A text's tokens stay in its row: nothing is sorted or shuffled for them. Marks
left alone are text.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stacks import CLOSER, ONCE, OPENER, WHOLE, mark_runs
from .assemble import PIECES, attributes, plain_piece

#: Signs, as expressions for one, that must not stand before and after an opening, before and after a closing.
Flank = tuple[str, str, str, str]
FREE: Flank = ("", "", "", "")
TIGHT: Flank = ("", r"\s", r"\s", "")
WORD: Flank = (r"\w", r"\s", r"\s", r"\w")


@dataclass(frozen=True)
class Inline:
    """Marked text: either a whole, `pattern`, whose group `text` is what is marked, or what an opening and a closing hold.

    `target` is the group with the attribute called `key`, of the pattern, the opening or, if `behind`, the closing.
    Without a closing the opening's expression is both. Marks of one `family` close each other. The signs of the type
    `group` stay in the text; they only tell which closing belongs to what.
    """

    type: str
    pattern: str = ""
    text: int = 1
    target: int = 0
    key: str = "href"
    more: tuple[tuple[str, str], ...] = ()
    opening: str = ""
    closing: str = ""
    behind: bool = False
    family: str = ""
    nests: int = ONCE
    flank: Flank = FREE


def mark(type: str, sign: str, flank: Flank = TIGHT) -> Inline:
    """Text between two equal signs."""
    return Inline(type, opening=sign, flank=flank)


@dataclass(frozen=True)
class Marks:
    """The marks of a format.

    `plain`: an expression for a stretch that begins no mark. `escapes`: one for signs that aren't marks. `twins`: a sign
    and the longer and the shorter mark that consist of it, such as *, ** and *: where they meet, the shorter one is cut
    off first behind a text, and each closes what was opened last.
    """

    inlines: tuple[Inline, ...] = ()
    plain: str = "."
    escapes: str = ""
    twins: tuple[str, int, int] | None = None


def _token_pattern(marks: Marks) -> str:
    """One token: an escape, a whole, a closing or opening, a stretch that begins nothing, or any sign."""
    wholes = [x.pattern for x in marks.inlines if x.pattern]
    signs = list(dict.fromkeys(y for x in marks.inlines if x.opening for y in (x.closing, x.opening) if y))
    cut = []
    if marks.twins:
        sign, long, short = marks.twins
        cut = [rf"(?<=[^\s{sign}])(?:{re.escape(sign)}){{{short}}}(?=(?:{re.escape(sign)}){{{long}}}(?!{re.escape(sign)}))"]
    parts = ([marks.escapes] if marks.escapes else []) + wholes + cut + signs + [marks.plain, "."]
    return "(?s)(" + "|".join(f"(?:{p})" for p in parts) + ")"


def _allowed(sign: Column, never: str) -> Column:
    return ~sign.rlike(f"^{never}$") if never else F.lit(True)


def with_pieces(rows: DataFrame, marks: Marks, shown: Callable[[Column], Column], text: str = "_text", marked: str = "_marked") -> DataFrame:
    """`rows` with `pieces`: those of `text` where `marked` holds, else the text as it is.

    `shown` undoes the escapes of a text. Where marks cross, the one opened first counts.
    """
    inlines = marks.inlines
    read, source = F.col(marked), F.col(text)
    plain = plain_piece(F.when(read, shown(source)).otherwise(source))
    if not inlines:
        return rows.withColumn("pieces", plain).drop(text, marked)
    # most texts have no sign that begins a mark; these aren't cut
    any_mark = source.isNotNull() & ~source.rlike(f"(?s)^(?:{marks.plain})$")
    tokens = F.when(read & any_mark, F.regexp_extract_all(source, F.lit(_token_pattern(marks)), F.lit(1)))
    families = list(dict.fromkeys(x.family or x.opening for x in inlines if x.opening))
    own = lambda x: families.index(x.family or x.opening)
    null = F.lit(None).cast("int")
    sign, twins = "", ()
    if marks.twins:
        sign, long, short = marks.twins
        twins = tuple(families.index(re.escape(sign) * n) for n in (long, short))

    def role(x: Column) -> Column:
        """What a token may be; null for a run of signs that begin nothing, which most tokens are."""
        token, before, after = x["token"], x["before"], x["after"]
        is_token = lambda p: token.rlike(f"(?s)^(?:{p})$")
        what = opens = closes = nests = null  # the whole or opening that a token is
        for k, i in reversed(list(enumerate(inlines))):
            if i.pattern:
                what = F.when(is_token(i.pattern), F.lit(k)).otherwise(what)
                continue
            may_open = is_token(i.opening) & (after != "") & _allowed(before, i.flank[0]) & _allowed(after, i.flank[1])
            may_close = is_token(i.closing or i.opening) & (before != "") & _allowed(before, i.flank[2]) & _allowed(after, i.flank[3])
            what, opens, nests = F.when(may_open, F.lit(k)).otherwise(what), F.when(may_open, F.lit(own(i))).otherwise(opens), F.when(may_open, F.lit(i.nests)).otherwise(nests)
            closes = F.when(may_close, F.lit(own(i))).otherwise(closes)
        beside = (before == sign) | (after == sign) if twins else F.lit(False)
        dull = is_token(marks.plain) | (is_token(marks.escapes) if marks.escapes else F.lit(False))
        return F.when(~dull, F.struct(what.alias("what"), opens.alias("opens"), closes.alias("closes"), beside.alias("beside"), F.coalesce(nests, F.lit(ONCE)).alias("nests")))

    def paired(x: Column) -> Column:
        twin = F.when(x["beside"], F.when(x["closes"] == twins[0], F.lit(twins[1])).when(x["closes"] == twins[1], F.lit(twins[0]))) if twins else null
        return F.when(x.isNotNull(), F.struct(x["what"].alias("what"), x["opens"].alias("opens"), x["closes"].alias("closes"), twin.alias("twin"), x["nests"].alias("nests")))

    end = lambda k, cut: F.coalesce(cut(F.get("_tokens", k), F.lit(1)), F.lit(""))
    beside = F.transform("_tokens", lambda x, k: F.struct(x.alias("token"), end(k - 1, F.right).alias("before"), end(k + 1, F.left).alias("after")))
    runs_of = mark_runs(tuple(k for k, x in enumerate(inlines) if x.pattern), tuple(k for k, x in enumerate(inlines) if x.type == "group"))
    rows = rows.withColumn("_tokens", tokens).withColumn("_runs", runs_of(F.transform(F.transform(beside, role), paired)))
    joined = lambda start, size: F.array_join(F.slice("_tokens", start, size), "")
    none = F.create_map().cast("map<string,string>")

    def made(kind: str, content: Column, own_attributes: Column, depth: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), content.cast("string").alias("content"), own_attributes.alias("attributes"), depth.alias("depth"))

    def piece(r: Column) -> Column:
        said, depth = r["said"], r["run"]["depth"]
        out = made("text", shown(said), none, depth)
        for k, x in reversed(list(enumerate(inlines))):
            group = lambda g, x=x: F.regexp_extract(r["closing"] if x.behind else said, f"(?s)^(?:{x.pattern or (x.closing if x.behind else x.opening)})$", g)
            held = {a: F.lit(v) for a, v in x.more} | ({x.key: F.nullif(group(x.target), F.lit(""))} if x.target else {})
            held = attributes(**held) if held else none
            # what a mark holds is its own content if that is one text
            body = group(x.text) if x.pattern else r["inside"]
            found = made(x.type, body if x.pattern and x.type in ("code", "math", "raw") else shown(body), held, depth)
            out = F.when(r["run"]["role"].isin(OPENER, WHOLE) & (r["run"]["what"] == k), found).otherwise(out)
        return out

    left = F.filter("_runs", lambda r: (r["role"] != CLOSER) & ~r["taken"])
    told = F.transform(left, lambda r: F.struct(
        r.alias("run"), joined(r["start"], r["size"]).alias("said"), F.when(r["closing"] > 0, F.get("_tokens", r["closing"] - 1)).alias("closing"), F.when(r["inside"] > 0, joined(r["start"] + 1, r["inside"])).alias("inside"),
    ))
    pieces = F.when(F.size("_tokens") > 0, F.transform(told, piece).cast(PIECES)).otherwise(plain)
    return rows.withColumn("pieces", pieces).drop("_tokens", "_runs", text, marked)
