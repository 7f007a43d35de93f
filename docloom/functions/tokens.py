"""What the tokens of a page stand in, and the records that they make up.

A page's tokens stay in its row, so that nothing is sorted or shuffled for them. Only numbers go to Python: one for each
token, and back the places of the tokens that a record is made of. Running counts along them are sums of whole columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Numbers of texts: of blanks alone, once blanks are one, and already as they are. Tags follow from FIRST_TAG on, each
#: with its place among NAMES from 1 on (0: another) in front of three bits.
BLANK, SPACES, FIRST_TAG = 1, 2, 4
CLOSES, ALONE, HAS_TARGET = 1, 2, 4

# Tags by what they do.
SECTIONS = ("main", "article", "header", "nav", "aside", "footer", "section")
MARKS = (("code", "code|kbd|samp|tt"), ("link", "a"), ("bold", "b|strong"), ("italic", "em|i|cite|var"), ("strikethrough", "s|del|strike"), ("underline", "u|ins"), ("superscript", "sup"), ("subscript", "sub"))
LISTS = ("ul", "ol", "dl")
_BLOCKS = tuple("p td tr li h1 h2 h3 h4 h5 h6 th ul ol pre blockquote table div address dl dt dd thead tbody tfoot caption hr br figure figcaption form fieldset title head body html".split()) + SECTIONS
NAMES = (*_BLOCKS, *(t for _, tags in MARKS for t in tags.split("|")), "img")

#: What a record is, and what its pieces are: a text, one with the k-th of the MARKS (as k + 1), an image, a break.
META, HEADING, CODE, ITEM, PARAGRAPH, QUOTE, TABLE, SECTION, RULE = range(9)
IMAGE, BREAK = len(MARKS) + 1, len(MARKS) + 2
#: What is done to a piece's text: its blanks in front or behind go; it is preformatted.
LEFT, RIGHT, RAW = 1, 2, 4
_ROLES = {"dt": 1, "dd": 2}
_PIECE = ("at", "how", "target", "does")
_NUMBERS = ("n", "what", "base", "depth", "list", "kind", "role", "rank", "ident")
_struct = lambda **fields: T.StructType([T.StructField(k, v) for k, v in fields.items()])
_ROWS = T.ArrayType(_struct(head=T.BooleanType(), cells=T.ArrayType(T.ArrayType(T.IntegerType()))))
#: Places of tokens are -1 where there is none; cells have their texts as 2 * place + whether it is preformatted.
_RECORDS = T.ArrayType(_struct(**dict.fromkeys(_NUMBERS, T.IntegerType()), opens=T.BooleanType(), pieces=T.ArrayType(_struct(**dict.fromkeys(_PIECE, T.IntegerType()))), rows=_ROWS))
#: So many tokens are looked at at once, or one page.
_MOST = 1 << 18


def _of(*names: str) -> np.ndarray:
    """Whether each of the NAMES, by its place, is one of these."""
    return np.array([False, *(x in names for x in NAMES)])


_COUNTED = [tags.split("|") for _, tags in MARKS] + [["pre"], LISTS, ["blockquote"], ["table"], SECTIONS, ["head"]]
_RANKS = np.array([0, *(int(x[1]) if x[0] == "h" and x[1:] in "123456" else 0 for x in NAMES)])
_ROLE, _KIND = (np.array([0, *(y.get(x, 0) for x in NAMES)]) for y in (_ROLES, {x: k for k, x in enumerate(LISTS)}))
_BLOCK, _BR, _IMG, _HR, _TITLE, _CELL, _TH, _LI, _LIST, _PART = _of(*_BLOCKS), _of("br"), _of("img"), _of("hr"), _of("title"), _of("td", "th"), _of("th"), _of("li", "dt", "dd"), _of(*LISTS), _of(*SECTIONS)


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(new)


def _innermost(moves: np.ndarray, step: np.ndarray, page: np.ndarray, n: int) -> np.ndarray:
    """For each token the last opening one that is still open, or -1; `moves` are those that open or close."""
    found, stack, before, last = np.full(n, -1), [], 0, -1
    for k, up, own in zip(moves.tolist(), step[moves].tolist(), page[moves].tolist(), strict=True):
        found[before:k] = stack[-1] if stack else -1
        if own != last:
            stack, last = [], own
        if up > 0:
            stack.append(k)
        elif stack:
            stack.pop()
        before = k
    found[before:] = stack[-1] if stack else -1
    return np.where((found >= 0) & (page[found] == page), found, -1)


def _opening(page: np.ndarray, what: np.ndarray, base: np.ndarray, depth: np.ndarray, own_list: np.ndarray) -> np.ndarray:
    """Whether an item opens a list: the last record that isn't within an item is none of the same list."""
    opens = np.zeros(len(page), bool)
    last, stack = -1, []
    for k, (own, item, b, d, which) in enumerate(zip(page.tolist(), (what == ITEM).tolist(), base.tolist(), depth.tolist(), own_list.tolist(), strict=True)):
        if own != last:
            last, stack = own, []
        rank, value = (b + 2 * d, (d, b, which)) if item else (b + 1, None)
        while stack and stack[-1][0] > rank:
            stack.pop()
        opens[k] = item and not (stack and stack[-1][1] == value)
        if stack and stack[-1][0] == rank:
            stack.pop()
        stack.append((rank, value))
    return opens


def _lists(sizes: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)


def _ints(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.int32))


def _records(codes: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """The records of pages, whose tokens stand one after the other."""
    n = len(codes)
    first = np.cumsum(lengths) - lengths
    page = np.repeat(np.arange(len(lengths)), lengths)
    start = first[page] if n else np.zeros(0, np.int64)
    is_text = codes < FIRST_TAG
    bits = np.where(is_text, 0, codes - FIRST_TAG)
    name, closes, alone, targeted = bits >> 3, (bits & CLOSES) > 0, (bits & ALONE) > 0, (bits & HAS_TARGET) > 0
    at = np.arange(n)

    def running(step: np.ndarray) -> np.ndarray:
        total = np.cumsum(step, dtype=np.int64)
        return total - np.concatenate([[0], total])[start]

    def last(flag: np.ndarray) -> np.ndarray:
        found = np.maximum.accumulate(np.where(flag, at, -1)) if n else at
        return np.where(found >= start, found, -1)

    step = np.where(alone, 0, np.where(closes, -1, 1))
    inside = [np.maximum(running(np.where(_of(*x)[name], step, 0)), 0) for x in _COUNTED]
    marked, (in_pre, in_list, in_quote, in_table, in_part, in_head) = inside[: len(MARKS)], inside[len(MARKS) :]
    no_li = running(_LI[name] & ~closes)
    splits = _BLOCK[name] & ~_BR[name]
    block, lately = running(splits), last(splits)
    within = np.where((lately >= 0) & ~closes[lately], name[lately], 0) if n else name
    ident, item, target = last(_BLOCK[name] & ~closes), last(_LI[name] & ~closes), last(_of("a")[name] & targeted)
    which = _innermost(np.flatnonzero(_LIST[name] & ~alone), step, page, n) if n else at

    # texts between two block tags
    image, breaks = _IMG[name] & ~closes, _BR[name]
    t = np.flatnonzero((is_text | image | breaks) & (in_table == 0) & ((in_head == 0) | _TITLE[within]))
    g = _starts(page[t], block[t])
    size = np.diff(np.append(g, len(t)))
    group = np.repeat(np.arange(len(g)), size)
    f = t[g]  # the first one of each
    raw = in_pre[t] > 0
    how = np.zeros(len(t), np.int64)
    for k in reversed(range(len(MARKS))):
        how[marked[k][t] > 0] = k + 1
    how[raw] = 0
    how[breaks[t]] = BREAK
    how[image[t]] = IMAGE
    says = (how == IMAGE) | (is_text[t] & ((codes[t] & np.where(raw, SPACES, BLANK)) == 0))
    heads, ends = np.zeros(len(t), bool), np.zeros(len(t), bool)
    heads[g], ends[g + size - 1] = True, True
    kept_raw = (in_pre[f] > 0)[group]
    left = (np.add.reduceat(says, g, dtype=np.int64) > 0) if len(g) else np.zeros(0, bool)  # groups of blanks alone are none
    keeps = left[group] & (kept_raw | says | ~(heads | ends))
    does = np.where(heads & ~kept_raw, LEFT, 0) + np.where(ends & ~kept_raw & (how != IMAGE), RIGHT, 0) + np.where(raw, RAW, 0)
    places = np.where(target[t] >= 0, target[t] - start[t], -1)
    pieces = pa.StructArray.from_arrays([_ints(x[keeps]) for x in (t - start[t], how, places, does)], list(_PIECE))
    n_pieces = np.bincount(group[keeps], minlength=len(g))[left]
    f = f[left]
    leads = np.zeros(len(f), bool)
    leads[_starts(page[f], no_li[f])] = True
    listed, rank = (in_list[f] > 0) & (no_li[f] > 0), _RANKS[within[f]]
    what = np.select([_TITLE[within[f]], rank > 0, in_pre[f] > 0, listed & leads, listed, in_quote[f] > 0], [META, HEADING, CODE, ITEM, PARAGRAPH, QUOTE], PARAGRAPH)
    base = in_part[f] + np.where(listed & ~leads & (rank == 0) & (what != CODE), 2 * in_list[f], 0)
    role = np.where(item[f] >= 0, _ROLE[name[item[f]]], 0)
    texts = [f, what, base, np.maximum(in_list[f], 1), which[f], role, np.where(what == HEADING, rank, 1), ident[f], n_pieces, np.zeros(len(f), np.int64)]

    # tables: texts to cells, cells to rows, rows to one record
    opens_cell = _CELL[name] & ~closes
    no_table, no_row, no_cell = running(_of("table")[name] & ~closes), running(_of("tr")[name] & ~closes), running(opens_cell)
    head = last(_CELL[name])
    in_th = np.where(head >= 0, _TH[name[head]] & ~closes[head], False) if n else is_text
    c = np.flatnonzero((is_text | opens_cell) & (in_table > 0) & (no_cell > 0))
    g = _starts(page[c], no_table[c], no_row[c], no_cell[c])
    group = np.repeat(np.arange(len(g)), np.diff(np.append(g, len(c))))
    of = lambda how, x: how.reduceat(x, g) if len(g) else np.zeros(0, np.int64)
    own, th, base = of(np.logical_or, opens_cell[c]), of(np.logical_or, in_th[c]), of(np.minimum, in_part[c])
    own, th = own.astype(bool), th.astype(bool)
    said = own[group] & is_text[c]
    cells = _lists(np.bincount(group[said], minlength=len(g))[own], _ints(2 * (c - start[c])[said] + (in_pre[c][said] > 0)))
    cell, th, base = c[g][own], th[own], base[own]
    g = _starts(page[cell], no_table[cell], no_row[cell])
    line, th, base = cell[g], of(np.logical_and, th).astype(bool), of(np.minimum, base)
    lines = pa.StructArray.from_arrays([pa.array(th), _lists(np.diff(np.append(g, len(cell))), cells)], ["head", "cells"])
    g = _starts(page[line], no_table[line])
    table, base = line[g], of(np.minimum, base)
    fixed = lambda places, what, base, ident, size: [places, *(np.full(len(places), x) if np.isscalar(x) else x for x in (what, base, 1, -1, 0, 1, ident, 0, size))]
    tables = fixed(table, TABLE, base, -1, np.diff(np.append(g, len(line))))
    parts, rules = np.flatnonzero(_PART[name] & ~closes), np.flatnonzero(_HR[name] & ~closes)
    every = [np.concatenate(x).astype(np.int64) for x in zip(texts, tables, fixed(parts, SECTION, np.maximum(in_part[parts] - 1, 0), parts, 0), fixed(rules, RULE, in_part[rules], -1, 0), strict=True)]
    place, what, base, depth, own_list, role, rank, ident, n_pieces, n_rows = (x[np.argsort(every[0])] for x in every)
    own = page[place]
    local = lambda x: np.where(x >= 0, x - first[own], -1)
    kind = np.where(own_list >= 0, _KIND[name[own_list]], 0) if n else own_list
    numbers = (local(place), what, base, depth, local(own_list), kind, role, rank, local(ident))
    fields = {k: _ints(x) for k, x in zip(_NUMBERS, numbers, strict=True)} | {"opens": pa.array(_opening(own, what, base, depth, own_list)), "pieces": _lists(n_pieces, pieces), "rows": _lists(n_rows, lines)}
    return _lists(np.bincount(own, minlength=len(lengths)), pa.StructArray.from_arrays(list(fields.values()), list(fields)))


@F.arrow_udf(_RECORDS)
def records_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """records_of(codes): the records of a page in order, from the numbers of its tokens; none of a null page."""
    for codes in batches:
        lengths = codes.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        numbers = codes.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(lengths)
        made, a = [], 0
        while a < len(lengths):
            before = ends[a] - lengths[a]
            b = max(a + 1, int(np.searchsorted(ends, before + _MOST, "right")))
            made.append(_records(numbers[before : ends[b - 1]], lengths[a:b]))
            a = b
        yield pa.concat_arrays(made or [_records(numbers, lengths)])
