"""Stacks along rows: which mark closes which, and the nearest earlier row of a lower rank, at any depth.

Windows can't tell these, since how far they look depends on the rows. Each function here gives a column that follows
the rows of a partition in their order and holds no more than what is open, so that it is linear in the rows and as
large as a document is deep. The rows must come in order: `first`, which says where a new stack begins, has to be
made by a window over that order, as `is_first` does, and the column be used right on its result; no window of a finer
partitioning may stand right before that one, since Spark swaps the two and the rows come in the other's order. Only numbers go to
Python; the other columns stay where they are. The functions are declared nondeterministic, since a filter that was
moved before one would take rows from it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec


def is_first(order: WindowSpec) -> Column:
    """Whether a row is the first one of its window."""
    return F.row_number().over(order) == 1


def _numbers(column: pa.Array, missing: int = -1) -> np.ndarray:
    return column.fill_null(missing).to_numpy(zero_copy_only=False)


#: How marks of a family stand in each other, for `closed_by`: not at all, or at any depth.
ONCE, NESTS = 0, 1


@F.arrow_udf(T.LongType())
def closed_by(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """closed_by(first, at, opens, closes, twin, nests): for a mark that closes one, the `at` of that one, else null.

    `opens` and `closes` are numbers of families, null if the row does neither. A row that may close an open mark of
    its family, or of the family `twin` if that was opened later, does, and the marks opened since then close nothing;
    else one that may open does, unless one of its family is open and doesn't nest. A mark holds something: the row
    right after an opening one, whose `at` is one more, doesn't close it. `at` must not be null.
    """
    stack: list[tuple[int, int]] = []
    open_of: dict[int, int] = {}
    for first, at, opens, closes, twin, nests in batches:
        first, opens, closes, twin = (_numbers(x) for x in (first.cast(pa.int8()), opens, closes, twin))
        at, nests = at.to_numpy(), _numbers(nests, 0)
        found = np.full(len(at), -1, np.int64)
        for k in np.flatnonzero((first == 1) | (opens >= 0) | (closes >= 0)).tolist():
            if first[k] == 1:
                stack, open_of = [], {}
            own, second, new = int(closes[k]), int(twin[k]), int(opens[k])
            empty = bool(stack) and stack[-1][0] in (own, second) and stack[-1][1] == at[k] - 1
            if own >= 0 and not empty and (open_of.get(own) or open_of.get(second)):
                while True:
                    family, place = stack.pop()
                    open_of[family] -= 1
                    if family in (own, second):
                        break
                found[k] = place
            elif new >= 0 and (nests[k] or not open_of.get(new)):
                stack.append((new, int(at[k])))
                open_of[new] = open_of.get(new, 0) + 1
        yield pa.array(found, pa.int64(), mask=found < 0)


_RUNS = "array<struct<role:int,what:int,depth:int,start:int,size:int,closing:int,inside:int,taken:boolean>>"
TEXT, OPENER, CLOSER, WHOLE = range(4)


def mark_runs(wholes: tuple[int, ...] = (), groups: tuple[int, ...] = ()):
    """A function of an array<struct<what, opens, closes, twin, nests>>, one for each token of a text: the text's runs.

    What opens and closes is paired as by `closed_by`. A run is an opening or closing mark that has its pair, a token
    with one of the `wholes`, or neighbouring tokens that are neither; marks of the `groups` are text though they pair.
    A run has its `role`, `what` its first token is, how deep it stands, its first token's number from 1 on and
    `size` in tokens; an opening mark that of its `closing` one, and as `inside` the number of tokens that it holds, if
    they are one text, whose run is then `taken`. A text is looked at by itself, so rows may come in any order.
    """

    def pairs(row_of: list[int], opens: list[int], closes: list[int], twin: list[int], nests: list[int], at: list[int]) -> list[tuple[int, int]]:
        stack: list[tuple[int, int]] = []
        open_of: dict[int, int] = {}
        found, last = [], -1
        for row, k, new, own, second, on in zip(row_of, at, opens, closes, twin, nests, strict=True):
            if row != last:
                stack, open_of, last = [], {}, row
            empty = bool(stack) and stack[-1][0] in (own, second) and stack[-1][1] == k - 1
            if own >= 0 and not empty and (open_of.get(own) or open_of.get(second)):
                while True:
                    family, place = stack.pop()
                    open_of[family] -= 1
                    if family in (own, second):
                        break
                found.append((place, k))
            elif new >= 0 and (on or not open_of.get(new)):
                stack.append((new, k))
                open_of[new] = open_of.get(new, 0) + 1
        return found

    def run(tokens: pa.Array) -> pa.Array:
        lengths = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        what, opens, closes, twin, nests = (_numbers(x) for x in tokens.flatten().flatten())
        n = len(what)
        role, closing = np.zeros(n, np.int8), np.full(n, -1, np.int64)
        role[np.isin(what, wholes)] = WHOLE
        marks = np.flatnonzero((opens >= 0) | (closes >= 0))
        row_of = np.searchsorted(bounds, marks, "right") - 1
        found = np.array(pairs(*(x.tolist() for x in (row_of, opens[marks], closes[marks], twin[marks], np.maximum(nests[marks], 0), marks))), np.int64).reshape(-1, 2)
        opener, closer = found[:, 0], found[:, 1]
        grouped = np.isin(what[opener], groups)
        role[opener], role[closer] = np.where(grouped, TEXT, OPENER), np.where(grouped, TEXT, CLOSER)
        closing[opener] = closer
        step = (role == OPENER).astype(np.int64) - (role == CLOSER)
        depth = np.cumsum(step) - (role == OPENER)  # all that is opened in a text is closed in it
        is_text = role == TEXT
        starts = np.ones(n, bool)
        starts[1:] = ~(is_text[1:] & is_text[:-1])
        starts[bounds[:-1][lengths > 0]] = True
        at = np.flatnonzero(starts)
        size = np.diff(np.append(at, n))
        row = np.searchsorted(bounds, at, "right") - 1
        held = np.append(role[at], [TEXT, TEXT])
        same = np.append(row, [-1, -1])
        alone = (held[:-2] == OPENER) & (held[1:-1] == TEXT) & (held[2:] == CLOSER) & (same[:-2] == same[2:])
        inside = np.where(alone, np.append(size[1:], 0), 0)
        taken = np.append([False], alone[:-1]) if len(alone) else alone
        first = bounds[row]
        counts = np.bincount(row, minlength=len(lengths)) if len(row) else np.zeros(len(lengths), np.int64)
        fields = [role[at], what[at], depth[at], at - first + 1, size, np.where(closing[at] >= 0, closing[at] - first + 1, -1), inside]
        runs = pa.StructArray.from_arrays([*(pa.array(x.astype(np.int32)) for x in fields), pa.array(taken)], ["role", "what", "depth", "start", "size", "closing", "inside", "taken"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), runs)

    return F.arrow_udf(run, _RUNS).asNondeterministic()


def _rank_stack(strict: bool):
    """For each row what is open before it: rows of lower ranks, and of the same one unless `strict`."""

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        ranks: list[int] = []
        values: list[int] = []
        sums: list[int] = []
        for first, rank, enters, value, weight in batches:
            first, enters = _numbers(first.cast(pa.int8())), _numbers(enters.cast(pa.int8()), 0)
            rank, value, weight = _numbers(rank, 0), _numbers(value, 0), _numbers(weight, 0)
            above, total, depth = (np.zeros(len(rank), np.int64) for _ in range(3))
            for k, (new, r, on, v, w) in enumerate(zip(first.tolist(), rank.tolist(), enters.tolist(), value.tolist(), weight.tolist(), strict=True)):
                if new == 1:
                    ranks, values, sums = [], [], []
                if on:
                    while ranks and ranks[-1] > r:
                        ranks.pop(), values.pop(), sums.pop()
                    if ranks and ranks[-1] == r:
                        if strict:
                            ranks.pop(), values.pop(), sums.pop()
                            above[k] = values[-1] if values else -1
                        else:
                            above[k] = values[-1]
                            ranks.pop(), values.pop(), sums.pop()
                    else:
                        above[k] = values[-1] if values else -1
                    ranks.append(r)
                    values.append(v)
                    sums.append((sums[-1] if sums else 0) + w)
                else:
                    above[k] = values[-1] if values else -1
                total[k] = sums[-1] if sums else 0
                depth[k] = len(ranks)
            yield pa.StructArray.from_arrays([pa.array(above, mask=above < 0), pa.array(total), pa.array(depth)], ["above", "total", "depth"])

    return run


_FOUND = T.StructType([T.StructField(x, T.LongType()) for x in ("above", "total", "depth")])


@F.arrow_udf(_FOUND)
def ranked(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """ranked(first, rank, enters, value, weight): along rows of which each that `enters` closes those of its rank and above.

    above: the `value` (0 or more) of the innermost row still open before it, of a lower rank; null if there is none.
    total: the sum of `weight` over the rows open at it, itself included; depth: their number. A row that doesn't
    enter sees what is open and changes nothing. Null ranks count as 0.
    """
    yield from _rank_stack(True)(batches)


@F.arrow_udf(_FOUND)
def ranked_or_equal(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """As `ranked`, but `above` is of the nearest earlier row of a lower or the same rank."""
    yield from _rank_stack(False)(batches)


@F.arrow_udf(T.LongType())
def enclosing(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """enclosing(first, step, value): the `value` of what a row stands in, null if in nothing.

    A row with step 1 opens something, and stands in it; one with step -1 closes what was opened last, if anything.
    """
    stack: list[int] = []
    for first, step, value in batches:
        first, step, value = _numbers(first.cast(pa.int8())), _numbers(step, 0), _numbers(value, 0)
        found = np.full(len(step), -1, np.int64)
        before = 0
        for k in np.flatnonzero((first == 1) | (step != 0)).tolist():
            if stack:
                found[before:k] = stack[-1]
            if first[k] == 1:
                stack = []
            if step[k] > 0:
                stack.append(int(value[k]))
            elif step[k] < 0 and stack:
                stack.pop()
            before = k
        if stack:
            found[before:] = stack[-1]
        yield pa.array(found, pa.int64(), mask=found < 0)


closed_by, ranked, ranked_or_equal, enclosing = (f.asNondeterministic() for f in (closed_by, ranked, ranked_or_equal, enclosing))
