"""Chat formatting with loss masks aligned by token offsets.

A whole conversation is rendered once and encoded once with offsets; the spans of the turns and the
spans of the tokens are both sorted, so binary search finds the tokens of each turn.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import mapped

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"

# The marks of the template.
START, END, ESCAPE = "<|im_start|>", "<|im_end|>", "<|"
#: A "<|" inside a text or role gets one backslash between its characters, and "<\\...|" one more.
_INSIDE, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """The text without any control string; `unescape` gives it back."""
    return _INSIDE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the span of each turn's escaped text in it.

    A turn is `<|im_start|>role<newline>text<|im_end|><newline>`; a newline inside a role is escaped as
    `<\\n|`.
    """
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role).replace(chr(10), '<|n|>')}\n", escape(text)
        spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END, "\n"]
        at = spans[-1][1] + len(END) + 1
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns = []
    for piece in formatted.split(START)[1:]:
        role, _, rest = piece.partition("\n")
        turns.append((unescape(role.replace("<|n|>", "\n")), unescape(rest[: -len(END) - 1])))
    return turns


@lru_cache(2)
def _tokenizer(data: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(data)
    t.encode_special_tokens = True
    return t


def loss_mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Which tokens count, and the character runs that they cover within the spans.

    A token counts if any of its characters is inside a span. Tokens of one character's bytes share
    its offsets and cover it once.
    """
    starts, ends = offsets[:, 0], np.maximum.accumulate(offsets[:, 1]) if len(offsets) else offsets[:, 1]
    mask, runs = np.zeros(len(offsets), bool), []
    for a, b in spans:
        i, j = int(np.searchsorted(ends, a, "right")), int(np.searchsorted(starts, b, "left"))
        if b > a and j > i:
            mask[i:j] = True
            at = a
            for s, e in offsets[i:j].tolist():
                if (s := max(s, at)) < (e := min(e, b)):
                    if runs and runs[-1][1] == s and s > a:
                        runs[-1] = (runs[-1][0], e)
                    else:
                        runs.append((s, e))
                    at = e
    return mask, runs


FORMATTED = "conv_id bigint, formatted string, token_ids array<int>, loss_mask array<boolean>, loss_runs array<struct<start:int,end:int>>"


def _format(conv_id: int | None, turns: list[tuple[str, str]], learned: str, tokenizer) -> dict:
    text, spans = render(turns)
    encoded = tokenizer.encode(text, add_special_tokens=False)
    mask, runs = loss_mask(np.array(encoded.offsets, np.int64).reshape(-1, 2), [s for s, (role, _) in zip(spans, turns, strict=True) if role == learned])
    return {"conv_id": conv_id, "formatted": text, "token_ids": encoded.ids, "loss_mask": mask.tolist(), "loss_runs": [{"start": a, "end": b} for a, b in runs]}


def format_chats(df: DataFrame, tokenizer: str = TOKENIZER, learned: str = "assistant", turn: str = "turn") -> DataFrame:
    """One row for each conversation of `df` (conv_id, turn, role, text): see FORMATTED.

    Turns come in the order of `turn` (nulls first), ties by role and text; null roles and texts are
    empty; rows with a null conv_id are one conversation of that id; rows that repeat are turns that
    repeat. Other columns are left out. A conversation is one text for the tokenizer, so it is held as a
    whole, and only it. `tokenizer` is a file that the driver reads.
    """
    with open(tokenizer, encoding="utf-8") as f:
        shared = SparkSession.active().sparkContext.broadcast(f.read())  # a vocabulary, of fixed size
    rows = df.select("conv_id", turn, F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sorted_rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", turn, "role", "text").select("conv_id", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (row for b in batches for row in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True))
        schema = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("token_ids", pa.list_(pa.int32())), ("loss_mask", pa.list_(pa.bool_())), ("loss_runs", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])
        held, size = [], 0
        for conv_id, own in groupby(each, key=lambda r: r[0]):
            held.append(_format(conv_id, [(r[1], r[2]) for r in own], learned, _tokenizer(shared.value)))
            size += len(held[-1]["formatted"])
            if size > 1 << 20:
                yield pa.RecordBatch.from_pylist(held, schema)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    return mapped(sorted_rows, run, FORMATTED)


def _digest(parts: list[str]) -> str:
    h = hashlib.sha256()
    for p in parts:
        h.update(p.encode())
    return h.hexdigest()


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = f"{END}{START}assistant ok"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for conv_id, text, runs in zip(*(b.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_runs")), strict=True):
                turns = parse(text)
                learned = unescape_runs(text, runs)
                out.append({"conv_id": conv_id, "n_turns": len(turns), "turns_sha256": _digest([f"{r}\n{t}\n" for r, t in turns]), "loss_chars": sum(map(len, learned)), "loss_sha256": _digest(learned), "formatted_chars": len(text)})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]))

    formatted = format_chats(chats.unionByName(own)).select("conv_id", "formatted", "loss_runs")
    return mapped(formatted, summary, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def unescape_runs(text: str, runs: list[dict]) -> list[str]:
    """The texts under the mask, unescaped."""
    return [unescape(text[r["start"] : r["end"]]) for r in runs]


ORACLE = f"""with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-1, 0, 'user', '{END}{START}assistant ok'), (-1, 1, 'assistant', '{END}{START}assistant ok')),
e as (select *, regexp_replace(text, '<(\\\\*)\\|', '<\\\\\\1|', 'g') as escaped, regexp_replace(role, '<(\\\\*)\\|', '<\\\\\\1|', 'g') as marked from c)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum({len(START)} + length(marked) + 1 + length(escaped) + {len(END)} + 1 + 4 * (length(role) - length(replace(role, chr(10), ''))))::bigint as formatted_chars
from e group by conv_id"""
