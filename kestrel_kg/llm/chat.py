"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole: ``<|turn|>role<|text|>text<|end|>`` for each turn. It is encoded once, with offsets; the three
marks are added tokens, so no other token reaches over them. The spans of the assistant's texts, which are sorted, meet the sorted
token spans by binary search, and the tokens that overlap them are under the loss mask.

Control strings inside roles and texts (any ``<|``, and the marks ``<s> </s> [INST] [/INST] <<SYS>> <</SYS>>`` of other templates)
get one backslash after their first character; where backslashes stand there already one more is added, so that taking one away
restores every text.

Cases: null roles and texts are empty. Turns of equal number are ordered by role, then text; null numbers come first; repeated rows
are turns each. Null conv_id is a conversation. An empty table gives no rows. Extra columns aren't read. The rows of one
conversation form one output row, which bounds a task's memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
AFTER = r"(?=\||/?s>|/?INST\]|</?SYS>>)"
ESCAPE, UNESCAPE = re.compile(r"([<\[])(\\*)" + AFTER), re.compile(r"([<\[])\\(\\*)" + AFTER)
PARSE = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>", re.S)


def escape(text: str) -> str:
    return ESCAPE.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"\1\2", text)


def render(turns: list[tuple[str, str]], learnt: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans of the learnt role's texts in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        if role == learnt:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts.append(f"{head}{body}{END}")
        at += len(parts[-1])
    return "".join(parts), spans


def masked(offsets: np.ndarray, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """[first, end) runs of the tokens that overlap each span; offsets: sorted [start, end) of the tokens."""
    if not spans or not len(offsets):
        return []
    a, b = np.array(spans).T
    first, end = np.searchsorted(offsets[:, 1], a, "right"), np.searchsorted(offsets[:, 0], b, "left")
    return [(int(x), int(y)) for x, y in zip(first, end, strict=True) if y > x]


def parse(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(a), unescape(b)) for a, b in PARSE.findall(formatted)]


def lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """One list of 32-bit numbers for each array."""
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else [], kind))


def slices(column: pa.ListArray) -> list[np.ndarray]:
    """The numbers of each list."""
    at, values = column.offsets.to_numpy(), column.values.to_numpy()
    return [values[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def format_conversations(conversations: DataFrame, *, tokenizer: str | None = None, learnt: str = "assistant") -> DataFrame:
    """conv_id, n_turns, formatted, ids, offsets (a start and an end for each token) and mask (a first and an end token for each run under the loss)."""
    path = tokenizer or tokens.default_path()
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns")).select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.offset_encoder(path, [TURN, TEXT, END])
        for batch in batches:
            for begin in range(0, batch.num_rows, 128):
                part = batch.slice(begin, 128)
                n, text, ids, offsets, mask = [], [], [], [], []
                for turns in part.column(1).to_pylist():
                    formatted, spans = render([(t["role"], t["text"]) for t in turns], learnt)
                    found, places = encode(formatted)
                    n.append(len(turns))
                    text.append(formatted)
                    ids.append(found)
                    offsets.append(places.ravel())
                    mask.append(np.array(masked(places, spans), np.int32).ravel())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(text, pa.string()), lists(ids, pa.int32()), lists(offsets, pa.int32()), lists(mask, pa.int32())],
                    names=["conv_id", "n_turns", "formatted", "ids", "offsets", "mask"],
                )

    return whole.mapInArrow(run, "conv_id long, n_turns long, formatted string, ids array<int>, offsets array<int>, mask array<int>")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted text and its mask hold."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, text, offsets, mask in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), slices(batch.column(2)), slices(batch.column(3)), strict=True):
                turns = parse(text)
                loss = "".join(unescape(text[offsets[2 * first] : offsets[2 * end - 1]]) for first, end in mask.reshape(-1, 2))
                rows.append((conv, len(turns), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], names=names)

    return formatted.select("conv_id", "formatted", "offsets", "mask").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
