"""Conversations as token rows with a loss mask aligned by offsets.

A whole conversation is rendered into one text, encoded once with character offsets, and the
spans of the trained turns are intersected with the sorted token spans by binary search. The
turn marks are tokens of their own, so no token reaches across a mark.

A turn is <|im_start|>role<|im_sep|>text<|im_end|>. Inside roles and texts every "<", any number
of backslashes and "|" get one more backslash, so marks appear only where the template puts them
and removing one backslash restores the text.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, MIDDLE, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
_TURN = re.compile(r"<\|im_start\|>(.*?)<\|im_sep\|>(.*?)<\|im_end\|>", re.DOTALL)
_TOKENIZERS: dict[int, object] = {}
FORMATTED = "text string, ids array<int>, starts array<int>, ends array<int>, loss_mask array<byte>"


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def render(turns: list[tuple[str, str]], trained: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The conversation's text and the spans of the trained role's texts, in order."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{MIDDLE}", escape(text)
        if role == trained:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += (head, body, END)
        at += len(head) + len(body) + len(END)
    return "".join(out), spans


def parse(text: str) -> list[tuple[str, str]]:
    """Roles and texts of a rendered conversation."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(text)]


def mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """1 for every token that overlaps a span; token starts and ends are sorted."""
    out = np.zeros(len(starts), np.int8)
    for a, b in spans:
        if a < b:
            out[np.searchsorted(ends, a, "right") : np.searchsorted(starts, b, "left")] = 1
    return out


def masked_texts(text: str, starts: np.ndarray, ends: np.ndarray, loss_mask: np.ndarray) -> list[str]:
    """The unescaped text under each run of masked tokens."""
    edge = np.diff(np.concatenate(([0], loss_mask, [0])))
    return [unescape(text[starts[a] : ends[b - 1]]) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]


def tokenizer(definition: str):
    """The tokenizer of a JSON definition with the turn marks added; whole offsets, kept for the process."""
    if hash(definition) not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, processors

        made = Tokenizer.from_str(definition)
        made.add_special_tokens([START, MIDDLE, END])
        made.post_processor = processors.ByteLevel(trim_offsets=False)
        _TOKENIZERS[hash(definition)] = made
    return _TOKENIZERS[hash(definition)]


def format_conversations(rows: DataFrame, tokenizer_path: str, trained: str = "assistant") -> DataFrame:
    """One row for each conv_id: conv_id, text, token ids, their offsets, loss_mask.

    Turns go by turn, then role, then text, nulls first; a null text or role is empty. Repeated
    rows are turns of their own. A null conv_id is a conversation too; an empty table gives an
    empty one. A conversation is one value of the result, so it has to fit a task.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        definition = rows.sparkSession.sparkContext.broadcast(file.read())  # one vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(definition.value)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                shown = [render([(t["role"] or "", t["text"] or "") for t in turns], trained) for turns in part.column(1).to_pylist()]
                ids, starts, ends, masks = [], [], [], []
                for (_, spans), code in zip(shown, coder.encode_batch([s for s, _ in shown], add_special_tokens=False)):
                    offsets = np.array(code.offsets, np.int32).reshape(-1, 2)
                    ids.append(np.array(code.ids, np.int32))
                    starts.append(np.ascontiguousarray(offsets[:, 0]))
                    ends.append(np.ascontiguousarray(offsets[:, 1]))
                    masks.append(mask(starts[-1], ends[-1], spans))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([s for s, _ in shown], pa.string()), *(_lists(x, t) for x, t in ((ids, pa.int32()), (starts, pa.int32()), (ends, pa.int32()), (masks, pa.int8())))],
                    names=["conv_id", "text", "ids", "starts", "ends", "loss_mask"])

    turns = rows.select("conv_id", F.struct("turn", "role", "text").alias("turn")).groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return turns.mapInArrow(run, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {FORMATTED}")


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, kind.to_pandas_dtype()), *rows]), kind))


def digest(formatted: DataFrame) -> DataFrame:
    """Counts and hashes of what a formatted conversation holds, read back from its text and tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, text in enumerate(batch.column(1).to_pylist()):
                starts, ends, loss = (batch.column(c)[k].values.to_numpy() for c in (2, 3, 4))
                turns, trained = parse(text), "".join(masked_texts(text, starts, ends, loss))
                out.append((len(turns), sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(trained), sha256(trained.encode()).hexdigest(), len(text)))
            names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in out], pa.string() if i in (1, 3) else pa.int64()) for i in range(5))], names=["conv_id", *names])

    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.select("conv_id", "text", "starts", "ends", "loss_mask").mapInArrow(
        run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
