"""Chat formatting with offset-aligned loss masks.

A conversation becomes one string, for each turn ``<|turn|>role<|text|>text<|end|>``. Inside roles and texts every
backslash is doubled and ``<|`` becomes ``<\\|``, so no control string can occur there, and ``unescape`` undoes both.
The whole string is encoded once, the control strings being single ids of their own, so that no token straddles a
text's edge. The sorted spans of the masked role's texts meet the token spans by binary search: a token is under the
loss mask if its span overlaps one.

Nulls and odd input: a null role or text is empty; a null conv_id is a conversation of its own; turns go by (turn, role,
text), nulls first, so ties and repeated rows have a fixed order and all count; an empty table gives no conversation;
other columns are ignored. Only whole conversations are gathered, one at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import ship, table

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
BATCH = 128
_TURN = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]], masked: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted string and the spans in it of the masked role's escaped texts, ascending; empty ones have none."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        start = at + len(head)
        if role == masked and body:
            spans.append((start, start + len(body)))
        parts += [head, body, END]
        at = start + len(body) + len(END)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


@lru_cache(maxsize=2)
def chat_tokenizer(path: str):
    from tokenizers import AddedToken, Tokenizer, processors

    out = Tokenizer.from_file(path)
    out.add_special_tokens([AddedToken(x, normalized=False, special=True) for x in (TURN, TEXT, END)])
    out.post_processor = processors.ByteLevel(trim_offsets=False)
    return out


def loss_mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """For each token whether its span overlaps one of the sorted, disjoint spans."""
    if not spans or not len(offsets):
        return np.zeros(len(offsets), bool)
    starts, ends = np.array(spans).T
    first = np.searchsorted(ends, offsets[:, 0], side="right")  # the first span that ends after the token starts
    return (first < len(spans)) & (starts[np.minimum(first, len(spans) - 1)] < offsets[:, 1])


def masked_text(formatted: str, offsets: np.ndarray, mask: np.ndarray) -> str:
    """All that the masked tokens cover, each place once, unescaped."""
    spans = offsets[mask]
    if not len(spans):
        return ""
    reach = np.maximum.accumulate(spans[:, 1])
    first = np.flatnonzero(np.append(True, spans[1:, 0] > reach[:-1]))
    return unescape("".join([formatted[a:b] for a, b in zip(spans[first, 0].tolist(), reach[np.append(first[1:], len(spans)) - 1].tolist(), strict=True)]))


_CHATS = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("ids", pa.list_(pa.int32())), ("loss_mask", pa.list_(pa.bool_())), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])
_DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _chats(rows: DataFrame, path: str | None, masked: str, then, schema: str) -> DataFrame:
    """then(batch of _CHATS) for the conversations of rows; each is gathered, formatted and encoded in one task."""
    ship(rows.sparkSession)
    path = path or tokens.default_paths()[0]

    def encoded(chats: list[tuple]) -> pa.RecordBatch:
        rendered = [render(turns, masked) for _, turns in chats]
        found = chat_tokenizer(path).encode_batch([x for x, _ in rendered], add_special_tokens=False)
        offsets = [np.array(e.offsets, np.int32).reshape(-1, 2) for e in found]
        columns = [
            [c for c, _ in chats], [x for x, _ in rendered], [e.ids for e in found],
            [loss_mask(o, spans) for o, (_, spans) in zip(offsets, rendered, strict=True)], [o[:, 0] for o in offsets], [o[:, 1] for o in offsets],
        ]
        return then(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _CHATS, strict=True)], schema=_CHATS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chats: list[tuple] = []
        size = 0
        for b in batches:
            for conv_id, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if not chats or chats[-1][0] != conv_id:
                    if len(chats) >= BATCH or size > 1 << 20:
                        yield encoded(chats)
                        chats, size = [], 0
                    chats.append((conv_id, []))
                chats[-1][1].append((role or "", text or ""))
                size += len(text or "")
        if chats:
            yield encoded(chats)

    ordered = rows.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(run, schema)


def format_chats(rows: DataFrame, path: str | None = None, masked: str = "assistant") -> DataFrame:
    """conv_id, formatted, ids, loss_mask and the offsets of each conversation's tokens."""
    return _chats(rows, path, masked, lambda b: b, "conv_id long, formatted string, ids array<int>, loss_mask array<boolean>, starts array<int>, ends array<int>")


def _digest(b: pa.RecordBatch) -> pa.RecordBatch:
    """What the contract asks for, read back from the formatted strings, the masks and the offsets."""
    out: list[list] = [[] for _ in range(6)]
    list_of = lambda c, k: b.column(c)[k].values.to_numpy(zero_copy_only=False)
    for k, (conv_id, formatted) in enumerate(zip(b.column("conv_id").to_pylist(), b.column("formatted").to_pylist(), strict=True)):
        turns = parse(formatted)
        offsets = np.stack([list_of("starts", k), list_of("ends", k)], axis=1).astype(np.int64)
        said = masked_text(formatted, offsets, list_of("loss_mask", k).astype(bool))
        whole = hashlib.sha256("".join(f"{role}\n{text}\n" for role, text in turns).encode()).hexdigest()
        for column, x in zip(out, (conv_id, len(turns), whole, len(said), hashlib.sha256(said.encode()).hexdigest(), len(formatted)), strict=True):
            column.append(x)
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def digests(chats: DataFrame) -> DataFrame:
    """The digests of stored chats, as format_chats gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _digest(b)

    return chats.mapInArrow(run, _DIGESTS)


def op4(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return _chats(rows.unionByName(more), None, "assistant", _digest, _DIGESTS)
