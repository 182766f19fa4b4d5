"""Packing: bounded-space online packing of token ids into windows.

Each partition of the input keeps at most ``open_windows`` windows open. A document's whole windows are cut off first
and stand alone; its rest goes to the open window that it leaves least room in (best fit). When none has room, the
fullest is emitted and a new one opened. What is open at the end of a partition is merged: groups of ``FAN_IN``
partitions pack each other's leftover pieces the same way, round by round, until one group is left; the last one joins
its windows end to end, so that all but one are full. Only leftovers are shuffled, and each round leaves at most
open_windows of them to a group.

Result: one row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the ids if asked
for. Each id of a document lies in exactly one piece; offsets in a sequence have no gap from 0.

Nulls and odd input: a null or empty text is the single end id; a null doc_id stays null; repeated rows are packed as
often as they occur; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import cut, ship, table

WINDOW = 2048
OPEN_WINDOWS = 128
FAN_IN = 16
END_ID = 1
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary, left_over boolean"
_ARROW = pa.schema([*((x, pa.int64()) for x in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")), ("ids", pa.binary()), ("left_over", pa.bool_())])


class Packer:
    """Best fit with a bounded number of open windows. A piece: (doc_id, start, ids as bytes of 4 each, doc_tokens)."""

    def __init__(self, window: int, open_windows: int, first_id: int):
        self.window, self.most, self.next_id = window, open_windows, first_id
        self.room: list[tuple[int, int]] = []  # (free places, window), ascending
        self.pieces: dict[int, list] = {}

    def _open(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def put(self, piece: tuple) -> Iterator[tuple[int, list]]:
        """Place a piece of at most a window; yields the windows that this closes."""
        size = len(piece[2]) // 4
        if size == self.window:
            yield self._open(), [piece]
            return
        at = bisect_left(self.room, (size, -1))
        if at < len(self.room):
            free, w = self.room.pop(at)
        else:
            if len(self.room) == self.most:
                _, full = self.room.pop(0)
                yield full, self.pieces.pop(full)
            free, w = self.window, self._open()
            self.pieces[w] = []
        self.pieces[w].append(piece)
        if free == size:
            yield w, self.pieces.pop(w)
        else:
            insort(self.room, (free - size, w))

    def joined(self) -> Iterator[tuple[int, list]]:
        """The open windows' pieces end to end, cut at each full window."""
        have: list = []
        free = self.window
        for w in [w for _, w in self.room]:
            for doc_id, start, ids, total in self.pieces.pop(w):
                while ids:
                    take = ids[: 4 * free]
                    have.append((doc_id, start, take, total))
                    start, ids, free = start + len(take) // 4, ids[4 * free :], free - len(take) // 4
                    if not free:
                        yield self._open(), have
                        have, free = [], self.window
        if have:
            yield self._open(), have
        self.room = []


def _rows(windows: Iterator[tuple[int, list]], left_over: bool, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    columns: list[list] = [[] for _ in _ARROW]
    for w, pieces in windows:
        offset = 0
        for doc_id, start, ids, total in pieces:
            n = len(ids) // 4
            for column, x in zip(columns, (doc_id, start, n, zlib.crc32(ids), total, w, offset, ids if left_over or keep_ids else None, left_over), strict=True):
                column.append(x)
            offset += n
        if len(columns[0]) >= 5000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)
            columns = [[] for _ in _ARROW]
    if columns[0]:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def _merger(window: int, open_windows: int, step: int, last: bool, keep_ids: bool):
    """Packs the leftover pieces of one group: at most FAN_IN x open_windows windows of them."""

    def again(key, found):
        rows = found.to_pylist()
        rows.sort(key=lambda r: (-r["length"], r["sequence_id"], r["offset"]))
        packer = Packer(window, open_windows, (step << 58) + (key[0].as_py() << 32))

        def closed() -> Iterator[tuple[int, list]]:
            for r in rows:
                yield from packer.put((r["doc_id"], r["start"], r["ids"], r["doc_tokens"]))
            if last:
                yield from packer.joined()

        done = [*_rows(closed(), False, keep_ids), *_rows(((w, packer.pieces[w]) for _, w in packer.room if not last), True, keep_ids)]
        return pa.Table.from_batches(done, schema=_ARROW)

    return again


def pack(docs: DataFrame, window: int = WINDOW, open_windows: int = OPEN_WINDOWS, paths: tuple[str, str] | None = None, end_id: int = END_ID, keep_ids: bool = True) -> DataFrame:
    ship(docs.sparkSession)
    paths = paths or tokens.default_paths()
    end = array("I", [end_id]).tobytes()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer = Packer(window, open_windows, TaskContext.get().partitionId() << 32)

        def closed() -> Iterator[tuple[int, list]]:
            for b in batches:
                for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                    ids = array("I", tokens.encode(text or "", paths)).tobytes() + end
                    total = len(ids) // 4
                    for at in range(0, total, window):
                        yield from packer.put((doc_id, at, ids[4 * at : 4 * (at + window)], total))

        yield from _rows(closed(), False, keep_ids)
        yield from _rows(((w, packer.pieces[w]) for _, w in packer.room), True, keep_ids)

    placed = cut(docs.select("doc_id", "text").mapInArrow(first, SCHEMA))
    done = [placed.where("not left_over")]
    left = placed.where("left_over").withColumn("part", F.shiftright("sequence_id", 32))
    widest = left.agg(F.max("part")).first()[0] or 0
    step = 0
    while True:
        step += 1
        widest //= FAN_IN
        last = widest == 0

        merged = left.withColumn("group", F.floor(F.col("part") / F.lit(FAN_IN**step)).cast("long")).groupBy("group").applyInArrow(_merger(window, open_windows, step, last, keep_ids), SCHEMA)
        if last:
            done.append(merged)
            break
        merged = cut(merged)
        done.append(merged.where("not left_over"))
        left = merged.where("left_over").withColumn("part", F.shiftright("sequence_id", 32).bitwiseAND((1 << 26) - 1) * F.lit(FAN_IN**step))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("left_over") if keep_ids else out.drop("left_over", "ids")


def op9(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), keep_ids=False)


def pack_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the pieces of all remaining documents."""
    return pack(docs, keep_ids=False)
