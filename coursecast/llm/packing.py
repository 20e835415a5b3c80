"""Packing token ids into windows of fixed size by minimum bin slack."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coursecast.llm.shared import giving_back
from coursecast.llm.token_ids import worker_encoder

WINDOW = 2048
POOL = 4096  # remainders that wait in a task; they are packed down to half as many


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length to take so that they fill ``room`` as far as any choice from ``counts`` can.

    Sums that can be reached are the bits of one number. Lengths come in descending order, and several of one
    length as groups of 1, 2, 4, ... that share its count; a group shifts the bits by its sum. The bits before each
    group are kept until ``room`` is reached, and the way back from the highest bit tells which groups were used.
    """
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted((n for n in counts if n <= room), reverse=True):
        left, group = min(counts[length], room // length), 1
        while left:
            many = min(group, left)
            new = (reach | reach << many * length) & mask
            if new != reach:
                steps.append((length, many, reach))
                reach = new
            left -= many
            group *= 2
        if reach >> room:
            break
    total = reach.bit_length() - 1
    taken: dict[int, int] = {}
    for length, many, before in reversed(steps):
        if not before >> total & 1:  # not reachable without this group
            taken[length] = taken.get(length, 0) + many
            total -= many * length
    return taken


class Piece:
    """A run of one document's ids."""

    __slots__ = ("name", "start", "whole", "ids")

    def __init__(self, name: int | None, start: int, whole: int, ids: np.ndarray) -> None:
        self.name, self.start, self.whole, self.ids = name, start, whole, ids

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.name, self.start, self.whole, self.ids[:n]), Piece(self.name, self.start + n, self.whole, self.ids[n:])


class Packer:
    """Windows of one task: full ones at once, the others from a bounded pool of remainders by length.

    A window begins with the longest remainder; the rest of it is the multiset of lengths that fills it closest
    to capacity. If that leaves room, the shortest remainder left gives a piece of just that size. What is in the
    pool at the end and does not fill a window is cut into sequences of 2**k ids, which need no padding.
    """

    def __init__(self, emit: Callable[[list[Piece]], None], window: int = WINDOW, pool: int = POOL) -> None:
        self.emit, self.window, self.most = emit, window, pool
        self.pool: dict[int, list[Piece]] = {}
        self.waiting = self.ids = 0

    def add(self, piece: Piece) -> None:
        while len(piece.ids) >= self.window:
            full, piece = piece.cut(self.window)
            self.emit([full])
        if len(piece.ids):
            self._keep(piece)
        if self.waiting > self.most:
            self._pack(self.most // 2)

    def finish(self) -> None:
        self._pack(0)

    def _keep(self, piece: Piece) -> None:
        self.pool.setdefault(len(piece.ids), []).append(piece)
        self.waiting += 1
        self.ids += len(piece.ids)

    def _take(self, length: int) -> Piece:
        piece = self.pool[length].pop()
        if not self.pool[length]:
            del self.pool[length]
        self.waiting -= 1
        self.ids -= length
        return piece

    def _pack(self, down_to: int) -> None:
        while self.waiting > down_to and self.ids >= self.window:
            row = [self._take(max(self.pool))]
            room = self.window - len(row[0].ids)
            chosen = fullest({n: len(p) for n, p in self.pool.items()}, room)
            for length, many in chosen.items():
                row += [self._take(length) for _ in range(many)]
                room -= many * length
            if room:  # every remainder left is longer than the room
                piece, rest = self._take(min(self.pool)).cut(room)
                row.append(piece)
                self._keep(rest)
            self.emit(row)
        if not down_to:
            self._tail()

    def _tail(self) -> None:
        left = self.ids
        while left:
            size, row = 1 << (left.bit_length() - 1), []
            left -= size
            while size:
                piece = self._take(max(self.pool))
                if len(piece.ids) > size:
                    piece, rest = piece.cut(size)
                    self._keep(rest)
                row.append(piece)
                size -= len(piece.ids)
            self.emit(row)


KINDS = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def packed(docs: DataFrame, *, tokenizer: str, end_id: int = 1, text_col: str = "text", window: int = WINDOW,
           pool: int = POOL) -> DataFrame:
    """The pieces of all documents in sequences of at most ``window`` ids: ``doc_id``, ``start``, ``length``,
    ``doc_tokens``, ``sequence_id``, ``offset`` and ``ids`` (little-endian unsigned 32-bit).

    Every text is encoded and followed by ``end_id``; a null or empty one is that id alone. Repeated rows, and rows
    without id, are documents of their own. Other columns are ignored; an empty table gives an empty result.
    Each task packs its own rows in one pass, with at most ``pool`` remainders in memory: nothing is shuffled, and a
    lost task is packed anew from its rows. A sequence number holds the task's number in its upper bits.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer)
        number = TaskContext.get().partitionId() << 33
        ready: list[tuple[int, list[Piece]]] = []
        size = 0

        def emit(row: list[Piece]) -> None:
            nonlocal number, size
            ready.append((number, row))
            number += 1
            size += sum(len(p.ids) for p in row)

        def table() -> pa.RecordBatch:
            nonlocal size
            pieces = [p for _, row in ready for p in row]
            length = np.array([len(p.ids) for p in pieces], np.int64)
            ids = np.concatenate([p.ids for p in pieces]).astype("<u4")
            at = np.concatenate([[0], np.cumsum(length)])
            in_row = [len(row) for _, row in ready]
            first = np.repeat(np.cumsum(in_row) - in_row, in_row)
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([p.name for p in pieces], pa.int64()), pa.array([p.start for p in pieces], pa.int64()), pa.array(length),
                    pa.array([p.whole for p in pieces], pa.int64()), pa.array(np.repeat([n for n, _ in ready], in_row), pa.int64()),
                    pa.array(at[:-1] - at[first]),
                    pa.Array.from_buffers(pa.binary(), len(pieces), [None, pa.py_buffer((4 * at).astype(np.int32)), pa.py_buffer(ids)]),
                ],
                ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
            )
            ready.clear()
            size = 0
            return out

        packer = Packer(emit, window, pool)
        for batch in batches:
            names = batch.column(0).to_pylist()
            for first, ids, at in encoder.encode_texts(batch.column(1)):
                ends = at + np.arange(len(at))  # each text with its end id
                ids = np.insert(ids, at[1:], end_id)
                for k in range(len(at) - 1):
                    mine = ids[ends[k] : ends[k + 1]]
                    rest = len(mine) % window
                    full = len(mine) - rest
                    name = names[first + k]
                    for a in range(0, full, window):
                        emit([Piece(name, a, len(mine), mine[a : a + window])])
                        if size >= 1 << 20:
                            yield table()
                    if rest:
                        packer.add(Piece(name, full, len(mine), mine[full:].copy()))
                    if size >= 1 << 20:
                        yield table()
        packer.finish()
        if ready:
            yield table()

    return rows.mapInArrow(giving_back(run), KINDS)


def packing_index(docs: DataFrame, *, tokenizer: str, **settings) -> DataFrame:
    """The rows of ``packed`` with ``ids_crc32`` in place of the ids."""
    pieces = packed(docs, tokenizer=tokenizer, **settings)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
