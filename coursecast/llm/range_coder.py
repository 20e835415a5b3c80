"""Adaptive context-mixing range coder for token ids below 65536.

A buffer of ids is cut into blocks of ``BLOCK``. Every block starts from the same state and carries the crc32
of its ids, so each can be decoded and checked by itself. Within a block an id is predicted from the two ids
before it, from the one before it, and without context:

* order 2 and order 1: tables of the block keep the id that last followed a context, with a confidence that
  grows with each hit and halves with each miss.
* mixing: the two confidences, and whether both name the same id, choose a pair of adaptive probabilities, for
  the order-2 id and for the order-1 id.
* order 0: what is left of the probability goes to all ids by their counts in the buffer, which its head holds.

The probabilities of all three drive one coding step per id. All blocks of a buffer go through the coder side
by side, one array operation for all of them, so nothing is done per id in Python. Everything is integer
arithmetic and so the same on every machine. Arrays hold what all blocks have at one place side by side, as
blocks look at about the same places of them at a time.

Layout: ``<4sHIQII`` magic, ids per block, number of blocks, number of ids, bytes and crc32 of the packed
counts; the counts (zlib: ids as ``<u2``, then counts as ``<u4``); per block ``<II`` number of 16-bit words and
crc32 of its ids as ``<u2``; the words of all blocks.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

HEAD = "<4sHIQII"
MAGIC = b"CMR2"
BLOCK = 2048
SLOTS = 1024  # of each table of a block
EVENT_BITS = 10
ID_BITS = 18
BITS = EVENT_BITS + ID_BITS
WHOLE = 1 << EVENT_BITS
TOP = 1 << 48
LEAST = 1 << 32
MASK32 = (1 << 32) - 1


def _turned(grid: np.ndarray) -> np.ndarray:
    """Rows as columns, a few rows at a time, which stay in a processor's cache."""
    out = np.empty(grid.shape[::-1], grid.dtype)
    for lo in range(0, len(grid), 32):
        out[:, lo : lo + 32] = grid[lo : lo + 32].T
    return out


class _Order0:
    """Frequencies of all ids that occur, out of 2**ID_BITS, none of them zero."""

    def __init__(self, present: np.ndarray, counts: np.ndarray) -> None:
        up = np.cumsum(counts.astype(np.int64))
        edges = np.concatenate([[0], up * ((1 << ID_BITS) - len(up)) // up[-1] + np.arange(1, len(up) + 1)])
        self._both = np.zeros(1 << 16, np.int64)  # begin and size of an id's range
        self._both[present] = edges[:-1] << 32 | np.diff(edges)
        self.present, self.edges = present, edges

    def ranges(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        both = self._both.take(ids, mode="clip")
        return both >> 32, both & MASK32

    def inverse(self) -> np.ndarray:
        return np.repeat(self.present, np.diff(self.edges))


class _Model:
    """The predictions of all blocks, the first ``k`` of which are still running; row 0 is order 2."""

    def __init__(self, n: int) -> None:
        self.n = n
        self.table = np.zeros(SLOTS * 2 * n, np.int32)
        self.mix = np.full(128 * 2 * n, 8192, np.int32)
        self.lane = np.arange(2 * n).reshape(2, n)
        self.prev1 = np.zeros(n, np.int64)
        self.prev2 = np.zeros(n, np.int64)

    def look(self, k: int) -> None:
        prev1 = self.prev1[:k]
        slot = np.empty((2, k), np.int64)
        np.multiply(prev1, 40503, out=slot[1])
        np.multiply(self.prev2[:k], 386093, out=slot[0])
        slot[0] += slot[1]
        slot >>= 7
        slot &= SLOTS - 1
        slot *= 2 * self.n
        slot += self.lane[:, :k]
        self.slot = slot
        self.entry = self.table.take(slot, mode="clip")  # all are in range; this is the fastest mode
        self.guess = self.entry >> 3
        self.trust = self.entry & 7
        same = (self.guess[0] == self.guess[1]).astype(np.int32)
        at = self.trust[0] * 8
        at += self.trust[1]
        at *= 2
        at += same
        at *= 2 * self.n
        self.at = self.lane[:, :k] + at.astype(np.int64)
        self.chance = self.mix.take(self.at, mode="clip")
        share = self.chance * 1000
        share >>= 16
        self.f2 = share[0] + 1
        f1 = np.minimum(share[1], WHOLE - 3 - self.f2)
        f1 += 1
        f1 *= 1 - same
        self.f1 = f1
        self.f12 = self.f2 + f1

    def ranges(self, hits: np.ndarray, other: np.ndarray, first: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the range of each block's id begins, and its size; ``first`` and ``many`` are those in order 0.

        ``hits`` and ``other`` are 1 for what holds of an id and else 0: sums of products, as branches on chance are slow.
        """
        begin = (self.f2 * hits[1] + self.f12 * other).astype(np.int64)
        begin <<= ID_BITS
        size = (self.f2 * hits[0] + self.f1 * hits[1]).astype(np.int64)
        size <<= ID_BITS
        rest = ((WHOLE - self.f12) * other).astype(np.int64)
        begin += rest * first
        size += rest * many
        return begin, size

    def learn(self, k: int, ids: np.ndarray, hits: np.ndarray, right: np.ndarray) -> None:
        step = hits * 65535
        step -= self.chance
        step >>= 4
        step += self.chance
        self.mix[self.at] = step
        new = np.empty_like(self.entry)
        new[:] = ids * 8 + 1
        kept = (right | (self.trust >= 2)).ravel().nonzero()[0]
        entry, trust, good = self.entry.take(kept), self.trust.take(kept), right.take(kept).astype(np.int32)
        entry -= ((trust + 1) >> 1) * (1 - good)
        entry += good * (trust < 7)
        new.ravel()[kept] = entry
        self.table[self.slot] = new
        self.prev2[:k] = self.prev1[:k]
        self.prev1[:k] = ids


class _Writer:
    def __init__(self, n: int) -> None:
        self.n = n
        self.low = np.zeros(n, np.int64)
        self.range = np.full(n, TOP, np.int64)
        self.out = np.zeros((BLOCK * 2 + 4) * n, np.uint16)
        self.place = np.arange(n)  # of each block's next word

    def emit(self, lanes: np.ndarray) -> None:
        low = self.low.take(lanes)
        place = self.place.take(lanes)
        word = low >> 32
        self.out[place] = word.astype(np.uint16)
        over = (word >> 16).nonzero()[0]
        if len(over):  # a carry into the words before
            before = place.take(over) - self.n
            while len(before):
                self.out[before] += 1
                before = before[self.out[before] == 0] - self.n
        self.place[lanes] = place + self.n
        self.low[lanes] = (low & MASK32) << 16

    def put(self, k: int, begin: np.ndarray, size: np.ndarray) -> None:
        now = self.range[:k]
        now >>= BITS
        self.low[:k] += now * begin
        now *= size
        small = now < LEAST
        while small.any():
            self.emit(small.nonzero()[0])
            now <<= small.astype(np.int64) << 4
            small = now < LEAST

    def finish(self) -> list[bytes]:
        everyone = np.arange(self.n)
        for _ in range(3):
            self.emit(everyone)
        many = self.place // self.n
        words = _turned(self.out[: many.max() * self.n].reshape(-1, self.n))
        return [w[:m].astype("<u2").tobytes() for w, m in zip(words, many.tolist())]


class _Reader:
    def __init__(self, streams: list[np.ndarray]) -> None:
        n = len(streams)
        width = max(len(s) for s in streams) + 4
        words = np.zeros((n, width), np.uint16)
        for k, s in enumerate(streams):
            words[k, : len(s)] = s
        first = words[:, :3].astype(np.int64)
        self.n = n
        self.words = _turned(words).ravel()
        self.place = np.arange(n) + 3 * n
        self.code = (first[:, 0] << 32) | (first[:, 1] << 16) | first[:, 2]
        self.range = np.full(n, TOP, np.int64)

    def target(self, k: int) -> np.ndarray:
        self.range[:k] >>= BITS
        # Both are below 2**49, so the rounded quotient does not reach the next whole number.
        found = (self.code[:k] / self.range[:k]).astype(np.int64)
        return np.minimum(found, (1 << BITS) - 1)

    def take(self, k: int, begin: np.ndarray, size: np.ndarray) -> None:
        now = self.range[:k]
        self.code[:k] -= now * begin
        now *= size
        small = now < LEAST
        while small.any():
            lanes = small.nonzero()[0]
            place = self.place.take(lanes)
            code = self.code.take(lanes)
            code <<= 16
            code += self.words.take(place, mode="clip").astype(np.int64)
            self.code[lanes] = code
            self.place[lanes] = place + self.n
            now <<= small.astype(np.int64) << 4
            small = now < LEAST


def encode(ids: np.ndarray) -> bytes:
    """The ids, each below 65536, as one buffer."""
    ids = np.ascontiguousarray(ids, "<u2")
    n_blocks = -(-len(ids) // BLOCK)
    counts = np.zeros(1 << 16, np.int64)
    for lo in range(0, len(ids), 1 << 18):
        counts += np.bincount(ids[lo : lo + (1 << 18)], minlength=1 << 16)
    present = np.flatnonzero(counts)
    packed = zlib.compress(present.astype("<u2").tobytes() + counts[present].astype("<u4").tobytes(), 1)
    head = struct.pack(HEAD, MAGIC, BLOCK, n_blocks, len(ids), len(packed), zlib.crc32(packed)) + packed
    if not n_blocks:
        return head
    order0 = _Order0(present, counts[present])
    padded = np.zeros(n_blocks * BLOCK, np.uint16)
    padded[: len(ids)] = ids
    steps = _turned(padded.reshape(n_blocks, BLOCK))
    last = len(ids) - (n_blocks - 1) * BLOCK
    model, writer = _Model(n_blocks), _Writer(n_blocks)
    for t in range(BLOCK if n_blocks > 1 else last):
        k = n_blocks if t < last else n_blocks - 1
        model.look(k)
        now = steps[t, :k].astype(np.int32)
        right = model.guess == now
        hits = right.astype(np.int32)
        hits[1] &= ~hits[0]
        begin, size = model.ranges(hits, 1 - hits[0] - hits[1], *order0.ranges(now))
        writer.put(k, begin, size)
        model.learn(k, now, hits, right)
    words = writer.finish()
    index = b"".join(
        struct.pack("<II", len(w) // 2, zlib.crc32(ids[b * BLOCK : (b + 1) * BLOCK].tobytes())) for b, w in enumerate(words)
    )
    return b"".join([head, index, *words])


def decode(buffer: bytes) -> np.ndarray:
    """The ids of a buffer; raises ValueError if its counts or a block do not match their checksum."""
    magic, block, n_blocks, n_ids, n_packed, crc = struct.unpack_from(HEAD, buffer)
    if magic != MAGIC or block != BLOCK:
        raise ValueError("not a token buffer of this format")
    at = struct.calcsize(HEAD)
    packed = bytes(buffer[at : at + n_packed])
    if zlib.crc32(packed) != crc:
        raise ValueError("the counts do not match their checksum")
    if not n_blocks:
        return np.zeros(0, np.uint16)
    counts = zlib.decompress(packed)
    n = len(counts) // 6
    order0 = _Order0(np.frombuffer(counts, "<u2", n).astype(np.int64), np.frombuffer(counts, "<u4", n, 2 * n))
    inverse = order0.inverse().astype(np.uint16)
    at += n_packed
    index = np.frombuffer(buffer, "<u4", 2 * n_blocks, at).reshape(n_blocks, 2)
    words = np.frombuffer(buffer, "<u2", offset=at + 8 * n_blocks)
    reader = _Reader(np.split(words, np.cumsum(index[:, 0].astype(np.int64)))[:n_blocks])
    steps = np.zeros((BLOCK, n_blocks), np.uint16)
    last = n_ids - (n_blocks - 1) * BLOCK
    model = _Model(n_blocks)
    for t in range(BLOCK if n_blocks > 1 else last):
        k = n_blocks if t < last else n_blocks - 1
        model.look(k)
        target = reader.target(k)
        event = (target >> ID_BITS).astype(np.int32)
        other = (event >= model.f12).astype(np.int32)
        hits = np.empty((2, k), np.int32)
        hits[0] = event < model.f2
        hits[1] = 1 - other - hits[0]
        target -= model.f12.astype(np.int64) << ID_BITS  # below 0 where a guess was right: any id will do there
        now = inverse.take((target / (WHOLE - model.f12)).astype(np.int64), mode="clip")
        begin, size = model.ranges(hits, other, *order0.ranges(now))
        now = now.astype(np.int32) * other
        now += model.guess[0] * hits[0]
        now += model.guess[1] * hits[1]
        reader.take(k, begin, size)
        steps[t, :k] = now
        model.learn(k, now, hits, model.guess == now)
    ids = _turned(steps).ravel()[:n_ids].astype("<u2", copy=False)
    for b in range(n_blocks):
        if zlib.crc32(ids[b * BLOCK : (b + 1) * BLOCK].tobytes()) != index[b, 1]:
            raise ValueError(f"block {b} does not match its checksum")
    return ids
