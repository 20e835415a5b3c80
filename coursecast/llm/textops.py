"""Whole Arrow batches of texts as numpy arrays: words, hashes, lines, repeated windows.

A word is a maximal run of bytes other than space and tab to carriage return. Work is done in chunks of
bounded bytes, so memory per task follows ``CHUNK_BYTES`` and the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

#: Maps A-Z to a-z and every other byte to itself.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_RANDOM = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}
_MOST_POWERS = 4 << 20  # kept for the worker's life; longer texts make their own


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse, modulo 2**64."""
    if not _POWERS or len(_POWERS["up"]) < n:
        made = []
        for base in (_STEP, _BACK):
            p = np.full(n, base, np.uint64)
            p[:1] = 1
            made.append(np.cumprod(p, out=p))
        if n > _MOST_POWERS:
            return made[0], made[1]
        _POWERS["up"], _POWERS["down"] = made
    return _POWERS["up"], _POWERS["down"]


@dataclass
class Chunk:
    """Some texts of a batch: their bytes, where each begins, and their words."""

    first: int  # index of the first text in its batch
    buf: np.ndarray
    text_at: np.ndarray  # n + 1 offsets into buf
    start: np.ndarray  # of each word in buf
    end: np.ndarray
    word_at: np.ndarray  # n + 1 offsets into the words

    def __len__(self) -> int:
        return len(self.text_at) - 1

    def n_words(self) -> np.ndarray:
        return np.diff(self.word_at)

    def owner(self) -> np.ndarray:
        """The text, within the chunk, of each word."""
        return np.repeat(np.arange(len(self)), self.n_words())

    def count_bytes(self, table: np.ndarray) -> np.ndarray:
        """Per text, how many of its bytes ``table`` marks."""
        total = np.zeros(len(self.buf) + 1, np.int64)
        np.cumsum(table[self.buf], out=total[1:])
        return np.diff(total[self.text_at])

    def prefix(self) -> np.ndarray:
        up, _ = _powers(len(self.buf) + 1)
        sums = np.zeros(len(self.buf) + 1, np.uint64)
        np.cumsum(_BYTE[self.buf] * up[: len(self.buf)], out=sums[1:])
        return sums

    def hashes(self, start: np.ndarray, end: np.ndarray, prefix: np.ndarray | None = None) -> np.ndarray:
        """64-bit hashes of byte ranges; equal bytes give equal hashes wherever they stand."""
        sums = self.prefix() if prefix is None else prefix
        _, down = _powers(len(self.buf) + 1)
        return mix((sums[end] - sums[start]) * down[start])


def chunks(
    texts: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES,
    fold: np.ndarray | None = None, space: np.ndarray = SPACE,
) -> Iterator[Chunk]:
    """A column of texts in pieces of at most ``limit`` bytes, or of one text; null is empty.

    ``fold`` maps bytes to bytes before words are cut, ``space`` marks the bytes between words.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    everything = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        piece = everything[offsets[at] : offsets[to]]
        yield split_words(at, piece if fold is None else fold[piece], offsets[at : to + 1] - offsets[at], space)
        at = to


def split_words(first: int, buf: np.ndarray, text_at: np.ndarray, space: np.ndarray = SPACE) -> Chunk:
    n = len(buf)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~space[buf]
    edge = np.zeros(n + 1, bool)
    edge[text_at] = True
    start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    return Chunk(first, buf, text_at, start, end, np.searchsorted(start, text_at))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive hashes; empty if there are fewer."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + n]
    return mix(out)


def whole_windows(word_at: np.ndarray, size: int, n_words: int) -> np.ndarray:
    """Which of the windows over a chunk's words lie within one text."""
    n = n_words - size + 1
    if n <= 0:
        return np.zeros(0, bool)
    owner = np.repeat(np.arange(len(word_at) - 1), np.diff(word_at))
    return owner[:n] == owner[size - 1 :]


def covered(starts: np.ndarray, size: int, n_words: int) -> np.ndarray:
    """Which words a window of ``size`` words beginning at one of ``starts`` covers."""
    change = np.zeros(n_words + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + size, -1)
    return np.cumsum(change[:-1]) > 0


def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between successive offsets."""
    total = np.zeros(len(values) + 1, np.result_type(values.dtype, np.int64))
    np.cumsum(values, out=total[1:])
    return np.diff(total[at])
