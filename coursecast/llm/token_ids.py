"""Ids of whole texts exactly as the tokenizers library gives them, whole Arrow batches at a time.

Words are cut and hashed as arrays; the library sees each different word once per worker, and the ids of a
chunk of texts are one gather from what it gave. Words are the runs between white space, so this is exact
for tokenizers that never join anything across white space; all others get whole texts.
"""

from __future__ import annotations

import json
import os
import sys
from collections.abc import Iterator
from itertools import chain
from types import ModuleType

import numpy as np
import pyarrow as pa

from coursecast.llm.textops import SPACE, Chunk, chunks

MOST_WORDS = 2_000_000  # of a worker's memory of words, about 100 MB; beyond, it begins anew
LONG = 256  # bytes; longer words are not remembered
SLOT_BITS = 16  # of an empty memory; slots double so that at most half are taken

#: Bytes that may begin a white space character other than space and tab to carriage return, or a control
#: character on which libraries differ.
_LEAD = np.zeros(256, bool)
_LEAD[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True


def _other_space(buf: np.ndarray) -> np.ndarray:
    """Where white space beyond the plain one, or a separator control character, begins."""
    at = np.flatnonzero(_LEAD[buf])
    if not len(at):
        return at
    padded = np.concatenate([buf, np.zeros(2, np.uint8)])
    a, b, c = buf[at], padded[at + 1], padded[at + 2]
    odd = (a < 0x20) | ((a == 0xC2) & ((b == 0x85) | (b == 0xA0))) | ((a == 0xE1) & (b == 0x9A) & (c == 0x80))
    odd |= (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
    odd |= ((a == 0xE2) & (b == 0x81) & (c == 0x9F)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
    return at[odd]


def _places(buf: np.ndarray, mark: bytes) -> np.ndarray:
    """Where ``mark`` begins."""
    if len(mark) == 1:
        return np.flatnonzero(buf == mark[0])
    data, found = buf.tobytes(), []
    k = data.find(mark)
    while k >= 0:
        found.append(k)
        k = data.find(mark, k + 1)
    return np.array(found, np.int64)


def _kind(setting: dict) -> str:
    """How texts can be cut: ``spaced`` (a word takes one space before it, the rest of the white space has ids of
    its own), ``words`` (white space is dropped), or ``whole`` (not at all)."""
    plain = all(
        not (t.get("single_word") or t.get("lstrip") or t.get("rstrip")) and not any(c.isspace() for c in t["content"])
        for t in setting.get("added_tokens", [])
    )
    norm, pre = setting.get("normalizer"), setting.get("pre_tokenizer") or {}
    if not plain or setting.get("truncation") or (setting["model"].get("type") or "BPE") != "BPE":
        return "whole"
    if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space"):
        return "spaced"
    steps = pre.get("pretokenizers", [])
    if pre.get("type") == "Sequence" and len(steps) == 2 and norm and norm.get("type") == "Sequence":
        split, level = steps
        drops = split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert") and (
            split.get("pattern") == {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}
        )
        bytewise = level.get("type") == "ByteLevel" and level.get("use_regex") is False and not level.get("add_prefix_space")
        local = all(  # composes, folds case or replaces white space: nothing that reaches across white space
            n["type"] in ("NFC", "Lowercase") or n == {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
            for n in norm.get("normalizers", [])
        )
        if drops and bytewise and local:
            return "words"
    return "whole"


class TextEncoder:
    """Ids of texts by one tokenizer file, with a bounded memory of words."""

    def __init__(self, path: str, most_words: int = MOST_WORDS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        setting = json.loads(self.tokenizer.to_str())
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.kind = _kind(setting)
        self.special = [t["content"].encode() for t in setting.get("added_tokens", [])]
        self.between = self._separator(setting.get("added_tokens", []))
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.uint32
        self.most = most_words
        self._forget()

    def _separator(self, added: list[dict]) -> tuple[bytes, int] | None:
        """A text that ends every word and has one id, which no word has."""
        if self.kind == "spaced":
            mark = self.tokenizer.encode("\n", add_special_tokens=False).ids
            return (b"\n", mark[0]) if len(mark) == 1 else None
        if self.kind == "words" and added:
            return added[0]["content"].encode(), added[0]["id"]
        return None

    def _forget(self) -> None:
        self._slots(SLOT_BITS)
        self.n_words = self.n_ids = 0
        self.word_at = np.zeros(1 << 12, np.int32)
        self.word_len = np.zeros(1 << 12, np.int32)
        self.flat = np.zeros(1 << 14, self.dtype)

    def _slots(self, bits: int) -> None:
        self.bits = bits
        self.slot_hash = np.zeros(1 << bits, np.uint64)
        self.slot_word = np.full(1 << bits, -1, np.int32)

    def _known(self, hashes: np.ndarray) -> np.ndarray:
        """The number of the word with each hash, -1 if it has none."""
        number = np.full(len(hashes), -1, np.int64)
        slot = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        open_ = np.arange(len(hashes))
        while len(open_):
            word = self.slot_word[slot]
            hit = (word >= 0) & (self.slot_hash[slot] == hashes[open_])
            number[open_[hit]] = word[hit]
            on = (word >= 0) & ~hit
            open_, slot = open_[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return number

    def _remember(self, hashes: np.ndarray, number: np.ndarray) -> None:
        need = 2 * (self.n_words + len(hashes))
        if need > 1 << self.bits:
            old = np.flatnonzero(self.slot_word >= 0)
            hashes = np.concatenate([self.slot_hash[old], hashes])
            number = np.concatenate([self.slot_word[old], number])
            self._slots((need - 1).bit_length())
        slot = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(slot):
            free = self.slot_word[slot] < 0
            self.slot_word[slot[free]] = number[free]
            mine = self.slot_word[slot] == number  # of several at a free slot one has got it
            self.slot_hash[slot[mine]] = hashes[mine]
            hashes, number, slot = hashes[~mine], number[~mine], (slot[~mine] + 1) & ((1 << self.bits) - 1)

    def _place(self, number: int, at: int, ids: np.ndarray, lengths: np.ndarray) -> int:
        """Put ids behind the first ``at`` as words ``number`` and on; the end of them."""
        end = at + len(ids)
        for name, need in (("word_at", number + len(lengths)), ("word_len", number + len(lengths)), ("flat", end)):
            old = getattr(self, name)
            if need > len(old):
                new = np.zeros(max(need, 2 * len(old)), old.dtype)
                new[: len(old)] = old
                setattr(self, name, new)
        self.word_len[number : number + len(lengths)] = lengths
        self.word_at[number : number + len(lengths)] = at + np.cumsum(lengths) - lengths
        self.flat[at:end] = ids
        return end

    def _ask(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of byte ranges by the library, how many each has, and the order in which the ranges come.

        Many words go as one text with a separator between that has an id of its own: a line feed if white space has
        ids, else a special token. White space, and words with special tokens, go by themselves.
        """
        size = end - start
        at = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=at[1:])
        place = np.repeat(start - at[:-1], size)
        place += np.arange(at[-1])
        data = buf[place]  # the pieces in a row
        if self.between is None:
            alone = np.ones(len(size), bool)
        else:
            alone = SPACE[buf[start]] & (SPACE[buf[np.minimum(start + 1, len(buf) - 1)]] | (size < 2))
            odd = [_other_space(data), *(_places(data, s) for s in {self.between[0], *self.special})]
            alone[np.searchsorted(at, np.concatenate(odd), "right") - 1] = True
        texts = [data[at[k] : at[k + 1]].tobytes().decode() for k in np.flatnonzero(alone).tolist()]
        alone_ids, alone_lengths = self._library(texts)
        if alone.all():
            return alone_ids, alone_lengths, np.arange(len(size))
        mark, mark_id = self.between
        many = np.flatnonzero(~alone)
        data, size = data[np.repeat(~alone, size)], size[many]
        joined = np.empty(len(data) + len(many) * len(mark), np.uint8)
        joined[np.arange(len(data)) + np.repeat(np.arange(len(many)) * len(mark), size)] = data
        last = np.cumsum(size + len(mark))
        for k, byte in enumerate(mark):
            joined[last - len(mark) + k] = byte
        edges = [0, *last[63:-1:64].tolist(), len(joined)]
        ids, lengths = self._library([joined[lo:to].tobytes().decode() for lo, to in zip(edges, edges[1:])])
        cut = np.flatnonzero(ids == mark_id)
        if not np.array_equal(np.searchsorted(cut, np.cumsum(lengths)), np.searchsorted(last, edges[1:], "right")):
            raise ValueError("the tokenizer joins words with what stands between them")
        return (
            np.concatenate([ids[ids != mark_id], alone_ids]),
            np.concatenate([np.diff(cut, prepend=-1) - 1, alone_lengths]),
            np.concatenate([many, np.flatnonzero(alone)]),
        )

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each has."""
        found = [f.ids for f in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        lengths = np.array([len(ids) for ids in found], np.int64)
        return np.fromiter(chain.from_iterable(found), self.dtype, lengths.sum()), lengths

    def _numbers(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The number of each piece's word; words not met before are given to the library together."""
        number = self._known(hashes)
        long = end - start > LONG
        miss = np.flatnonzero((number < 0) & ~long)
        if len(miss):
            some, first, back = np.unique(hashes[miss], return_index=True, return_inverse=True)
            at = miss[first]
            mine = np.empty(len(some), np.int64)
            for lo in range(0, len(at), 4096):
                part = at[lo : lo + 4096]
                ids, lengths, order = self._ask(buf, start[part], end[part])
                self.n_ids = self._place(self.n_words + lo, self.n_ids, ids, lengths)
                mine[lo + order] = self.n_words + lo + np.arange(len(part))
            self._remember(some, mine)
            self.n_words += len(some)
            number[miss] = mine[back]
        at = np.flatnonzero(long)
        behind, end_ids = self.n_words, self.n_ids  # behind the words that are kept, for this chunk only
        for lo in range(0, len(at), 64):
            part = at[lo : lo + 64]
            ids, lengths, order = self._ask(buf, start[part], end[part])
            end_ids = self._place(behind, end_ids, ids, lengths)
            number[part[order]] = np.arange(behind, behind + len(part))
            behind += len(part)
        return number

    def _pieces(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Where the byte ranges begin and end that are encoded by themselves."""
        if self.kind == "words":
            return chunk.start, chunk.end
        buf, n = chunk.buf, len(chunk.buf)
        edge = np.zeros(n + 1, bool)
        if self.kind == "spaced":
            first = np.zeros(n + 1, bool)
            first[chunk.text_at] = True
            gap = ~first[chunk.start]  # white space of the same text comes before
            gap &= SPACE[buf[chunk.start - 1]]
            edge[chunk.start[gap] - 1] = True
            edge[chunk.start[~(gap & (buf[chunk.start - 1] == 32))]] = True
            edge[chunk.end] = True
            for k in self._uncut(chunk):
                edge[chunk.text_at[k] : chunk.text_at[k + 1]] = False
        edge[chunk.text_at] = True
        edge[n] = False
        start = np.flatnonzero(edge)
        return start, np.append(start[1:], n)

    def _uncut(self, chunk: Chunk) -> list[int]:
        """Texts with special tokens or other white space, where neighbours matter."""
        at = np.concatenate([_other_space(chunk.buf), *(_places(chunk.buf, s) for s in self.special)])
        return np.unique(np.searchsorted(chunk.text_at, at, "right") - 1).tolist()

    def encode_chunk(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a chunk, and the offsets at which each begins (and the end)."""
        if self.n_words > self.most:
            self._forget()
        start, end = self._pieces(chunk)
        if not len(start):
            return np.zeros(0, self.dtype), np.zeros(len(chunk) + 1, np.int64)
        number = self._numbers(chunk.buf, start, end, chunk.hashes(start, end))
        length = self.word_len[number]
        at = np.zeros(len(number) + 1, np.int64)
        np.cumsum(length, out=at[1:])
        place = np.repeat(self.word_at[number] - at[:-1], length)
        place += np.arange(at[-1])
        return self.flat[place], at[np.searchsorted(start, chunk.text_at)]

    def encode_texts(self, texts: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Index of its first text, ids and offsets of each chunk; null is an empty text."""
        for chunk in chunks(texts):
            yield chunk.first, *self.encode_chunk(chunk)

    def encode(self, text: str) -> bytes:
        """The ids of one text, little-endian."""
        ids = [ids for _, ids, _ in self.encode_texts(pa.array([text]))]
        return np.concatenate(ids).astype(np.dtype(self.dtype).newbyteorder("<")).tobytes()


def worker_encoder(path: str, most_words: int = MOST_WORDS) -> TextEncoder:
    """The encoder of this Python worker, which serves many tasks; a worker keeps one at a time."""
    kept = sys.modules.setdefault("coursecast_llm_worker", ModuleType("coursecast_llm_worker")).__dict__
    if kept.get("key") != (path, most_words):
        kept["key"], kept["encoder"] = (path, most_words), TextEncoder(path, most_words)
    return kept["encoder"]
