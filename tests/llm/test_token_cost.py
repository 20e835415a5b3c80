"""What the token operator spends on a word, and that its buffers stay as they were."""

from __future__ import annotations

import sys
import zlib

import numpy as np
import pyarrow as pa

from coursecast.llm import range_coder, registry
from coursecast.llm.token_ids import TextEncoder

CRCS = [(1, "many", 929182779), (2049, "many", 280713325), (5000, "skewed", 1862614299), (70000, "skewed", 1278897353)]


def test_new_words_are_not_handled_one_by_one():
    encoder = TextEncoder(registry.tokenizer_path())
    words = [f"{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}x{k}" for k in range(4000)]
    texts = pa.array([" ".join(words[lo : lo + 100]) for lo in range(0, 4000, 100)])
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        got = [ids for _, ids, _ in encoder.encode_texts(texts)]
    finally:
        sys.setprofile(None)
    assert calls < 2000
    want = [i for t in texts.to_pylist() for i in encoder.tokenizer.encode(t, add_special_tokens=False).ids]
    assert np.concatenate(got).tolist() == want


def test_words_that_go_alone_stand_among_others():
    texts = ["one<|endoftext|>two three", "a\x85b c", "\n\n x \t\n", "", "é, ü. naïve", "plain words here", " \n", "x\n"]
    encoder = TextEncoder(registry.tokenizer_path())
    library = encoder.tokenizer
    for _, ids, at in encoder.encode_texts(pa.array(texts)):
        got = [ids[a:b].tolist() for a, b in zip(at, at[1:])]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_memory_of_words_grows_with_them():
    encoder = TextEncoder(registry.tokenizer_path())
    assert encoder.slot_hash.nbytes + encoder.slot_word.nbytes < 1 << 20
    texts = pa.array([" ".join(f"w{k}" for k in range(lo, lo + 1000)) for lo in range(0, 90_000, 1000)] * 2)
    got = np.concatenate([ids for _, ids, _ in encoder.encode_texts(texts)])
    assert 90_000 <= encoder.n_words <= len(encoder.slot_word) // 2
    some = [0, 45_000, 89_000]
    want = {lo: encoder.tokenizer.encode(texts[lo // 1000].as_py(), add_special_tokens=False).ids for lo in some}
    assert got[: len(want[0])].tolist() == want[0] and got[-len(want[89_000]) :].tolist() == want[89_000]
    assert np.array_equal(got[: len(got) // 2], got[len(got) // 2 :])


def test_buffers_are_those_of_earlier_versions():
    rng = np.random.default_rng(7)
    for n, kind, crc in CRCS:
        ids = rng.integers(0, 65536, n) if kind == "many" else rng.zipf(1.3, n) % 65536
        assert zlib.crc32(range_coder.encode(ids.astype(np.uint16))) == crc
