"""Merkle manifest, packing and fill-in-middle against plain calculations, with the odd cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from coursecast.llm import merkle, registry
from coursecast.llm.fill_middle import fill_middle_index, filled_middle, restore, rotate, transform
from coursecast.llm.packing import Packer, Piece, fullest, packed, packing_index
from coursecast.llm.token_ids import TextEncoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (4, "One", "en", "b", 3), (-7, "X y", "en", "b", 3),
    (5, "word " * 30_000, "en", "b", 150_000), (6, "tie tie tie", "en", "c", 11), (6, "tie tie tie", "en", "c", 11), (6, "other", "en", "c", 5),
    (None, "no id Here", "en", None, 10), (None, "none", "en", None, 10), (8, "x" * 50_000, "de", "a", 50_000),
    (9, "É ñ 日本 \U0001f600 a<P>b", "es", "a", 8), (1 << 62, "far", "en", "a", 3), (-(1 << 63), "least", "en", "a", 5), (10, "<S", "", "a", 2),
]
UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def odd(spark):
    more = ["g", "pos", "leaf", "word", "bit", "slots", "steps", "h1", "ids", "n", "sequence_id", "text_"]
    return spark.createDataFrame(ODD, SCHEMA).select("*", *[F.lit("x").alias(c) for c in more])


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


# --- Merkle manifest ---------------------------------------------------------------------------------------------


def plain_tree(nodes: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """Root of the nodes, and the left and right siblings on each node's way up."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for way, k in zip(ways, at):
            lo = k - k % 8
            way.append(("".join(nodes[lo:k]), "".join(nodes[k + 1 : lo + 8])))
        nodes, at = [sha("".join(nodes[k : k + 8])) for k in range(0, len(nodes), 8)], [k // 8 for k in at]
    return nodes[0], ways


def plain_manifest(rows: list[tuple]) -> list[tuple]:
    def leaf(doc_id, text, lang, source, n_chars):
        parts = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)]
        return sha("".join(parts))

    groups = defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        seen = text
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0 and text is not None:
            seen = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        groups[lang].append((doc_id, leaf(doc_id, text, lang, source, n_chars), leaf(doc_id, seen, lang, source, n_chars)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        trees[g] = plain_tree([r[1] for r in groups[g]])
    root, above = plain_tree([trees[g][0] for g in names])
    out = []
    for g, up in zip(names, above):
        for (doc_id, first, seen), way in zip(groups[g], trees[g][1]):
            for left, right in (way := way + up):
                seen = sha(left + seen + right)
            out.append((doc_id, first, trees[g][0], root, sha("".join(a + b for a, b in way)), seen, seen == root))
    return sorted(out, key=repr)


def as_rows(df) -> list[tuple]:
    return sorted(map(tuple, df.collect()), key=repr)


def test_manifest_of_odd_rows(odd):
    got = as_rows(merkle.manifest(odd))
    assert got == plain_manifest(ODD)
    assert [c for c in merkle.manifest(odd.limit(0)).columns] == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert merkle.manifest(odd.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 8, 9, 64, 65, 513])
def test_manifest_sizes(spark, n):
    """Group sizes around the powers of the run, ids far apart."""
    rng = random.Random(n)
    ids = rng.sample(range(-(1 << 40), 1 << 40), n)
    rows = [(i, f"T {i}", "en", "s", 3) for i in ids] + [(k, "U", f"lang{k}", None, None) for k in range(n % 70)]
    assert as_rows(merkle.manifest(spark.createDataFrame(rows, SCHEMA))) == plain_manifest(rows)


def test_rows_with_one_id_keep_their_places(spark):
    """A third of the rows share an id (some of them equal), another part has none."""
    rng = random.Random(5)
    rows = [(k, f"T{k}", "en", "s", 1) for k in range(300)] + [(77, f"t{rng.randrange(60)}", "en", "s", 1) for _ in range(300)]
    rows += [(None, f"n{k % 50}", "en", "s", 1) for k in range(200)]
    got = as_rows(merkle.manifest(spark.createDataFrame(rows, SCHEMA)))
    assert got == plain_manifest(rows)


def test_tampering_is_found(spark, sf):
    got = merkle.manifest(spark.read.parquet(f"{sf}/documents.parquet")).toPandas()
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = {d: zlib.crc32(str(d).encode()) % 3 != 0 or not re.search("[A-Z]", t) for d, t in text.items()}
    assert dict(zip(got.doc_id, got.verified)) == want


# --- packing -----------------------------------------------------------------------------------------------------


def test_fullest_choice():
    rng = random.Random(1)
    for _ in range(300):
        counts = {rng.randrange(1, 40): rng.randrange(1, 4) for _ in range(rng.randrange(0, 5))}
        room = rng.randrange(1, 90)
        best = max(s for s in (sum(n * k for n, k in zip(counts, take)) for take in product(*[range(c + 1) for c in counts.values()])) if s <= room)
        taken = fullest(counts, room)
        assert sum(n * k for n, k in taken.items()) == best and all(0 < k <= counts[n] for n, k in taken.items())


@pytest.mark.parametrize("window,pool", [(16, 4), (16, 50), (2048, 4096)])
def test_packer_fills_windows(window, pool):
    rng, rows = random.Random(window + pool), []
    packer = Packer(rows.append, window, pool)
    lengths = [rng.randrange(1, window * 2) for _ in range(300)]
    for name, n in enumerate(lengths):
        packer.add(Piece(name, 0, n, np.arange(n)))
    packer.finish()
    sizes = [sum(len(p.ids) for p in row) for row in rows]
    assert sum(sizes) == sum(lengths) and all(s == window or s & (s - 1) == 0 for s in sizes)
    for name, n in enumerate(lengths):
        mine = sorted((p for row in rows for p in row if p.name == name), key=lambda p: p.start)
        assert np.array_equal(np.concatenate([p.ids for p in mine]), np.arange(n)) and all(p.ids[0] == p.start and p.whole == n for p in mine)


def packing_is_right(pieces, ids_of):
    """Every id of every document lies in one piece; sequences are gapless and full, or of a power of two."""
    docs, rows = defaultdict(list), defaultdict(list)
    for p in pieces:
        docs[p.doc_id].append(p)
        rows[p.sequence_id].append(p)
    for name, mine in docs.items():
        want = ids_of[name]
        mine.sort(key=lambda p: p.start)
        assert [p.start for p in mine] == list(np.cumsum([0, *[p.length for p in mine]]))[:-1] and sum(p.length for p in mine) == len(want)
        for p in mine:
            assert p.doc_tokens == len(want) and p.ids_crc32 == zlib.crc32(np.array(want[p.start : p.start + p.length], "<u4").tobytes())
    for mine in rows.values():
        mine.sort(key=lambda p: p.offset)
        n = sum(p.length for p in mine)
        assert [p.offset for p in mine] == list(np.cumsum([0, *[p.length for p in mine]]))[:-1] and (n == 2048 or n & (n - 1) == 0) and n <= 2048
    assert set(docs) == set(ids_of)


def test_packing(spark, sf):
    path = registry.tokenizer_path("word_bpe_49k.json")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    library = TextEncoder(path).tokenizer
    ids_of = {r.doc_id: [*library.encode(r.text or "", add_special_tokens=False).ids, 1] for r in docs.collect()}
    packing_is_right(packing_index(docs, tokenizer=path).collect(), ids_of)
    whole = packed(docs, tokenizer=path).filter("doc_id = 5").orderBy("start").collect()
    assert np.frombuffer(b"".join(bytes(p.ids) for p in whole), "<u4").tolist() == ids_of[5]


def test_packing_of_odd_rows(odd):
    path = registry.tokenizer_path("word_bpe_49k.json")
    got = packing_index(odd, tokenizer=path)
    library = TextEncoder(path).tokenizer
    want = sum(len(library.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in ODD)
    rows = got.collect()
    assert sum(p.length for p in rows) == want and {p.doc_id for p in rows} == {r[0] for r in ODD}
    assert packing_index(odd.limit(0), tokenizer=path).count() == 0
    once = {r[0]: [*library.encode(r[1] or "", add_special_tokens=False).ids, 1] for r in ODD if r[0] not in (6, None)}
    packing_is_right(packing_index(odd.filter("doc_id <> 6"), tokenizer=path).collect(), once)


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_the_library_s(file):
    rng = random.Random(3)
    parts = ["a", "B", "'s", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "　", " ", "é", "é", "́", "日本", "1", "²", "!", "..",
             "<|endoftext|>", "<|startoftext|>", "Σ", "ΑΣ", "İ", "x" * 300, "\r\n", "ﬁ", "_", "\U0001f600", "\x00"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    encoder = TextEncoder(registry.tokenizer_path(file), most_words=500)  # forgets often
    import pyarrow as pa

    assert encoder.kind in ("words", "spaced")
    got = []
    for lo in range(0, len(texts), 100):
        for _, ids, at in encoder.encode_texts(pa.array(texts[lo : lo + 100])):
            got += [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]
    assert got == [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]


# --- fill in the middle ------------------------------------------------------------------------------------------


def plain_middle(doc_id, text):
    text = text or ""
    unit = UNITS.findall(text)
    digest = sha(f"42:{'' if doc_id is None else doc_id}")
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(unit) + 1) for x in h[:2])
    p, m, s = "".join(unit[:a]), "".join(unit[a:b]), "".join(unit[b:])
    plain = not text or any(t in text for t in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50
    form = "plain" if plain else "spm" if h[3] % 100 < 80 else "psm"
    out = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
    return doc_id, len(unit), form, None if plain else len(p), None if plain else len(m), sha(out), sha(text)


def test_middles_of_odd_rows(odd):
    assert as_rows(fill_middle_index(odd)) == sorted((plain_middle(r[0], r[1]) for r in ODD), key=repr)
    assert fill_middle_index(odd.limit(0)).count() == 0
    forms = {r.form for r in filled_middle(odd, percent=100).collect()}
    assert forms == {"plain", "spm", "psm"}


@pytest.mark.parametrize("form", ["psm", "spm"])
def test_rotations_are_undone(form):
    rng = random.Random(7)
    for _ in range(500):
        text = "".join(rng.choice(["<", "P", "S>", "M", ">", "é", " ", "日"]) for _ in range(rng.randrange(1, 12))).encode()
        if any(s in text for s in (b"<P>", b"<S>", b"<M>")):
            continue
        a, b = sorted(rng.randrange(len(text) + 1) for _ in range(2))
        got = bytes(transform(text, a, b, form))
        p, m, s = text[:a], text[a:b], text[b:]
        assert got == (b"<P>" + p + b"<S>" + s + b"<M>" + m if form == "psm" else b"<S>" + s + b"<P>" + p + b"<M>" + m)
        assert bytes(restore(got, form)) == text


def test_rotate():
    for n in range(7):
        for a in range(n + 1):
            for m in range(a, n + 1):
                for b in range(m, n + 1):
                    buf = bytearray(range(n))
                    rotate(buf, a, m, b)
                    x = list(range(n))
                    assert list(buf) == x[:a] + x[m:b] + x[a:m] + x[b:]
