"""Fill-in-middle transformation by in-place rotation of blocks, and its inverse."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coursecast.llm.textops import SPACE, Chunk, chunks

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED = 42
FIM_PERCENT = 50
SPM_PERCENT = 80


def rotate(buf: bytearray, start: int, mid: int, end: int) -> None:
    """Exchange ``buf[start:mid]`` and ``buf[mid:end]`` in place, by three reversals."""
    view = np.frombuffer(buf, np.uint8)
    for a, b in ((start, mid), (mid, end), (start, end)):
        half = (b - a) // 2
        low, high = view[a : a + half], view[b - half : b][::-1]
        kept = low.copy()
        low[:] = high
        high[:] = kept


def transform(text: bytes, cut1: int, cut2: int, form: str) -> bytearray:
    """The text as prefix, middle and suffix (cut at two byte offsets) in the order of ``form``, psm or spm."""
    buf = bytearray(text)
    buf[cut2:cut2] = SUFFIX
    buf[cut1:cut1] = MIDDLE
    buf[0:0] = PREFIX
    middle, suffix = cut1 + len(PREFIX), cut2 + len(PREFIX) + len(MIDDLE)
    if form == "psm":
        rotate(buf, middle, suffix, len(buf))
    else:
        rotate(buf, 0, suffix, len(buf))
    return buf


def restore(output: bytes | bytearray, form: str) -> bytearray:
    """The text of a transformed one. Texts hold no sentinel, so the first of each kind is the one put in."""
    buf = bytearray(output)
    if form == "psm":
        suffix, middle = buf.index(SUFFIX), buf.rindex(MIDDLE)
        rotate(buf, suffix, middle, len(buf))
    elif form == "spm":
        rotate(buf, 0, buf.index(PREFIX), len(buf))
    else:
        return buf
    at = buf.rindex(SUFFIX)
    del buf[at : at + len(SUFFIX)]
    at = buf.index(MIDDLE)
    del buf[at : at + len(MIDDLE)]
    del buf[: len(PREFIX)]
    return buf


def units(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Per text its number of units (a word with the white space before it; white space at the end), and whether it
    ends in white space."""
    n_bytes = np.diff(chunk.text_at)
    trail = np.zeros(len(chunk), bool)
    some = n_bytes > 0
    trail[some] = SPACE[chunk.buf[chunk.text_at[1:][some] - 1]]
    return chunk.n_words() + trail, trail


def cut_at(chunk: Chunk, n_units: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Where, in the chunk's bytes, the first ``k`` units of each text end."""
    words = chunk.n_words()
    out = chunk.text_at[:-1].copy()
    inside = (k > 0) & (k <= words)
    out[inside] = chunk.end[chunk.word_at[:-1][inside] + k[inside] - 1]
    beyond = (k > words) & (k > 0)
    out[beyond] = chunk.text_at[1:][beyond]
    return out


KINDS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary, restored_sha256 string"


def filled_middle(docs: DataFrame, *, seed: int = SEED, percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT,
                  text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n`` (units), ``form`` (plain, psm, spm), ``prefix_chars``, ``middle_chars``, ``output`` (UTF-8) and
    ``restored_sha256`` of every row.

    Cuts and form come from the sha256 of ``seed:doc_id`` alone, so reruns agree. A null text is empty; empty texts, and
    those with a sentinel, stay plain, with null counts. Repeated rows each get their row; a row without id is hashed as
    if its id were the empty text. Other columns are ignored; an empty table gives an empty result. One pass over the
    texts, nothing is shuffled.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *h)

    def one(text: bytes, cut1: int, cut2: int, form: str) -> tuple[bytes, str]:
        output = bytes(transform(text, cut1, cut2, form)) if form != "plain" else text
        return output, hashlib.sha256(restore(output, form)).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            draws = [batch.column(2 + k).to_numpy() for k in range(4)]
            for chunk in chunks(batch.column(1)):
                to = chunk.first + len(chunk)
                h1, h2, h3, h4 = (d[chunk.first : to] for d in draws)
                n, _ = units(chunk)
                first, second = h1 % (n + 1), h2 % (n + 1)
                cuts = [cut_at(chunk, n, np.minimum(first, second)), cut_at(chunk, n, np.maximum(first, second))]
                chars = np.zeros(len(chunk.buf) + 1, np.int64)
                np.cumsum((chunk.buf & 0xC0) != 0x80, out=chars[1:])
                prefix, middle = chars[cuts[0]] - chars[chunk.text_at[:-1]], chars[cuts[1]] - chars[cuts[0]]
                texts = [chunk.buf[a:b].tobytes() for a, b in zip(chunk.text_at[:-1], chunk.text_at[1:])]
                plain = np.array([not t or PREFIX in t or SUFFIX in t or MIDDLE in t for t in texts], bool) | (h3 % 100 >= percent)
                form = np.where(plain, "plain", np.where(h4 % 100 < spm_percent, "spm", "psm")).tolist()
                at = [(c - chunk.text_at[:-1]).tolist() for c in cuts]
                done = [one(*x) for x in zip(texts, *at, form)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(chunk.first, len(chunk)), pa.array(n, pa.int64()), pa.array(form, pa.string()),
                        pa.array(prefix, pa.int64(), mask=plain), pa.array(middle, pa.int64(), mask=plain),
                        pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string()),
                    ],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored_sha256"],
                )

    return rows.mapInArrow(run, KINDS)


def fill_middle_index(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``filled_middle`` with ``output_sha256`` in place of the output."""
    done = filled_middle(docs, **settings)
    return done.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), "restored_sha256"
    )


#: The query ``op13_fill_middle`` in DuckDB's SQL.
ORACLE = r"""
with words as (
    select doc_id, coalesce(text, '') as text, sha256('42:' || coalesce(cast(doc_id as varchar), '')) as digest,
           regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as unit
    from documents
), drawn as (
    select *, len(unit) as n, cast('0x' || digest[1:8] as bigint) as h1, cast('0x' || digest[9:16] as bigint) as h2,
           cast('0x' || digest[17:24] as bigint) % 100 as h3, cast('0x' || digest[25:32] as bigint) % 100 as h4
    from words
), cut as (
    select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
           case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 >= 50 then 'plain'
                when h4 < 80 then 'spm' else 'psm' end as form
    from drawn
), parts as (
    select *, array_to_string(unit[1:a], '') as prefix, array_to_string(unit[a + 1:b], '') as middle,
           array_to_string(unit[b + 1:], '') as suffix
    from cut
)
select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then length(prefix) end as prefix_chars,
       case when form <> 'plain' then length(middle) end as middle_chars,
       sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
       sha256(text) as restored_sha256
from parts
"""
