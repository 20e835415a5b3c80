"""Substring dedup: repeated passages found in FM-indexes, by backward search over wavelet matrices."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coursecast.llm.bits import bit_table, in_table
from coursecast.llm.textops import Chunk, chunks, split_words, whole_windows, windows
from coursecast.sources.scratch import settle

LENGTH = 50  # words of a repeated passage, at least
GRAM = 8  # words of an anchor
HOT_PASSAGES = 20_000
SHARD_WORDS = 400_000
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


class FmIndex:
    """Index of many word sequences for patterns of up to 63 words.

    The transform is sorted by 64 words, which is all that backward search over such patterns needs. It is held
    as a wavelet matrix: one bit per symbol and level, packed, with a running count per 64 bits.
    """

    DEPTH = 64

    def __init__(self, symbols: np.ndarray, keep: tuple[int, ...]) -> None:
        """``symbols`` are numbers from 0, where 0 stands behind each sequence. For each length in ``keep``,
        ``runs[length]`` has the first and the last-plus-one place of suffixes that begin with the same words."""
        n = len(symbols)
        rank = {1: symbols.astype(np.int64)}
        h = 1
        while h < self.DEPTH:
            rank[2 * h] = self._pair(rank[h], rank[h], h)
            h *= 2
        order = np.argsort(rank[h], kind="stable")
        self.place = order  # where each suffix begins
        self.runs = {}
        for length in keep:
            half = 1 << (length - 1).bit_length() - 1  # two overlapping halves give the length
            name = self._pair(rank[half], rank[half], length - half)[order]
            begin = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
            size = np.diff(np.append(begin, n))
            self.runs[length] = np.repeat(begin, size), np.repeat(begin + size, size)
        last = symbols[order - 1]  # the word before each suffix
        self.levels = max(1, int(symbols.max()).bit_length())
        self.bits, self.counts, self.zeros = [], [], []
        counts = np.bincount(symbols, minlength=1 << self.levels)
        now = last
        for level in range(self.levels - 1, -1, -1):
            bit = ((now >> level) & 1).astype(bool)
            packed = np.packbits(np.concatenate([bit, np.zeros(-n % 64 + 64, bool)]), bitorder="little").view(np.uint64)
            self.bits.append(packed)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)[:-1]]))
            self.zeros.append(n - int(bit.sum()))
            now = np.concatenate([now[~bit], now[bit]])
        before = np.concatenate([[0], np.cumsum(counts)[:-1]])
        every = np.arange(1 << self.levels)
        self.shift = before - self._down(every, np.zeros(len(every), np.int64))

    @staticmethod
    def _pair(left: np.ndarray, right: np.ndarray, apart: int) -> np.ndarray:
        """Ranks of (left[i], right[i + apart]); what lies beyond the end comes first."""
        moved = np.zeros(len(left), np.int64)
        moved[: max(len(left) - apart, 0)] = right[apart:] + 1
        return np.unique(left * (int(right.max()) + 2) + moved, return_inverse=True)[1]

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How far the first ``at`` places lead when they follow the symbol's bits through the levels."""
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            word, left = at >> 6, (at & 63).astype(np.uint64)
            ones = self.counts[k][word] + np.bitwise_count(self.bits[k][word] & ((np.uint64(1) << left) - np.uint64(1)))
            at = np.where((symbol >> level) & 1, self.zeros[k] + ones, at - ones)
        return at

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes that begin with ``symbol`` and then with what those in ``low`` to ``high`` begin with."""
        both = self._down(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        both += np.concatenate([self.shift[symbol]] * 2)
        return both[: len(symbol)], both[len(symbol) :]


def repeated_in_smaller(passages: list[np.ndarray], docs: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """Per passage, which of its windows also stand in a passage of a smaller document.

    All passages are indexed, then streamed through the index from their last word to their first. The state of
    each is its longest match, up to ``length``, as an interval of suffixes. It is cut to ``length - 1`` words,
    which widens it to the run of suffixes that share them, and extended to the left by the next word. Where it
    has ``length`` words, the smallest document in the interval decides.
    """
    sizes = np.array([len(p) for p in passages])
    names, coded = np.unique(np.concatenate(passages), return_inverse=True)
    coded = coded + 1
    at = np.concatenate([[0], np.cumsum(sizes + 1)])
    text = np.zeros(at[-1], np.int64)
    owner = np.repeat(np.arange(len(passages)), sizes + 1)
    inside = np.ones(len(text), bool)
    inside[at[1:] - 1] = False
    text[inside] = coded
    index = FmIndex(text, (length - 1, length))
    short_first, short_end = index.runs[length - 1]
    first, _ = index.runs[length]
    begin = np.unique(first)
    smallest = np.zeros(len(text), np.int64)
    smallest[begin] = np.minimum.reduceat(docs[owner[index.place]], begin)

    order = np.argsort(-sizes, kind="stable")
    low, high = np.zeros(len(order), np.int64), np.full(len(order), len(text))
    found = [np.zeros(max(0, s - length + 1), bool) for s in sizes]
    flat = np.concatenate(found)
    flat_at = np.concatenate([[0], np.cumsum(np.maximum(0, sizes - length + 1))])
    running = sizes[order]
    for step in range(int(sizes.max())):
        k = int(np.searchsorted(-running, -step, "left"))  # those with more than step words
        mine = order[:k]
        if step >= length:
            low[:k], high[:k] = short_first[low[:k]], short_end[high[:k] - 1]
        word = sizes[mine] - 1 - step
        low[:k], high[:k] = index.extend(text[at[mine] + word], low[:k], high[:k])
        if step >= length - 1:
            flat[flat_at[mine] + word] = smallest[first[low[:k]]] < docs[mine]
    return np.split(flat, flat_at[1:-1])


STRETCH = 1 << 22  # windows whose anchors are found together


def least_places(h: np.ndarray, span: int) -> np.ndarray:
    """Where, for each run of ``span`` numbers, the least one stands; the first of those equal in their 40 leading bits.

    Numbers and places share 64 bits, so long texts are taken in overlapping stretches, whose places fit.
    """
    n = len(h) - span + 1
    out = np.empty(max(n, 0), np.int64)
    low = np.uint64((1 << 24) - 1)
    for lo in range(0, n, STRETCH):
        mine = h[lo : lo + STRETCH + span - 1]
        least = (mine & ~low) | np.arange(len(mine), dtype=np.uint64)
        width, many = 1, len(mine) - span + 1
        while 2 * width <= span:
            least = np.minimum(least[: len(least) - width], least[width:])
            width *= 2
        if width < span:
            least = np.minimum(least[:many], least[span - width : span - width + many])
        out[lo : lo + many] = (least[:many] & low).astype(np.int64) + lo
    return out


def anchors(chunk: Chunk) -> tuple[np.ndarray, ...]:
    """Runs of windows of ``LENGTH`` words that have the same anchor: the least of the hashes of their grams.

    Equal windows have equal anchors, wherever they stand. Returns text, first word within it, number of
    windows, the anchor's hash and the hash of the run's words.
    """
    words = chunk.hashes(chunk.start, chunk.end)
    n = len(words) - LENGTH + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    grams = windows(words, GRAM)
    at = least_places(grams, LENGTH - GRAM + 1)
    one_text = whole_windows(chunk.word_at, LENGTH, len(words))
    owner = chunk.owner()[:n]
    fresh = np.ones(n, bool)
    fresh[1:] = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1]) | ~one_text[:-1]
    start = np.flatnonzero(fresh & one_text)
    edges = np.flatnonzero(np.append(fresh | ~one_text, True))
    count = edges[np.searchsorted(edges, start, "right")] - start
    sums = np.concatenate([[np.uint64(0)], np.cumsum(words * _powers(_BASE, len(words)), dtype=np.uint64)])
    whole = (sums[start + count + LENGTH - 1] - sums[start]) * _powers(pow(_BASE, -1, 1 << 64), len(words))[start]
    whole ^= count.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return owner[start], start - chunk.word_at[owner[start]], count, grams[at[start]], whole


_BASE = 0xC2B2AE3D27D4EB4F


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _runs(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(2)):
                text, first, count, anchor, whole = anchors(c)
                at = pa.array(text + c.first)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.view(np.int64)), pa.array(whole.view(np.int64)), batch.column(0).take(at), batch.column(1).take(at),
                     pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32))],
                    ["anchor", "passage", "doc_id", "row", "first", "count"],
                )

    kinds = "anchor long, passage long, doc_id long, row long, first int, count int"
    return docs.filter("doc_id is not null").mapInArrow(run, kinds)


def _marks(docs: DataFrame, rows: DataFrame):
    """A broadcast bit table of the ``row`` values of ``rows``; a row that is not marked is surely not among them.

    Few rows leave most texts out of the shuffle behind it; many rows fill the table, and then all texts go there.
    """
    return docs.sparkSession.sparkContext.broadcast(bit_table(rows, "row"))


def _is_marked(marks, batch: pa.RecordBatch) -> pa.Array:
    return pa.array(in_table(marks.value, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))


def _marked(docs: DataFrame, marks) -> DataFrame:
    """The marked ones of ``docs`` (``doc_id``, ``row``, ``text``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(_is_marked(marks, batch))

    return docs.mapInArrow(run, "doc_id long, row long, text string")


def _cut(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The word hashes of wanted passages (``row``, ``anchor``, ``passage``, ``first``, ``count``, ``hot``), each from one document."""
    lists = wanted.groupBy("row").agg(F.collect_list(F.struct("anchor", "passage", "first", "count", "hot")).alias("cuts"))
    texts = _marked(docs, _marks(docs, wanted)).dropDuplicates(["row"])
    texts = texts.join(lists, "row").select("doc_id", "text", "cuts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(1)):
                words = c.hashes(c.start, c.end)
                out = []
                for k in range(len(c)):
                    doc = batch.column(0)[c.first + k].as_py()
                    for cut in batch.column(2)[c.first + k].as_py():
                        at = c.word_at[k] + cut["first"]
                        out.append((cut["anchor"], cut["passage"], doc, cut["hot"], words[at : at + cut["count"] + LENGTH - 1].tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.int64()),
                     pa.array([o[3] for o in out], pa.bool_()), pa.array([o[4] for o in out], pa.binary())],
                    ["anchor", "passage", "doc_id", "hot", "words"],
                )

    return texts.mapInArrow(run, "anchor long, passage long, doc_id long, hot boolean, words binary")


def _segments(covered: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
    return [{"first": int(a), "count": int(b - a)} for a, b in zip(edge[::2], edge[1::2])]


_FOUND = pa.list_(pa.struct([("first", pa.int32()), ("count", pa.int32())]))


def _search(passages: DataFrame) -> DataFrame:
    """``passage`` and ``found``, its windows that a smaller document has too, from one FM-index per shard of anchors."""

    def solve(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        hits = repeated_in_smaller([np.frombuffer(r[2], np.uint64) for r in rows], np.array([r[1] for r in rows], np.int64))
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([_segments(h) for h in hits], _FOUND)], ["passage", "found"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, words, last = [], 0, None
        for batch in batches:
            for anchor, passage, doc, data in zip(*(c.to_pylist() for c in batch.columns)):
                if words >= SHARD_WORDS and anchor != last:  # an anchor's passages stay together
                    yield solve(rows)
                    rows, words = [], 0
                rows.append((passage, doc, data))
                words += len(data) // 8
                last = anchor
        if rows:
            yield solve(rows)

    dealt = passages.select("anchor", "passage", "doc_id", "words").repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(run, "passage long, found array<struct<first:int,count:int>>")


def _search_hot(passages: DataFrame) -> DataFrame:
    """The same for anchors with too many different passages for one shard: every window by itself, by its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for passage, doc, data in zip(*(c.to_pylist() for c in batch.columns)):
                h = windows(np.frombuffer(data, np.uint64), LENGTH)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(h), passage)), pa.array(np.full(len(h), doc)), pa.array(np.arange(len(h), dtype=np.int32)), pa.array(h.view(np.int64))],
                    ["passage", "doc_id", "first", "window"],
                )

    all_windows = passages.select("passage", "doc_id", "words").mapInArrow(run, "passage long, doc_id long, first int, window long")
    least = all_windows.groupBy("window").agg(F.min("doc_id").alias("least"))
    hits = all_windows.join(least, "window").filter("least < doc_id")
    return hits.groupBy("passage").agg(F.collect_list(F.struct("first", F.lit(1).alias("count"))).alias("found"))


def _without(text: bytes, removed: list[dict] | None) -> tuple[int, int, str]:
    words = WORD.findall(text)
    gone = 0
    if removed:
        change = np.zeros(len(words) + 1, np.int64)
        for r in removed:
            change[r["first"]] += 1
            change[min(r["first"] + r["count"] + LENGTH - 1, len(words))] -= 1
        keep = np.cumsum(change[:-1]) == 0
        gone = len(words) - int(keep.sum())
        words = [w for w, k in zip(words, keep) if k]
    return len(words) + gone, gone, hashlib.sha256(b" ".join(words)).hexdigest()


def repeated_passages(docs: DataFrame, *, hot_passages: int = HOT_PASSAGES) -> tuple[DataFrame, DataFrame]:
    """Rows (``doc_id``, ``row``, ``text``), and per ``row`` the windows (``first``, ``count``) that a smaller document has too.

    1. Windows of ``LENGTH`` words are named by an anchor, so that only runs of windows, about one in twenty, are
       shuffled. Anchors of one document alone are dropped.
    2. Equal runs are one passage, held by its smallest document; larger ones have all its windows repeated.
    3. Passages with the same anchor go to the same shard, and each shard's FM-index finds the windows that they
       have in common at other offsets. Anchors with over ``hot_passages`` passages are compared window by window.
    """
    runs = _runs(docs)
    anchor = runs.groupBy("anchor").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    shared = settle(anchor.filter("least < most").select("anchor"), "anchors")
    runs = settle(runs.join(shared, "anchor").dropDuplicates(["row", "first"]), "runs")
    holder = F.min(F.struct("doc_id", "row", "first", "count"))
    passages = settle(runs.groupBy("anchor", "passage").agg(holder.alias("at")).select("anchor", "passage", "at.*"), "passages")
    hot = passages.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > hot_passages).select("anchor", F.lit(True).alias("hot"))
    several = passages.groupBy("anchor").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).filter("x < y").select("anchor")
    wanted = passages.join(several, "anchor").join(hot, "anchor", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    cut = settle(_cut(docs, settle(wanted, "wanted")), "cut")
    inner = _search(cut.filter("not hot")).unionByName(_search_hot(cut.filter("hot")))
    inner = inner.select(F.col("passage").alias("_p"), "found")
    held = passages.select(F.col("passage").alias("_passage"), F.col("anchor").alias("_anchor"), F.col("doc_id").alias("holder"))
    rows = runs.join(held, (runs.anchor == F.col("_anchor")) & (runs.passage == F.col("_passage")))
    later = rows.filter("holder < doc_id").select("row", "first", "count")
    own = rows.filter("holder = doc_id").join(inner, F.col("passage") == F.col("_p")).select("row", "first", F.explode("found").alias("f"))
    own = own.select("row", (F.col("first") + F.col("f.first")).alias("first"), F.col("f.count").alias("count"))
    return docs, later.unionByName(own)


def without_repeats(docs: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed`` and ``kept_sha256`` of every row.

    A word goes if a window of 50 words over it also stands in a document with a smaller id. Texts of fewer words,
    null and empty ones lose nothing. Rows without id lose and lend nothing; repeated rows, having no smaller id, keep
    what no other document has, each. Other columns are ignored; an empty table gives an empty result.
    """
    text = F.col(text_col).cast("string")
    doc_id = F.col("doc_id").cast("long")
    docs = docs.select(doc_id.alias("doc_id"), F.xxhash64(doc_id, text).alias("row"), text.alias("text"))
    _, found = repeated_passages(docs, **options)
    lists = settle(found.groupBy("row").agg(F.collect_list(F.struct("first", "count")).alias("removed")), "removed")
    marks = _marks(docs, lists)
    some = _marked(docs, marks).join(lists, "row", "left").select("doc_id", "text", "removed")

    def results(ids: pa.Array, texts: pa.Array, removed: list) -> pa.RecordBatch:
        done = [_without((t.as_py() or "").encode(), r) for t, r in zip(texts, removed)]
        return pa.RecordBatch.from_arrays(
            [ids, pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.int64()),
             pa.array([d[2] for d in done], pa.string())],
            ["doc_id", "n_words", "n_removed", "kept_sha256"],
        )

    def with_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield results(batch.column(0), batch.column(1), batch.column(2).to_pylist())

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.invert(_is_marked(marks, batch)))
            yield results(batch.column(0), batch.column(2), [None] * batch.num_rows)

    kinds = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    return some.mapInArrow(with_lists, kinds).unionByName(docs.mapInArrow(whole, kinds))


ORACLE = r"""
with words as (
  select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as w from documents
), starts as (
  select doc_id, s, md5(array_to_string(w[s:s + 49], ' ')) as h
  from (select doc_id, w, unnest(range(1, len(w) - 48)) as s from words where len(w) >= 50)
), least as (
  select h, min(doc_id) as d from starts group by h
), gone as (
  select distinct doc_id, unnest(range(s, s + 50)) as k from starts join least using (h) where d < doc_id
), lists as (
  select doc_id, list(k) as ks from gone group by doc_id
)
select doc_id, len(w)::bigint as n_words, coalesce(len(ks), 0)::bigint as n_removed,
  sha256(array_to_string(case when ks is null then w else list_filter(w, lambda x, i: not list_contains(ks, i)) end, ' ')) as kept_sha256
from words left join lists using (doc_id)
"""
