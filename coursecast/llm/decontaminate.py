"""Benchmark decontamination: template windows with typed placeholders, and consistent slots."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coursecast.llm.bits import bit_table, in_table
from coursecast.llm.shared import giving_back
from coursecast.llm.textops import LOWER, SPACE, Chunk, chunks, mix, split_words, whole_windows, windows
from coursecast.operators.order import fresh
from coursecast.sources.scratch import settle

WINDOW = 5
MIN_LITERALS = 2

# Fixed word lists of the placeholders.
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen "
    "seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million "
    "billion half quarter dozen once twice"
)
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg gram grams kilogram kilograms oz "
    "ounce ounces lb lbs pound pounds ton tons ml l liter liters litre litres gallon gallons s sec second seconds "
    "min minute minutes h hr hour hours day days week weeks month months year years cent cents dollar dollars "
    "euro euros usd eur percent degree degrees meter meters metre metres kmh mph kb mb gb tb hz w kw v a n j"
)

BETWEEN = SPACE.copy()
BETWEEN[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
_DIGIT, _UPPER, _SMALL, _STOP = (np.zeros(256, bool) for _ in range(4))
_DIGIT[48:58] = _UPPER[65:91] = _SMALL[97:123] = True
_STOP[[10, 33, 46, 58, 63]] = True  # line feed ! . : ?


def folded(buf: np.ndarray) -> np.ndarray:
    """UTF-8 bytes in lower case: A-Z, and the capitals of Latin-1 (0xC3 with 0x80 to 0x9E, without the times sign)."""
    out = LOWER[buf]
    capital = (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97) & (buf[:-1] == 0xC3)
    out[1:][capital] += 0x20
    return out


def _word_hashes(words: str) -> np.ndarray:
    buf = np.frombuffer(words.encode(), np.uint8)
    c = split_words(0, buf, np.array([0, len(buf)]))
    return np.sort(c.hashes(c.start, c.end))


_NUMBERS, _UNITS = _word_hashes(NUMBER_WORDS), _word_hashes(UNITS)
NUMBER, UNIT, NAME, LITERAL = (mix(np.array([k], np.uint64))[0] for k in (101, 102, 103, 104))


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return known[at] == h


def canonical(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Template and slot value of each word; the value of a word that stays literal is 0.

    A word with a digit or a number word is a number; a unit's name behind a number is a unit; a capitalised
    word that begins no sentence is a name. Other words are themselves, in lower case.
    """
    n = len(chunk.start)
    raw = Chunk(chunk.first, folded(chunk.buf), chunk.text_at, chunk.start, chunk.end, chunk.word_at)
    h = raw.hashes(raw.start, raw.end)
    if not n:
        return h, h

    def among(table: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(table[chunk.buf])])

    def within(total: np.ndarray) -> np.ndarray:
        return total[chunk.end] - total[chunk.start]

    number = (within(among(_DIGIT)) > 0) | _among(h, _NUMBERS)
    first = np.zeros(n, bool)
    first[chunk.word_at[:-1][chunk.n_words() > 0]] = True
    follows = np.zeros(n, bool)
    follows[1:] = number[:-1]
    unit = ~number & follows & ~first & _among(h, _UNITS)
    stops = among(_STOP)
    begins = first.copy()
    begins[1:] |= stops[chunk.start[1:]] > stops[chunk.end[:-1]]
    titled = _UPPER[chunk.buf[chunk.start]] & (within(among(_UPPER)) == 1) & (within(among(_SMALL)) > 0)
    name = titled & ~begins & ~number & ~unit
    slot = number | unit | name
    template = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, h)))
    return template, np.where(slot, h | np.uint64(1), np.uint64(0))


def template_windows(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, position in its words, hash, slot values (one column per word) of each window, and whether it is literal.

    A window with at least ``MIN_LITERALS`` literal words is its template. One with fewer is too common as a template: it
    is literal, the hash of its words as they are, in lower case, and has no slots.
    """
    template, value = canonical(chunk)
    n = max(len(template) - WINDOW + 1, 0)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), np.zeros((0, WINDOW), np.uint64), np.zeros(0, bool)
    values = np.stack([value[k : k + n] for k in range(WINDOW)], axis=1)
    literal = (values == 0).sum(axis=1) < MIN_LITERALS
    words = np.where(value != 0, value, template)
    h = np.where(literal, mix(windows(words, WINDOW) ^ LITERAL), windows(template, WINDOW))
    values[literal] = 0
    at = np.flatnonzero(whole_windows(chunk.word_at, WINDOW, len(template)))
    text = chunk.owner()[at]
    return text, at - chunk.word_at[text], h[at], values[at], literal[at]


def _window_rows(rows: DataFrame, key: str, known: np.ndarray | None) -> DataFrame:
    """``key``, ``uid``, ``pos``, ``h``, ``slots`` and ``literal`` of the windows of ``rows`` (``key``, ``uid``, ``text``).

    ``known`` marks the hashes that a window must fall on, by their leading bits.
    """
    shared = None if known is None else rows.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(2), space=BETWEEN):
                text, pos, h, values, literal = template_windows(c)
                if shared is not None:
                    use = in_table(shared.value, h)
                    text, pos, h, values, literal = text[use], pos[use], h[use], values[use], literal[use]
                if not len(h):
                    continue
                at = pa.array(text + c.first)
                slots = pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(values).ravel().view(np.int64)), WINDOW)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array(pos, pa.int64()), pa.array(h.view(np.int64)),
                     slots.cast(pa.list_(pa.int64())), pa.array(literal)],
                    [key, "uid", "pos", "h", "slots", "literal"],
                )

    return rows.mapInArrow(giving_back(run), f"{key} long, uid long, pos long, h long, slots array<long>, literal boolean")


def _keyed(rows: DataFrame, key: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return rows.select(F.col(key).cast("long").alias(key), F.xxhash64(text).alias("uid"), text.alias("text"))


def leaks(docs: DataFrame, benchmark: DataFrame, *, min_coverage: float = 0.5, text_col: str = "text") -> DataFrame:
    """One row per document and benchmark item that it holds.

    ``doc_id``, ``uid`` (hash of the document's text), ``item_id``, ``matched`` and ``windows`` (windows of the
    item that were found, and that it has), ``coverage``, and ``changed`` (slots with another value: 0 for a
    literal copy). Windows of five template words are joined by hash; those at one distance belong together. Each slot
    value of the item stands for one value of the document, the one most of its windows have; windows with another do not
    count. Two values of the item may become the same one. An item is held if ``min_coverage`` of its windows count.
    An item whose windows all have fewer than two literal words, such as a list of numbers, is matched by its words as they are.

    Null and empty texts, and items of fewer than five words, have no windows. Equal rows give one row; rows
    without id are told apart by their text; other columns are ignored. An empty table gives an empty result. A
    bit table of fixed size holds back windows of documents that cannot match; the join is exact.
    """
    items = _keyed(benchmark, "item_id", text_col).distinct()
    bench = settle(_window_rows(items, "item_id", None), "item-windows")
    per_item = bench.groupBy("item_id", "uid").agg(F.count_if(~F.col("literal")).alias("templates"), F.count("*").alias("windows"))
    per_item = per_item.withColumnsRenamed({"item_id": "_item", "uid": "_uid"})
    of_item = (F.col("item_id").eqNullSafe(F.col("_item"))) & (F.col("uid") == F.col("_uid"))
    # Literal windows count only where there are no others.
    bench = settle(bench.join(per_item, of_item).filter(~F.col("literal") | (F.col("templates") == 0)).drop("_item", "_uid", "windows", "templates"), "item-windows")
    found = _window_rows(_keyed(docs, "doc_id", text_col), "doc_id", bit_table(bench, "h")).drop("literal").distinct()
    item = bench.select("item_id", F.col("uid").alias("item_uid"), F.col("pos").alias("item_pos"), "h", F.col("slots").alias("item_slots"))
    pairs = F.filter(F.arrays_zip("item_slots", "slots"), lambda x: x["item_slots"] != 0)
    joined = found.join(item, "h").withColumn("pairs", pairs)
    lined = joined.groupBy("doc_id", "uid", "item_id", "item_uid", (F.col("pos") - F.col("item_pos")).alias("off")).agg(
        F.collect_set(F.struct("item_pos", "pairs")).alias("found")  # no longer than the item
    )
    lined = lined.withColumn("all_pairs", F.flatten("found.pairs")).withColumn("of", F.array_distinct("all_pairs.item_slots"))

    def most_frequent(value: Column) -> Column:
        mine = F.filter("all_pairs", lambda p: p["item_slots"] == value)
        ranked = F.transform(F.array_distinct(mine["slots"]), lambda s: F.struct(F.size(F.filter(mine, lambda p: p["slots"] == s)).alias("n"), s.alias("s")))
        return F.array_max(ranked)["s"]

    lined = lined.withColumn("becomes", F.map_from_arrays("of", F.transform("of", most_frequent)))
    agrees = lambda w: F.forall(w["pairs"], lambda p: F.element_at("becomes", p["item_slots"]) == p["slots"])
    lined = lined.select(
        "doc_id", "uid", "item_id", "item_uid", F.transform(F.filter("found", agrees), lambda w: w["item_pos"]).alias("places"),
        F.size(F.filter("of", lambda v: F.element_at("becomes", v) != v)).alias("changed"),
    ).filter(F.size("places") > 0)
    per = lined.groupBy("doc_id", "uid", "item_id", "item_uid").agg(
        F.size(F.array_distinct(F.flatten(F.collect_set("places")))).cast("long").alias("matched"),
        F.min("changed").cast("long").alias("changed"),
    )
    size = bench.groupBy("item_id", F.col("uid").alias("item_uid")).agg(F.count("*").alias("windows"))
    size = size.withColumnsRenamed({"item_id": "_item", "item_uid": "_uid"})
    per = per.join(size, per.item_id.eqNullSafe(F.col("_item")) & (per.item_uid == F.col("_uid")))
    per = per.withColumn("coverage", F.col("matched") / F.col("windows")).filter(F.col("coverage") >= min_coverage)
    return per.select("doc_id", "uid", "item_id", "matched", "windows", "coverage", "changed")


def clean_documents(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with the columns of ``docs``; same cases as ``leaks``.

    Further columns stay as they are, whatever their names.
    """
    uid = fresh(docs, "dirty_uid")
    dirty = leaks(docs, benchmark, text_col=text_col, **options).select(F.col("uid").alias(uid)).distinct()
    return docs.join(dirty, F.xxhash64(F.col(text_col).cast("string")) == F.col(uid), "left_anti")
