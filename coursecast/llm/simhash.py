"""SimHash fingerprints and near-duplicate components by a binary trie self-join."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coursecast.llm.graph import components
from coursecast.llm.shared import giving_back
from coursecast.llm.textops import LOWER, Chunk, chunks
from coursecast.operators.order import fresh
from coursecast.sources.scratch import settle

# Fixed values of XXH64.
P1, P2, P3, P4, P5 = (
    np.uint64(11400714785074694791), np.uint64(14029467366897019727), np.uint64(1609587929392839161),
    np.uint64(9650029242287828579), np.uint64(2870177450012600261),
)
SEED = 42
MAX_FRONTIER = 1 << 20


def _turn(x: np.ndarray, k: int) -> np.ndarray:
    return (x << np.uint64(k)) | (x >> np.uint64(64 - k))


def xxh64(buf: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """XXH64 of many byte ranges at once; ranges of 32 bytes and more go to the library one by one."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    word = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
    h = length.astype(np.uint64) + (np.uint64(SEED) + P5)
    short = length < 32
    at, left = at.copy(), np.where(short, length, 0)
    for _ in range(3):
        on = np.flatnonzero(left >= 8)
        if not len(on):
            break
        lane = _turn(word[at[on]] * P2, 31) * P1
        h[on] = _turn(h[on] ^ lane, 27) * P1 + P4
        at[on] += 8
        left[on] -= 8
    on = np.flatnonzero(left >= 4)
    lane = (word[at[on]] & np.uint64(0xFFFFFFFF)) * P1
    h[on] = _turn(h[on] ^ lane, 23) * P2 + P3
    at[on] += 4
    left[on] -= 4
    for _ in range(3):
        on = np.flatnonzero(left >= 1)
        h[on] = _turn(h[on] ^ (padded[at[on]].astype(np.uint64) * P5), 11) * P1
        at[on] += 1
        left[on] -= 1
    h ^= h >> np.uint64(33)
    h *= P2
    h ^= h >> np.uint64(29)
    h *= P3
    h ^= h >> np.uint64(32)
    for k in np.flatnonzero(~short):
        h[k] = xxhash.xxh64_intdigest(memoryview(buf[at[k] : at[k] + length[k]]), SEED)
    return h


def fingerprints(chunk: Chunk, size: int) -> np.ndarray:
    """The SimHash of every text over shingles of ``size`` words; texts with fewer have one shingle."""
    length = chunk.end - chunk.start
    new = np.zeros(len(length) + 1, np.int64)
    np.cumsum(length + 1, out=new[1:])
    joined = np.full(int(new[-1]), 32, np.uint8)  # every word with one space behind it
    inside = np.repeat(chunk.start - new[:-1], length)
    target = np.ones(len(joined), bool)
    target[new[1:] - 1] = False
    target = np.flatnonzero(target)
    joined[target] = chunk.buf[target + inside]

    n_words = chunk.n_words()
    n_shingles = np.where(n_words >= size, n_words - size + 1, np.minimum(n_words, 1))
    at = np.zeros(len(n_words) + 1, np.int64)
    np.cumsum(n_shingles, out=at[1:])
    text = np.repeat(np.arange(len(chunk)), n_shingles)
    first = np.arange(at[-1]) - at[text] + chunk.word_at[text]
    last = first + np.minimum(n_words[text], size) - 1
    return majority(xxh64(joined, new[first], new[last + 1] - 1 - new[first]), at)


def majority(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Per text, the bits set in over half of its hashes ``h[at[k] : at[k + 1]]``; zero if it has none."""
    n_hashes = np.diff(at)
    out = np.zeros(len(n_hashes), np.uint64)
    some = np.flatnonzero(n_hashes)
    if not len(some):
        return out
    step = max(1, (1 << 17) // max(1, int(n_hashes[some].mean())))
    for k in range(0, len(some), step):  # 64 counters a text, over a bounded number of hashes
        part = some[k : k + step]
        lo, hi = at[part[0]], at[part[-1] + 1]
        counts = np.zeros((len(part), 64), np.int64)
        for b in range(lo, hi, 1 << 18):
            to = min(hi, b + (1 << 18))
            bits = np.unpackbits(h[b:to].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            begin = np.maximum(at[part], b)
            use = (begin < to) & (at[part + 1] > b)
            counts[use] += np.add.reduceat(bits, begin[use] - b, axis=0, dtype=np.int64)
        ones = (2 * counts > n_hashes[part][:, None]).astype(np.uint8)
        out[part] = np.packbits(ones, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def simhash(docs: DataFrame, *, size: int = 3, text_col: str = "text", uid: Column | None = None) -> DataFrame:
    """``doc_id``, ``uid`` (a long to tell rows apart, if given) and ``fp`` (the 64 bits as a long) of every row; no words
    give zero."""
    more = [] if uid is None else [uid.alias("uid")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprints(c, size) for c in chunks(batch.column(1), fold=LOWER)]
            fp = np.concatenate(found) if found else np.zeros(0, np.uint64)
            kept = [batch.column(0), *batch.columns[2:], pa.array(fp.view(np.int64))]
            yield pa.RecordBatch.from_arrays(kept, ["doc_id", *batch.schema.names[2:], "fp"])

    return rows.mapInArrow(giving_back(run), f"doc_id long, {'uid long, ' if more else ''}fp long")


def layouts(budget: int) -> tuple[list[tuple[int, int]], list[tuple[int, ...]]]:
    """Blocks of the 64 bits, as (shift, width), and for each trie the order in which it reads them.

    With ``budget + 2`` blocks, two fingerprints within the budget agree in two blocks at least, so they
    share the first two blocks of one of the tries.
    """
    n = budget + 2
    edges = [64 * k // n for k in range(n + 1)]
    blocks = [(64 - edges[k + 1], edges[k + 1] - edges[k]) for k in range(n)]
    return blocks, [(*pair, *(k for k in range(n) if k not in pair)) for pair in combinations(range(n), 2)]


def _reordered(fp, blocks, order):
    """The bits of a long column, block by block in another order."""
    out, left = F.lit(0).cast("long"), 64
    for k in order:
        shift, width = blocks[k]
        left -= width
        part = F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        out = out.bitwiseOR(F.shiftleft(part, left))
    return out


def join_trie(
    keys: np.ndarray, groups: np.ndarray, skip: int, budget: np.ndarray, close: Callable[[np.ndarray, np.ndarray], np.ndarray]
) -> np.ndarray:
    """For keys sorted within groups: a label each, equal for keys that links within a group connect.

    All keys of a group agree in their first ``skip`` bits. ``budget[d]`` is the number of bits in which a pair may
    differ among the first ``d``; ``close`` decides on the pairs of keys that are left.

    The trie of a group is its sorted keys: a node is the range of keys with the same leading bits. Pairs of
    nodes go down together from the root's pair; a pair is dropped when the bits in which it differs exceed
    the budget, or when all keys of both nodes are already in one component, where more links change nothing.
    Keys may repeat: rows of equal keys are one node of the last level, and ``close`` decides on each of its pairs.
    """
    n = len(keys)
    label = np.arange(n)

    def unite(i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = label[i], label[j]
            open_ = a != b
            if not open_.any():
                return
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = label[label]
                if np.array_equal(up, label):
                    break
                label[:] = up

    near = np.flatnonzero(groups[1:] == groups[:-1])
    near = near[close(near, near + 1)]
    unite(near, near + 1)
    start = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
    end = np.append(start[1:], n)
    many = end - start > 1
    start, end = start[many], end[many]
    todo = [(skip, np.stack([start, end, start, end]), np.zeros(len(start), np.int8))]
    zeros: dict[int, np.ndarray] = {}
    while todo:
        depth, pairs, differ = todo.pop()
        change = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])
        a0, a1, b0, b1 = pairs
        settled = (change[a1 - 1] == change[a0]) & (change[b1 - 1] == change[b0]) & (label[a0] == label[b0])
        pairs, differ = pairs[:, ~settled], differ[~settled]
        a0, a1, b0, b1 = pairs
        single = (a1 - a0 == 1) & (b1 - b0 == 1)
        i, j = a0[single], b0[single]
        linked = close(i, j)
        unite(i[linked], j[linked])
        pairs, differ = pairs[:, ~single], differ[~single]
        if not pairs.shape[1]:
            continue
        if depth == 64:  # nodes of several rows with equal keys
            for i, j in _row_pairs(pairs):
                open_ = label[i] != label[j]
                i, j = i[open_], j[open_]
                linked = close(i, j)
                unite(i[linked], j[linked])
            continue
        if pairs.shape[1] > MAX_FRONTIER:  # depth first, so that few pairs wait
            half = pairs.shape[1] // 2
            todo += [(depth, pairs[:, half:], differ[half:]), (depth, pairs[:, :half], differ[:half])]
            continue
        if depth not in zeros:
            bit = (keys >> np.uint64(63 - depth)) & np.uint64(1)
            zeros[depth] = np.concatenate([[0], np.cumsum(bit == 0)])
        z = zeros[depth]
        a0, a1, b0, b1 = pairs
        am, bm = a0 + z[a1] - z[a0], b0 + z[b1] - z[b0]
        same = (a0 == b0) & (a1 == b1)
        other = ~same
        children = [
            (a0, am, b0, bm, differ), (am, a1, bm, b1, differ), (a0, am, bm, b1, differ + 1),
            (am[other], a1[other], b0[other], bm[other], differ[other] + 1),
        ]
        c = np.concatenate([np.stack(x[:4]) for x in children], axis=1)
        d = np.concatenate([x[4] for x in children])
        keep = (c[1] > c[0]) & (c[3] > c[2]) & (d <= budget[depth + 1])
        keep &= ~((c[0] == c[2]) & (c[1] == c[3]) & (c[1] - c[0] == 1))
        if keep.any():
            todo.append((depth + 1, c[:, keep], d[keep]))
    return label


def _row_pairs(pairs: np.ndarray, limit: int = MAX_FRONTIER) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each pair of different rows from pairs of ranges (a0, a1, b0, b1), at most ``limit`` at a time."""
    a0, a1, b0, b1 = pairs
    row = np.repeat(a0, a1 - a0) + np.arange((a1 - a0).sum()) - np.repeat(np.cumsum(a1 - a0) - (a1 - a0), a1 - a0)
    left, right = np.repeat(b0, a1 - a0), np.repeat(b1, a1 - a0)
    left = np.where(np.repeat(a0 == b0, a1 - a0), row + 1, left)  # within one range each pair once
    n = right - left
    at = np.concatenate([[0], np.cumsum(n)])
    for lo in range(0, int(at[-1]), limit):
        k = np.arange(lo, min(lo + limit, int(at[-1])))
        of = np.searchsorted(at, k, "right") - 1
        yield row[of], left[of] + k - at[of]


def trie_links(prints: DataFrame, budget: int) -> DataFrame:
    """Edges (``a``, ``b``) that connect all distinct ``fp`` values within ``budget`` differing bits.

    Every fingerprint goes once to each trie, whose parts are dealt by two blocks of bits. A task returns,
    for each part, the links of a spanning forest: no more rows than fingerprints.
    """
    blocks, orders = layouts(budget)
    skip = [blocks[o[0]][1] + blocks[o[1]][1] for o in orders]
    tries = F.array(*[
        F.struct(
            F.lit(t).alias("trie"), F.shiftrightunsigned(_reordered(F.col("fp"), blocks, o), 64 - skip[t]).alias("part"),
            _reordered(F.col("fp"), blocks, o).alias("key"),
        )
        for t, o in enumerate(orders)
    ])
    rows = (
        prints.select("fp", F.explode(tries).alias("x")).select("x.trie", "x.part", "x.key", "fp")
        .repartition("trie", "part").sortWithinPartitions("trie", "part", "key")
    )

    most = np.full(65, budget)

    def solve(table: pa.Table) -> pa.RecordBatch:
        trie, part, key, fp = (c.to_numpy() for c in table.columns)
        key = key.view(np.uint64)
        order = np.lexsort((key, part, trie))  # Spark sorts the key as a signed number
        trie, part, key, fp = trie[order], part[order], key[order], fp[order]
        out = []
        for t in np.unique(trie):
            lo, hi = np.searchsorted(trie, [t, t + 1])
            mine = key[lo:hi]
            near = lambda i, j, k=mine: np.bitwise_count(k[i] ^ k[j]) <= budget
            label = join_trie(mine, part[lo:hi], skip[t], most, near) + lo
            link = np.flatnonzero(label != np.arange(lo, hi)) + lo
            out.append((fp[link], fp[label[link - lo]]))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([o[k] for o in out])) for k in (0, 1)], ["a", "b"]
        )

    return rows.mapInArrow(giving_back(by_parts(solve)), "a long, b long").distinct()


def by_parts(solve: Callable[[pa.Table], pa.RecordBatch]) -> Callable:
    """Calls ``solve`` on rows sorted by their first two columns, about 2**18 at a time, parts kept whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            waiting.append(batch)
            if sum(b.num_rows for b in waiting) < 1 << 18:
                continue
            table = pa.Table.from_batches(waiting)  # all but the last part are whole
            trie, part = table.column(0).to_numpy(), table.column(1).to_numpy()
            earlier = np.flatnonzero((trie != trie[-1]) | (part != part[-1]))
            whole = int(earlier[-1]) + 1 if len(earlier) else 0
            if whole:
                yield solve(table.slice(0, whole))
            waiting = table.slice(whole).to_batches()
        if waiting:
            yield solve(pa.Table.from_batches(waiting))

    return run


def _rooted(prints: DataFrame, budget: int) -> DataFrame:
    """``fp``, ``least`` (its smallest ``doc_id``) and ``root`` (the smallest ``fp`` that links reach) of every fingerprint."""
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(trie_links(classes.select("fp"), budget), "simhash-links")
    return settle(
        classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")),
        "simhash-classes",
    )


def near_components(docs: DataFrame, *, size: int = 3, budget: int = 2, text_col: str = "text") -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` of every row.

    Fingerprints with at most ``budget`` differing bits are linked; ``component_id`` is the smallest
    ``doc_id`` that links reach. Null and empty texts have fingerprint zero and link like any other. Repeated
    rows each get their row; a row without id is in its component but never names it. Other columns are
    ignored; an empty table gives an empty result. Equal fingerprints are one node of the trie, whatever
    their number of documents.
    """
    prints = settle(simhash(docs, size=size, text_col=text_col), "simhash")
    of_class = _rooted(prints, budget)
    named = of_class.groupBy("root").agg(F.min("least").alias("component_id"))
    named = of_class.join(named, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def without_near_copies(docs: DataFrame, *, size: int = 3, budget: int = 2, text_col: str = "text") -> DataFrame:
    """One row of each component of ``near_components``, the one with the smallest ``doc_id``, with the columns of ``docs``.

    A row without id stays only if its component has no id at all; of several texts with one id, the one with the
    smallest hash; of rows equal in id and text, one. Texts without words are copies of each other. Further columns
    stay as they are, whatever their names; an empty table gives an empty result. Texts are read twice, and once more
    for rows equal in both, if there are any; only ids and hashes are shuffled beside what stays.
    """
    uid = F.xxhash64(F.col(text_col).cast("string"))
    prints = settle(simhash(docs, size=size, text_col=text_col, uid=uid), "simhash")
    found = prints.join(_rooted(prints, budget).select("fp", "root"), "fp")
    of_row = found.groupBy("root", "doc_id", "uid").agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "uid", "n")).alias("first")
    id_, hash_, n = (fresh(docs, c) for c in ("stays_id", "stays_hash", "stays_rows"))
    stays = settle(
        of_row.groupBy("root").agg(first).select(F.col("first.doc_id").alias(id_), F.col("first.uid").alias(hash_), F.col("first.n").alias(n)),
        "simhash-stays",
    )

    def of(chosen: DataFrame) -> DataFrame:
        return docs.join(chosen, F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (uid == F.col(hash_)))

    once = of(stays.filter(F.col(n) == 1)).select(*docs.columns)
    several = stays.filter(F.col(n) > 1)
    if not several.take(1):
        return once
    return once.unionByName(of(several).dropDuplicates([id_, hash_]).select(*docs.columns))
