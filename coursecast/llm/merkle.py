"""Merkle manifest of a dataset: a tree of hashes per group, a root over the groups, and proofs.

Leaf coordinates come from bitmaps: the ids of a group are bits of 64-bit words, of which only those with a bit
are kept; running sums of their popcounts, by directories of bounded blocks, give every id its rank without
sorting the rows. Rows then meet in blocks of 512 keyed slots, in which three levels of the tree are reduced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coursecast.operators.order import with_position
from coursecast.sources.scratch import settle

RUN = 8
DEPTH = 3  # levels reduced at a time
BLOCK = RUN**DEPTH
WORD_BITS = 6
DIRECTORY_BITS = (10, 16, 16, 16)  # of the word number, from the lowest: one directory each

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def encoded(column: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon, and the value."""
    text = column.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaves(docs: DataFrame, *, fields: Sequence[str] = FIELDS, group: str = "lang") -> DataFrame:
    """``doc_id``, ``g`` (the group's name behind ``=``, empty for null), ``leaf`` and ``seen``, the leaf after tampering
    (null: untouched), ``word`` and ``bit``, the id's place in a bitmap.

    Where 3 divides the crc32 of the decimal id, tampering lower-cases A-Z of ``text``; rows without id are left alone.
    """
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    changed = F.translate(F.col("text").cast("string"), UPPER, UPPER.lower())

    def digest(text: Column) -> Column:
        return F.sha2(F.concat(*[encoded(text if c == "text" else F.col(c)) for c in fields]), 256)

    leaf = digest(F.col("text"))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("g"),
        leaf.alias("leaf"), F.when(hit, digest(changed)).alias("seen"),
    )
    # The number of the id's word, below all others for a row without id, and its bit.
    word = F.coalesce(F.shiftright("doc_id", WORD_BITS), F.lit(-(1 << (63 - WORD_BITS)) - 1))
    return rows.withColumn("word", word).withColumn("bit", F.coalesce(F.col("doc_id").bitwiseAND((1 << WORD_BITS) - 1), F.lit(0)).cast("int"))


def words(rows: DataFrame) -> DataFrame:
    """The bitmap of each group as its words that are not zero: ``g``, ``word``, ``bits``, ``n`` (the word's rows).

    Bitmaps are merged by ``or``, first within each task. Stored.
    """
    merged = F.expr("bit_or(shiftleft(1L, bit))")
    return settle(rows.groupBy("g", "word").agg(merged.alias("bits"), F.count("*").alias("n")), "merkle-words")


def with_starts(ids: DataFrame) -> DataFrame:
    """``start``, the number of the group's rows before each word.

    Word numbers are read as digits. A directory holds the sum of the rows for each number without its last digits;
    running sums go over one digit only, so that no window has more rows than a digit has values.
    """
    counts = [ids.select("g", F.col("word").alias("k"), "n")]
    for bits in DIRECTORY_BITS[:-1]:
        counts.append(counts[-1].groupBy("g", F.shiftright("k", bits).alias("k")).agg(F.sum("n").alias("n")))
    above = None
    for depth in reversed(range(len(counts))):
        level = counts[depth].withColumn("up", F.shiftright("k", DIRECTORY_BITS[depth]))
        within = W.partitionBy("g", "up") if above is not None else W.partitionBy("g")
        before = F.sum("n").over(within.orderBy("k").rowsBetween(W.unboundedPreceding, -1))
        level = level.withColumn("before", F.coalesce(before, F.lit(0)))
        if above is not None:
            level = level.join(above.select("g", F.col("k").alias("up"), F.col("before").alias("more")), ["g", "up"])
            level = level.withColumn("before", F.col("before") + F.col("more"))
        above = level.select("g", "k", "before")
        if depth == 1:
            above = settle(above, "merkle-directory")
    return ids.join(above.select("g", F.col("k").alias("word"), F.col("before").alias("start")), ["g", "word"])


def placed(rows: DataFrame) -> DataFrame:
    """``pos`` within the group for every row, in order of the id; rows without id come first.

    Rows with the same id follow each other in order of their leaves. Such ids are ranked apart: their leaves'
    leading bits are counted like words of a directory, so that an id with a large share of all rows is dealt over
    many tasks, and rows that are equal in everything travel as one row and its count.
    """
    ids = words(rows)
    crowded = ids.filter(F.col("n") > F.bit_count("bits")).select("g", "word")
    below = F.expr("bit_count(bits & ~shiftleft(-1L, bit))").cast("long")  # bits before the row's
    if not crowded.take(1):
        index = settle(with_starts(ids).select("g", "word", "bits", "start"), "merkle-starts")
        return rows.join(index, ["g", "word"]).select("g", "doc_id", "leaf", "seen", (F.col("start") + below).alias("pos"))
    many = rows.join(crowded, ["g", "word"]).groupBy("g", "word", "bit").count().filter("count > 1")
    many = settle(many, "merkle-several")
    lists = many.groupBy("g", "word").agg(F.collect_list(F.struct("bit", "count")).alias("many"))  # at most 64
    index = with_starts(ids).join(lists, ["g", "word"], "left").select("g", "word", "bits", "start", "many")
    index = settle(index, "merkle-starts")
    more = F.expr("aggregate(many, 0L, (a, x) -> if(x.bit < bit, a + x.count - 1, a))")
    first = F.col("start") + below + F.coalesce(more, F.lit(0).cast("long"))
    several = many.select("g", "word", "bit")
    once = rows.join(several, ["g", "word", "bit"], "left_anti").join(index, ["g", "word"])
    once = once.select("g", "doc_id", "leaf", "seen", first.alias("pos"))
    ties = rows.join(several, ["g", "word", "bit"]).groupBy("g", "word", "bit", "doc_id", "leaf", "seen").count()
    ties = settle(ties.withColumn("lead", F.conv(F.substring("leaf", 1, 4), 16, 10).cast("int")), "merkle-ties")
    key = ["g", "word", "bit"]
    before = W.partitionBy(*key).orderBy("lead").rowsBetween(W.unboundedPreceding, -1)
    leads = ties.groupBy(*key, "lead").agg(F.sum("count").alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0)))
    before = W.partitionBy(*key, "lead").orderBy("leaf", "seen").rowsBetween(W.unboundedPreceding, -1)
    ties = ties.withColumn("within", F.coalesce(F.sum("count").over(before), F.lit(0))).join(leads.drop("n"), [*key, "lead"])
    ties = ties.join(index, ["g", "word"]).withColumn("first", first + F.col("ahead") + F.col("within"))
    piece = 1 << 16
    ties = ties.withColumn("part", F.explode(F.expr(f"sequence(0L, (count - 1) div {piece})"))).repartition("g", "first", "part")
    last = F.least(F.col("count") - 1, F.col("part") * piece + (piece - 1))
    ties = ties.withColumn("k", F.explode(F.sequence(F.col("part") * piece, last)))
    return once.union(ties.select("g", "doc_id", "leaf", "seen", (F.col("first") + F.col("k")).alias("pos")))


def _hash(parts: Sequence[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _levels(nodes: list[str], width: int) -> list[list[str]]:
    """A block's nodes and what they become, level by level; ``width`` is the number of nodes of the whole group."""
    out = [nodes]
    for _ in range(DEPTH):
        if width == 1:
            break
        nodes = [_hash(nodes[k : k + RUN]) for k in range(0, len(nodes), RUN)]
        width = -(-width // RUN)
        out.append(nodes)
    return out


def _siblings(levels: list[list[str]], slot: int) -> list[tuple[str, str]]:
    """What stands left and right of a node's ancestors within their runs, from the node up."""
    out = []
    for nodes in levels[:-1]:
        first = slot - slot % RUN
        out.append(("".join(nodes[first:slot]), "".join(nodes[slot + 1 : first + RUN])))
        slot //= RUN
    return out


def _rows(batch: pa.RecordBatch, *columns: int) -> Iterator[tuple]:
    """The rows of a batch one by one; a block of slots is large as Python objects."""
    chosen = [batch.column(k) for k in columns] if columns else batch.columns
    return (tuple(c[k].as_py() for c in chosen) for k in range(batch.num_rows))


STEPS = "array<struct<left:string,right:string>>"


class Trees:
    """One hash tree per group over stored blocks of slots; stage ``s`` holds nodes of level ``DEPTH * s``.

    ``nodes`` has ``g``, ``pos``, ``digest`` (and further columns, kept in the slots of the first stage), ``sizes`` has
    ``g`` and ``n``, or is the size of the only group. All blocks have at most ``BLOCK`` slots, so no task holds a group.
    """

    def __init__(self, nodes: DataFrame, sizes: DataFrame | int, most: int) -> None:
        self.stages: list[DataFrame] = []
        width, span = most, 1
        while True:
            names = [c for c in nodes.columns if c not in ("g", "pos")]
            slot = F.struct((F.col("pos") % BLOCK).cast("int").alias("slot"), *names)
            per = nodes.groupBy("g", F.expr(f"pos div {BLOCK}").alias("block")).agg(F.collect_list(slot).alias("slots"))
            per = per.withColumn("n", F.lit(sizes).cast("long")) if isinstance(sizes, int) else per.join(sizes, "g")
            per = per.withColumn("width", F.ceil(F.col("n") / span)).drop("n")
            per = settle(per, "merkle-slots")
            self.stages.append(per)
            nodes = self._up(per)
            width, span = -(-width // BLOCK), span * BLOCK
            if width == 1:
                break
        self.tops = settle(nodes.select("g", "digest"), "merkle-tops")

    @staticmethod
    def _up(per: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                top = [
                    _levels([s["digest"] for s in sorted(slots, key=lambda s: s["slot"])], width)[-1][0]
                    for slots, width in _rows(batch, 2, 3)
                ]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(top, pa.string())], ["g", "pos", "digest"])

        rows = per.select("g", "block", F.transform("slots", lambda s: F.struct(s["slot"], s["digest"])).alias("slots"), "width")
        return rows.mapInArrow(run, "g string, pos long, digest string")

    def blocks(self, above: DataFrame) -> DataFrame:
        """The first stage's blocks with ``steps``, the siblings of their tops up to the end of ``above`` (g, steps)."""
        above = above.select("g", F.lit(0).cast("long").alias("block"), "steps")
        for per in reversed(self.stages[1:]):
            above = self._down(per.join(above, ["g", "block"]))
        return self.stages[0].join(above, ["g", "block"])

    @staticmethod
    def _down(rows: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for g, block, slots, width, steps in _rows(batch):
                    levels = _levels([s["digest"] for s in sorted(slots, key=lambda s: s["slot"])], width)
                    mine = [[{"left": a, "right": b} for a, b in _siblings(levels, k)] + steps for k in range(len(slots))]
                    at = [block * BLOCK + k for k in range(len(slots))]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([g] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(mine, pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())])))],
                        ["g", "block", "steps"],
                    )

        rows = rows.select("g", "block", "slots", "width", "steps")
        return rows.mapInArrow(run, f"g string, block long, steps {STEPS}")


def manifest(docs: DataFrame, *, fields: Sequence[str] = FIELDS, group: str = "lang") -> DataFrame:
    """``doc_id``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root`` and ``verified`` of every row.

    Nulls are encoded as such in any column; a null group is a group, the first. Rows without id come first in their
    group, rows with equal ids in order of their leaves; equal rows are leaves of their own, next to each other. Further
    columns are ignored; an empty table gives an empty result.
    """
    rows = settle(leaves(docs, fields=fields, group=group), "merkle-leaves")
    sizes = settle(rows.groupBy("g").agg(F.count("*").alias("n")), "merkle-sizes")
    most, groups = sizes.agg(F.max("n"), F.count("*")).first()
    where = placed(rows).select("g", "pos", F.col("leaf").alias("digest"), "seen", "doc_id")
    trees = Trees(where, sizes, most or 1)
    tops = with_position(trees.tops, ["g"], "pos").select(F.lit("").alias("g"), "pos", "digest", F.col("g").alias("name"))
    over = Trees(settle(tops, "merkle-subroots"), groups, groups or 1)
    root = over.tops.select("g", F.col("digest").alias("root"))
    ends = root.select("g", F.array().cast(STEPS).alias("steps"))
    groups_steps = settle(_expand(over.blocks(ends).join(root, "g")), "merkle-group-steps")
    blocks = trees.blocks(groups_steps.select(F.col("name").alias("g"), "steps"))
    blocks = blocks.join(groups_steps.select(F.col("name").alias("g"), F.col("digest").alias("subroot"), "root"), "g")
    return _proofs(blocks)


def _expand(blocks: DataFrame) -> DataFrame:
    """``name``, ``digest``, ``root`` and ``steps`` up to the root of every slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slots, width, steps, root in _rows(batch):
                slots = sorted(slots, key=lambda s: s["slot"])
                levels = _levels([s["digest"] for s in slots], width)
                mine = [[{"left": a, "right": b} for a, b in _siblings(levels, k)] + steps for k in range(len(slots))]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([s["name"] for s in slots], pa.string()), pa.array(levels[0], pa.string()), pa.array([root] * len(slots), pa.string()),
                        pa.array(mine, pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))),
                    ],
                    ["name", "digest", "root", "steps"],
                )

    return blocks.select("slots", "width", "steps", "root").mapInArrow(run, f"name string, digest string, root string, steps {STEPS}")


def _proofs(blocks: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slots, width, steps, subroot, root in _rows(batch):
                slots = sorted(slots, key=lambda s: s["slot"])
                levels = _levels([s["digest"] for s in slots], width)
                above = [(s["left"], s["right"]) for s in steps]
                upper = "".join(a + b for a, b in above)
                folded: dict[str, str] = {}  # what a block's top becomes; most leaves give the same one
                out = []
                for k, s in enumerate(slots):
                    mine = _siblings(levels, k)
                    proof = _hash([*(a + b for a, b in mine), upper])
                    top = s["seen"] or s["digest"]
                    for a, b in mine:
                        top = _hash([a, top, b])
                    if top not in folded:
                        end = top
                        for a, b in above:
                            end = _hash([a, end, b])
                        folded[top] = end
                    out.append((s["doc_id"], s["digest"], proof, folded[top]))
                n = len(out)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.string()), pa.array([subroot] * n, pa.string()),
                        pa.array([root] * n, pa.string()), pa.array([o[2] for o in out], pa.string()), pa.array([o[3] for o in out], pa.string()),
                        pa.array([o[3] == root for o in out], pa.bool_()),
                    ],
                    ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
                )

    kinds = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return blocks.select("slots", "width", "steps", "subroot", "root").mapInArrow(run, kinds)


def oracle(levels: int = 8, group_levels: int = 4) -> str:
    """The query ``op11_merkle_manifest`` in DuckDB's SQL, for groups of up to ``8 ** levels`` rows."""
    folded = "list_reduce(list_transform(string_split(cast(doc_id as varchar), ''), lambda c: cast(ascii(c) as bigint)), lambda c, b: " \
        "list_reduce(range(8), lambda d, x: xor(d >> 1, 3988292384 * (d & 1)), xor(c, b)), 4294967295)"

    def field(name: str) -> str:
        return f"coalesce(strlen(cast({name} as varchar)) || ':' || cast({name} as varchar), '-')"

    ctes = [
        f"hit as (select *, coalesce(xor({folded}, 4294967295) % 3 = 0, false) as hit from documents)",
        "dirty as (select *, case when hit then translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else text end as dirt from hit)",
        "leaves as (select doc_id, lang, sha256(" + " || ".join(map(field, FIELDS)) + ") as leaf, sha256("
        + " || ".join(field("dirt" if f == "text" else f) for f in FIELDS) + ") as seen from dirty)",
        "doc as (select *, coalesce('=' || lang, '') as g, row_number() over (partition by lang order by doc_id nulls first, leaf, seen) - 1 as pos from leaves)",
        "a0 as (select g, pos, leaf as d, count(*) over (partition by g) as m from doc)",
    ]

    def tree(a: str, n: int) -> None:
        for k in range(n):
            run = f"over (partition by g, pos // 8 order by pos rows between"
            ctes.append(
                f"{a}s{k} as (select g, pos, m, d, case when m = 1 then '' else coalesce(string_agg(d, '') {run} unbounded preceding and 1 preceding), '') end as l, "
                f"case when m = 1 then '' else coalesce(string_agg(d, '') {run} 1 following and unbounded following), '') end as r from {a}{k})"
            )
            ctes.append(
                f"{a}{k + 1} as (select g, pos // 8 as pos, case when m = 1 then max(d) else sha256(string_agg(d, '' order by pos)) end as d, (m + 7) // 8 as m "
                f"from {a}{k} group by g, pos // 8, m)"
            )

    tree("a", levels)
    ctes.append(f"b0 as (select '' as g, row_number() over (order by g) - 1 as pos, d, count(*) over () as m, g as name from a{levels})")
    tree("b", group_levels)
    ctes.append("x0 as (select doc.doc_id, doc.g, doc.pos, doc.leaf, doc.seen as f, '' as p, b0.pos as gpos, b0.d as subroot from doc join b0 on b0.name = doc.g)")
    step = 0
    for a, n, place, same in (("a", levels, "pos", " and s.g = x.g"), ("b", group_levels, "gpos", "")):
        for k in range(n):
            ctes.append(
                f"x{step + 1} as (select x.doc_id, x.g, x.pos, x.leaf, case when s.m = 1 then x.f else sha256(s.l || x.f || s.r) end as f, x.p || s.l || s.r as p, "
                f"x.gpos, x.subroot from x{step} x join {a}s{k} s on s.pos = x.{place} // {RUN**k}{same})"
            )
            step += 1
    return (
        "with " + ",\n".join(ctes) + f"\nselect doc_id, leaf, subroot, root.d as root, sha256(p) as proof_sha256, f as folded_root, f = root.d as verified "
        f"from x{step} cross join b{group_levels} root"
    )
