"""Positions and exact quantiles over a whole table, without a single-task window."""

from __future__ import annotations

import math
import struct
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coursecast.sources.scratch import settle

DIGIT_BITS = 16  # of a value's 64 bits, counted in one pass


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def with_position(df: DataFrame, order: Sequence[Column | str], name: str, start: int = 0) -> DataFrame:
    """Number the rows ``start``, ``start + 1``, ... in sort order.

    Rows are dealt by ranges of the sort key, sorted in their task, and stored with their number in the
    task; the counts of the tasks, one number each, give the offsets. No task sees all rows. ``order``
    should end in a unique key, so that rows that tie on the leading columns can be split too.
    """
    part, row = fresh(df, "part"), fresh(df, "row")
    kept = [F.col(c) for c in df.columns if c.lower() != name.lower()]
    at = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    stored = settle(ranged.select("*", F.spark_partition_id().alias(part), at.alias(row)), "positions")
    counts = {r[0]: r[1] for r in stored.groupBy(part).count().collect()}
    offsets, total = [], start
    for k in range(max(counts, default=-1) + 1):
        offsets.append(f"{total}L")
        total += counts.get(k, 0)
    if not offsets:
        return stored.select(F.lit(start).cast("long").alias(name), *kept)
    offset = F.expr(f"element_at(array({', '.join(offsets)}), `{part}` + 1)")
    return stored.select((offset + F.col(row)).alias(name), *kept)


def _ranked_bits(value: Column) -> Column:
    """The 64 bits of a double as a long whose order is the order of the values; -0.0 is 0.0."""
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), F.coalesce(value, F.lit(0.0)) + F.lit(0.0)).cast("long")
    return F.when(bits < 0, F.bitwise_not(bits).bitwiseXOR(F.lit(-(1 << 63)))).otherwise(bits)


def _value(bits: int) -> float:
    raw = bits if bits >= 0 else ~bits ^ -(1 << 63)
    return struct.unpack(">d", struct.pack(">q", raw))[0]


def exact_quantiles(stored: DataFrame, column: str, probabilities: Mapping[str, float]) -> dict[str, float | None]:
    """Interpolated quantiles of a column by name, nulls skipped.

    The two neighbours of each quantile are found by radix selection: each pass counts the values by the
    next 16 bits among those that agree with a neighbour in all bits before, so four passes over the
    column fix all 64. Nothing is sorted or kept; the driver gets counts, 65,536 a neighbour at most. (``percentile``
    would gather every distinct value in one task.) The frame is read five times, so it should be a stored table.
    """
    bits = stored.filter(F.col(column).isNotNull()).select(_ranked_bits(F.col(column).cast("double")).alias("bits"))
    last = bits.count() - 1
    if last < 0:
        return dict.fromkeys(probabilities)
    places = {name: last * p for name, p in probabilities.items()}
    # Per wanted position: the leading bits found so far, and the position among the values that share them.
    wanted = {at: (None, at) for at in {end(place) for place in places.values() for end in (math.floor, math.ceil)}}
    for shift in range(64 - DIGIT_BITS, -1, -DIGIT_BITS):
        lead = F.shiftright("bits", shift)  # the sign stays, so leading bits keep the order
        heads = {head for head, _ in wanted.values() if head is not None}
        among = bits.filter(F.shiftright("bits", shift + DIGIT_BITS).isin(list(heads))) if heads else bits
        counts = sorted((r[0], r[1]) for r in among.groupBy(lead.alias("lead")).count().collect())
        for at, (head, left) in wanted.items():
            for found, n in counts:
                if head is not None and found >> DIGIT_BITS != head:
                    continue
                if left < n:
                    wanted[at] = (found, left)
                    break
                left -= n
    at = {place: _value(head) for place, (head, _) in wanted.items()}

    def between(place: float) -> float:
        low, high = at[math.floor(place)], at[math.ceil(place)]
        return low + (high - low) * (place - math.floor(place)) if low != high else low

    return {name: between(place) for name, place in places.items()}
