"""Connected components of a large edge table, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coursecast.sources.scratch import settle


def components(edges: DataFrame, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """``node`` and ``root`` (the smallest node reachable) for every node of ``edges`` (``a``, ``b``).

    Each round turns every node's larger neighbours, then its smaller ones, to its smallest neighbour; the
    edges end as stars around the roots after a number of rounds about the logarithm of the longest path. Only
    minima per node are shuffled, never lists of neighbours, and each round is a table in the shared scratch
    folder.
    """
    now = settle(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    state = None
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = settle(small.union(least.select("a", F.col("m").alias("b"))).distinct(), name)
        seen = now.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()
        if tuple(seen) == state:
            break
        state = tuple(seen)
    else:
        raise RuntimeError(f"no components after {max_rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
