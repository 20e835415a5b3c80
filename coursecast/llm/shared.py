"""Small things that operators share with their tasks, and samples of bounded size."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def share(spark: SparkSession, value) -> Callable[[], object]:
    """Broadcast ``value`` with its classes, so that workers need no copy of this package; call the result in a task."""
    packed = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(packed.value)


def by_hash(df: DataFrame, columns: Sequence[str], n: int, seed: int | None = None) -> DataFrame:
    """The ``n`` rows with the smallest hash of ``columns``.

    A bound on the hash, from a count, leaves about 2 ``n`` rows before they meet in one task, whatever the number of
    partitions.
    """
    h = F.xxhash64(*columns, *([F.lit(seed)] if seed is not None else []))
    total = df.count()
    if total > 4 * n:
        df = df.filter(h < -(1 << 63) + int((1 << 64) * (2 * n / total)))
    return df.orderBy(h, *columns).limit(n)


def giving_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for ``mapInArrow``, with the task's free memory given back to the machine at its end.

    Python workers stay for the tasks that follow, also of other stages; what they keep unused counts against the
    executor's memory.
    """

    def tidy(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            import ctypes

            import pyarrow

            pyarrow.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
            if trim is not None:
                trim(0)

    return tidy
