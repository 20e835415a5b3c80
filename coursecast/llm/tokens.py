"""Token-id files: texts to ids, compressed by the range coder in order of the documents, and back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coursecast.llm.range_coder import decode, encode
from coursecast.llm.shared import giving_back
from coursecast.llm.token_ids import MOST_WORDS, worker_encoder
from coursecast.sources.scratch import scratch_path

SEGMENT_IDS = 8 << 20


def write_token_files(docs: DataFrame, path: str, *, tokenizer: str, end_id: int = 2, text_col: str = "text",
                      segment_ids: int = SEGMENT_IDS, most_words: int = MOST_WORDS) -> None:
    """Encode every text, append ``end_id``, and write the ids to ``path`` in ascending ``doc_id`` order.

    Documents are sorted over the cluster by id, equal and null ids (first) by the hash of their text. A file
    holds segments of whole documents, about ``segment_ids`` ids each (fewer take less memory and more time): the document ids, their counts, and
    one buffer of the range coder. ``shard`` and ``segment`` number them in order. Files are Parquet, so Spark
    commits them, retries lost tasks, and any store it reaches will do. Null texts are empty.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    ).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        encoder = worker_encoder(tokenizer, most_words)
        if encoder.dtype != np.uint16:
            raise ValueError("the file format holds ids below 65536")
        end = np.array([end_id], "<u2").tobytes()
        names, parts, n_ids, segment = [], [], 0, 0

        def pack() -> pa.RecordBatch:
            counts = [len(p) // 2 for p in parts]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], pa.int32()), pa.array([segment], pa.int32()), pa.array([sum(counts)], pa.int64()),
                    pa.array([names], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64())),
                    pa.array([encode(np.frombuffer(b"".join(parts), "<u2"))], pa.binary()),
                ],
                ["shard", "segment", "n_ids", "doc_ids", "counts", "ids"],
            )

        for batch in batches:
            mine = batch.column(0).to_pylist()
            for first, ids, at in encoder.encode_texts(batch.column(1)):
                for k in range(len(at) - 1):
                    names.append(mine[first + k])
                    parts.append(ids[at[k] : at[k + 1]].tobytes() + end)
                    n_ids += len(parts[-1]) // 2
                    if n_ids >= segment_ids:
                        yield pack()
                        names, parts, n_ids, segment = [], [], 0, segment + 1
        if parts:
            yield pack()

    kinds = "shard int, segment int, n_ids long, doc_ids array<long>, counts array<long>, ids binary"
    rows.select("doc_id", "text").mapInArrow(giving_back(run), kinds).write.parquet(path)


def segment_starts(files: DataFrame) -> DataFrame:
    """``shard``, ``segment`` and ``segment_start``, the number of ids before each segment.

    Only counts go into the running sums: one row per segment within a shard, one row per shard over all.
    """
    segments = files.select("shard", "segment", "n_ids")
    per = segments.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    per = per.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))
    before = W.partitionBy("shard").orderBy("segment").rowsBetween(W.unboundedPreceding, -1)
    starts = segments.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).join(per, "shard")
    return starts.select("shard", "segment", (F.col("start") + F.col("shard_start")).alias("segment_start"))


def decoded(files: DataFrame) -> DataFrame:
    """``shard``, ``segment``, ``at`` (ids before it in the segment), ``doc_id``, ``n_tokens`` and ``ids`` (little-endian
    unsigned 32-bit) of every document. Fails if a block does not match its checksum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids = decode(batch.column("ids")[k].as_buffer()).astype("<u4")
                counts = np.array(batch.column("counts")[k].as_py(), np.int64)
                at = np.concatenate([[0], np.cumsum(counts)])
                if at[-1] != len(ids):
                    raise ValueError("a segment's counts do not add up to its ids")
                n = len(counts)
                for lo in range(0, n, 1000):
                    to = min(n, lo + 1000)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(to - lo, batch.column("shard")[k].as_py(), np.int32)),
                            pa.array(np.full(to - lo, batch.column("segment")[k].as_py(), np.int32)),
                            batch.column("doc_ids")[k].values.slice(lo, to - lo), pa.array(at[lo:to]), pa.array(counts[lo:to]),
                            pa.array([ids[a:b].tobytes() for a, b in zip(at[lo:to], at[lo + 1 : to + 1])], pa.binary()),
                        ],
                        ["shard", "segment", "doc_id", "at", "n_tokens", "ids"],
                    )

    kinds = "shard int, segment int, doc_id long, at long, n_tokens long, ids binary"
    return files.select("shard", "segment", "doc_ids", "counts", "ids").mapInArrow(giving_back(run), kinds)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start`` (ids before it in all files), ``n_tokens`` and ``ids`` of every document."""
    files = spark.read.parquet(path)
    found = decoded(files).join(segment_starts(files), ["shard", "segment"])
    return found.select("doc_id", (F.col("segment_start") + F.col("at")).alias("start"), "n_tokens", "ids")


def token_index(docs: DataFrame, *, tokenizer: str, end_id: int = 2, path: str | None = None, text_col: str = "text", **sizes) -> DataFrame:
    """Write token files and read them back: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` per document.

    A null or empty text is its end id alone; repeated rows are documents of their own, with equal digests
    and different starts; other columns are ignored; an empty table gives an empty result. ``path`` is a
    new folder, by default in the shared scratch folder.
    """
    path = path or scratch_path(docs.sparkSession, "tokens")
    write_token_files(docs, path, tokenizer=tokenizer, end_id=end_id, text_col=text_col, **sizes)
    files = docs.sparkSession.read.parquet(path)
    found = decoded(files).select("shard", "segment", "at", "doc_id", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    found = found.join(segment_starts(files), ["shard", "segment"])
    return found.select("doc_id", (F.col("segment_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
