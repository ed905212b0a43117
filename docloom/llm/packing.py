"""Packing by power-of-two decomposition.

A document's ids are cut into as many whole sequences of the full length as fit and then into one
piece for each bit of the rest, longest first. Every piece is a sequence of its own, so none crosses
documents and none needs padding; sequences of equal length are numbered together (a bucket a length).
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, text_batches
from .tokens import encoder, vocabulary_path

FULL = 4096


def binary_lengths(n: int, full: int = FULL) -> list[int]:
    """n as whole sequences, then falling powers of two."""
    if full & full - 1:
        raise ValueError("the full length is a power of two")
    rest = n % full
    return [full] * (n // full) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def pieces(docs: DataFrame, vocabulary: str | None = None, end_id: int = 2, full: int = FULL, keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, part, place[, ids]): place counts a task's pieces of that length."""
    vocabulary = vocabulary or vocabulary_path()
    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, part int, place bigint" + (", ids binary" if keep_ids else "")

    def cut_up(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        tool, part = encoder(vocabulary), TaskContext.get().partitionId()
        end, count = np.array([end_id], dtype="<u4").tobytes(), dict.fromkeys((1 << b for b in range(full.bit_length())), 0)
        for batch in batches:
            for some in text_batches(batch):
                out: list[list] = [[] for _ in range(8 if keep_ids else 7)]
                for doc_id, ids in zip(some.column("doc_id").to_pylist(), tool.encode(some.column("text").to_pylist())):
                    ids += end
                    n, start = len(ids) // 4, 0
                    for length in binary_lengths(n, full):
                        piece = ids[4 * start : 4 * (start + length)]
                        for column, value in zip(out, (doc_id, start, length, zlib.crc32(piece), n, part, count[length], piece)):
                            column.append(value)
                        start += length
                        count[length] += 1
                kinds = [pa.int64()] * 5 + [pa.int32(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "place", "ids"][: len(out)])

    return docs.select("doc_id", "text").mapInArrow(cut_up, schema)


def pack(docs: DataFrame, vocabulary: str | None = None, end_id: int = 2, full: int = FULL, keep_ids: bool = False) -> DataFrame:
    """Pieces with sequence_id (gapless; longest bucket first) and offset (always 0: a piece fills its sequence).

    Null texts are empty and hold the end id alone; repeated rows are packed like any others; an empty
    table gives no rows; other columns are not looked at.
    """
    made = cut(pieces(docs, vocabulary, end_id, full, keep_ids), "pieces")
    # A row for each task and length: a bucket's numbers start where the longer buckets and earlier tasks end.
    counts = made.groupBy("length", "part").agg(F.count("*").alias("n"))
    inside = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    longer = Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)  # a row a length: 13 at most
    bases = counts.groupBy("length").agg(F.sum("n").alias("n")).select("length", F.coalesce(F.sum("n").over(longer), F.lit(0)).alias("base"))
    starts = counts.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(bases, "length")
    starts = starts.select("length", "part", (F.col("before") + F.col("base")).alias("first"))
    ids = ["ids"] if keep_ids else []
    return made.join(starts, ["length", "part"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.col("place")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"), *ids)
