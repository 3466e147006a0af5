"""Best-fit packing of documents into sequences, online and in bounded space.

A task keeps a fixed number of open bins, in lists by free space; a bitset holds which lists are filled, so the tightest bin that
still takes a piece is one bit operation. When a new bin would exceed the number, the fullest open bin closes. Pieces reach the tasks
in an order that a hash of their content gives, which mixes lengths as online best fit wants them.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import slices, staged
from tidelog.llm.token_orc import ids_crc32
from tidelog.llm.words import encoder


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids): each document's ids and end id, cut every `capacity` ids if longer.

    Null text counts as empty: a piece of the end id alone. Repeated rows give their pieces again. Other columns are not read.
    `with_ids=False` leaves the ids out, for callers that only place the pieces.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    fields = [src.schema["doc_id"], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType(), False))] * with_ids

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512, 8_000_000):
            ids, total = encoder(tokenizer).encode(batch.column(1), end_id)
            count = -(-total // capacity)
            piece = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            size = np.minimum(capacity, np.repeat(total, count) - piece * capacity)
            ends = np.cumsum(size)
            crc = [ids_crc32(ids[a:b]) for a, b in zip((ends - size).tolist(), ends.tolist())]
            cols = [batch.column(0).take(pa.array(np.repeat(np.arange(total.size), count))), pa.array(piece, pa.int32()), pa.array(piece * capacity, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())]
            if with_ids:
                cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(ids, pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])

    return src.mapInArrow(run, T.StructType(fields))


class OpenBins:
    """At most `most` open bins of `capacity`; place(length) gives (bin, offset)."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most, self.filled, self.open, self.made = capacity, most, 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def take(self, free: int) -> int:
        bins = self.by_free[free]
        found = bins.pop()
        self.open -= 1
        if not bins:
            self.filled &= ~(1 << free)
        return found

    def put(self, found: int, free: int) -> None:
        if free:  # a full bin closes
            self.by_free[free].append(found)
            self.filled |= 1 << free
            self.open += 1

    def place(self, length: int) -> tuple[int, int]:
        fits = self.filled >> length
        if fits:
            free = length + ((fits & -fits).bit_length() - 1)
            found = self.take(free)
        else:
            if self.open >= self.most:
                self.take((self.filled & -self.filled).bit_length() - 1)  # the fullest closes
            found, free = self.made, self.capacity
            self.made += 1
        self.put(found, free - length)
        return found, self.capacity - free


def best_fit(pieces: DataFrame, capacity: int = 2048, open_bins: int = 4096, task_rows: int = 400_000) -> DataFrame:
    """pieces and (sequence_id, offset): each piece's sequence and its place there, gapless from 0.

    pieces needs doc_id, piece, start, length (1 to capacity; null or other lengths fail) and ids_crc32, and may carry more. Each
    task packs about `task_rows` pieces with `open_bins` open bins; the sequence id holds the task and its bin, so tasks share none.
    The order of a task's pieces is fixed by their content, so a repeated task gives the same result. Ties: the bin opened or filled last.
    pieces is read twice (count, packing); pass a written table.
    """
    n = pieces.count()
    tasks = max(1, math.ceil(n / task_rows))
    cols = pieces.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, base = OpenBins(capacity, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            lengths = batch.column(at).to_pylist()
            if any(x is None or not 0 < x <= capacity for x in lengths):
                raise ValueError("a piece's length must be from 1 to the capacity")
            placed = [bins.place(x) for x in lengths]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([base + b for b, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())], names=[*cols, "sequence_id", "offset"])

    at = cols.index("length")
    mixed = pieces.repartition(tasks, F.xxhash64("doc_id", "piece", "ids_crc32")).sortWithinPartitions(F.xxhash64("ids_crc32", "doc_id", "piece"), "doc_id", "piece", "length", "ids_crc32")
    return mixed.mapInArrow(run, T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, open_bins: int = 4096) -> DataFrame:
    """Pieces of all documents with their places, by token_pieces (written once) and best_fit; no rows give no rows."""
    return best_fit(staged(token_pieces(docs, tokenizer, capacity, end_id, id_col, text_col, with_ids), "pieces"), capacity, open_bins)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids): the token ids of each sequence in order and the documents of its pieces; a sequence is at most the capacity."""
    rows = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "ids"))).alias("p"))
    return rows.select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"))
