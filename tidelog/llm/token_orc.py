"""Token ids in ORC files: one row per document, run-length-encoded ids, row indexes, Bloom filters on document ids.

Files are written in ascending id order by a range-partitioned sort, so that the stripe and row-index statistics of doc_id
are disjoint and a reader of few ids skips the rest; the Bloom filters cut what the ranges leave. A reader of all rows reads the
stripes in parallel, as ORC splits by stripe.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import slices
from tidelog.llm.words import encoder

STRIPE = 64 * 1024 * 1024


def ids_crc32(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", stripe_bytes: int = STRIPE) -> None:
    """Write (doc_id, part, place, ids) of each row of docs to ORC at `path`, ascending by doc_id.

    ids: the whole text's ids and the end id; null text counts as empty. part: the writing task, ascending with the ids; place: ids
    before the document within its part. Null ids come first; rows with the same id are ordered by text. No rows give files without rows.
    Other columns of docs are not read.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place = TaskContext.get().partitionId(), 0
        for batch in slices(batches, 512, 8_000_000):
            ids, size = encoder(tokenizer).encode(batch.column(1), end_id)
            ends = np.cumsum(size)
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(ids, pa.int32()))
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(n, part), pa.int32()), pa.array(place + ends - size, pa.int64()), ids], names=["doc_id", "part", "place", "ids"])
            place += int(ends[-1])

    schema = T.StructType([T.StructField("doc_id", src.schema["doc_id"].dataType), T.StructField("part", T.IntegerType()), T.StructField("place", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])
    ordered = src.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, schema)
    (
        ordered.write.option("orc.stripe.size", str(stripe_bytes)).option("orc.row.index.stride", "1000").option("orc.create.index", "true")
        .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").option("orc.compress", "ZSTD").orc(path)
    )


def read_tokens(spark: SparkSession, path: str, doc_ids: list | None = None) -> DataFrame:
    """(doc_id, ids) of all documents, or of the listed ids only: that filter reaches the ORC reader's ranges and Bloom filters."""
    df = spark.read.orc(path).select("doc_id", "ids")
    return df if doc_ids is None else df.filter(F.col("doc_id").isin(list(doc_ids)))


def starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, before): ids in all earlier parts, from the id-free columns; one row per writing task."""
    held = spark.read.orc(path)
    total = held.groupBy("part").agg(F.max(F.col("place") + F.size("ids")).alias("n"))
    return total.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))


def digest(spark: SparkSession, path: str, summary: Callable[[np.ndarray], int] = ids_crc32) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the files at `path`."""
    held = spark.read.orc(path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            at = ids.offsets.to_numpy()
            flat = ids.values.to_numpy(zero_copy_only=False)
            crc = [summary(flat[a:b]) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(at), pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "part", "place", "n_tokens", "ids_crc32"])

    schema = T.StructType([held.schema["doc_id"], T.StructField("part", T.IntegerType()), T.StructField("place", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])
    rows = held.select("doc_id", "part", "place", "ids").mapInArrow(run, schema)
    return rows.join(F.broadcast(starts(spark, path)), "part").select("doc_id", (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")
