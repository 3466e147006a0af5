"""Helpers shared by the text operators: row access in Arrow batches, staged tables, ASCII words, folds."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.session import run_folder


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet below spark.checkpoint.dir and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = run_folder(spark, name)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def fold(col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds. A null id is in fold -1."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % folds, F.lit(-1)).cast("int")


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each value; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def ascii_words(text: bytes) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` with A-Z in lower case."""
    return text.lower().split()


PUNCTUATION = bytes(32 if i < 128 and not chr(i).isalnum() else i for i in range(256))


def plain_words(text: bytes) -> list[bytes]:
    """Lower-case words without ASCII punctuation; a sign separates words as a space does."""
    return text.decode("utf-8", "replace").lower().encode().translate(PUNCTUATION).split()


def slices(batches: Iterable[pa.RecordBatch], most: int = 512, most_bytes: int = 16_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of few rows and of at most about `most_bytes` of text, or one row, so that Python holds little at once."""
    for batch in batches:
        size = np.zeros(batch.num_rows, np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
                size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        before = np.concatenate(([0], np.cumsum(size)))
        at = 0
        while at < batch.num_rows:
            full = int(np.searchsorted(before, before[at] + most_bytes, side="right")) - 1
            to = min(batch.num_rows, at + most, max(full, at + 1))
            yield batch.slice(at, to - at)
            at = to


def split_words(column: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """(all words of the column in a row, words per row): runs without ASCII blanks, as `bytes.split` cuts them; null is empty. lower: A-Z as a-z."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    cut = pc.ascii_split_whitespace(pc.fill_null(column.cast(pa.large_string()), ""))
    flat = cut.flatten()
    if lower:  # the words, not the column: the kernel fails on text that does not begin at its buffer's start
        flat = pc.ascii_lower(flat)
    some = np.asarray(pc.binary_length(flat)) > 0  # blanks at the ends of a text leave empty pieces
    ends = np.asarray(cut.offsets)
    count = np.diff(np.concatenate(([0], np.cumsum(some)))[ends - ends[0]])
    return (flat if some.all() else flat.filter(pa.array(some))).cast(pa.large_binary()), count


def mixed(h: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit integers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(max(0, n - 1), base, np.uint64))))


def hashed(words: pa.Array, piece: int = 2_000_000) -> np.ndarray:
    """64-bit hashes of non-empty words (large binary), computed on their bytes at once: two polynomials modulo 2**64, scrambled together."""
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    out = np.empty(len(words), np.uint64)
    if not len(words):
        return out
    longest = int(np.diff(offsets).max())
    p, q = powers(0x9E3779B97F4A7C15, longest), powers(0xD6E8FEB86659FD93, longest)
    at = 0
    while at < len(words):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + piece, side="right")) - 1)
        start, size = offsets[at:to], np.diff(offsets[at : to + 1])
        place = np.arange(offsets[at], offsets[to]) - np.repeat(start, size)
        code = data[offsets[at] : offsets[to]].astype(np.uint64) + np.uint64(1)
        first = start - offsets[at]
        a, b = np.add.reduceat(code * p[place], first), np.add.reduceat(code * q[place], first)
        out[at:to] = mixed(a) + mixed(b ^ (size.astype(np.uint64) << np.uint64(32)))
        at = to
    return out


def set_apart(docs: DataFrame, used: Iterable[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with all columns but the `used` ones under names that no operator uses, and the way back to the columns of docs."""
    names = {c: c if c in used else f"__c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), lambda df: df.select(*[F.col(n).alias(c) for c, n in names.items()])


#: A filter of 64-bit hashes: 2**20 words of 64 bits, two bits of one word for each hash. Its size is fixed; only its false hits grow.
FILTER_WORDS = 20


def id_hash(column: str) -> Column:
    """Hash of an id as text, alike for ids of other integer types."""
    return F.xxhash64(F.col(column).cast("string"))


def hash_filter(rows: DataFrame, column: str) -> np.ndarray:
    """The filter of id_hash(column) over rows: one bit-or per word in Spark, at most 2**20 rows to the driver."""
    h = id_hash(column).alias("h")
    bits = F.expr("shiftleft(1L, cast(h & 63 as int)) | shiftleft(1L, cast(shiftright(h, 6) & 63 as int))")
    words = rows.select(h).groupBy(F.shiftrightunsigned("h", 64 - FILTER_WORDS).alias("w")).agg(F.bit_or(bits).alias("b")).toPandas()
    held = np.zeros(1 << FILTER_WORDS, np.uint64)
    held[words["w"].to_numpy(dtype=np.int64)] = words["b"].to_numpy(dtype=np.int64).view(np.uint64)
    return held


def may_hold(held: np.ndarray, hashes: pa.Array) -> np.ndarray:
    """Whether each id hash may be in the filter; False is certain."""
    h = hashes.to_numpy(zero_copy_only=False).view(np.uint64)
    one = np.uint64(1)
    bits = np.left_shift(one, h & np.uint64(63)) | np.left_shift(one, (h >> np.uint64(6)) & np.uint64(63))
    return (held[(h >> np.uint64(64 - FILTER_WORDS)).astype(np.int64)] & bits) == bits


class Slots(dict):
    """Word -> dense number, by first use; `made` keeps one value for each number.

    Holds at most `limit` words; `full` says when the owner should start anew, so memory stays bounded.
    """

    def __init__(self, make, limit: int = 400_000, limit_bytes: int = 48_000_000):
        super().__init__()
        self.make, self.limit, self.limit_bytes, self.made, self.held = make, limit, limit_bytes, [], 0

    def __missing__(self, word: bytes) -> int:
        slot = self[word] = len(self.made)
        self.made.append(self.make(word))
        self.held += len(word)
        return slot

    @property
    def full(self) -> bool:
        return len(self.made) >= self.limit or self.held >= self.limit_bytes
