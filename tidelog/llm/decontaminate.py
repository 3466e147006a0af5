"""Benchmark passages in documents by greedy string tiling.

Words are lower-case, signs separate. Word hashes and the Karp-Rabin hashes of their runs of `tile` words run vectorised over every
document; a fixed-size Bloom filter of the benchmark's runs picks the documents that share a seed, and only these go on, as hash arrays. Seeds join
the benchmark's by hash; a pair whose shared seeds could not cover the threshold is dropped (tiles are made of such seeds, so this loses
nothing). The others are tiled: the longest match of unmarked words is marked again and again, so passages in another order count too.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import Slots, plain_words, set_apart, slices, staged, texts

#: Bits of the filter; its size does not grow with the benchmark, only its false hits do, and the join removes those.
FILTER_BITS = 26
BASE = np.uint64(0x9E3779B97F4A7C15)
ROUNDS = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def seed_hashes(h: np.ndarray, tile: int) -> np.ndarray:
    """Hashes of runs that seed a tile: those of another length never meet."""
    return run_hashes(h, tile) * BASE + np.uint64(tile)


def run_hashes(h: np.ndarray, tile: int) -> np.ndarray:
    """Karp-Rabin hash modulo 2**64 of each run of `tile` word hashes."""
    if h.size < tile:
        return np.zeros(0, np.uint64)
    out, n = np.zeros(h.size - tile + 1, np.uint64), h.size - tile + 1
    for j in range(tile):
        out = out * BASE + h[j : j + n]
    return out ^ (out >> np.uint64(29))


def probes(g: np.ndarray, i: int) -> np.ndarray:
    x = g * ROUNDS[i]
    return (x >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


class WordHashes:
    """64-bit hashes of a text's words; words met before are looked up."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.slots, self.hashes = Slots(xxhash.xxh64_intdigest), np.zeros(0, np.uint64)

    def __call__(self, batch: list[bytes], cut=plain_words) -> list[np.ndarray]:
        if self.slots.full:
            self.clear()
        found = []
        for t in batch:
            w = cut(t)
            found.append(np.fromiter(map(self.slots.__getitem__, w), dtype=np.int64, count=len(w)))
        self.hashes = np.concatenate((self.hashes, np.array(self.slots.made[self.hashes.size :], dtype=np.uint64)))
        return [self.hashes[s] for s in found]


def tiles(doc: np.ndarray, item: np.ndarray, tile: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in doc, place in item, words), longest first, earlier places first among equals."""
    tile = min(tile, item.size)
    if not tile:
        return []
    seeds = defaultdict(list)
    for j, g in enumerate(run_hashes(item, tile).tolist()):
        seeds[g].append(j)
    open_, heap = {}, []
    runs = run_hashes(doc, tile)
    at = np.nonzero(np.isin(runs, np.array(list(seeds), dtype=np.uint64)))[0] if seeds else []
    for i in (int(x) for x in at):
        for j in seeds[int(runs[i])]:
            # a seed one further on the same diagonal lengthens the match
            start = open_.pop((i - 1, j - 1), (i, j))
            open_[i, j] = start
            if (i + 1 >= runs.size or j + 1 > item.size - tile or runs[i + 1] not in seeds or j + 1 not in seeds[int(runs[i + 1])]) and np.array_equal(doc[start[0] : i + tile], item[start[1] : j + tile]):
                heapq.heappush(heap, (-(i + tile - start[0]), *start))
    doc_free, item_free, out = np.ones(doc.size, bool), np.ones(item.size, bool), []
    while heap and item_free.any():
        n, i, j = heapq.heappop(heap)
        free = doc_free[i : i - n] & item_free[j : j - n]
        if free.all():
            doc_free[i : i - n] = item_free[j : j - n] = False
            out.append((i, j, -n))
            continue
        edge = np.flatnonzero(np.diff(np.concatenate(([0], free.astype(np.int8), [0]))))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if b - a >= tile:
                heapq.heappush(heap, (a - b, i + a, j + a))
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, tile: int = 5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, coverage, covered, item_words, tiles, text_hash): pairs whose tiles of at least `tile` words cover the share `threshold` of the item's words.

    Every row of docs is tested by its whole text; repeated rows give their pairs again. Null and empty texts have no words and no pairs; an item with
    fewer than `tile` words is one tile as a whole, an item without words has no pair. Null ids are kept as they are. Repeated benchmark rows with the same id and text count once.
    No documents or no items give no rows. Other columns are not read. tiles: (doc_at, item_at, words), longest first.
    """
    spark = docs.sparkSession

    def item_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches):
            h = hashes(texts(batch.column(1)))
            ends = np.cumsum([0, *[x.size for x in h]])
            runs = [seed_hashes(x, min(tile, x.size)) if x.size else x for x in h]
            run_ends = np.cumsum([0, *[x.size for x in runs]])
            longs = lambda parts, ends: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*parts, np.zeros(0, np.uint64)]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), longs(h, ends), longs(runs, run_ends)], names=["item_id", "item", "runs"])

    src = benchmark.select(F.col(item_col).alias("item_id"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("text")).distinct()
    item_type = src.schema["item_id"].dataType
    items = src.mapInArrow(item_rows, T.StructType([T.StructField("item_id", item_type), T.StructField("item", T.ArrayType(T.LongType())), T.StructField("runs", T.ArrayType(T.LongType()))]))
    items = staged(items.withColumn("item_key", F.xxhash64("item_id", "item")), "items")

    # items shorter than a tile are their own tile; at most `tile` lengths
    lengths = [r[0] for r in items.select(F.least(F.size("item"), F.lit(tile)).alias("n")).filter("n > 0").distinct().collect()]

    def filter_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g = batch.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            at = np.concatenate([probes(g, i) for i in range(len(ROUNDS))])
            word, bit = at >> 6, np.left_shift(np.uint64(1), (at & 63).astype(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bit)], names=["word", "bits"])

    words = items.select("runs").mapInArrow(filter_words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    bitmap = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    bitmap[words["word"].to_numpy(dtype=np.int64)] = words["bits"].to_numpy(dtype=np.int64).view(np.uint64)
    held = spark.sparkContext.broadcast(bitmap)

    def seeded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, bits = WordHashes(), held.value
        for batch in slices(batches):
            rows, found, hits = [], [], []
            for row, h in enumerate(hashes(texts(batch.column(1)))):
                g = np.concatenate([seed_hashes(h, n) for n in lengths]) if lengths else np.zeros(0, np.uint64)
                for i in range(len(ROUNDS)):
                    if g.size:
                        at = probes(g, i)
                        g = g[(bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1]
                if g.size:
                    rows.append(row)
                    found.append(h.view(np.int64))
                    hits.append(np.unique(g).view(np.int64))
            if rows:
                lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *[x.size for x in y]]), pa.int32()), pa.array(np.concatenate(y))) for y in (found, hits)]
                text = batch.column(1).take(pa.array(rows))
                key = pa.array([xxhash.xxh64_intdigest(t) - (1 << 63) for t in texts(text)], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), key, *lists], names=["doc_id", "text_hash", "doc", "seeds"])

    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    long_list = T.ArrayType(T.LongType())
    near = read.mapInArrow(seeded, T.StructType([read.schema["doc_id"], T.StructField("text_hash", T.LongType()), T.StructField("doc", long_list), T.StructField("seeds", long_list)]))
    near = staged(near, "seeded")

    # one test per distinct text and item; copies of a document share it
    texts_once = near.select("text_hash", "seeds").dropDuplicates(["text_hash"])
    seeds = items.select("item_key", F.size("item").alias("n"), F.posexplode("runs").alias("at", "run"))
    pairs = texts_once.select("text_hash", F.explode("seeds").alias("run")).join(seeds, "run").groupBy("text_hash", "item_key", "n").agg(F.sort_array(F.collect_set("at")).alias("at"))
    own = F.least(F.lit(tile), F.col("n"))
    cover = F.aggregate("at", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda s, x: F.struct((s["n"] + x + own - F.greatest(s["end"], x)).alias("n"), (x + own).alias("end")))["n"]
    pairs = pairs.filter(cover >= F.col("n") * F.lit(threshold)).select("text_hash", "item_key")

    def tiled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            out = defaultdict(list)
            for key, item_key, doc, item in zip(*(batch.column(i) for i in range(4))):
                a, b = (np.asarray(x.values.to_numpy(zero_copy_only=False)).view(np.uint64) for x in (doc, item))
                found = tiles(a, b, tile)
                covered = sum(t[2] for t in found)
                if covered >= threshold * b.size:
                    for name, v in (("text_hash", key.as_py()), ("item_key", item_key.as_py()), ("coverage", covered / b.size), ("covered", covered), ("item_words", b.size), ("tiles", [dict(zip(("doc_at", "item_at", "words"), t)) for t in found])):
                        out[name].append(v)
            if out:
                yield pa.RecordBatch.from_pydict(dict(out), schema=arrow)

    arrow = pa.schema([("text_hash", pa.int64()), ("item_key", pa.int64()), ("coverage", pa.float64()), ("covered", pa.int32()), ("item_words", pa.int32()), ("tiles", pa.list_(pa.struct([("doc_at", pa.int32()), ("item_at", pa.int32()), ("words", pa.int32())])))])
    both = pairs.join(near.select("text_hash", "doc").dropDuplicates(["text_hash"]), "text_hash").join(items.select("item_key", "item"), "item_key").select("text_hash", "item_key", "doc", "item")
    done = both.mapInArrow(tiled, "text_hash long, item_key long, coverage double, covered int, item_words int, tiles array<struct<doc_at int, item_at int, words int>>")
    out = near.select("doc_id", "text_hash").join(done, "text_hash").join(items.select("item_key", "item_id"), "item_key")
    return out.select("doc_id", "item_id", "coverage", "covered", "item_words", "tiles", "text_hash")


def text_key(text: bytes) -> int:
    """The text_hash of leaks."""
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def without_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, tile: int = 5, text_col: str = "text") -> DataFrame:
    """docs without the rows whose text leaks() finds; all columns and all other rows as they are, null and empty texts too."""
    found = leaks(docs.select(F.lit(0).alias("doc_id"), text_col), benchmark, threshold, tile, text_col=text_col).select("text_hash").distinct()

    def keyed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([text_key(t) for t in texts(batch.column(at))], pa.int64())], names=[*batch.schema.names, "__text_hash"])

    safe, back = set_apart(docs, [text_col])
    marked = safe.mapInArrow(keyed, T.StructType([*safe.schema.fields, T.StructField("__text_hash", T.LongType())]))
    return back(marked.join(found.withColumnRenamed("text_hash", "__text_hash"), "__text_hash", "left_anti"))
