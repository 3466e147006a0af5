"""SimHash near-duplicates: fingerprints, vantage-point shards for pairs within a bit distance, components.

Search. Two 64-bit fingerprints that differ in at most k bits differ in at most k // 2 bits in one half. For each half a
vantage-point tree splits the 32-bit values by their distance to a vantage value; a value within the radius of the border goes
to both sides (|d(x,p) - d(y,p)| <= d(x,y)), so two values within the radius meet in the home shard of each. The upper tree
is fitted on a bounded sample of fingerprints, ordered by hash; every fingerprint is then dealt to its shards, where the tree
goes on and the members of a small leaf are compared on all 64 bits. A leaf returns a spanning star of its links, not the pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import ascii_words, set_apart, slices, staged, texts
from tidelog.llm.components import local_stars, stars

LANES = np.uint64(0x0101010101010101)


def bit_votes(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits; bit b at place b."""
    votes = np.zeros((8, 8), dtype=np.int64)
    for at in range(0, h.size, 255):
        block = h[at : at + 255]
        for b in range(8):
            votes[:, b] += np.add.reduce((block >> np.uint64(b)) & LANES).reshape(1).view(np.uint8)
    return votes.reshape(64)


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Fingerprint of a whole text: bit set where over half of the shingle hashes have it; no words: zero."""
    words = ascii_words(text)
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    begin = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
    end = begin + size
    last = end[shingle - 1 :].tolist() if len(words) >= shingle else [len(joined)]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], 42) for a, b in zip(begin.tolist(), last)), dtype=np.uint64, count=len(last))
    bits = bit_votes(h) * 2 > h.size
    return int((bits.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum())


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fingerprint", shingle: int = 3) -> DataFrame:
    """docs with the fingerprint of `text` as a signed long in column `name`; null text counts as empty."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at = batch.schema.get_field_index(text)
            out = np.array([fingerprint(t, shingle) for t in texts(batch.column(at))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def halves(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u = f.view(np.uint64)
    return (u >> np.uint64(32)).astype(np.uint32), u.astype(np.uint32)


class Vantage:
    """A node of the tree over 32-bit values: within `radius` of `point` or beyond."""

    def __init__(self, point: int, radius: int):
        self.point, self.radius, self.inside, self.outside = point, radius, None, None


def vantage(values: np.ndarray, rng: np.random.Generator) -> Vantage | None:
    """The vantage value, out of a few, that splits the values most evenly; None if none splits them."""
    best, found = 0.0, None
    for p in rng.choice(values, size=min(6, values.size), replace=False):
        d = np.bitwise_count(values ^ p)
        at = int(np.median(d))
        for r in (at - 1, at):
            inside = float((d <= r).mean())
            near = float(((d == r) | (d == r + 1)).mean())
            gain = min(inside, 1 - inside) * (1 - 0.7 * near)
            if gain > best:
                best, found = gain, Vantage(int(p), r)
    return found if best > 0.02 else None


def grow(values: np.ndarray, leaf: int, rng: np.random.Generator) -> Vantage | None:
    """Tree over a sample; leaves (None) hold about `leaf` sampled values, with no copies over the borders."""
    if values.size <= leaf:
        return None
    node = vantage(values, rng)
    if node is not None:
        inside = np.bitwise_count(values ^ np.uint32(node.point)) <= node.radius
        node.inside, node.outside = grow(values[inside], leaf, rng), grow(values[~inside], leaf, rng)
    return node


def deal(node: Vantage | None, values: np.ndarray, rows: np.ndarray, reach: int, path: int, out: list) -> None:
    """Collect (leaf path, rows): each row in every leaf that its ball of radius `reach` overlaps."""
    if node is None or not rows.size:
        out.append((path, rows))
        return
    d = np.bitwise_count(values[rows] ^ np.uint32(node.point)).astype(np.int64)
    deal(node.inside, values, rows[d - reach <= node.radius], reach, path * 2, out)
    deal(node.outside, values, rows[d + reach > node.radius], reach, path * 2 + 1, out)


def leaf_links(f: np.ndarray, rows: np.ndarray, bits: int, out: list) -> None:
    """Links among a leaf's fingerprints; of a dense leaf only those by which a search reaches its members."""
    g = f[rows]
    if g.size <= 1024:
        near = np.triu(np.bitwise_count(g[:, None] ^ g[None, :]) <= bits, 1)
        if near.sum() <= 8 * g.size:
            a, b = np.nonzero(near)
            out.append((rows[a], rows[b]))
            return
    rest = np.arange(g.size)
    while rest.size:
        queue, rest = [rest[0]], rest[1:]
        while queue and rest.size:
            x = queue.pop()
            near = np.bitwise_count(g[rest] ^ g[x]) <= bits
            if near.any():
                hit = rest[near]
                out.append((np.full(hit.size, rows[x]), rows[hit]))
                queue.extend(hit.tolist())
                rest = rest[~near]


def shard_links(f: np.ndarray, values: np.ndarray, rows: np.ndarray, bits: int, rng: np.random.Generator, out: list) -> None:
    """The tree within a shard: split, copy over the border, compare in small leaves."""
    if rows.size > 512:
        node = vantage(values[rng.choice(rows, size=min(2000, rows.size), replace=False)], rng)
        if node is not None:
            d = np.bitwise_count(values[rows] ^ np.uint32(node.point)).astype(np.int64)
            reach = bits // 2
            inside, outside = rows[d - reach <= node.radius], rows[d + reach > node.radius]
            if max(inside.size, outside.size) < 0.95 * rows.size:
                shard_links(f, values, inside, bits, rng, out)
                shard_links(f, values, outside, bits, rng, out)
                return
    if rows.size > 1:
        leaf_links(f, rows, bits, out)


def links(prints: DataFrame, bits: int = 3, shard_rows: int = 20_000, sample_rows: int = 131_072, seed: int = 7) -> DataFrame:
    """(a, b): links between the distinct fingerprints `fp` of prints that differ in at most `bits` bits.

    Every two fingerprints within that distance are joined by a chain of the returned links, and each returned link is within it.
    The tree above the shards is fitted on at most `sample_rows` fingerprints; shards hold about `shard_rows` and their borders.
    """
    spark = prints.sparkSession
    n = prints.count()
    wanted = max(1, n // shard_rows)
    sample = min(n, sample_rows, max(2048, 32 * wanted))
    drawn = prints.orderBy(F.xxhash64("fp"), "fp").limit(sample).toPandas()["fp"].to_numpy(dtype=np.int64)
    rng = np.random.default_rng(seed)
    trees = spark.sparkContext.broadcast([grow(v, max(4, drawn.size // wanted), rng) for v in halves(drawn)])

    def shards(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = batch.column(0).to_numpy(zero_copy_only=False)
            for side, v in enumerate(halves(f)):
                out: list = []
                deal(trees.value[side], v, np.arange(f.size), bits // 2, 1, out)
                for path, rows in out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(rows.size, path * 2 + side), pa.int64()), pa.array(f[rows])], names=["shard", "fp"])

    def within(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        f = table.column("fp").to_numpy().view(np.uint64)
        found: list = []
        side = key[0].as_py() % 2
        shard_links(f, halves(f)[side], np.arange(f.size), bits, np.random.default_rng(seed), found)
        a, b = (np.concatenate([x[i] for x in found]) if found else np.zeros(0, dtype=np.int64) for i in (0, 1))
        root = local_stars(f.size, a, b)
        member = np.nonzero(root != np.arange(f.size))[0]
        s = f.view(np.int64)
        return pa.table({"a": pa.array(s[root[member]], pa.int64()), "b": pa.array(s[member], pa.int64())})

    return prints.select("fp").mapInArrow(shards, "shard long, fp long").groupBy("shard").applyInArrow(within, "a long, b long")


def groups(prints: DataFrame, bits: int = 3, least: Column | None = None) -> DataFrame:
    """(fp, least, root) for each distinct fingerprint of prints(id, fp, ..): its smallest id, or what the aggregate `least` gives, and one root for all that links of at most `bits` bits join."""
    distinct = staged(prints.groupBy("fp").agg((F.min("id") if least is None else least).alias("least")), "fingerprints")
    root = stars(links(distinct, bits), "links")
    return distinct.join(root, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bits: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs, by its whole text.

    Repeated rows and repeated ids give a row each. Null or empty texts have fingerprint zero, which links like any other. The
    component id is the smallest id in the component; null ids count as larger than all, so it is null only if all are null. No rows give no rows.
    Other columns of docs are not read.
    """
    prints = with_fingerprint(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), "text", "fp", shingle).select("id", "fp")
    prints = staged(prints, "prints")
    of = groups(prints, bits)
    of = of.join(of.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return prints.join(of, "fp").select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bits: int = 3) -> DataFrame:
    """docs with one row of each component: the one with the smallest id; of rows with the same id, by the MD5 of the text, then the first by all columns.

    Fingerprints are computed once: rows are found again by id and MD5 of the text, which fix the component. Null or empty texts count
    as empty, null ids as larger than all. No rows give no rows. All columns stay, whatever their names.
    """
    docs, back = set_apart(docs, [id_col, text_col])
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    marked = docs.withColumn("__key", F.concat_ws("|", F.col(id_col).cast("string"), F.md5(text.cast("binary"))))
    prints = with_fingerprint(marked.select(F.col(id_col).alias("id"), text.alias("text"), F.col("__key").alias("key")), "text", "fp", shingle).select("id", "key", "fp")
    of = groups(staged(prints, "prints"), bits, F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")))
    kept = of.groupBy("root").agg(F.min("least").alias("k")).select(F.col("k.key").alias("__key"))
    left = marked.join(kept, "__key", "left_semi")
    whole = F.struct(*[F.col(f.name) if not isinstance(f.dataType, (T.MapType, T.VariantType)) else F.to_json(F.col(f.name)) for f in docs.schema.fields])
    return back(left.withColumn("__n", F.row_number().over(W.partitionBy("__key").orderBy(whole))).filter("__n = 1"))
