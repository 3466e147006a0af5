"""Nearest neighbours by learned partitions: a balanced partition of a neighbour graph, a classifier that routes, exact reranking.

A bounded sample gives a graph of nearest neighbours, a balanced partition of that graph (halving along main directions, then moves of vectors to the
part of most neighbours as room allows), and a softmax classifier of the parts of a vector's neighbours. Every vector is stored in its most probable
part. A query visits its most probable parts, as many as reached the wanted recall between sample vectors that the classifier was not fitted on, and
at least as many as hold `least_rows` vectors. Parts are scanned in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.llm.common import staged


def top_rows(q: np.ndarray, x: np.ndarray, k: int, own: np.ndarray | None = None) -> np.ndarray:
    """Rows of the k largest inner products of each query, largest first; own: a row to leave out of each."""
    out = np.empty((q.shape[0], min(k, x.shape[0] - (own is not None))), np.int64)
    for at in range(0, q.shape[0], 512):
        s = q[at : at + 512] @ x.T
        if own is not None:
            s[np.arange(s.shape[0]), own[at : at + 512]] = -np.inf
        best = np.argpartition(-s, out.shape[1] - 1, axis=1)[:, : out.shape[1]] if out.shape[1] < x.shape[0] else np.argsort(-s, axis=1)
        out[at : at + 512] = np.take_along_axis(best, np.argsort(-np.take_along_axis(s, best, 1), axis=1), 1)
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rng: np.random.Generator, slack: float = 1.1, rounds: int = 8) -> np.ndarray:
    """Part of each vector: equal halves along main directions, then moves towards the part of most graph neighbours under a size limit."""
    part = np.zeros(x.shape[0], np.int64)

    def halve(rows: np.ndarray, low: int, n: int) -> None:
        if n == 1:
            part[rows] = low
            return
        centred = x[rows] - x[rows].mean(axis=0)
        v = rng.standard_normal(x.shape[1])
        for _ in range(12):
            v = centred.T @ (centred @ v)
            v /= np.linalg.norm(v) + 1e-30
        order = rows[np.argsort(centred @ v, kind="stable")]
        cut = rows.size * (n // 2) // n
        halve(order[:cut], low, n // 2)
        halve(order[cut:], low + n // 2, n - n // 2)

    halve(np.arange(x.shape[0]), 0, parts)
    room = int(slack * x.shape[0] / parts) + 1
    for _ in range(rounds):
        votes = np.zeros((x.shape[0], parts), np.int32)
        np.add.at(votes, (np.repeat(np.arange(x.shape[0]), graph.shape[1]), part[graph].reshape(-1)), 1)
        want = votes.argmax(axis=1)
        gain = votes[np.arange(x.shape[0]), want] - votes[np.arange(x.shape[0]), part]
        size, moved = np.bincount(part, minlength=parts), 0
        for i in np.argsort(-gain, kind="stable")[: int((gain > 0).sum())].tolist():
            if size[want[i]] < room:
                size[part[i]] -= 1
                size[want[i]] += 1
                part[i] = want[i]
                moved += 1
        if not moved:
            break
    return part


@dataclass
class Router:
    """Softmax classifier of parts: a hidden layer of rectified units; `visits` parts reach the wanted recall."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    visits: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def ranked(self, x: np.ndarray) -> np.ndarray:
        return np.argsort(-self.scores(x), axis=1, kind="stable")


def train_router(x: np.ndarray, target: np.ndarray, rng: np.random.Generator, hidden: int = 96, epochs: int = 30) -> Router:
    """Fit the classifier to the distribution of parts among each vector's neighbours, by Adam on cross entropy."""
    scale = np.sqrt(2 / x.shape[1])
    p = [rng.standard_normal((x.shape[1], hidden)) * scale, np.zeros(hidden), rng.standard_normal((hidden, target.shape[1])) * 0.05, np.zeros(target.shape[1])]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for epoch in range(epochs):
        order, rate = rng.permutation(x.shape[0]), 0.01 * (1 - epoch / epochs) + 0.0005
        for at in range(0, order.size, 256):
            rows = order[at : at + 256]
            h = np.maximum(x[rows] @ p[0] + p[1], 0)
            s = h @ p[2] + p[3]
            e = np.exp(s - s.max(axis=1, keepdims=True))
            d = (e / e.sum(axis=1, keepdims=True) - target[rows]) / rows.size
            dh = (d @ p[2].T) * (h > 0)
            t += 1
            for i, g in enumerate((x[rows].T @ dh, dh.sum(0), h.T @ d, d.sum(0))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.99 * v[i] + 0.01 * g * g
                p[i] -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.99**t)) + 1e-8)
    return Router(*p, visits=1)


def fit(sample: np.ndarray, parts: int, k: int = 20, recall: float = 0.96, neighbours: int = 10, seed: int = 5) -> Router:
    """Router over a sample; a quarter of it is held out, and sets the visits by the neighbours that at most 2000 of these have among the others of it."""
    rng = np.random.default_rng(seed)
    held = rng.permutation(sample.shape[0])[: max(2, sample.shape[0] // 4)]
    mask = np.ones(sample.shape[0], bool)
    mask[held] = False
    x = sample[mask]
    graph = top_rows(x, x, neighbours, np.arange(x.shape[0]))
    part = balanced_parts(x, graph, parts, rng)
    target = np.zeros((x.shape[0], parts))
    np.add.at(target, (np.repeat(np.arange(x.shape[0]), neighbours), part[graph].reshape(-1)), 1.0 / (neighbours + 2))
    target[np.arange(x.shape[0]), part] += 2.0 / (neighbours + 2)
    router = train_router(x, target, rng)
    y = sample[held]
    stored = router.scores(y).argmax(axis=1)
    asked = np.arange(min(2000, y.shape[0]))
    # of the k nearest in the sample, the held-out quarter has its share
    near = top_rows(y[asked], y, min(-(-k * y.shape[0] // sample.shape[0]), y.shape[0] - 1), asked)
    rank = np.argsort(router.ranked(y[asked]), axis=1)
    found = np.sort(np.take_along_axis(rank, stored[near], 1).reshape(-1))
    router.visits = int(found[min(found.size - 1, int(np.ceil(recall * found.size)) - 1)]) + 1
    return router


def parts_of(count: int) -> int:
    """Number of parts: half the square root of the vectors' number, 1 below 64 vectors, at most 256."""
    return max(1, min(256, math.isqrt(count) // 2)) if count >= 64 else 1


def vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v, row): usable vectors in double precision, once for each id and vector; row is a hash that tells them apart."""
    v = F.transform(F.col(vec_col), lambda e: e.cast("double"))
    ok = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("v", lambda e: e != 0)
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ok)
    return rows.distinct().withColumn("row", F.xxhash64("vec_id", "v"))


def matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def block_top(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, q_rows: np.ndarray | None = None, rows_of: np.ndarray | None = None) -> list[np.ndarray]:
    """(query's row, query id, id, score) of each query's k best in a block, ties to smaller ids; scores summed alike in every block.

    A query leaves out its own row; without row numbers, the ids are these.
    """
    q_rows, rows_of = q_ids if q_rows is None else q_rows, ids if rows_of is None else rows_of
    order = np.argsort(ids, kind="stable")
    ids, x, rows_of = ids[order], x[order], rows_of[order]
    # of equal vectors, the k + 1 smallest ids can be among the best
    _, same = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * 8))).reshape(-1), return_inverse=True)
    by = np.argsort(same, kind="stable")
    first = np.concatenate(([0], np.flatnonzero(np.diff(same[by])) + 1))
    nth = np.arange(by.size) - np.repeat(first, np.diff(np.concatenate((first, [by.size]))))
    keep = np.sort(by[nth <= k])
    ids, x, rows_of = ids[keep], x[keep], rows_of[keep]
    out = []
    for at in range(0, q_ids.size, 256):
        s = q[at : at + 256] @ x.T
        s[q_rows[at : at + 256, None] == rows_of[None, :]] = -np.inf
        n = min(k, ids.size)
        least = np.partition(s, ids.size - n, axis=1)[:, ids.size - n]
        for i in range(s.shape[0]):
            rows = np.flatnonzero((s[i] >= least[i] - 1e-9 * max(1.0, abs(least[i]))) & (s[i] > -np.inf)) if least[i] > -np.inf else np.flatnonzero(s[i] > -np.inf)
            exact = (x[rows] * q[at + i]).sum(axis=1)
            best = np.lexsort((ids[rows], -exact))[:k]
            out.append(np.rec.fromarrays([np.full(best.size, q_rows[at + i]), np.full(best.size, q_ids[at + i]), ids[rows[best]], exact[best]], names="r,q,i,s"))
    return out


def search(df: DataFrame, queries_of, k: int = 20, recall: float = 0.96, id_col: str = "vec_id", vec_col: str = "embedding", part_rows: int | None = None, sample_rows: int = 20_000, block_rows: int = 20_000, block_queries: int = 4000, least_rows: int = 500) -> DataFrame:
    """(query_id, rank, vec_id, score): for the rows that queries_of(vec_id column) picks, the k nearest found among all other rows by inner product.

    Vectors that are null, zero, hold null or non-finite components, or lack an id take no part, nor do those whose size is not the most common one.
    Ties go to the smaller id. Rows with one id and different vectors are rows of their own, as candidates and as queries; equal rows count once. A query with fewer than k others gets all of them. No rows give no
    rows. The router is fitted on at most `sample_rows` vectors by hash order, every vector is stored; parts and their queries are scanned in
    blocks of bounded size. There are `parts_of` parts, or one for `part_rows` vectors. The parts that a query visits hold at least `least_rows`
    vectors, so tables up to that size are searched whole, the larger ones in part. Other columns are not read.
    """
    spark = df.sparkSession
    rows = staged(vectors(df, id_col, vec_col).withColumn("n", F.size("v")), "vectors")
    sizes = rows.groupBy("n").count().orderBy(F.desc("count"), "n").first()
    empty = "query_id long, rank int, vec_id long, score double"
    if sizes is None or rows.filter(queries_of(F.col("vec_id"))).isEmpty():
        return spark.createDataFrame([], empty)
    size, count = int(sizes["n"]), int(sizes["count"])
    rows = rows.filter(F.col("n") == size).select("vec_id", "v", "row")
    parts = max(1, min(256, count // part_rows)) if part_rows else parts_of(count)
    router = None
    if parts > 1:
        drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("v").toArrow()
        router = fit(matrix(drawn["v"].combine_chunks(), size), parts, k, recall)
    held = spark.sparkContext.broadcast(router)

    def stored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = held.value.scores(matrix(batch.column(1), size)).argmax(axis=1) if held.value else np.zeros(batch.num_rows, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *batch.columns], names=["part", "vec_id", "v", "row"])

    index = staged(rows.mapInArrow(stored, "part int, vec_id long, v array<double>, row long"), "index")
    held_rows = {r["part"]: r["count"] for r in index.groupBy("part").count().collect()}
    blocks = {p: -(-n // block_rows) for p, n in held_rows.items()}

    def routed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = matrix(batch.column(1), size)
            ranked = held.value.ranked(q) if held.value else np.zeros((batch.num_rows, 1), np.int64)
            there = np.array([held_rows.get(p, 0) for p in range(parts)])[ranked]
            # the visits that reach the recall, and further parts until these hold k others and least_rows
            use = (np.arange(parts)[None, :] < (held.value.visits if held.value else 1)) | (np.cumsum(there, axis=1) - there <= max(k, least_rows - 1))
            of, at = np.nonzero(use & (there > 0))
            yield pa.RecordBatch.from_arrays([pa.array(ranked[of, at], pa.int32()), *[c.take(pa.array(of)) for c in batch.columns]], names=["part", "vec_id", "v", "row"])

    asked = staged(rows.filter(queries_of(F.col("vec_id"))).mapInArrow(routed, "part int, vec_id long, v array<double>, row long"), "asked")
    per_part = {p: 0 for p in held_rows} | {r["part"]: -(-r["count"] // block_queries) for r in asked.groupBy("part").count().collect()}
    number = lambda m: F.element_at(F.create_map(*[F.lit(int(x)) for kv in sorted(m.items()) for x in kv]), F.col("part"))
    salt = lambda c, n: F.pmod(F.xxhash64("row", F.lit(c)), n).cast("int")
    # each block of a part meets each block of the queries that visit it
    left = index.withColumn("b", salt("b", number(blocks))).filter(number(per_part) > 0).withColumn("qb", F.explode(F.sequence(F.lit(0), number(per_part) - 1)))
    right = asked.withColumn("qb", salt("q", number(per_part))).withColumn("b", F.explode(F.sequence(F.lit(0), number(blocks) - 1)))

    def block(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"query_row": pd.Series(dtype="int64"), "query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        found = np.concatenate(block_top(b["vec_id"].to_numpy(), np.stack(b["v"].to_numpy()), a["vec_id"].to_numpy(), np.stack(a["v"].to_numpy()), k, b["row"].to_numpy(), a["row"].to_numpy()))
        return pd.DataFrame({"query_row": found["r"], "query_id": found["q"], "vec_id": found["i"], "score": found["s"]})

    keys = ["part", "b", "qb"]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(block, "query_row long, query_id long, vec_id long, score double")
    best = F.row_number().over(W.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", best).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
