"""Exact percentiles and sums of a distribution from one stored table of (key, value, number of rows).

Rows are folded to value counts once; every later step reads these. Counts are summed per block of ``width`` values, a key's blocks
are laid side by side in one array, a running sum over it finds the block of each wanted rank, and only those blocks are opened.
A task sees at most (value range / width) blocks or the distinct values of one block of a key, however many rows there are. Keys should be few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged

WIDTH = 65_536
_FOLD = {"sum": F.sum, "min": F.min, "max": F.max}


def counted(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """(keys, v, n): the rows of each value, written once. NULL and NaN values are left out; values are longs or doubles."""
    v = F.col(column)
    if dict(df.select(v.alias("v")).dtypes)["v"] not in ("double", "float"):
        v = v.cast("long")
    rows = df.select(*keys, v.alias("v")).where(F.col("v").isNotNull() & ~F.isnan(F.col("v").cast("double")))
    return staged(rows.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("n")), "histogram")


def _at(items: str, rank: Column, item: str) -> Column:
    """The first entry (struct of ``item`` and n, in order) whose running sum of n passes the rank, with the sum before it."""
    start = F.struct(F.lit(0).cast("long").alias("before"), F.get(items, 0)[item].alias("hit"), F.lit(False).alias("found"))
    step = lambda s, b: F.when(s["found"], s).otherwise(F.struct(
        F.when(s["before"] + b["n"] > rank, s["before"]).otherwise(s["before"] + b["n"]).alias("before"), b[item].alias("hit"), (s["before"] + b["n"] > rank).alias("found")))
    return F.aggregate(items, start, step)


def profile(hist: DataFrame, keys: list[str], points: dict[str, float], measures: dict[str, tuple[str, Column]] | None = None, width: int = WIDTH) -> DataFrame:
    """Per key: ``rows``, the folded measures ((sum | min | max, expression over v and n)) and the interpolated percentiles."""
    measures = measures or {}
    keyed = hist.withColumn("_k", F.lit(0)) if not keys else hist
    names = keys or ["_k"]
    per_block = keyed.groupBy(*names, F.floor(F.col("v") / width).cast("long").alias("block")).agg(
        F.sum("n").alias("n"), *[_FOLD[how](e).alias(n) for n, (how, e) in measures.items()])
    per_key = per_block.groupBy(*names).agg(
        F.sum("n").alias("rows"), *[_FOLD[how](n).alias(n) for n, (how, _) in measures.items()],
        F.array_sort(F.collect_list(F.struct("block", "n"))).alias("blocks"))
    wanted = per_key.select(*names, "blocks", "rows", F.inline(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for p, q in points.items()])))
    pos = F.col("q") * (F.col("rows") - 1)
    wanted = wanted.select(*names, "p", pos.alias("pos"), "blocks", F.explode(F.array_distinct(F.array(F.floor(pos), F.ceil(pos)))).alias("rank"))
    hit = wanted.select(*names, "p", "pos", "rank", _at("blocks", F.col("rank"), "block").alias("h"))
    hit = hit.select(*names, "p", "pos", "rank", F.col("h.before").alias("before"), F.col("h.hit").alias("block"))
    inside = keyed.withColumn("block", F.floor(F.col("v") / width).cast("long")).join(F.broadcast(hit), [*names, "block"])
    opened = inside.groupBy(*names, "p", "rank").agg(
        F.first("pos").alias("pos"), F.first("before").alias("before"), F.array_sort(F.collect_list(F.struct("v", "n"))).alias("values"))
    found = opened.select(*names, "p", "pos", _at("values", F.col("rank") - F.col("before"), "v")["hit"].alias("v"))
    at = lambda fold, p, c: fold(F.when(F.col("p") == p, F.col(c)))
    between = lambda p: at(F.min, p, "v") + (at(F.max, p, "v") - at(F.min, p, "v")) * (at(F.max, p, "pos") - F.floor(at(F.max, p, "pos")))
    spread = found.groupBy(*names).agg(*[between(p).alias(p) for p in points])
    out = per_key.drop("blocks").join(F.broadcast(spread), names, "left")
    return out.drop("_k")
