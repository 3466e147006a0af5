"""Approximate distincts and quantiles that are stored per day and merged later: HLL, Theta and KLL sketches in binary columns.

HLL counts a union (relative error about 0.8 % at ``lg_k`` 14). Theta also counts what two ranges share or lack. KLL holds a
distribution (rank error about 1.3 % at ``k`` 200). A month, or any choice of days or keys, comes from the stored sketches alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_K = 14
KLL_K = 400


def daily_sketches(rows: DataFrame, keys: list[str], fields: dict[str, str], numbers: dict[str, str] | None = None, lg_k: int = LG_K, k: int = KLL_K) -> DataFrame:
    """Per key: row count, and per field one HLL and one Theta sketch of its text, per number one KLL sketch.

    Column names are <field>_hll, <field>_theta and <number>_kll. NULLs are left out.
    """
    aggs = [F.count(F.lit(1)).alias("rows")]
    for name, c in fields.items():
        text = F.col(c).cast("string")
        aggs += [F.hll_sketch_agg(text, F.lit(lg_k)).alias(f"{name}_hll"), F.theta_sketch_agg(text, F.lit(lg_k)).alias(f"{name}_theta")]
    aggs += [F.kll_sketch_agg_bigint(F.col(c).cast("long"), F.lit(k)).alias(f"{name}_kll") for name, c in (numbers or {}).items()]
    return rows.groupBy(*keys).agg(*aggs)


def merged(sketches: DataFrame, keys: list[Column | str], lg_k: int = LG_K, k: int = KLL_K) -> DataFrame:
    """Sketches of coarser keys, still sketches: they can be stored and merged again."""
    one = {"hll": lambda c: F.hll_union_agg(c), "theta": lambda c: F.theta_union_agg(c, F.lit(lg_k)), "kll": lambda c: F.kll_merge_agg_bigint(c, F.lit(k))}
    aggs = [one[c.rsplit("_", 1)[1]](c).alias(c) for c in sketches.columns if c.rsplit("_", 1)[-1] in one]
    return sketches.groupBy(*keys).agg(F.sum("rows").alias("rows"), *aggs)


def estimates(sketches: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Distinct values per key and field, 0 where a sketch is missing."""
    return sketches.select(*keys, "rows", *[F.coalesce(F.hll_sketch_estimate(f"{f}_hll"), F.lit(0).cast("long")).alias(f) for f in fields])


def quantiles(sketches: DataFrame, keys: list[str], number: str, points: dict[str, float]) -> DataFrame:
    """Approximate quantiles per key; NULL where no value was seen."""
    kll = F.col(f"{number}_kll")
    seen = F.kll_sketch_get_n_bigint(kll) > 0
    return sketches.select(*keys, *[F.when(seen, F.kll_sketch_get_quantile_bigint(kll, F.lit(p))).alias(n) for n, p in points.items()])


def overlap(a: DataFrame, b: DataFrame, field: str, lg_k: int = LG_K) -> DataFrame:
    """One row from the sketches of two inputs: distinct values of each, in both, in the first only, in the second only, and the share of the sum."""
    column = f"{field}_theta"
    one = lambda df, name: df.agg(F.theta_union_agg(column, F.lit(lg_k)).alias(name), F.lit(0).alias("_k"))
    both = one(a, "a").join(one(b, "b"), "_k")
    count = lambda s: F.theta_sketch_estimate(s)
    out = both.select(
        count("a").alias("ids_a"), count("b").alias("ids_b"), count(F.theta_intersection("a", "b")).alias("common"),
        count(F.theta_difference("a", "b")).alias("only_a"), count(F.theta_difference("b", "a")).alias("only_b"))
    return out.withColumn("pct_of_sum", F.round(F.try_divide(F.lit(100.0) * F.col("common"), F.col("ids_a") + F.col("ids_b")), 2))


def within(estimated: DataFrame, exact: DataFrame, keys: list[str], columns: list[str], bound: float) -> DataFrame:
    """keys, the exact counts, and per column whether the estimate is within ``bound`` of it (relative, one off at least)."""
    near = lambda c: F.abs(F.col(f"_e_{c}") - F.col(c)) <= F.greatest(F.lit(1.0), F.col(c) * F.lit(bound))
    named = estimated.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[F.col(c).alias(f"_e_{c}") for c in columns])
    on = [exact[k].eqNullSafe(named[f"_k_{k}"]) for k in keys] or F.lit(True)
    return exact.join(named, on, "left").select(*keys, *columns, *[F.coalesce(near(c), F.lit(False)).alias(f"{c}_ok") for c in columns])
