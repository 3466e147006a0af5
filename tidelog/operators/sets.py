"""Set operations: dedup, subtract, overlap, duplicate groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import one_row, percent


def exact_dedup(df: DataFrame) -> DataFrame:
    """Distinct rows; equal rows meet only after a map-side pass, so copies of one row do not skew."""
    return df.distinct()


def dedup_counts(df: DataFrame) -> DataFrame:
    """rows_before, rows_after, removed in one aggregate over row counts."""
    per = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return per.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows_before"), F.count(F.lit(1)).alias("rows_after"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("removed"),
    )


def new_rows(df: DataFrame, master: DataFrame) -> DataFrame:
    """Rows not in the master table; set semantics, so the result is distinct."""
    return df.select(*master.columns).subtract(master)


def common_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*b.columns).intersect(b)


def overlap_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """rows1, rows2, common and rows1 + rows2 - 2 * common."""
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    out = one_row(n(a, "rows1"), n(b, "rows2"), n(common_rows(a, b), "common"))
    return out.withColumn("unmatched", F.col("rows1") + F.col("rows2") - 2 * F.col("common"))


def all_pairs_overlap(df: DataFrame, source: str, columns: list[str]) -> DataFrame:
    """Distinct rows shared by each pair of sources, in one pass over the rows.

    Each distinct row is reduced to the sorted set of its sources; equal source sets are
    counted first, and only the sets (bounded by the number of sources, not rows) are paired.
    """
    tagged = df.select(F.col(source).cast("string").alias("_s"), F.struct(*columns).alias("_r")).distinct()
    sets = tagged.groupBy("_r").agg(F.sort_array(F.collect_set("_s")).alias("_sources")).where(F.size("_sources") > 1)
    per_set = sets.groupBy("_sources").agg(F.count(F.lit(1)).alias("n"))
    left = per_set.select("n", "_sources", F.posexplode("_sources").alias("_i", "source_a"))
    pairs = left.select("n", "source_a", F.explode(F.expr("slice(_sources, _i + 2, size(_sources))")).alias("source_b"))
    return pairs.groupBy("source_a", "source_b").agg(F.sum("n").alias("common_rows"))


def duplicate_groups(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Groups of equal rows (on all or the given columns) with their size."""
    return df.groupBy(*(columns or df.columns)).agg(F.count(F.lit(1)).alias("count")).where(F.col("count") > 1)


def duplicate_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return duplicate_groups(df, columns).agg(
        F.count(F.lit(1)).alias("duplicate_groups"), F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("extra_rows")
    )


def union_sources(*frames: DataFrame) -> DataFrame:
    """Union by name; columns missing in a source are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def distinct_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*columns).distinct()


def id_overlap(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Distinct ids of two inputs, those in both, and the share of the sum of both."""
    tagged = a.select(F.col(column).alias("id"), F.lit(1).alias("in_a"), F.lit(0).alias("in_b")).unionByName(
        b.select(F.col(column).alias("id"), F.lit(0).alias("in_a"), F.lit(1).alias("in_b")))
    per = tagged.where(F.col("id").isNotNull()).groupBy("id").agg(F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b"))
    out = per.agg(F.sum("in_a").alias("ids_a"), F.sum("in_b").alias("ids_b"), F.sum(F.col("in_a") * F.col("in_b")).alias("common"))
    return out.withColumn("pct_of_sum", percent(F.col("common"), F.col("ids_a") + F.col("ids_b")))
