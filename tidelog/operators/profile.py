"""Profiling: completeness, distinct counts, key statistics of query strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.querystring import qs_pairs, qs_value
from ..functions.text import is_filled
from ..model import as_text
from .ranking import counts, one_row, percent, with_share

COLUMNS_PER_PASS = 100
DISTINCTS_PER_PASS = 5


def completeness(df: DataFrame, columns: list[str], sample_rows: int | None = None) -> DataFrame:
    """Filled and empty rows per column, one scan per 100 columns. Sampling only when asked for."""
    if sample_rows is not None:
        df = df.limit(sample_rows)
    out = None
    for i in range(0, len(columns), COLUMNS_PER_PASS):
        part = columns[i : i + COLUMNS_PER_PASS]
        one = df.agg(
            F.count(F.lit(1)).alias("_rows"), *[F.count_if(is_filled(c)).alias(f"filled_rows_{j}") for j, c in enumerate(part)]
        )
        rows = one.select("_rows", F.inline(F.array(*[
            F.struct(F.lit(c).alias("column_name"), F.col(f"filled_rows_{j}").alias("filled_rows")) for j, c in enumerate(part)])))
        out = rows if out is None else out.unionByName(rows)
    total, filled = F.col("_rows"), F.col("filled_rows")
    return out.select(
        "column_name", "filled_rows", (total - filled).alias("empty_rows"), total.alias("total_rows"),
        F.coalesce(percent(filled, total), F.lit(0.0)).alias("filled_pct"),
        F.coalesce(percent(total - filled, total), F.lit(0.0)).alias("empty_pct"),
    )


def column_stats(df: DataFrame, column: str) -> DataFrame:
    """Rows, filled rows and distinct values of one column."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count(column).alias("filled"), F.count_distinct(column).alias("distinct_values"))


def distinct_counts(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Exact distinct values per field, one row per field.

    Values are reduced to (field, value) pairs map-side, so the shuffle carries each pair
    once per task and no row is multiplied after it.
    """
    pairs = F.array(*[F.struct(F.lit(n).alias("field"), as_text(c).alias("value")) for n, c in columns.items()])
    long = df.select(F.inline(pairs)).distinct()
    per = long.groupBy("field").agg(F.count("value").alias("distinct_values"))
    return per


def distinct_exact_or_approx(df: DataFrame, columns: list[str], exact: bool = True, lg_k: int = 14) -> DataFrame:
    """Distinct counts of several columns as one row; approximate ones use a mergeable sketch."""
    if not exact:
        return df.agg(*[F.hll_sketch_estimate(F.hll_sketch_agg(as_text(c), F.lit(lg_k))).alias(c) for c in columns])
    parts = [columns[i : i + DISTINCTS_PER_PASS] for i in range(0, len(columns), DISTINCTS_PER_PASS)]
    return one_row(*[df.agg(*[F.count_distinct(c).alias(c) for c in part]) for part in parts])


def distinct_tuples(df: DataFrame, columns: list[str], out: str = "distinct_tuples") -> DataFrame:
    """Distinct tuples, counting those that hold NULLs (a struct is never NULL)."""
    return df.select(*columns).distinct().agg(F.count(F.lit(1)).alias(out))


def top_values(df: DataFrame, column: str, n: int) -> DataFrame:
    """Most frequent non-blank values with their share of all non-blank rows."""
    c = as_text(column)
    per = counts(df.where(c.isNotNull() & (F.trim(c) != "")), c.alias("value"), name="rows")
    return with_share(per, "rows", "pct").orderBy(F.desc("rows"), "value").limit(n)


def _key_values(df: DataFrame, qs: str) -> DataFrame:
    """(key, value, rows): equal strings are counted before they are parsed."""
    per_text = counts(df.where(F.col(qs).isNotNull()), F.col(qs).alias("qs"), name="n")
    pairs = per_text.select("n", F.inline(qs_pairs("qs"))).where(F.col("key") != "")
    return pairs.groupBy("key", "value").agg(F.sum("n").alias("rows"))


def key_values(df: DataFrame, qs: str = "queryStr") -> DataFrame:
    return _key_values(df, qs)


def key_stats(df: DataFrame, qs: str = "queryStr") -> DataFrame:
    """Distinct values and rows per query-string key."""
    return _key_values(df, qs).groupBy("key").agg(F.count(F.lit(1)).alias("distinct_values"), F.sum("rows").alias("filled_rows"))


def key_fill(df: DataFrame, qs: str = "queryStr") -> DataFrame:
    """Rows that carry a non-blank value per key, and their share of all rows with a query string."""
    total = df.where(F.col(qs).isNotNull()).agg(F.count(F.lit(1))).scalar()
    filled = _key_values(df, qs).groupBy("key").agg(F.sum(F.when(F.col("value") != "", F.col("rows")).otherwise(0)).alias("filled"))
    return filled.withColumn("fill_pct", percent(F.col("filled"), total))


def is_mostly_numeric(df: DataFrame, columns: list[str], threshold: float = 0.75) -> DataFrame:
    """Share of values that parse as numbers, and whether it exceeds the threshold."""
    n = F.count(F.lit(1)).alias("_rows")
    one = df.agg(n, *[F.count(as_text(c).try_cast("double")).alias(f"n_{i}") for i, c in enumerate(columns)])
    rows = one.select("_rows", F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"n_{i}").alias("n")) for i, c in enumerate(columns)])))
    return rows.select("column_name", percent(F.col("n"), F.col("_rows")).alias("numeric_pct"),
                       (F.col("n") > F.col("_rows") * threshold).alias("is_numeric"))


def qs_fields(keys: list[str], qs: str = "queryStr") -> dict[str, Column]:
    return {f"qs.{k}": qs_value(qs, k) for k in keys}
