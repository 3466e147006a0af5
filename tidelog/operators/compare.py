"""Range summaries and A/B comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bands import lower_asn
from ..functions.text import label_blank
from .dimensions import full_compare
from .profile import distinct_exact_or_approx
from .ranking import counts, one_row


def range_summary(df: DataFrame, columns: list[str], exact: bool = True, ts: str = "req_ts") -> DataFrame:
    facts = df.agg(F.count(F.lit(1)).alias("rows"), F.min(ts).alias("min_ts"), F.max(ts).alias("max_ts"))
    return one_row(facts, distinct_exact_or_approx(df, columns, exact).select(*[F.col(c).alias(f"distinct_{c}") for c in columns]))


def top_dimension(df: DataFrame, column: str, n: int, extra: str | None = None) -> DataFrame:
    """Rows per value, optionally with the distinct values of another column."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    if extra:
        aggs.append(F.count_distinct(extra).alias(f"distinct_{extra}"))
    per = df.groupBy(label_blank(column).alias("value")).agg(*aggs)
    return per.orderBy(F.desc("rows"), "value").limit(n)


def top_asn(df: DataFrame, n: int, asn: str = "asn") -> DataFrame:
    return counts(df, lower_asn(asn).alias("asn_key"), name="rows").orderBy(F.desc("rows"), "asn_key").limit(n)


def pair_counts(df: DataFrame, a: str, b: str, n: int) -> DataFrame:
    per = counts(df, label_blank(a).alias(a), label_blank(b).alias(b), name="rows")
    return per.orderBy(F.desc("rows"), a, b).limit(n)


def cross_counts(df: DataFrame, columns: list[str], distinct: str = "cliIP") -> DataFrame:
    """Rows and distinct IPs per combination of several dimensions."""
    return df.groupBy(*[label_blank(c).alias(c) for c in columns]).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct(distinct).alias("distinct_ip"))


def compare_ranges(df: DataFrame, range_a: Column, range_b: Column, by: Column, name: str = "value") -> DataFrame:
    """Counts of a breakdown in two ranges of one frame, in one pass, with difference and change."""
    tagged = df.where(range_a | range_b).groupBy(by.alias(name)).agg(
        F.count_if(range_a).alias("a"), F.count_if(range_b).alias("b"))
    change = F.round(F.try_divide((F.col("b") - F.col("a")) * F.lit(100.0), F.col("a")), 2)
    return tagged.withColumns({"delta": F.col("b") - F.col("a"), "pct_change": change})


def compare_frames(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The same for two separate aggregates."""
    return full_compare(a, b, keys, value)
