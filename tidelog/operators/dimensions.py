"""Joins to dimension tables. No side is broadcast unless its size is fixed; others are left to AQE."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bands import lower_asn

GEO_FIELDS = ("country", "region", "city", "isp", "timezone")


def duplicate_keys(dim: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once; a mapping table must give no row here."""
    return dim.groupBy(*keys).agg(F.count(F.lit(1)).alias("count")).where(F.col("count") > 1)


def unique_left_join(df: DataFrame, dim: DataFrame, keys: list[str]) -> DataFrame:
    """Left join to a mapping whose keys must be unique.

    Uniqueness is asserted inside the query: a repeated key raises an error when it runs.
    """
    values = [c for c in dim.columns if c not in keys]
    once = dim.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.min(c).alias(c) for c in values])
    checked = once.where(F.when(F.col("_n") == 1, F.lit(True)).otherwise(F.raise_error(F.lit("mapping keys are not unique")).cast("boolean")))
    return df.join(checked.drop("_n"), keys, "left")


def with_asn(df: DataFrame, dim: DataFrame, asn: str = "asn", dim_asn: str = "asn") -> DataFrame:
    """Left join on the normalised ASN; of several rows with one key the smallest whole row counts."""
    values = [c for c in dim.columns if c != dim_asn]
    one = dim.select(lower_asn(dim_asn).alias("asn_key"), *values).groupBy("asn_key").agg(F.min(F.struct(*values)).alias("_row"))
    one = one.select("asn_key", *[F.col("_row")[c].alias(c) for c in values])
    return df.withColumn("asn_key", lower_asn(asn)).join(one, "asn_key", "left")


def with_geo(df: DataFrame, geo: DataFrame, ip: str = "cliIP") -> DataFrame:
    """Left join IP -> geography; missing text fields are '', latitude and longitude stay NULL. Of several rows with one IP the smallest counts."""
    values = [c for c in geo.columns if c != ip]
    one = geo.groupBy(ip).agg(F.min(F.struct(*values)).alias("_row")).select(ip, *[F.col("_row")[c].alias(c) for c in values])
    joined = df.drop(*[c for c in (*GEO_FIELDS, "lat", "lon") if c in df.columns]).join(one, ip, "left")
    have = [c for c in GEO_FIELDS if c in one.columns]
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in have})


def country_names(df: DataFrame) -> DataFrame:
    """Two-letter code -> English name, generated from the runtime's ISO list (about 250 rows)."""
    locale = df.sparkSession._jvm.java.util.Locale
    codes = list(locale.getISOCountries())
    rows = [(c, locale("", c).getDisplayCountry(locale.ENGLISH)) for c in codes]
    return df.sparkSession.createDataFrame(rows, "_code string, _country string")


def with_country_name(df: DataFrame, code: str, names: DataFrame | None = None) -> DataFrame:
    """Add country_name; unknown codes become Unknown. ``names`` (_code, _country) overrides the ISO list."""
    # the ISO list has about 250 rows; a caller's table is left to adaptive execution
    dim = F.broadcast(country_names(df)) if names is None else names
    key = F.upper(F.trim(F.col(code)))
    joined = df.join(dim, key == F.col("_code"), "left")
    return joined.withColumn("country_name", F.coalesce("_country", F.lit("Unknown"))).drop("_code", "_country")


def best_match(df: DataFrame, key: str, candidate: str, weight: Column, out: str, out_weight: str) -> DataFrame:
    """Heaviest candidate per key, lowest candidate on ties."""
    per = df.groupBy(key, candidate).agg(weight.alias("_w"))
    best = per.groupBy(key).agg(F.min(F.struct((-F.col("_w")).alias("w"), F.col(candidate).alias("c"))).alias("_b"))
    return best.select(key, F.col("_b")["c"].alias(out), (-F.col("_b")["w"]).alias(out_weight))


def full_compare(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Full outer join of two aggregates with difference and percentage change."""
    left = a.select(*keys, F.col(value).alias("a"))
    right = b.select(*keys, F.col(value).alias("b"))
    out = left.join(right, keys, "full")
    out = out.withColumns({"a": F.coalesce("a", F.lit(0)), "b": F.coalesce("b", F.lit(0))})
    change = F.round(F.try_divide((F.col("b") - F.col("a")) * F.lit(100.0), F.col("a")), 2)
    return out.withColumns({"delta": F.col("b") - F.col("a"), "pct_change": change})
