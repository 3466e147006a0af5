"""Predicate builders; each returns a Column so Catalyst can push it down."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bands, clock
from ..functions.querystring import qs_value
from ..functions.text import decode_form
from ..model import NULL_SENTINELS, as_text


def all_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def any_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts)


def matches(filters: dict[str, list] | None = None, either: dict[str, list] | None = None) -> Column:
    """AND over ``filters``, IN inside a column, compared as text; ``either`` is one OR group."""
    parts = [as_text(c).isin([str(v) for v in vals]) for c, vals in (filters or {}).items() if vals]
    options = [as_text(c).isin([str(v) for v in vals]) for c, vals in (either or {}).items() if vals]
    if options:
        parts.append(any_of(options))
    return all_of(parts)


def select_rows(
    df: DataFrame, columns: list[str], filters: dict | None = None, either: dict | None = None, limit: int | None = None
) -> DataFrame:
    """Projected, filtered rows; unknown columns are skipped; ``limit`` only when asked for."""
    have = [c for c in columns if c in df.columns]
    out = df.where(matches(filters, either)).select(*have)
    return out if limit is None else out.limit(limit)


def epoch_between(start: int, end: int, ts: str = "req_ts") -> Column:
    return F.col(ts).between(start, end)


def date_between(start: str, end: str, ts: str = "req_ts", zone: str = "UTC") -> Column:
    """Date range in a zone. For fixed-offset zones it is an epoch range, so it can be pushed down."""
    offset = {"UTC": 0, "IST": 19800}.get(zone)
    if offset is None and zone[:1] in "+-":
        h, m = zone[1:].split(":")
        offset = (int(h) * 3600 + int(m) * 60) * (-1 if zone[0] == "-" else 1)
    if offset is None:
        return clock.zone_date(ts, zone).between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    lo = F.unix_date(F.lit(start).cast("date")).cast("long") * 86400 - offset
    hi = (F.unix_date(F.lit(end).cast("date")).cast("long") + 1) * 86400 - offset
    return (F.col(ts) >= lo) & (F.col(ts) < hi)


def only_status(code: int = 200, column: str = "statusCode") -> Column:
    return as_text(column).try_cast("long") == code


def equals_ignore_case(column: Column | str, value: str) -> Column:
    return F.lower(as_text(column)) == value.lower()


def facets(
    start: int | None = None, end: int | None = None, hosts=(), states=(), cities=(), status_classes=(),
    renditions=(), device_families=(), path_contains: str = "", path_regex: str = "", status_codes=(),
    countries=(), cache_status=(), device_family: Column | None = None,
) -> Column:
    """Facet filter; every argument is optional and they are ANDed."""
    parts: list[Column] = []
    if start is not None:
        parts.append(F.col("req_ts") >= start)
    if end is not None:
        parts.append(F.col("req_ts") <= end)
    listed = [
        (F.col("reqHost"), hosts), (F.col("state"), states), (F.col("city"), cities),
        (bands.status_class("statusCode"), status_classes), (bands.rendition_any("reqPath"), renditions),
        (device_family, device_families), (as_text("statusCode").try_cast("long"), status_codes),
        (F.col("country"), countries), (F.col("cacheStatus"), cache_status),
    ]
    parts += [c.isin(*vals) for c, vals in listed if vals]
    if path_contains.strip():
        parts.append(F.col("reqPath").ilike(f"%{path_contains.strip()}%"))
    if path_regex:
        parts.append(F.col("reqPath").rlike(path_regex))
    return all_of(parts)


def last_days(df: DataFrame, date: str, days: int) -> DataFrame:
    """Rows of the last N days counted back from the newest date in the data."""
    newest = df.agg(F.max(date)).scalar()
    return df.where(F.col(date) >= F.date_sub(newest, days))


def contains_text(column: str, needle: str) -> Column:
    return as_text(column).contains(needle)


def time_of_day(start: int, end: int, ts: str = "req_ts", offset: int = 0) -> Column:
    """Seconds of the day, both ends included."""
    return clock.second_of_day(ts, offset).between(start, end)


def keyword_rows(df: DataFrame, qs: str, keyword: str, key: str) -> DataFrame:
    """Rows whose query string holds a keyword, with the decoded value of a key."""
    return df.where(F.col(qs).contains(keyword)).withColumn(f"{key}_decoded", decode_form(qs_value(qs, key)))


def distinct_filled(df: DataFrame, column: str) -> DataFrame:
    """Distinct values of a sparse column, sentinels removed."""
    c = as_text(column)
    return df.where(c.isNotNull() & ~c.isin("", *NULL_SENTINELS)).select(c.alias("value")).distinct()


def rows_of(df: DataFrame, picked: DataFrame, on: list[str]) -> DataFrame:
    """Full rows whose key is among the picked ones; the join side is chosen by measured size."""
    return df.join(picked.select(*on).distinct(), on, "left_semi")
