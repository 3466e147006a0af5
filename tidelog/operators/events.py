"""Behaviour base: parsed and enriched events, one frame reused by every behaviour report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bands, channels, clock, devices
from ..functions.querystring import qs_mentions, qs_present, qs_text, qs_value
from ..functions.text import clean_location, decode_form
from ..model import COLS, ColMap, typed

QS_FIELDS = {
    "device_id": "device_id", "session_id": "session_id", "channel_qs": "channel",
    "channel_name_qs": "channel_name", "content_type": "content_type", "content_title": "content_title",
    "platform": "platform", "device_name": "device", "category_name": "category_name",
}


def with_qs_fields(df: DataFrame, cols: ColMap = COLS, fields: dict[str, str] = QS_FIELDS) -> DataFrame:
    """Add one column per query-string key (strict dialect)."""
    return df.select("*", *[qs_value(cols.qs, key).alias(name) for name, key in fields.items()])


def behaviour_events(
    logs: DataFrame, cols: ColMap = COLS, daypart_mode: str = "Default", where: Column | None = None
) -> DataFrame:
    """Events that carry both IDs, with channel, label, daypart and device type."""
    df = typed(logs, cols)
    if where is not None:
        df = df.where(where)
    df = df.where(qs_mentions(cols.qs, "session_id") & qs_present(cols.qs, "session_id") & qs_present(cols.qs, "device_id"))
    df = with_qs_fields(df, cols)
    # later columns build on extracted ones, so every pattern runs once per row
    df = df.withColumn("_stream", channels.stream_id(cols.path))
    named = [F.col("channel_qs"), F.col("channel_name_qs"), F.col("_stream")]
    df = df.withColumn("channel_name_raw", F.coalesce(*named, F.lit("Unknown")))
    return df.select(
        *[c for c in df.columns if c != "_stream"],
        clock.day_date("req_ts").alias("event_date"),
        channels.channel_folded("channel_name_raw").alias("channel_name"),
        F.coalesce("content_title", *named, F.col(cols.path)).alias("content_label"),
        clock.daypart("req_ts", daypart_mode).alias("day_part"),
        devices.device_type(cols.ua, F.col("platform")).alias("device_type"),
    )


def entity_column(entity: str = "Channel", channel_mode: str = "Clean") -> str:
    if entity != "Channel":
        return "content_label"
    return "channel_name_raw" if channel_mode == "Raw" else "channel_name"


def coverage(logs: DataFrame, cols: ColMap = COLS) -> DataFrame:
    """Total rows, rows with a session key, their share, distinct sessions and devices."""
    has = qs_mentions(cols.qs, "session_id")
    df = typed(logs, cols).select(
        has.alias("has"),
        F.when(has, qs_text(cols.qs, "session_id")).alias("s"),
        F.when(has, qs_text(cols.qs, "device_id")).alias("d"),
    )
    out = df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if("has").alias("behavior_rows"),
        F.count_distinct("s").alias("sessions"),
        F.count_distinct("d").alias("devices"),
    )
    share = F.try_divide(F.col("behavior_rows") * 100.0, F.col("total_rows"))
    return out.withColumn("coverage_pct", F.round(F.coalesce(share, F.lit(0.0)), 4))


def behaviour_date_range(logs: DataFrame, cols: ColMap = COLS) -> DataFrame:
    df = typed(logs, cols).where(qs_mentions(cols.qs, "session_id"))
    day = clock.day_date("req_ts")
    return df.agg(F.min(day).alias("min_date"), F.max(day).alias("max_date"), F.count(F.lit(1)).alias("behavior_rows"))


def enrich(events: DataFrame, cols: ColMap = COLS) -> DataFrame:
    """Row enrichment for one device or many: decoded fields, pure channel, quality, date parts."""
    df = events
    for name in QS_FIELDS:
        df = df.withColumn(name, decode_form(F.coalesce(F.col(name), F.lit(""))))
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    raw = F.coalesce(blank("channel_qs"), blank("channel_name_qs"), channels.stream_id(cols.path), F.lit("Unknown"))
    df = df.withColumn("channel_name_raw", raw)
    df = df.withColumn("channel_name", channels.channel_pure("channel_name_raw", "platform", "device_name"))
    day_second = clock.second_of_day("req_ts")
    return df.select(
        "*",
        F.coalesce(blank("content_title"), F.col("channel_name"), F.col(cols.path)).alias("content_label"),
        bands.quality(cols.path).alias("quality"),
        devices.device_type(cols.ua, F.col("platform")).alias("device_type"),
        clock.day_date("req_ts").alias("event_date"),
        clock.hhmmss(day_second).alias("time_only"),
        F.round(day_second / 60, 6).alias("watch_time_min"),
    )


def device_rows(
    logs: DataFrame, device_id: str | None = None, where: Column | None = None, cols: ColMap = COLS
) -> DataFrame:
    """Rows of one device (or of all devices), with the nine query-string fields."""
    df = typed(logs, cols)
    if where is not None:
        df = df.where(where)
    if device_id is not None:
        # a cheap text test first, so the patterns run on few rows
        df = df.where(F.col(cols.qs).contains(f"device_id={device_id}"))
    df = with_qs_fields(df.where(qs_present(cols.qs, "device_id")), cols)
    return df if device_id is None else df.where(F.col("device_id") == device_id)


def location_events(logs: DataFrame, cols: ColMap = COLS, daypart_mode: str = "Default") -> DataFrame:
    """Behaviour events with cleaned country, region, city and decoded pure channel."""
    df = behaviour_events(logs, cols, daypart_mode)
    platform = decode_form(F.coalesce(F.col("platform"), F.lit("")))
    device = decode_form(F.coalesce(F.col("device_name"), F.lit("")))
    return df.select(
        clean_location(cols.country).alias("country"),
        clean_location(cols.region).alias("region"),
        clean_location(cols.city).alias("city"),
        decode_form("channel_name_raw").alias("raw_channel"),
        channels.channel_pure(decode_form("channel_name_raw"), platform, device).alias("channel_name"),
        platform.alias("platform"), device.alias("device_name"),
        "device_type", "session_id", "device_id", "req_ts", "event_date", "day_part",
    )
