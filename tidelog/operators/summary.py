"""Device-day summary table, its rollups and its reconciliation with the raw rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import channels, clock, devices
from ..functions.querystring import qs_value
from ..functions.text import clean_location, decode_form
from ..model import COLS, ColMap, typed
from .ranking import percent

DEVICE_DAY_KEYS = [
    "event_date", "country", "region", "city", "channel_name", "raw_channel", "platform", "device_name",
    "device_type", "device_id", "session_id", "device_id_source", "session_id_source",
]


def with_estimated_ids(df: DataFrame, cols: ColMap = COLS) -> DataFrame:
    """device_id and session_id from the query string, else an estimate, with source labels."""
    dev, sid = qs_value(cols.qs, "device_id"), qs_value(cols.qs, "session_id")
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    guess = F.concat(F.lit("est_"), F.md5(F.concat_ws("|", blank(cols.ip), blank(cols.ua))))
    df = df.withColumns({
        "device_id": F.coalesce(dev, guess),
        "device_id_source": F.when(dev.isNotNull(), "queryStr.device_id").otherwise("estimated_cliIP_UA"),
    })
    day, hour = clock.day_date("req_ts").cast("string"), clock.hour_of_day("req_ts").cast("string")
    session = F.concat(F.lit("est_"), F.md5(F.concat_ws("|", "device_id", day, hour)))
    return df.withColumns({
        "session_id": F.coalesce(sid, session),
        "session_id_source": F.when(sid.isNotNull(), "queryStr.session_id").otherwise("estimated_device_date_hour"),
    })


def device_day(logs: DataFrame, cols: ColMap = COLS) -> DataFrame:
    """Requests per date, place, channel, device and session: the base of all rollups."""
    text = lambda key: decode_form(F.coalesce(qs_value(cols.qs, key), F.lit("")))
    df = with_estimated_ids(typed(logs, cols), cols).select(
        clock.day_date("req_ts").alias("event_date"), clean_location(cols.country).alias("country"),
        clean_location(cols.region).alias("region"), clean_location(cols.city).alias("city"),
        decode_form(channels.channel_raw(cols.qs, cols.path)).alias("raw_channel"),
        text("platform").alias("platform"), text("device").alias("device_name"),
        devices.device_type(cols.ua, qs_value(cols.qs, "platform"), wide=True).alias("device_type"),
        "device_id", "session_id", "device_id_source", "session_id_source",
    )
    # group first: the channel cleaning then runs once per group, not once per request
    raw_keys = [k for k in DEVICE_DAY_KEYS if k != "channel_name"]
    per = df.groupBy(*raw_keys).agg(F.count(F.lit(1)).alias("requests"))
    pure = channels.channel_pure("raw_channel", "platform", "device_name")
    return per.withColumn("channel_name", pure).select(*DEVICE_DAY_KEYS, "requests")


def rollup(summary: DataFrame, keys: list[str], distinct: dict[str, str]) -> DataFrame:
    """Requests and exact distinct counts per key; at most five distincts expand the rows in one go."""
    return summary.groupBy(*keys).agg(
        F.sum("requests").alias("requests"), *[F.count_distinct(c).alias(n) for n, c in distinct.items()]
    )


_IDS = {"sessions": "session_id", "devices": "device_id"}
ROLLUPS = {
    "quality": (["device_id_source", "session_id_source"], _IDS),
    "daily_country": (["event_date", "country"], {**_IDS, "regions": "region", "cities": "city", "channels": "channel_name", "device_types": "device_type"}),
    "daily_region": (["event_date", "country", "region"], {**_IDS, "cities": "city", "channels": "channel_name", "device_types": "device_type"}),
    "daily_city": (["event_date", "country", "region", "city"], {**_IDS, "channels": "channel_name", "device_types": "device_type"}),
    "daily_device_type": (["event_date", "device_type"], {**_IDS, "countries": "country", "regions": "region", "cities": "city", "channels": "channel_name"}),
    "daily_city_channel": (["event_date", "country", "region", "city", "channel_name", "device_type"], _IDS),
}


def named_rollup(summary: DataFrame, name: str) -> DataFrame:
    keys, distinct = ROLLUPS[name]
    return rollup(summary, keys, distinct)


GRAINS = {name: spec for name, spec in ROLLUPS.items() if name != "quality"}


def all_rollups(summary: DataFrame) -> DataFrame:
    """All daily rollups in one pass, in long form: grain, the keys (NULL where a grain lacks them), requests and distincts (NULL for fields that are no measure of the grain).

    Each row gives one entry per field. Entries are folded per (all keys, field, value) first; the grouping sets then repeat those, one row per value and grain,
    and a last aggregate counts them. No key holds its values in one task.
    """
    fields = list(dict.fromkeys(c for _, d in GRAINS.values() for c in d.values()))
    keys = list(dict.fromkeys(k for ks, _ in GRAINS.values() for k in ks))
    names = {c: n for _, d in GRAINS.values() for n, c in d.items()}
    entries = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in fields])
    per = summary.select(*keys, "requests", F.inline(entries)).groupBy(*keys, "field", "value").agg(F.sum("requests").alias("requests"))
    sets = [[F.col(k) for k in (*ks, "field", "value")] for ks, _ in GRAINS.values()]
    used = [F.grouping(k).alias(f"_no_{k}") for k in keys]
    wide = per.groupingSets(sets, *keys, "field", "value").agg(F.sum("requests").alias("requests"), *used)
    # a grain is known by the keys that it lacks
    lacks = lambda ks: [F.col(f"_no_{k}") == (0 if k in ks else 1) for k in keys]
    grain = F.coalesce(*[F.when(reduce(lambda a, b: a & b, lacks(ks)), F.lit(name)) for name, (ks, _) in GRAINS.items()])
    out = wide.select(grain.alias("grain"), *keys, "field", "value", "requests").groupBy("grain", *keys).agg(
        F.sum(F.when(F.col("field") == fields[0], F.col("requests"))).alias("requests"),
        *[F.count_if((F.col("field") == c) & F.col("value").isNotNull()).alias(f"_n_{c}") for c in fields])
    has = {c: [g for g, (_, d) in GRAINS.items() if c in d.values()] for c in fields}
    return out.select("grain", *keys, "requests", *[F.when(F.col("grain").isin(has[c]), F.col(f"_n_{c}")).alias(names[c]) for c in fields])


def available_dates(summary: DataFrame) -> DataFrame:
    return summary.agg(
        F.min("event_date").alias("min_date"), F.max("event_date").alias("max_date"), F.count(F.lit(1)).alias("summary_rows"),
        F.count_distinct("event_date").alias("active_days"), F.sum("requests").alias("raw_requests"),
    )


def kpis(summary: DataFrame) -> DataFrame:
    return summary.agg(
        F.sum("requests").alias("requests"), F.count_distinct("session_id").alias("sessions"),
        F.count_distinct("device_id").alias("devices"), F.count_distinct("country").alias("countries"),
        F.count_distinct("channel_name").alias("channels"),
        percent(F.sum(F.when(F.col("device_id_source") == "estimated_cliIP_UA", F.col("requests")).otherwise(0)), F.sum("requests"))
        .alias("estimated_request_pct"),
    )


def reconcile(summary: DataFrame, logs: DataFrame, cols: ColMap = COLS) -> DataFrame:
    """Per date: raw rows against summed requests; any non-zero diff is a fault."""
    raw = typed(logs, cols).groupBy(clock.day_date("req_ts").alias("event_date")).agg(F.count(F.lit(1)).alias("raw_rows"))
    own = summary.groupBy("event_date").agg(F.sum("requests").alias("summary_requests"))
    out = raw.join(own, "event_date", "full")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("raw_rows", "summary_requests")})
    return out.withColumn("diff", F.col("summary_requests") - F.col("raw_rows"))
