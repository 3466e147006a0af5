"""Channel, platform and value reports: cubes, value x day matrices, ranked lists."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import channels, clock
from ..functions.querystring import qs_mentions, qs_value
from ..functions.text import blank_to_null
from ..model import COLS, ColMap, typed
from ..session import staged
from .ranking import counts, top_per_group, with_group_share, with_share


def channel_platform(logs: DataFrame, n: int | None = None, cols: ColMap = COLS) -> DataFrame:
    """Requests, devices and sessions per channel and platform with the share of all of them; ``n`` lists the largest only."""
    df = logs.where(qs_mentions(cols.qs, "channel")).select(
        channels.channel_report(cols.qs).alias("channel"),
        F.coalesce(qs_value(cols.qs, "platform"), F.lit("Unknown")).alias("platform"),
        qs_value(cols.qs, "device_id").alias("d"), qs_value(cols.qs, "session_id").alias("s"),
    )
    per = df.groupBy("channel", "platform").agg(
        F.count(F.lit(1)).alias("requests"), F.count_distinct("d").alias("devices"), F.count_distinct("s").alias("sessions"))
    shared = with_share(per, "requests", "pct")
    return shared if n is None else shared.orderBy(F.desc("requests"), "channel", "platform").limit(n)


def detailed_cube(logs: DataFrame, cols: ColMap = COLS) -> DataFrame:
    """Requests, devices and sessions per date, state, agent, channel, platform and device, with share of the day."""
    unknown = lambda k: F.coalesce(qs_value(cols.qs, k), F.lit("Unknown"))
    df = typed(logs, cols).where(qs_mentions(cols.qs, "channel") & (F.col(cols.region) != "")).select(
        clock.day_date("req_ts").alias("utc_date"), F.col(cols.region).alias("state"), F.col(cols.ua).alias("ua"),
        channels.channel_report(cols.qs).alias("channel"), unknown("platform").alias("platform"), unknown("device").alias("device"),
        qs_value(cols.qs, "device_id").alias("d"), qs_value(cols.qs, "session_id").alias("s"),
    )
    per = df.groupBy("utc_date", "state", "ua", "channel", "platform", "device").agg(
        F.count(F.lit(1)).alias("requests"), F.count_distinct("d").alias("unique_devices"), F.count_distinct("s").alias("unique_sessions"))
    return with_group_share(per, ["utc_date"], "requests", "pct_of_day")


def days_between(first: str, last: str) -> list[str]:
    a, b = datetime.date.fromisoformat(first), datetime.date.fromisoformat(last)
    return [(a + datetime.timedelta(days=i)).isoformat() for i in range((b - a).days + 1)]


def values_by_day(df: DataFrame, value: Column, date: Column, n: int) -> DataFrame:
    """Long form: rows per value and day for the n most frequent values."""
    per = counts(df, value.alias("value"), date.cast("string").alias("day"), name="row_count")
    top = per.groupBy("value").agg(F.sum("row_count").alias("_t")).orderBy(F.desc("_t"), "value").limit(n)
    # n rows, fixed by the caller
    return per.join(F.broadcast(top.select("value")), "value", "left_semi")


def value_day_matrix(df: DataFrame, value: Column, date: Column, days: list[str], n: int) -> DataFrame:
    """One row per value, one column per day, zeros filled, and the total over all days."""
    long = values_by_day(df, value, date, n)
    wide = long.groupBy("value").pivot("day", days).agg(F.sum("row_count"))
    total = long.groupBy("value").agg(F.sum("row_count").alias("total"))
    out = wide.join(total, "value")
    return out.select("value", "total", *[F.coalesce(F.col(f"`{d}`"), F.lit(0)).alias("d_" + d.replace("-", "_")) for d in days])


def key_matrix_with_modes(
    logs: DataFrame, key: Column, days: list[str], n: int, mode_columns: dict[str, Column], cols: ColMap = COLS
) -> DataFrame:
    """Value x day matrix of IPs or devices plus the most frequent value of other columns per key (lowest value on ties).

    Each row gives one entry for its day and one per mode column; entries are counted per (key, field, value) in one scan and written once. Keys, days, totals
    and modes all come from that table.
    """
    df = typed(logs, cols).select(key.cast("string").alias("value"), clock.day_date("req_ts").cast("string").alias("_day"), *[c.cast("string").alias(m) for m, c in mode_columns.items()])
    df = df.where(blank_to_null("value").isNotNull())
    entries = F.array(*[F.struct(F.lit(i).alias("_f"), F.col(c).alias("_v")) for i, c in enumerate(("_day", *mode_columns))])
    per = staged(df.select("value", F.inline(entries)).groupBy("value", "_f", "_v").agg(F.count(F.lit(1)).alias("_n")), "matrix")
    top = per.where(F.col("_f") == 0).groupBy("value").agg(F.sum("_n").alias("_t")).orderBy(F.desc("_t"), "value").limit(n)
    # n rows, fixed by the caller
    kept = per.join(F.broadcast(top.select("value")), "value", "left_semi")
    on_day = lambda d: F.coalesce(F.sum(F.when((F.col("_f") == 0) & (F.col("_v") == d), F.col("_n"))), F.lit(0)).alias("d_" + d.replace("-", "_"))
    best = lambda i: F.min(F.when((F.col("_f") == i) & F.col("_v").isNotNull(), F.struct((-F.col("_n")).alias("n"), F.col("_v").alias("v"))))["v"]
    return kept.groupBy("value").agg(
        F.sum(F.when(F.col("_f") == 0, F.col("_n"))).alias("total"), *[on_day(d) for d in days], *[best(i).alias(m) for i, m in enumerate(mode_columns, 1)])


def top_channels_by_state(logs: DataFrame, n: int, cols: ColMap = COLS) -> DataFrame:
    df = logs.where(qs_mentions(cols.qs, "channel") & blank_to_null(cols.region).isNotNull())
    per = counts(df, F.col(cols.region).alias("state"), channels.channel_report(cols.qs).alias("channel"), name="requests")
    return top_per_group(per, ["state"], [F.desc("requests"), F.asc("channel")], n, "rank")


def billing_counts(logs: DataFrame) -> DataFrame:
    """Requests per billing region, country and server country."""
    return counts(logs, "billingRegion", "country", "serverCountry", name="requests")


def billing_pairs(logs: DataFrame, n: int) -> DataFrame:
    """Top country and server-country pairs per billing region."""
    per = billing_counts(logs)
    return top_per_group(per, ["billingRegion"], [F.desc("requests"), F.asc("country"), F.asc("serverCountry")], n)


def trend(logs: DataFrame, days: int, cols: ColMap = COLS) -> DataFrame:
    """Requests, devices and sessions per day over the last N days of the data."""
    df = typed(logs, cols).select(
        clock.day_date("req_ts").alias("date"), qs_value(cols.qs, "device_id").alias("d"), qs_value(cols.qs, "session_id").alias("s"))
    newest = df.agg(F.max("date")).scalar()
    return df.where(F.col("date") >= F.date_sub(newest, days)).groupBy("date").agg(
        F.count(F.lit(1)).alias("requests"), F.count_distinct("d").alias("devices"), F.count_distinct("s").alias("sessions"))


def top_by(df: DataFrame, value: Column, n: int) -> DataFrame:
    return counts(df, value.alias("value"), name="requests").orderBy(F.desc("requests"), "value").limit(n)


def calendar_counts(df: DataFrame, seconds: int, ts: str = "req_ts", between: tuple[int, int] | None = None) -> DataFrame:
    """Rows per time bucket with empty buckets as 0.

    The calendar spans the data's first to last bucket, or ``between`` (epoch seconds, last one included), which keeps
    a wrong timestamp from stretching it. It grows with time, not rows, and is made in blocks of about a day.
    """
    kept = df if between is None else df.where(F.col(ts).between(*between))
    per = counts(kept, clock.bucket_start(ts, seconds).alias("bucket"), name="requests")
    if between is None:
        span = per.agg(F.min("bucket").alias("a"), F.max("bucket").alias("b")).where(F.col("a").isNotNull())
    else:
        span = df.sparkSession.range(1).select(*[F.lit(t - t % seconds).cast("long").alias(n) for t, n in zip(between, "ab")])
    step, block = F.lit(seconds).cast("long"), seconds * max(1, 86400 // seconds)
    blocks = span.select("b", F.explode(F.sequence("a", "b", F.lit(block).cast("long"))).alias("a"))
    calendar = blocks.select(F.explode(F.sequence("a", F.least(F.col("a") + block - seconds, "b"), step)).alias("bucket"))
    return calendar.join(per, "bucket", "left").withColumn("requests", F.coalesce("requests", F.lit(0)))


def activity_by_date(df: DataFrame, offset: int = 0, ts: str = "req_ts") -> DataFrame:
    return counts(df, clock.day_date(ts, offset).alias("date"), name="requests")


def activity_by_hour(df: DataFrame, offset: int = 0, ts: str = "req_ts") -> DataFrame:
    return counts(df, clock.hour_of_day(ts, offset).alias("hour"), name="requests")


def activity_pattern(df: DataFrame, bucket_minutes: int = 15, ts: str = "req_ts", offset: int = 0) -> DataFrame:
    """Rows per date and time-of-day bucket."""
    minute = F.floor(clock.second_of_day(ts, offset) / 60)
    slot = (minute - F.pmod(minute, F.lit(bucket_minutes))).cast("int")
    return counts(df, clock.day_date(ts, offset).alias("date"), slot.alias("minute_of_day"), name="requests")
