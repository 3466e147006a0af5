"""Views of single users and devices: dashboards, pseudo users, retries, viewers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clock
from ..functions.querystring import qs_trimmed
from ..functions.text import blank_to_null
from ..model import COLS, ColMap, typed
from .ordered import Ordered
from .ranking import summarize, top_per_group


def device_dashboard(rows: DataFrame) -> DataFrame:
    """Per device: rows, sessions, watch hours, span and most frequent channel, content, platform, type."""
    t = F.col("req_ts")
    out = summarize(
        rows, ["device_id"], {"_w": ("sum", F.col("watch_sec")), "first_seen": ("min", t), "last_seen": ("max", t)},
        {"sessions": "session_key"},
        {"top_channel": "channel_name", "top_content": "content_label", "top_platform": "platform", "top_device_type": "device_type"},
        rows="rows",
    )
    return out.withColumn("est_watch_hours", F.round(F.col("_w") / 3600, 4)).drop("_w")


def content_table(rows: DataFrame, min_requests: int = 1) -> DataFrame:
    out = rows.groupBy("content_label", "channel_name").agg(
        F.count(F.lit(1)).alias("requests"), F.round(F.sum("watch_sec") / 60, 4).alias("est_watch_min"),
        F.min("req_ts").alias("first_seen"), F.max("req_ts").alias("last_seen"),
        F.count_distinct("session_key").alias("sessions"),
    )
    return out.where(F.col("requests") >= min_requests)


def path_table(rows: DataFrame, n: int) -> DataFrame:
    out = rows.groupBy("reqPath").agg(
        F.count(F.lit(1)).alias("requests"), F.min("req_ts").alias("first_seen"), F.max("req_ts").alias("last_seen"),
        F.round(F.sum("watch_sec") / 60, 4).alias("est_watch_min"),
    )
    return out.orderBy(F.desc("requests"), F.desc("est_watch_min"), "reqPath").limit(n)


def content_switches(rows: DataFrame, tie: list[str] = ("event_id",), **tuning) -> DataFrame:
    """Rows whose content differs from the device's previous row; the first row counts as a switch."""
    df = Ordered.by(rows, ["device_id"], ["req_ts", *tie], **tuning).neighbours(lag=["content_label"]).rows()
    df = df.withColumnRenamed("prev_content_label", "prev_content")
    changed = F.col("prev_content").isNull() | (F.col("content_label") != F.col("prev_content"))
    return df.where(changed).select(
        "device_id", *tie, "req_ts", "prev_content", "content_label", "channel_name", "session_key"
    )


def watch_starts(rows: DataFrame, tie: list[str] = ("event_id",)) -> DataFrame:
    """First event of each session: a partial aggregate, no sort."""
    first = F.min(F.struct("req_ts", *tie, "content_label", "channel_name", "platform")).alias("f")
    return rows.groupBy("session_key").agg(first).select("session_key", "f.*")


def with_pseudo_user(df: DataFrame, cols: ColMap = COLS) -> DataFrame:
    """IP|UA with NA for what is missing; IP alone, or UNKNOWN, when a column does not exist."""
    na = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("NA"))
    if cols.ip not in df.columns:
        return df.withColumn("pseudo_user", F.lit("UNKNOWN"))
    if cols.ua not in df.columns:
        return df.withColumn("pseudo_user", na(cols.ip))
    return df.withColumn("pseudo_user", F.concat(na(cols.ip), F.lit("|"), na(cols.ua)))


def retries(
    df: DataFrame, seconds: int = 2, tie: list[str] = ("event_id",), user: str | None = None, **tuning
) -> DataFrame:
    """Rows that ask for the same path again within ``seconds``, with the gap."""
    if user is not None:
        df = df.where(F.col("pseudo_user") == user)
    keys = ["pseudo_user", "reqPath"]
    df = df.where(F.col("reqPath").isNotNull())
    df = Ordered.by(df, keys, ["req_ts", *tie], **tuning).neighbours(lag=["req_ts"]).rows()
    df = df.withColumn("path_gap", F.col("req_ts") - F.col("prev_req_ts")).drop("prev_req_ts")
    return df.where(F.col("path_gap") <= seconds)


def viewer_id(ip: Column, ua: Column) -> tuple[Column, Column]:
    """Typed viewer id and its type from trimmed IP and UA."""
    both = ip.isNotNull() & ua.isNotNull()
    vid = (
        F.when(both, F.concat(F.lit("ipua:"), ip, F.lit("|"), ua))
        .when(ip.isNotNull(), F.concat(F.lit("ip:"), ip)).when(ua.isNotNull(), F.concat(F.lit("ua:"), ua))
    )
    kind = F.when(both, "cliIP_UA").when(ip.isNotNull(), "cliIP_only").when(ua.isNotNull(), "UA_only").otherwise("no_viewer")
    return vid, kind


def viewer_rows(logs: DataFrame, cols: ColMap = COLS, offset: int = 0) -> DataFrame:
    """Distinct rows per viewer, ready for :func:`sessions.viewer_timelines`."""
    df = typed(logs, cols).select(
        blank_to_null(cols.ip).alias("cliip"), blank_to_null(cols.ua).alias("ua"),
        qs_trimmed(cols.qs, "device_id").alias("device_id"), qs_trimmed(cols.qs, "session_id").alias("session_id"),
        "req_ts", clock.day_date("req_ts", offset).alias("event_date"),
    )
    vid, kind = viewer_id(F.col("cliip"), F.col("ua"))
    df = df.select(vid.alias("viewer_id"), kind.alias("viewer_type"), "*")
    return df.where(F.col("viewer_id").isNotNull()).distinct()


def viewer_daily(timelines: DataFrame) -> DataFrame:
    """Daily viewers, timelines and watch hours, from the one windowed frame (no self join)."""
    watch = F.col("watch_sec")
    hours = lambda c: F.round(F.coalesce(F.sum(c), F.lit(0)) / 3600, 4)
    return timelines.groupBy("event_date").agg(
        F.count(F.lit(1)).alias("rows_used"), F.count_distinct("viewer_id").alias("viewers"),
        F.count_distinct("device_id").alias("devices"), F.count_distinct("cliip").alias("distinct_cliip"),
        F.count_distinct("ua").alias("distinct_ua"),
        F.count_distinct(F.struct("viewer_id", "timeline_no")).alias("timelines"),
        hours(watch).alias("watch_hours"), hours(F.when(F.col("device_id").isNotNull(), watch)).alias("device_watch_hours"),
    )


def user_summary(df: DataFrame, user: str | None = None) -> DataFrame:
    """One row per pseudo user (or for the one named): span, volume, QoE and most frequent facets."""
    if user is not None:
        df = df.where(F.col("pseudo_user") == user)
    num = lambda c: F.col(c).try_cast("double")
    t = F.col("req_ts")
    out = summarize(
        df, ["pseudo_user"],
        {
            "first_seen": ("min", t), "last_seen": ("max", t),
            "errors": ("sum", F.coalesce((F.col("statusCode").try_cast("long") >= 400).cast("long"), F.lit(0))),
            "total_bytes": ("sum", num("totalBytes")),
            "_tp": ("sum", num("throughput")), "_tpn": ("sum", num("throughput").isNotNull().cast("long")),
            "_fb": ("sum", num("timeToFirstByte")), "_fbn": ("sum", num("timeToFirstByte").isNotNull().cast("long")),
        },
        {"unique_paths": "reqPath"},
        {"top_cache_status": "cacheStatus", "top_state": "state", "top_country": "country"},
    )
    return out.withColumns({
        "total_bytes": F.col("total_bytes").cast("long"),
        "avg_throughput": F.round(F.try_divide("_tp", "_tpn"), 2), "avg_ttfb": F.round(F.try_divide("_fb", "_fbn"), 2),
    }).drop("_tp", "_tpn", "_fb", "_fbn")


def user_timeline(df: DataFrame, user: str, n: int, tie: list[str] = ("event_id",)) -> DataFrame:
    """First n rows of a pseudo user in time order."""
    cols = [c for c in ("req_ts", *tie, "reqHost", "reqPath", "queryStr", "statusCode", "cacheStatus", "totalBytes",
                        "throughput", "timeToFirstByte", "city", "state", "country", "asn") if c in df.columns]
    return df.where(F.col("pseudo_user") == user).select(*cols).orderBy("req_ts", *tie).limit(n)


def latest_rows(df: DataFrame, n: int, tie: list[str] = ("event_id",)) -> DataFrame:
    return df.orderBy(F.desc("req_ts"), *[F.desc(c) for c in tie]).limit(n)


def first_rows(df: DataFrame, group: list[str], n: int, order: list[str]) -> DataFrame:
    return top_per_group(df, group, [F.col(c) for c in order], n)
