"""Watch-time estimates from request timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clock
from ..functions.channels import stream_key
from ..functions.querystring import qs_has_key, qs_trimmed
from ..functions.text import blank_to_null
from ..model import COLS, WATCH_GAP_CAP_SECONDS, ColMap, typed
from ..session import staged
from .ordered import Ordered
from .ranking import one_row, with_share

TIE = ["cliip_ua_viewer", "UA"]


def viewer_key(ip: Column, ua: Column) -> Column:
    """ip|ua, or the one that is present, or NULL."""
    return F.nullif(F.concat_ws("|", ip, ua), F.lit(""))


def row_group(device: Column, session: Column) -> Column:
    return F.when(device.isNotNull() | session.isNotNull(), "id_sample").otherwise("no_id_estimated")


def timeline_key(device: Column, session: Column, ip: Column, ua: Column, stream: Column) -> Column:
    """Key of a request timeline; IDs first, then IP and UA; NULL when nothing identifies the row."""
    tail = F.concat(F.lit("|stream:"), stream)
    dev = F.concat(F.lit("id|device:"), device)
    both = ip.isNotNull() & ua.isNotNull()
    return (
        F.when(device.isNotNull() & session.isNotNull(), F.concat(dev, F.lit("|sid:"), session, tail))
        .when(device.isNotNull(), F.concat(dev, F.lit("|no_sid"), tail))
        .when(session.isNotNull() & both, F.concat(F.lit("id|sid:"), session, F.lit("|viewer:"), ip, F.lit("|"), ua, tail))
        .when(both, F.concat(F.lit("noid|"), ip, F.lit("|"), ua, tail))
        .when(ip.isNotNull(), F.concat(F.lit("noid|"), ip, tail))
        .when(ua.isNotNull(), F.concat(F.lit("noid|"), ua, tail))
    )


def timeline_rows(logs: DataFrame, cols: ColMap = COLS, where: Column | None = None, keep: list[str] = (), qs_keys: list[str] = ()) -> DataFrame:
    """Distinct timeline events. ``keep`` names extra dimension columns and ``qs_keys`` query-string keys, all part of the distinct tuple."""
    df = typed(logs, cols)
    if where is not None:
        df = df.where(where)
    df = df.select(
        "req_ts", blank_to_null(cols.ip).alias("cliIP"), blank_to_null(cols.ua).alias("UA"),
        stream_key(cols.path).alias("stream_key"),
        qs_trimmed(cols.qs, "device_id").alias("device_id"), qs_trimmed(cols.qs, "session_id").alias("session_id"),
        qs_has_key(cols.qs, "device_id", False).cast("int").alias("has_device_id_key"),
        qs_has_key(cols.qs, "session_id", False).cast("int").alias("has_session_id_key"),
        *[F.col(c).alias(f"dim_{c}") for c in keep], *[qs_trimmed(cols.qs, k).alias(f"dim_{k}") for k in qs_keys],
    )
    dev, sid, ip, ua = (F.col(c) for c in ("device_id", "session_id", "cliIP", "UA"))
    # the same rows as "timeline_key is not null"; the keys below derive from the distinct
    # columns, so they are added after the shuffle and do not travel with it
    df = df.where(ip.isNotNull() | ua.isNotNull() | dev.isNotNull()).distinct()
    return df.select(
        "*",
        clock.day_date("req_ts").alias("event_date"),
        timeline_key(dev, sid, ip, ua, F.col("stream_key")).alias("timeline_key"),
        row_group(dev, sid).alias("row_group"),
        viewer_key(ip, ua).alias("cliip_ua_viewer"),
        F.concat(F.lit("device:"), dev).alias("device_viewer"),
    )


def gap_watch(
    rows: DataFrame, keys: list[str], cap: int | None = WATCH_GAP_CAP_SECONDS, ts: str = "req_ts", tie: list[str] = (),
    out: str = "watch_sec", **tuning,
) -> DataFrame:
    """Add next_<ts> and the seconds to the next row of the key, clipped to [0, cap].

    The last row of a key has a NULL next time and counts 0 seconds.
    """
    df = Ordered.by(rows, keys, [ts, *tie], **tuning).neighbours(lead=[ts]).rows()
    gap = F.coalesce(F.greatest(F.col(f"next_{ts}") - F.col(ts), F.lit(0)), F.lit(0))
    return df.withColumn(out, gap if cap is None else F.least(gap, F.lit(cap)))


def timeline_capped(rows: DataFrame, cap: int = WATCH_GAP_CAP_SECONDS, **tuning) -> DataFrame:
    """Rows that have a next row in their timeline, with the capped gap."""
    # rows equal on these differ in nothing that the gap or a report uses, but for kept dimensions
    tie = [*TIE, *[c for c in rows.columns if c.startswith("dim_")]]
    return gap_watch(rows, ["timeline_key"], cap, tie=tie, **tuning).where(F.col("next_req_ts").isNotNull())


def timeline_uncapped(rows: DataFrame, by_day: bool = False) -> DataFrame:
    """Last minus first time per timeline (and day): an aggregate, no sort."""
    keys = [*(["event_date"] if by_day else []), "timeline_key", "row_group"]
    return rows.groupBy(*keys).agg(
        F.min("cliip_ua_viewer").alias("cliip_ua_viewer"), F.min("device_viewer").alias("device_viewer"),
        F.min("stream_key").alias("stream_key"), F.min("req_ts").alias("first_ts"), F.max("req_ts").alias("last_ts"),
        F.count(F.lit(1)).alias("event_rows"),
        (F.max("req_ts") - F.min("req_ts")).alias("watch_sec"),
    )


def watch_summary(rows: DataFrame, cap: int = WATCH_GAP_CAP_SECONDS, **tuning) -> DataFrame:
    """One row of 25 measures over distinct timeline events and their capped gaps.

    Events and gaps are written once, so the log is read and ordered once. All distinct counts come from (field, value) pairs made distinct before they are counted.
    """
    gaps = gap_watch(rows, ["timeline_key"], cap, tie=TIE, **tuning)
    watched = F.col("next_req_ts").isNotNull()
    all_rows = staged(gaps.withColumn("watch_sec", F.when(watched, F.col("watch_sec"))).drop("next_req_ts", "event_date", "req_ts"), "watch")
    sid, dev, w = F.col("session_id"), F.col("device_id"), F.col("watch_sec")
    is_id = F.col("row_group") == "id_sample"
    hours = lambda c: F.round(F.coalesce(F.sum(c), F.lit(0)) / 3600, 4)
    facts = all_rows.agg(
        F.count(F.lit(1)).alias("rows_used_after_dedup"),
        F.count(dev).alias("rows_with_device_id"), F.count_if(dev.isNull()).alias("rows_without_device_id"),
        F.count(sid).alias("rows_with_session_id"), F.count_if(sid.isNull()).alias("rows_without_session_id"),
        F.count_if(dev.isNotNull() & sid.isNotNull()).alias("rows_with_both"),
        F.count_if((F.col("has_device_id_key") == 1) & dev.isNull()).alias("rows_device_id_blank"),
        F.count_if((F.col("has_session_id_key") == 1) & sid.isNull()).alias("rows_session_id_blank"),
        hours(w).alias("total_watch_hours"), hours(F.when(is_id, w)).alias("id_sample_watch_hours"), hours(F.when(~is_id, w)).alias("no_id_watch_hours"),
        F.round(F.coalesce(F.avg(w), F.lit(0.0)), 4).alias("avg_gap_sec"), F.coalesce(F.max(w), F.lit(0)).alias("max_gap_sec"),
        F.sum(w).alias("_all"), F.sum(F.when(is_id, w)).alias("_id"), F.sum(F.when(~is_id, w)).alias("_no"),
    )
    viewer = F.col("cliip_ua_viewer")
    fields = {
        "distinct_viewers": viewer, "distinct_device_id": dev, "distinct_session_id": sid, "distinct_cliip": F.col("cliIP"), "distinct_ua": F.col("UA"),
        "distinct_stream_key": F.col("stream_key"), "timeline_count": F.col("timeline_key"), "id_sample_timelines": F.when(is_id, F.col("timeline_key")),
        "no_id_timelines": F.when(~is_id, F.col("timeline_key")), "_v": F.when(w.isNotNull(), viewer), "_d": F.when(w.isNotNull() & is_id, F.col("device_viewer")),
        "_nv": F.when(w.isNotNull() & ~is_id, viewer),
    }
    pairs = F.filter(F.array(*[F.struct(F.lit(n).alias("field"), c.alias("value")) for n, c in fields.items()]), lambda x: x["value"].isNotNull())
    per = all_rows.select(F.inline(pairs)).distinct().groupBy("field").agg(F.count(F.lit(1)).alias("n"))
    distincts = per.agg(*[F.coalesce(F.sum(F.when(F.col("field") == n, F.col("n"))), F.lit(0)).alias(n) for n in fields])
    out = one_row(facts, distincts)
    per = lambda s, n: F.round(F.coalesce(F.try_divide(F.col(s) / 60, F.col(n)), F.lit(0.0)), 4)
    out = out.select(
        "*", per("_all", "_v").alias("watch_min_per_viewer"), per("_id", "_d").alias("watch_min_per_device"),
        per("_no", "_nv").alias("no_id_watch_min_per_viewer"),
    )
    return out.drop("_all", "_id", "_no", "_v", "_d", "_nv")


def watch_by_day(watch: DataFrame) -> DataFrame:
    """Capped gaps count on the day of their earlier row; daily uncapped spans restart each day."""
    events = F.col("event_rows") if "event_rows" in watch.columns else F.lit(1)
    return watch.groupBy("event_date").agg(
        F.sum(events).alias("event_rows"), F.count_distinct("timeline_key").alias("timelines"),
        F.count_distinct("cliip_ua_viewer").alias("viewers"),
        F.round(F.sum("watch_sec") / 3600, 4).alias("watch_hours"),
        F.round(F.coalesce(F.sum(F.when(F.col("row_group") == "id_sample", F.col("watch_sec"))), F.lit(0)) / 3600, 4)
        .alias("id_sample_watch_hours"),
    )


def watch_by(watch: DataFrame, dimension: Column, label: str = "value") -> DataFrame:
    """Watch hours, timelines and share of total per value of a dimension."""
    value = F.coalesce(F.nullif(F.trim(dimension.cast("string")), F.lit("")), F.lit("(blank/null)"))
    per = watch.groupBy(value.alias(label)).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("timeline_key").alias("timelines"),
        F.sum("watch_sec").alias("watch_sec"),
    )
    return with_share(per, "watch_sec", "pct_of_watch").withColumn("watch_hours", F.round(F.col("watch_sec") / 3600, 4))
