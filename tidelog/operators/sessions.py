"""Sessionization and per-session summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import INACTIVITY_MINUTES, SESSION_GAP_MINUTES, SMART_CONTEXT_CHANGES, SMART_GAP_MINUTES
from .ordered import Ordered
from .ranking import summarize

CONTEXT = ("channel_name", "cliIP", "asn", "platform")


def _differs(column: str) -> Column:
    blank = F.lit("__x__")
    return F.coalesce(F.col(column).cast("string"), blank) != F.coalesce(F.col(f"prev_{column}").cast("string"), blank)


def smart_sessions(
    events: DataFrame, device: str = "device_id", ts: str = "req_ts", tie: list[str] = (),
    gap_minutes: int = SESSION_GAP_MINUTES, watch_cap: int | None = None, **tuning,
) -> DataFrame:
    """Add session_no and session_key per device; with ``watch_cap`` also next_<ts> and watch_sec as `watch.gap_watch` would, from the same window pass.

    A row opens a session when it is the device's first, follows a gap above
    ``gap_minutes``, changes session_id, or follows a gap above 8 minutes with at least two
    of channel, IP, ASN and platform changed. ``tuning`` goes to :meth:`Ordered.by`.
    """
    have = [c for c in CONTEXT if c in events.columns]
    lagged = [ts, *have, *(["session_id"] if "session_id" in events.columns else [])]
    gap = F.col(ts) - F.col(f"prev_{ts}")
    changes = reduce(lambda a, b: a + b, [_differs(c).cast("int") for c in have], F.lit(0))
    new = F.col(f"prev_{ts}").isNull() | (gap > gap_minutes * 60)
    if "session_id" in events.columns:
        new = new | _differs("session_id")
    new = new | ((gap > SMART_GAP_MINUTES * 60) & (changes >= SMART_CONTEXT_CHANGES))
    flag = F.coalesce(new, F.lit(False)).cast("int")
    rows = (
        Ordered.by(events, [device], [ts, *tie], **tuning)
        .step(lag=lagged, lead=[] if watch_cap is None else [ts])
        .map(lambda df: df.withColumn("new_session", flag).drop(*[f"prev_{c}" for c in lagged]))
        .running_sum("new_session", "session_no")
        .rows()
    )
    if watch_cap is not None:
        gap = F.coalesce(F.greatest(F.col(f"next_{ts}") - F.col(ts), F.lit(0)), F.lit(0))
        rows = rows.withColumn("watch_sec", F.least(gap, F.lit(watch_cap)))
    return rows.withColumn("session_key", F.concat(F.col(device), F.lit("_S"), F.col("session_no").cast("string")))


def gap_sessions(
    events: DataFrame, user: list[str], ts: str = "req_ts", tie: list[str] = (), minutes: int = INACTIVITY_MINUTES, **tuning
) -> DataFrame:
    """Add gap_session (1, 2, ...) per user, split where the gap exceeds ``minutes``."""
    flag = F.coalesce((F.col(ts) - F.col(f"prev_{ts}") > minutes * 60).cast("int"), F.lit(1))
    return (
        Ordered.by(events, user, [ts, *tie], **tuning)
        .neighbours(lag=[ts])
        .map(lambda df: df.withColumn("new_session", flag).drop(f"prev_{ts}"))
        .running_sum("new_session", "gap_session")
        .rows()
    )


def gap_session_summary(sessions: DataFrame, user: list[str], ts: str = "req_ts") -> DataFrame:
    """One row per user session: span, requests, paths, bytes, errors, duration."""
    status = F.col("statusCode").try_cast("long")
    out = sessions.groupBy(*user, "gap_session").agg(
        F.min(ts).alias("session_start"), F.max(ts).alias("session_end"), F.count(F.lit(1)).alias("requests"),
        F.count_distinct("reqPath").alias("unique_paths"),
        F.sum(F.col("totalBytes").try_cast("double")).cast("long").alias("total_bytes"),
        F.count_if(status >= 400).alias("errors"),
    )
    return out.withColumn("duration_sec", F.col("session_end") - F.col("session_start"))


def session_summary(events: DataFrame, ts: str = "req_ts", path: str = "reqPath") -> DataFrame:
    """One row per session_key with its span, counts, watch minutes and most frequent channel and title."""
    t = F.col(ts)
    out = summarize(
        events, ["session_key"],
        {"device_id": ("min", F.col("device_id")), "start_ts": ("min", t), "end_ts": ("max", t), "_w": ("sum", F.col("watch_sec"))},
        {"unique_paths": path, "unique_channels": "channel_name"},
        {"top_channel": "channel_name", "top_title": "content_label"},
    )
    return out.withColumns({
        "est_watch_min": F.round(F.col("_w") / 60, 4),
        "session_duration_min": F.round((F.col("end_ts") - F.col("start_ts")) / 60, 4),
    }).drop("_w")


def viewer_timelines(
    rows: DataFrame, viewer: str = "viewer_id", session: str = "session_id", ts: str = "req_ts", **tuning
) -> DataFrame:
    """Split a viewer's rows only where a *new known* session id appears.

    ``rows`` must be distinct. Adds timeline_no and watch_sec (uncapped, inside the
    timeline; NULL on the timeline's last row).
    """
    order = [ts, *[c for c in (session, "device_id", "cliip", "ua") if c in rows.columns]]
    new = F.col(session).isNotNull() & F.col("_known").isNotNull() & (F.col(session) != F.col("_known"))
    flag = (F.col(f"prev_{ts}").isNull() | F.coalesce(new, F.lit(False))).cast("int")
    # the viewer's next row belongs to the same timeline unless it opens one
    gap = F.when(F.col("next__new") == 0, F.greatest(F.col(f"next_{ts}") - F.col(ts), F.lit(0)))
    return (
        Ordered.by(rows, [viewer], order, **tuning)
        .step(lag=[ts], lead=[ts], known={session: "_known"})
        .map(lambda df: df.withColumn("_new", flag).drop("_known", f"prev_{ts}"))
        .step(lead=["_new"], running={"_new": "timeline_no"})
        .map(lambda df: df.withColumn("watch_sec", gap).drop("_new", f"next_{ts}", "next__new"))
        .rows()
    )
