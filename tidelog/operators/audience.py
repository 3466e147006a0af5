"""Behaviour reports: channel master, daypart ranking, stickiness, retention, switching."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import channels
from ..functions.bands import watch_bucket
from ..functions.querystring import qs_mentions, qs_text, qs_value
from ..functions.text import decode_form
from ..model import COLS, WATCH_GAP_CAP_SECONDS, ColMap, typed
from .events import coverage
from .ordered import Ordered
from .ranking import summarize, top_per_group

SESSION = ["device_id", "session_id"]


def channel_master(logs: DataFrame, cols: ColMap = COLS) -> DataFrame:
    """Pure channel x raw channel x platform x device with requests and *exact* sessions and devices.

    The counts are taken after cleaning, at the reported grain; summing the distincts of
    raw combinations would only give an upper bound.
    """
    rows = master_rows(logs, cols)
    per = rows.groupBy("raw_channel", "platform", "device_name").agg(
        F.count(F.lit(1)).alias("requests"), F.count_distinct("s").alias("sessions"), F.count_distinct("d").alias("devices"))
    return per.withColumn("pure_channel", channels.channel_pure("raw_channel", "platform", "device_name"))


def master_rows(logs: DataFrame, cols: ColMap = COLS) -> DataFrame:
    """The rows that the channel master counts: names as text, device and session."""
    has = typed(logs, cols).where(qs_mentions(cols.qs, "session_id"))
    text = lambda key: decode_form(F.coalesce(qs_value(cols.qs, key), F.lit("")))
    return has.select(
        decode_form(channels.channel_raw(cols.qs, cols.path)).alias("raw_channel"), text("platform").alias("platform"), text("device").alias("device_name"),
        qs_text(cols.qs, "session_id").alias("s"), qs_text(cols.qs, "device_id").alias("d"))


def pure_rollup(logs: DataFrame, cols: ColMap = COLS) -> DataFrame:
    """Per pure channel: requests, exact sessions and devices, and the number of raw variants.

    Sessions and devices of raw channels overlap, so their counts cannot be summed. Rows are first counted per raw combination and id, names are cleaned
    once per group, and each (pure channel, id) pair counts once.
    """
    names = ["raw_channel", "platform", "device_name"]
    per = master_rows(logs, cols).groupBy(*names, "s", "d").agg(F.count(F.lit(1)).alias("n"))
    per = per.withColumn("pure_channel", channels.channel_pure("raw_channel", "platform", "device_name"))
    return summarize(per, ["pure_channel"], {"requests": ("sum", F.col("n"))}, {"sessions": "s", "devices": "d", "raw_variants": "raw_channel"}, {}, rows="_groups").drop("_groups")


def daypart_top(events: DataFrame, entity: str, n: int) -> DataFrame:
    """Top entities per daypart by sessions, then requests, then name."""
    per = events.groupBy("day_part", F.col(entity).alias("entity_name")).agg(
        F.count(F.lit(1)).alias("requests"), F.count_distinct("session_id").alias("sessions"), F.count_distinct("device_id").alias("devices"))
    return top_per_group(per, ["day_part"], [F.desc("sessions"), F.desc("requests"), F.asc("entity_name")], n)


def sequenced(events: DataFrame, entity: str, tie: list[str] = ("event_id",), lag: bool = False, **tuning) -> DataFrame:
    """Events per device and session with next time and next (or previous) entity; a stored base (`base.read_base`) has them already."""
    if f"next_{entity}" in events.columns:
        return events.withColumns({"entity_name": F.col(entity), "next_entity_name": F.col(f"next_{entity}"), "prev_entity_name": F.col(f"prev_{entity}")})
    rows = events.withColumn("entity_name", F.col(entity))
    step = Ordered.by(rows, SESSION, ["req_ts", *tie], **tuning)
    return (step.neighbours(lag=["entity_name"]) if lag else step.neighbours(lead=["req_ts", "entity_name"])).rows()


def _gap():
    return F.greatest(F.col("next_req_ts") - F.col("req_ts"), F.lit(0))


def _watch(cap: int):
    """Capped seconds; ``greatest`` skips the NULL of a last row, which so counts 0."""
    return F.least(_gap(), F.lit(cap))


def stickiness(seq: DataFrame, n: int, min_sessions: int, cap: int = WATCH_GAP_CAP_SECONDS) -> DataFrame:
    """Watch and switch-away measures per entity, with a 4-way label against the medians of the rows returned."""
    away = F.coalesce((F.col("next_entity_name") != F.col("entity_name")).cast("int"), F.lit(0))
    per = seq.groupBy("entity_name").agg(
        F.count(F.lit(1)).alias("requests"), F.count_distinct("session_id").alias("sessions"),
        F.count_distinct("device_id").alias("devices"), F.sum(_watch(cap)).alias("_w"), F.sum(away).alias("_a"),
    ).where(F.col("sessions") >= min_sessions)
    w, req = F.col("_w"), F.col("requests")
    per = per.select(
        "entity_name", "requests", "sessions", "devices",
        F.round(w / 60, 2).alias("watch_min"), F.round(w / req / 60, 3).alias("avg_watch_per_request"),
        F.round(w / F.col("sessions") / 60, 2).alias("avg_watch_per_session"),
        F.round(F.col("_a") * 100.0 / req, 2).alias("switch_away_pct"),
    )
    top = per.orderBy(F.desc("sessions"), F.desc("watch_min"), "entity_name").limit(n)
    # the medians range over the n returned rows only
    medians = top.agg(F.median("requests").alias("_rm"), F.median("avg_watch_per_request").alias("_wm"), F.lit(0).alias("_k"))
    out = top.withColumn("_k", F.lit(0)).join(medians.withColumn("_k", F.lit(0)), "_k")
    busy, sticky = F.col("requests") >= F.col("_rm"), F.col("avg_watch_per_request") >= F.col("_wm")
    label = (
        F.when(busy & ~sticky, "High traffic, low retention").when(busy, "Strong").when(sticky, "Niche but sticky")
        .otherwise("Low traction")
    )
    return out.withColumn("label", label).drop("_k", "_rm", "_wm")


def retention(seq: DataFrame, n: int, cap: int = WATCH_GAP_CAP_SECONDS) -> DataFrame:
    """Sessions per entity and watch bucket, for the n entities with most sessions."""
    watches = seq.groupBy("session_id", "device_id", "entity_name").agg(F.sum(_watch(cap)).alias("_w"))
    per = watches.groupBy("entity_name", watch_bucket(F.col("_w") / 60).alias("watch_bucket")).agg(F.count(F.lit(1)).alias("sessions"))
    top = per.groupBy("entity_name").agg(F.sum("sessions").alias("_s")).orderBy(F.desc("_s"), "entity_name").limit(n)
    # n rows, fixed by the caller
    return per.join(F.broadcast(top.select("entity_name")), "entity_name", "left_semi")


def transitions(seq: DataFrame, n: int) -> DataFrame:
    """Most frequent changes from one channel to the next, with the mean gap."""
    moved = seq.where(F.col("next_entity_name") != F.col("entity_name"))
    per = moved.groupBy(F.col("entity_name").alias("from_channel"), F.col("next_entity_name").alias("to_channel")).agg(
        F.count(F.lit(1)).alias("transitions"), F.round(F.avg(_gap()), 2).alias("avg_gap_sec"))
    return per.orderBy(F.desc("transitions"), "from_channel", "to_channel").limit(n)


def switch_rate(seq: DataFrame, min_events: int, n: int) -> DataFrame:
    """Share of events after which the viewer leaves the channel."""
    away = F.coalesce((F.col("next_entity_name") != F.col("entity_name")).cast("int"), F.lit(0))
    per = seq.groupBy(F.col("entity_name").alias("channel_name")).agg(
        F.count(F.lit(1)).alias("events"), F.round(F.sum(away) * 100.0 / F.count(F.lit(1)), 2).alias("switch_away_pct"))
    return per.where(F.col("events") >= min_events).orderBy(F.desc("switch_away_pct"), F.desc("events"), "channel_name").limit(n)


def session_switches(seq_lag: DataFrame) -> DataFrame:
    """Sessions by number of switches: 0, 1, 2-3, 4+."""
    per = seq_lag.groupBy("session_id").agg(F.count_if(F.col("prev_entity_name") != F.col("entity_name")).alias("s"))
    s = F.col("s")
    bucket = F.when(s == 0, "0").when(s == 1, "1").when(s <= 3, "2-3").otherwise("4+")
    return per.groupBy(bucket.alias("switch_bucket")).agg(F.count(F.lit(1)).alias("sessions"))


def session_paths(stored: DataFrame, cap: int = WATCH_GAP_CAP_SECONDS) -> DataFrame:
    """Per device and session of a stored base: events, channels, switches and capped watch seconds; no shuffle by that key."""
    return stored.groupBy(*SESSION).agg(
        F.count(F.lit(1)).alias("events"), F.size(F.collect_set("channel_name")).cast("long").alias("channels"),
        F.count_if(F.col("next_channel_name") != F.col("channel_name")).alias("switches"), F.sum(F.least(F.greatest(F.col("next_req_ts") - F.col("req_ts"), F.lit(0)), F.lit(cap))).alias("watch_sec"))


def bundle(events: DataFrame, n: int, min_sessions: int, min_events: int, logs: DataFrame | None = None, cols: ColMap = COLS) -> dict[str, DataFrame]:
    """All behaviour sections over one base frame, best a stored one (`base.read_base`): nothing is then ordered again. With ``logs`` also the coverage and the channel master."""
    out = {}
    if logs is not None:
        master = channel_master(logs, cols)
        out |= {"coverage": coverage(logs, cols), "channel_master": master, "pure_channels": pure_rollup(logs, cols)}
    for entity in ("content_label", "channel_name"):
        seq = sequenced(events, entity)
        out[f"daypart_{entity}"] = daypart_top(events, entity, n)
        out[f"stickiness_{entity}"] = stickiness(seq, n, min_sessions)
        out[f"retention_{entity}"] = retention(seq, n)
    seq = sequenced(events, "channel_name")
    out["transitions"] = transitions(seq, n)
    out["switch_rate"] = switch_rate(seq, min_events, n)
    out["session_switches"] = session_switches(sequenced(events, "channel_name", lag=True))
    return out


def long_form(sections: dict[str, DataFrame]) -> DataFrame:
    """(section, name, measure, value): every number of every section; name joins the row's texts by '|'."""
    parts = []
    for section, df in sections.items():
        texts = [c for c, t in df.dtypes if t == "string"]
        measures = [F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c, t in df.dtypes if t != "string"]
        parts.append(df.select(F.lit(section).alias("section"), F.concat_ws("|", *texts).alias("name"), F.inline(F.array(*measures))))
    return reduce(DataFrame.unionByName, parts)
