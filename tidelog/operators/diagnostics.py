"""Checks on watch-hour inputs: repeated seconds, gap distribution, path types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clock
from ..functions.bands import path_type
from ..functions.querystring import qs_trimmed
from ..model import COLS, WATCH_GAP_CAP_SECONDS, ColMap, typed
from . import histogram, sketches
from .ranking import counts, percent
from .watch import gap_watch

GAP_POINTS = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def id_rows(logs: DataFrame, cols: ColMap = COLS) -> DataFrame:
    """req_ts, device_id, session_id of the rows that carry a device."""
    df = typed(logs, cols).select(
        "req_ts", qs_trimmed(cols.qs, "device_id").alias("device_id"), qs_trimmed(cols.qs, "session_id").alias("session_id")
    )
    return df.where(F.col("device_id").isNotNull())


def same_second_groups(rows: DataFrame) -> DataFrame:
    per = rows.groupBy("device_id", "req_ts").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(
        F.count(F.lit(1)).alias("device_second_groups"), F.sum("n").alias("rows_in_groups"),
        F.sum(F.col("n") - 1).alias("extra_rows"), F.count_if(F.col("n") > 1).alias("duplicate_groups"),
    )


def _gap_counts(rows: DataFrame, grains: dict[str, list[str]], **tuning) -> DataFrame:
    """(grain, v, n): rows per gap to the next event of the grain's key, written once. A row counts in each grain whose keys it has."""
    names = sorted({k for keys in grains.values() for k in keys})
    full = lambda keys: F.array(*[F.col(k).isNotNull() for k in keys])
    each = [F.when(F.forall(full(keys), lambda x: x), F.struct(F.lit(g).alias("grain"), *[(F.col(k) if k in keys else F.lit("")).alias(k) for k in names])) for g, keys in grains.items()]
    rows = rows.select("req_ts", F.inline(F.filter(F.array(*each), lambda x: x.isNotNull())))
    g = gap_watch(rows, ["grain", *names], None, out="gap", **tuning).where(F.col("next_req_ts").isNotNull())
    return histogram.counted(g, "gap", ["grain"])


def _gap_profile(counts: DataFrame, cap: int) -> DataFrame:
    v, n = F.col("v"), F.col("n")
    measures = {
        "zero": ("sum", F.when(v == 0, n).otherwise(0)), "total": ("sum", v * n), "max_gap_sec": ("max", v), "capped": ("sum", F.least(v, F.lit(cap)) * n)}
    rows = histogram.profile(counts, ["grain"], GAP_POINTS, measures)
    return rows.select(
        "grain", F.col("rows").alias("rows_with_next_event"), F.col("zero").alias("zero_gap_rows"), percent(F.col("zero"), F.col("rows")).alias("zero_gap_pct"),
        F.round(F.col("total") / F.col("rows"), 3).alias("avg_gap_sec"), "max_gap_sec", F.round(F.col("capped") / F.col("rows"), 3).alias("avg_capped_sec"),
        F.round(F.col("capped") / 3600, 4).alias("watch_hours"), *GAP_POINTS)


def gap_profile(rows: DataFrame, keys: list[str], cap: int = WATCH_GAP_CAP_SECONDS, **tuning) -> DataFrame:
    """Distribution of gaps to the next event, and capped watch hours, as one row; no row where no key has two events."""
    return _gap_profile(_gap_counts(rows, {"all": keys}, **tuning), cap).drop("grain")


def device_vs_session(rows: DataFrame, cap: int = WATCH_GAP_CAP_SECONDS, **tuning) -> DataFrame:
    """The gap profile per device, and per device and session, as two rows: one ordering of the rows serves both."""
    return _gap_profile(_gap_counts(rows, {"device": ["device_id"], "device+session": ["device_id", "session_id"]}, **tuning), cap)


def watch_per_device(rows: DataFrame, cap: int = WATCH_GAP_CAP_SECONDS, **tuning) -> DataFrame:
    """Average, percentiles and maximum of capped watch minutes per device."""
    g = gap_watch(rows.select("device_id", "req_ts"), ["device_id"], None, out="gap", **tuning).where(F.col("next_req_ts").isNotNull())
    per = g.groupBy("device_id").agg(F.sum(F.least(F.col("gap"), F.lit(cap))).alias("sec"))
    points = {k: v for k, v in GAP_POINTS.items() if k != "p99"}
    one = histogram.profile(histogram.counted(per, "sec", []), [], points, {"total": ("sum", F.col("v") * F.col("n")), "most": ("max", F.col("v"))})
    return one.select(
        F.col("rows").alias("devices_with_watch"), F.round(F.col("total") / F.col("rows") / 60, 4).alias("avg_min"), F.round(F.col("most") / 60, 4).alias("max_min"),
        *[F.round(F.col(p) / 60, 4).alias(f"{p}_min") for p in points])


def device_gaps(rows: DataFrame, **tuning) -> DataFrame:
    """(day, gap): seconds to the device's next event, of every event that has one."""
    g = gap_watch(rows.select("device_id", "req_ts"), ["device_id"], None, out="gap", **tuning).where(F.col("next_req_ts").isNotNull())
    return g.select(clock.day_date("req_ts").alias("day"), "gap")


def daily_gap_sketches(rows: DataFrame, **tuning) -> DataFrame:
    """Per UTC day: KLL sketch of the gaps to a device's next event, to be stored and merged over any days (`sketches.merged`, `sketches.quantiles`)."""
    return sketches.daily_sketches(device_gaps(rows, **tuning), ["day"], {}, {"gap": "gap"})


def path_types(logs: DataFrame, cols: ColMap = COLS) -> DataFrame:
    return counts(logs, path_type(cols.path).alias("path_type"), name="rows")
