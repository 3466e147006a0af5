"""IP, device and session relations; audits of missing IDs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bands
from ..functions.querystring import qs_has_key, qs_value
from ..functions.text import blank_to_null, decode_form
from ..model import COLS, ColMap, typed
from .dimensions import best_match
from .ranking import first_values, one_row, percent, summarize, top_per_group


def id_events(logs: DataFrame, cols: ColMap = COLS) -> DataFrame:
    """IP, trimmed strict IDs and key flags of rows with an IP."""
    df = typed(logs, cols).where(blank_to_null(cols.ip).isNotNull())
    return df.select(
        F.col(cols.ip).alias("cliIP"), "req_ts", F.col(cols.path).alias("reqPath"),
        blank_to_null(qs_value(cols.qs, "device_id")).alias("device_id"),
        blank_to_null(qs_value(cols.qs, "session_id")).alias("session_id"),
        qs_has_key(cols.qs, "device_id", False).alias("has_device_key"),
        qs_has_key(cols.qs, "session_id", False).alias("has_session_key"),
        decode_form(qs_value(cols.qs, "platform")).alias("platform"),
        *[F.col(c) for c in ("country", "state", "city") if c in logs.columns],
    )


def ip_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("cliIP").agg(
        F.count(F.lit(1)).alias("rows"), F.count("device_id").alias("rows_with_device_id"),
        F.count("session_id").alias("rows_with_session_id"), F.count_distinct("device_id").alias("distinct_device_id"),
        F.count_distinct("session_id").alias("distinct_session_id"),
        F.min("req_ts").alias("first_req_ts"), F.max("req_ts").alias("last_req_ts"),
    )


def missing_ip_list(rows: DataFrame) -> DataFrame:
    """IPs on which no row carries a device or session id."""
    return ip_summary(rows).where((F.col("rows_with_device_id") == 0) & (F.col("rows_with_session_id") == 0))


def missing_ip_bins(rows: DataFrame) -> DataFrame:
    per = rows.groupBy("cliIP").agg(
        F.count(F.lit(1)).alias("rows"), F.count(F.coalesce("device_id", "session_id")).alias("ids")).where("ids = 0")
    return per.groupBy(bands.count_bin("rows", bands.ROW_BINS, "10K+").alias("rows_per_ip")).agg(F.count(F.lit(1)).alias("ip_count"))


def id_audit(logs: DataFrame, cols: ColMap = COLS) -> DataFrame:
    """One row: ID coverage by row and by IP."""
    rows = id_events(logs, cols)
    dev, sid = F.col("device_id"), F.col("session_id")
    total = typed(logs, cols).agg(F.count(F.lit(1)).alias("total_rows"))
    overall = rows.agg(
        F.count(F.lit(1)).alias("rows_with_cliip"), F.count(dev).alias("rows_with_device_id"),
        F.count_if(dev.isNull()).alias("rows_without_device_id"), F.count(sid).alias("rows_with_session_id"),
        F.count_if(sid.isNull()).alias("rows_without_session_id"), F.count_if(dev.isNotNull() & sid.isNotNull()).alias("rows_with_both"),
        F.count_if(F.col("has_device_key") & dev.isNull()).alias("device_key_blank"),
        F.count_if(F.col("has_session_key") & sid.isNull()).alias("session_key_blank"),
        F.count_if(~F.col("has_device_key")).alias("device_key_absent"),
        F.count_if(~F.col("has_session_key")).alias("session_key_absent"),
        F.count_distinct("device_id").alias("distinct_device_id"), F.count_distinct("session_id").alias("distinct_session_id"),
    )
    per_ip = rows.groupBy("cliIP").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.coalesce("device_id", "session_id")).alias("ids"))
    none = F.col("ids") == 0
    by_ip = per_ip.agg(
        F.count(F.lit(1)).alias("distinct_cliip"), F.count_if(none).alias("cliip_missing_both"),
        F.coalesce(F.sum(F.when(none, F.col("n"))), F.lit(0)).alias("rows_on_missing_both"),
        F.count_if(~none).alias("cliip_with_id"), F.coalesce(F.sum(F.when(~none, F.col("n"))), F.lit(0)).alias("rows_on_cliip_with_id"),
    )
    out = one_row(total, overall, by_ip)
    return out.select(
        "*", percent(F.col("cliip_missing_both"), F.col("distinct_cliip")).alias("pct_cliip_missing_both"),
        percent(F.col("rows_on_missing_both"), F.col("rows_with_cliip")).alias("pct_rows_missing_both"),
        percent(F.col("rows_with_device_id"), F.col("rows_with_cliip")).alias("pct_device_filled"),
        percent(F.col("rows_with_session_id"), F.col("rows_with_cliip")).alias("pct_session_filled"),
        percent(F.col("rows_with_both"), F.col("rows_with_cliip")).alias("pct_both_filled"),
    )


def device_rows_with_ip(logs: DataFrame, cols: ColMap = COLS) -> DataFrame:
    """Per device: rows and distinct IPs, over rows with an IP."""
    return id_events(logs, cols).where(F.col("device_id").isNotNull()).groupBy("device_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("cliIP").alias("distinct_cliip"))


def _mapping(rows: DataFrame, key: str, other: str, count_name: str, top_name: str, weight_name: str, share: str) -> DataFrame:
    both = rows.where(F.col("device_id").isNotNull())
    per = both.groupBy(key).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct(other).alias(count_name),
        F.min("req_ts").alias("first_seen"), F.max("req_ts").alias("last_seen"))
    best = best_match(both, key, other, F.count(F.lit(1)), top_name, weight_name)
    return per.join(best, key, "left").withColumn(share, percent(F.col(weight_name), F.col("rows")))


def ip_to_device(rows: DataFrame) -> DataFrame:
    return _mapping(rows, "cliIP", "device_id", "distinct_devices", "top_device_id", "device_rows", "top_device_row_pct")


def device_to_ip(rows: DataFrame) -> DataFrame:
    return _mapping(rows, "device_id", "cliIP", "distinct_ips", "top_cliip", "ip_rows", "top_ip_row_pct")


def device_count_bands(rows: DataFrame) -> DataFrame:
    """IPs by number of devices: 1, 2-5, 6-20, 20+."""
    per = rows.where(F.col("device_id").isNotNull()).groupBy("cliIP").agg(F.count_distinct("device_id").alias("n"))
    return per.groupBy(bands.count_bin("n", bands.DEVICE_BINS, "20+").alias("devices")).agg(F.count(F.lit(1)).alias("ips"))


def ip_device_pairs(rows: DataFrame) -> DataFrame:
    """One row per IP and device with requests, sessions, paths and the most frequent platform."""
    both = rows.where(F.col("device_id").isNotNull())
    out = summarize(both, ["cliIP", "device_id"], {}, {"sessions": "session_id", "unique_paths": "reqPath"}, {"platform": "platform"})
    return out.withColumn("platform", F.coalesce("platform", F.lit("")))


def top_paths_per_device(rows: DataFrame, n: int) -> DataFrame:
    per = rows.where(F.col("device_id").isNotNull() & F.col("reqPath").isNotNull()).groupBy("device_id", "reqPath").agg(
        F.count(F.lit(1)).alias("requests"), F.count_distinct("session_id").alias("sessions"))
    return top_per_group(per, ["device_id"], [F.desc("requests"), F.asc("reqPath")], n)


def region_devices(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Devices, requests and IPs per region (or region and ISP) over geo-joined pairs."""
    keep = pairs
    if "isp" in by:
        keep = keep.where(F.col("isp") != "")
    return keep.groupBy(*by).agg(
        F.count_distinct("device_id").alias("unique_devices"), F.sum("requests").alias("total_requests"),
        F.count_distinct("cliIP").alias("unique_ips"))


def ip_device_paths(rows: DataFrame) -> DataFrame:
    both = rows.where(F.col("device_id").isNotNull() & F.col("reqPath").isNotNull())
    return both.groupBy("cliIP", "device_id", "reqPath").agg(
        F.count(F.lit(1)).alias("requests"), F.count_distinct("session_id").alias("sessions"))


def multi_device_ips(rows: DataFrame, shown: int) -> DataFrame:
    """IPs with more than one device: device count, requests and the first ids in order.

    Ids are ranked per IP and only the first ``shown`` are gathered, so no group is
    collected whole.
    """
    pairs = rows.where(F.col("device_id").isNotNull()).groupBy("cliIP", "device_id").agg(F.count(F.lit(1)).alias("requests"))
    per = pairs.groupBy("cliIP").agg(F.count(F.lit(1)).alias("n_devices"), F.sum("requests").alias("total_requests"))
    lists = first_values(pairs, ["cliIP"], "device_id", shown, "device_list")
    return per.where(F.col("n_devices") > 1).join(lists, "cliIP", "left")


def platforms_by_country(pairs: DataFrame, n: int) -> DataFrame:
    """Devices per country and platform, for the n countries with most."""
    per = pairs.where((F.col("country") != "") & (F.col("platform") != "")).groupBy("country", "platform").agg(
        F.count_distinct("device_id").alias("unique_devices"))
    top = per.groupBy("country").agg(F.sum("unique_devices").alias("_s")).orderBy(F.desc("_s"), "country").limit(n)
    return per.join(F.broadcast(top.select("country")), "country", "left_semi")


def sessions_per_device(rows: DataFrame, extra: list[str] = ("platform",)) -> DataFrame:
    both = rows.where(F.col("device_id").isNotNull() & F.col("session_id").isNotNull())
    return summarize(both, ["device_id"], {}, {"session_count": "session_id"}, {f"top_{c}": c for c in extra}, rows="total_events")


def sessions_per_device_bins(per_device: DataFrame) -> DataFrame:
    return per_device.groupBy(bands.count_bin("session_count", bands.SESSION_BINS, "100+").alias("sessions_per_device")).agg(
        F.count(F.lit(1)).alias("device_count"))


def multi_links(rows: DataFrame, key: str, other: str, name: str) -> DataFrame:
    """Keys linked to more than one value of ``other``."""
    both = rows.where(F.col("device_id").isNotNull() & F.col("session_id").isNotNull())
    return both.groupBy(key).agg(F.count_distinct(other).alias(name)).where(F.col(name) > 1)


def session_device_map(rows: DataFrame) -> DataFrame:
    both = rows.where(F.col("device_id").isNotNull() & F.col("session_id").isNotNull())
    return both.groupBy("session_id", "device_id").agg(F.count(F.lit(1)).alias("event_count"))
