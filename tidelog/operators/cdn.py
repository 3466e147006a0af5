"""CDN health: KPIs, hourly series, breakdowns, anomalies, QoE, user-agent and network shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bands, clock, devices
from ..functions.text import decode_uri
from ..model import COLS, ColMap, typed
from ..session import staged
from . import histogram
from .ranking import counts, one_row, percent, with_share


def num(c: str) -> Column:
    return F.col(c).cast("string").try_cast("double")


def cdn_rows(logs: DataFrame, cols: ColMap = COLS) -> DataFrame:
    """Typed request rows with hit, error, agent tag and IST hour."""
    ua = decode_uri(F.coalesce(F.col(cols.ua), F.lit("")))
    df = typed(logs, cols).withColumn("ua_text", ua)
    return df.select(
        "*", (F.col("cacheStatus") == "1").alias("hit"), bands.is_error_text(cols.status).alias("err"),
        devices.platform_tag("ua_text").alias("tag"), devices.android_version("ua_text").alias("android"),
        clock.hour_start("req_ts").alias("hour_ts"),
    )


def kpis(rows: DataFrame) -> DataFrame:
    facts = rows.agg(
        F.count(F.lit(1)).alias("requests"), percent(F.count_if("hit"), F.count(F.lit(1))).alias("hit_pct"),
        percent(F.count_if("err"), F.count(F.lit(1))).alias("error_pct"), F.round(F.avg(num("throughput")), 2).alias("avg_throughput"),
        F.round(F.sum(num("totalBytes")) / 1e12, 6).alias("terabytes"), F.count_distinct("ua_text").alias("unique_uas"),
    )
    return facts


def volume_kpis(rows: DataFrame) -> DataFrame:
    """Requests, hosts, paths, states, IPs, bytes and error share in one row."""
    facts = rows.agg(F.count(F.lit(1)).alias("requests"), F.sum(num("totalBytes")).cast("long").alias("bytes"),
                     percent(F.count_if("err"), F.count(F.lit(1))).alias("error_pct"),
                     F.min("req_ts").alias("first_ts"), F.max("req_ts").alias("last_ts"))
    names = {"hosts": "reqHost", "paths": "reqPath", "states": "state", "ips": "cliIP"}
    return one_row(facts, rows.agg(*[F.count_distinct(c).alias(n) for n, c in names.items()]))


def hourly(rows: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return rows.groupBy("hour_ts").agg(
        n.alias("requests"), F.sum(num("totalBytes")).cast("long").alias("bytes"), F.round(F.avg(num("throughput")), 2).alias("avg_throughput"),
        percent(F.count_if("hit"), n).alias("hit_pct"), percent(F.count_if("err"), n).alias("error_pct"),
        F.round(F.avg(num("timeToFirstByte")), 2).alias("avg_ttfb"))


def breakdown(rows: DataFrame, column: str) -> DataFrame:
    return counts(rows, F.col(column).alias("value"), name="requests")


def anomalies(rows: DataFrame, error_share: float = 0.1, android_from: int = 16) -> DataFrame:
    """One row per flag with its count; zero means clear."""
    tags = [("null_or_invalid_ua", "Null/Invalid"), ("hls2disk", "Service: hls2disk"), ("ffmpeg", "Tool: FFmpeg"), ("palo_alto_scanner", "Scanner: Palo Alto")]
    one = rows.agg(
        *[F.count_if(F.col("tag") == t).alias(n) for n, t in tags],
        F.count_if(F.coalesce(F.col("android").try_cast("double"), F.lit(0.0)) >= android_from).alias("new_android"))
    names = [n for n, _ in tags] + ["new_android"]
    flags = one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("flag"), F.col(n).alias("count")) for n in names])))
    per_hour = rows.groupBy("hour_ts").agg(F.avg(F.col("err").cast("int")).alias("share"))
    hours = per_hour.agg(F.count_if(F.col("share") > error_share).alias("count")).select(F.lit("high_error_hours").alias("flag"), "count")
    return flags.unionByName(hours)


def global_summary(rows: DataFrame) -> DataFrame:
    """Requests, users, paths, bytes, throughput (mean, exact median), errors and cache in one row.

    Each row gives one entry per user, path and throughput; entries are counted per value and written once, and sums, distincts and the median come from that table.
    """
    status, n = F.col("statusCode").try_cast("long"), F.col("n")
    means = {"bytes": num("totalBytes"), "throughput": num("throughput"), "ttfb": num("timeToFirstByte"), "download_time": num("downloadTime")}
    facts = {
        "error_requests": F.coalesce((status >= 400).cast("long"), F.lit(0)), "hits": F.coalesce(F.upper("cacheStatus").contains("HIT").cast("long"), F.lit(0)),
        **{f"{m}_sum": c for m, c in means.items()}, **{f"{m}_n": c.isNotNull().cast("long") for m, c in means.items()}}
    speed = num("throughput")
    entries = F.array(*[F.struct(F.lit(i).alias("f"), t.cast("string").alias("t"), v.cast("double").alias("v")) for i, (t, v) in enumerate((
        (F.col("pseudo_user"), F.lit(None)), (F.col("reqPath"), F.lit(None)), (F.lit(None), speed)))])
    long = rows.select(*[c.alias(m) for m, c in facts.items()], F.inline(entries))
    per = staged(long.groupBy("f", "t", "v").agg(F.count(F.lit(1)).alias("n"), *[F.sum(m).alias(m) for m in facts]), "entries")
    once = lambda c: F.when(F.col("f") == 0, F.col(c))  # noqa: E731  the entries of the first field cover every row once
    one = per.agg(
        F.sum(once("n")).alias("rows"), *[F.sum(once(m)).alias(m) for m in facts], F.count_if((F.col("f") == 0) & F.col("t").isNotNull()).alias("pseudo_users"),
        F.count_if((F.col("f") == 1) & F.col("t").isNotNull()).alias("unique_paths"))
    median = histogram.profile(per.where((F.col("f") == 2) & F.col("v").isNotNull()).select("v", "n"), [], {"median_throughput": 0.5}).select("median_throughput")
    mean = lambda m: F.round(F.col(f"{m}_sum") / F.col(f"{m}_n"), 6).alias(f"avg_{m}")
    return one_row(one, median).select(
        F.coalesce("rows", F.lit(0)).alias("total_requests"), F.col("bytes_sum").cast("long").alias("total_bytes"), mean("bytes"), mean("throughput"), "error_requests",
        percent(F.col("error_requests"), F.col("rows")).alias("error_rate_pct"), percent(F.col("hits"), F.col("rows")).alias("cache_hit_pct"),
        mean("ttfb"), mean("download_time"), "pseudo_users", "unique_paths", "median_throughput")


def top_states(rows: DataFrame, n: int) -> DataFrame:
    return counts(rows, "state", name="requests").orderBy(F.desc("requests"), "state").limit(n)


def top_paths(rows: DataFrame, n: int) -> DataFrame:
    per = rows.groupBy("reqPath").agg(
        F.count(F.lit(1)).alias("hits"), F.sum(num("totalBytes")).cast("long").alias("total_bytes"),
        F.round(F.avg(num("throughput")), 2).alias("avg_throughput"), F.count_if(F.col("statusCode").try_cast("long") >= 400).alias("errors"))
    return per.orderBy(F.desc("hits"), "reqPath").limit(n)


def status_breakdown(rows: DataFrame) -> DataFrame:
    return counts(rows, "statusCode", bands.error_side("statusCode").alias("status_class"))


def top_error_paths(rows: DataFrame, n: int) -> DataFrame:
    bad = rows.where(F.col("statusCode").try_cast("long") >= 400)
    return counts(bad, "statusCode", "reqPath").orderBy(F.desc("count"), "statusCode", "reqPath").limit(n)


def top_users(rows: DataFrame, n: int) -> DataFrame:
    per = rows.groupBy("pseudo_user").agg(
        F.count(F.lit(1)).alias("requests"), F.count_distinct("reqPath").alias("unique_paths"),
        F.sum(num("totalBytes")).cast("long").alias("total_bytes"), F.count_if(F.col("statusCode").try_cast("long") >= 400).alias("errors"))
    return per.orderBy(F.desc("requests"), "pseudo_user").limit(n)


def bot_like(rows: DataFrame, min_requests: int = 500, min_ratio: float = 50.0) -> DataFrame:
    """Users with many requests on few paths."""
    per = rows.groupBy("pseudo_user").agg(
        F.count(F.lit(1)).alias("requests"), F.count_distinct("reqPath").alias("unique_paths"), F.count_distinct("reqHost").alias("unique_hosts"))
    ratio = F.try_divide(F.col("requests"), F.col("unique_paths"))
    per = per.withColumn("request_path_ratio", F.round(ratio, 4))
    return per.where((F.col("requests") >= min_requests) & (ratio >= min_ratio))


def repeated_requests(rows: DataFrame, keys: list[str], seconds: int | None = None) -> DataFrame:
    """Groups of equal keys, optionally inside one time bucket, with more than one row."""
    by = [F.col(k) for k in keys]
    if seconds is not None:
        by.append(clock.bucket_start("req_ts", seconds).alias("time_bucket"))
    return counts(rows, *by).where(F.col("count") > 1)


def qoe_bands(rows: DataFrame) -> DataFrame:
    return rows.groupBy(bands.throughput_band("throughput").alias("throughput_band")).agg(
        F.count(F.lit(1)).alias("requests"), F.round(F.avg(num("timeToFirstByte")), 2).alias("avg_ttfb"))


def state_qoe(rows: DataFrame, n: int) -> DataFrame:
    per = rows.groupBy("state").agg(
        F.count(F.lit(1)).alias("requests"), F.round(F.avg(num("throughput")), 2).alias("avg_throughput"),
        F.round(F.avg(num("timeToFirstByte")), 2).alias("avg_ttfb"), F.count_if(F.col("statusCode").try_cast("long") >= 400).alias("errors"))
    return per.orderBy(F.desc("requests"), "state").limit(n)


def top_volume(rows: DataFrame, column: str, n: int) -> DataFrame:
    per = rows.groupBy(F.col(column).alias("value")).agg(
        F.count(F.lit(1)).alias("requests"), F.sum(num("totalBytes")).cast("long").alias("bytes"))
    return per.orderBy(F.desc("requests"), "value").limit(n)


def asn_share(logs: DataFrame, asn: str = "asn") -> DataFrame:
    per = counts(logs.select(bands.upper_asn(asn).alias("asn")).where(F.col("asn").isNotNull()), "asn", name="requests")
    return with_share(per, "requests", "pct")


def agents(logs: DataFrame, ua: str = "UA") -> DataFrame:
    """Distinct agents with volume and classes; agents are counted before they are classified."""
    per = counts(logs, F.coalesce(F.col(ua), F.lit("")).alias("ua"), name="volume")
    return per.select(
        "*", devices.device_brand("ua").alias("brand"), devices.brand_type("ua").alias("brand_type"),
        devices.os_family("ua").alias("os"), devices.is_bot("ua").alias("is_bot"))


def agent_report(agent_rows: DataFrame) -> DataFrame:
    """Shares, concentration and flags over classified agents, as (measure, value) rows."""
    v = F.col("volume")
    by_brand = agent_rows.groupBy("brand").agg(F.sum("volume").alias("v"))
    by_os = agent_rows.groupBy("os").agg(F.sum("volume").alias("v"))
    # both are bounded by the number of classes
    tops = by_brand.agg(F.slice(F.reverse(F.array_sort(F.collect_list("v"))), 1, 10).alias("_t"), F.count(F.lit(1)).alias("brands"))
    top_os = by_os.agg(F.max("v").alias("_o"))
    typed_sum = lambda t: F.coalesce(F.sum(F.when(F.col("brand_type") == t, v)), F.lit(0))
    facts = agent_rows.agg(
        F.sum(v).alias("_all"), F.count(F.lit(1)).alias("agents"), typed_sum("Connected TV").alias("_ctv"),
        typed_sum("Mobile / Tablet").alias("_mob"), typed_sum("Desktop").alias("_desk"),
        F.coalesce(F.sum(F.when(F.col("is_bot"), v)), F.lit(0)).alias("_bot"),
        F.coalesce(F.sum(F.when(F.col("brand").isin("Unknown", "Missing / Null"), v)), F.lit(0)).alias("_unk"))
    one = one_row(facts, tops, top_os)
    upto = lambda k: F.aggregate(F.slice("_t", 1, k), F.lit(0).cast("long"), lambda a, x: a + x)
    share = lambda c: F.round(c / F.col("_all"), 4)
    top1, top3 = upto(1), upto(3)
    one = one.select(
        F.col("_all").alias("total_volume"), "agents", "brands", share(top1).alias("top_brand_share"), share(top3).alias("top3_share"),
        share(upto(10)).alias("top10_share"), share(F.col("_ctv")).alias("ctv_share"), share(F.col("_mob")).alias("mobile_share"),
        share(F.col("_desk")).alias("desktop_share"), share(F.col("_o")).alias("top_os_share"), share(F.col("_bot")).alias("bot_share"),
        share(F.col("_unk")).alias("unknown_share"),
        F.when(top1 / F.col("_all") > 0.5, "extreme dependency").when(top1 / F.col("_all") > 0.35, "high dependency").alias("dependency_flag"),
        (top3 / F.col("_all") > 0.7).alias("concentrated"), (F.col("_bot") / F.col("_all") > 0.05).alias("high_bot_traffic"),
        (F.col("_unk") / F.col("_all") > 0.05).alias("data_quality_issue"))
    return one


def user_ip_asn(rows: DataFrame, user_column: str, geo: DataFrame | None = None) -> DataFrame:
    """Requests per user, IP and ASN, with location columns when a geo table is given."""
    per = counts(rows, user_column, "cliIP", "asn", name="requests")
    if geo is None:
        return per
    from .dimensions import with_geo

    return with_geo(per, geo)
