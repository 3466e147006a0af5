"""Device, system and browser of user agents, with versions, from one ordered table of patterns.

Agents repeat a lot: distinct texts are matched once and joined back. Each text meets the fixed table inside one expression, so
there is no join with it and no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.devices import is_bot

# Kind, keyword of the lower-case agent, label, pattern of the version ('' where there is none). Within a kind the first keyword that occurs counts.
PATTERNS = (
    ("device", "aft", "Amazon Fire TV", r"(aft[a-z0-9]+)"),
    ("device", "bravia", "Sony Bravia", r"(bravia [a-z0-9]+)"),
    ("device", "mibox", "Xiaomi Mi Box", r"(mibox[a-z0-9]*)"),
    ("device", "mitv", "Xiaomi Mi TV", r"(mitv-[a-z0-9]+)"),
    ("device", "apple tv", "Apple TV", ""),
    ("device", "iphone", "iPhone", ""),
    ("device", "ipad", "iPad", ""),
    ("device", "macintosh", "Mac", ""),
    ("device", "windows", "PC", ""),
    ("device", "build/", "Android device", r"; ([^;()]+?) build/"),
    ("os", "windows nt", "Windows", r"windows nt ([0-9.]+)"),
    ("os", "iphone os", "iOS", r"iphone os ([0-9_]+)"),
    ("os", "cpu os", "iOS", r"cpu os ([0-9_]+)"),
    ("os", "mac os x", "Mac OS X", r"mac os x ([0-9_.]+)"),
    ("os", "tizen", "Tizen", r"tizen ([0-9.]+)"),
    ("os", "web0s", "webOS", ""),
    ("os", "android", "Android", r"android ([0-9.]+)"),
    ("os", "linux", "Linux", ""),
    ("browser", "exoplayer", "ExoPlayer", r"exoplayer[a-z]*/([0-9.]+)"),
    ("browser", "edg/", "Edge", r"edg/([0-9.]+)"),
    ("browser", "opr/", "Opera", r"opr/([0-9.]+)"),
    ("browser", "samsungbrowser/", "Samsung Internet", r"samsungbrowser/([0-9.]+)"),
    ("browser", "firefox/", "Firefox", r"firefox/([0-9.]+)"),
    ("browser", "chrome/", "Chrome", r"chrome/([0-9.]+)"),
    ("browser", "safari/", "Safari", r"version/([0-9.]+)"),
    ("browser", "applecoremedia/", "Apple CoreMedia", r"applecoremedia/([0-9.]+)"),
    ("browser", "dalvik/", "Dalvik", r"dalvik/([0-9.]+)"),
    ("browser", "mozilla/", "Mozilla", r"mozilla/([0-9.]+)"),
)
KINDS = ("device", "os", "browser")


def _hit(agent: Column, kind: str) -> Column:
    """label and version pattern of the kind's first keyword in the agent, or NULL."""
    rules = F.array(*[F.struct(F.lit(k).alias("keyword"), F.lit(label).alias("label"), F.lit(v).alias("version")) for t, k, label, v in PATTERNS if t == kind])
    return F.get(F.filter(rules, lambda r: agent.contains(r["keyword"])), 0)


def parsed(agents: DataFrame, ua: str) -> DataFrame:
    """ua, device, device_version, os, os_version, browser, browser_version, is_bot of distinct non-NULL agents; 'Other' and NULL where nothing fits."""
    rows = agents.select(F.col(ua).alias("ua")).where(F.col("ua").isNotNull()).distinct()
    rows = rows.withColumn("_low", F.lower("ua"))
    rows = rows.select("ua", "_low", *[_hit(F.col("_low"), k).alias(f"_{k}") for k in KINDS])
    version = lambda k: F.nullif(F.call_function("regexp_extract", F.col("_low"), F.col(f"_{k}")["version"], F.lit(1)), F.lit(""))
    return rows.select(
        F.col("ua").alias(ua), *[c for k in KINDS for c in (
            F.coalesce(F.col(f"_{k}")["label"], F.lit("Other")).alias(k), F.when(F.col(f"_{k}")["version"] != "", version(k)).alias(f"{k}_version"))],
        is_bot("ua").alias("is_bot"))


def with_agent(df: DataFrame, ua: str) -> DataFrame:
    """df with the columns of ``parsed``; rows without an agent have 'Missing' and no versions. One shuffle of the distinct texts, one join back (left to adaptive execution)."""
    known = parsed(df, ua)
    out = df.join(known.withColumnRenamed(ua, "_ua"), F.col(ua) == F.col("_ua"), "left").drop("_ua")
    return out.withColumns({**{k: F.coalesce(k, F.lit("Missing")) for k in KINDS}, "is_bot": F.coalesce("is_bot", F.lit(False))})


def shares(df: DataFrame, ua: str) -> DataFrame:
    """Requests per device, system, system version and browser: agents are counted before they are parsed."""
    per = df.groupBy(ua).agg(F.count(F.lit(1)).alias("n"))
    rows = with_agent(per, ua)
    return rows.groupBy("device", "os", "os_version", "browser", "is_bot").agg(F.sum("n").alias("requests"), F.count(ua).alias("agents"))
