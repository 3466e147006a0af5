"""Query registry and the request-log view built from the ``events`` table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.channels import PLATFORM_TOKENS
from ..session import run_folder
from ..sources import lake

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal the few raw columns evenly before the derivation, at every size: its branches then share one scan of the table."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


# One list of expressions serves both engines; only the epoch differs.
_SHIFT = "1704067200 + 79200 * (user_id % 4) + CAST(FLOOR(({micros} - 1704067200000000) / 100000000.0) AS BIGINT)"
# wall-clock parts of the zone-less timestamp, so the session's zone has no say
_SPARK_MICROS = (
    "(unix_date(CAST(ts AS DATE)) * 86400000000L + (hour(ts) * 3600 + minute(ts) * 60) * 1000000L"
    " + CAST(extract(SECOND FROM ts) * 1000000 AS BIGINT))"
)
_DUCK_MICROS = "epoch_us(ts)"

LOG_COLUMNS: dict[str, str] = {
    "event_id": "event_id",
    "reqTimeSec": "CAST({epoch} AS STRING)",
    "queryStr": """CASE WHEN event_id % 7 = 0 THEN NULL
 WHEN event_id % 11 = 0 THEN 'm=1'
 WHEN event_id % 13 = 0 THEN concat('device_id=&session_id=&channel=', event_type)
 ELSE concat('session_id=s', CAST(user_id AS STRING), '-', CAST(event_id % 3 AS STRING),
  '&device_id=d', CAST(user_id AS STRING),
  '&category_name=cat', CAST(event_id % 4 AS STRING),
  '&platform=', CASE WHEN user_id % 3 = 0 THEN 'android_tv' WHEN user_id % 3 = 1 THEN 'web' ELSE 'ios' END,
  '&device=', CASE WHEN user_id % 2 = 0 THEN 'BRAVIA%204K' ELSE 'AFTSS' END,
  '&channel=', event_type, CASE WHEN event_id % 2 = 0 THEN '_android' ELSE '' END,
  '&content_title=t%20', CAST(CAST(FLOOR(value) AS BIGINT) % 20 AS STRING)) END""",
    "cliIP": "concat('10.0.', CAST(user_id % 16 AS STRING), '.', CAST(user_id % 50 AS STRING))",
    "UA": """CASE WHEN event_id % 29 = 0 THEN NULL
 WHEN user_id % 4 = 0 THEN 'Dalvik/2.1 (Linux; Android 11; BRAVIA 4K Build/X)'
 WHEN user_id % 4 = 1 THEN 'Mozilla/5.0 (iPhone; CPU iPhone OS 17 like Mac OS X)'
 WHEN user_id % 4 = 2 THEN 'Mozilla/5.0 (Windows NT 10.0)'
 ELSE 'ExoPlayer Android 13' END""",
    "reqPath": """concat('vglive-sk-', CAST(user_id % 5 AS STRING), '/',
 CASE WHEN event_id % 4 = 0 THEN 'main.m3u8' ELSE concat('720p/seg', CAST(event_id % 97 AS STRING), '.ts') END)""",
    "statusCode": "CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 2 = 0 THEN '404' ELSE '503' END ELSE '200' END",
    "asn": "CASE WHEN event_id % 17 = 0 THEN '-' ELSE concat('AS', CAST(100 + user_id % 9 AS STRING)) END",
    "country": "CASE WHEN user_id % 10 < 7 THEN 'IN' WHEN user_id % 10 < 9 THEN 'AE' ELSE '^' END",
    "state": "CASE WHEN event_id % 19 = 0 THEN '' ELSE concat('state', CAST(user_id % 6 AS STRING)) END",
    "city": "concat('city', CAST(user_id % 12 AS STRING))",
    "reqHost": "concat('app', CAST(user_id % 3 AS STRING), '-live.akamaized.net')",
    "billingRegion": "CAST(user_id % 4 AS STRING)",
    "serverCountry": "CASE WHEN event_id % 5 = 0 THEN 'SG' ELSE 'IN' END",
    "cacheStatus": "CASE WHEN event_id % 3 = 0 THEN '0' ELSE '1' END",
    "totalBytes": "CAST(CAST(FLOOR(value * 100) AS BIGINT) AS STRING)",
    "throughput": "CAST((event_id * 7919) % 9000000 AS STRING)",
    "timeToFirstByte": "CAST((event_id * 31) % 900 AS STRING)",
    "downloadTime": "CAST((event_id * 17) % 700 AS STRING)",
}


def logs(spark: SparkSession, d: str) -> DataFrame:
    """Request log rows derived from the whole events table; all columns but event_id are text."""
    epoch = _SHIFT.format(micros=_SPARK_MICROS)
    exprs = [f"{e.replace('{epoch}', epoch)} AS {n}" for n, e in LOG_COLUMNS.items()]
    raw = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return spread(raw).selectExpr(*exprs)


def written_lake(spark: SparkSession, d: str) -> str:
    """Folder of a lake by year, month and day text, holding the whole log."""
    folder = run_folder(spark, "lake")
    lake.build_day_lake(logs(spark, d), folder)
    return folder


def _duck_logs() -> str:
    epoch = _SHIFT.format(micros=_DUCK_MICROS)
    body = ",\n".join(f"{e.replace('{epoch}', epoch)} AS {n}" for n, e in LOG_COLUMNS.items())
    return f"SELECT {body} FROM events"


DUCK_LOGS = _duck_logs()


def with_ctes(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


_LOGS = f"logs AS ({DUCK_LOGS})"
# t: typed rows
_T = "t AS (SELECT *, CAST(FLOOR(TRY_CAST(reqTimeSec AS DOUBLE)) AS BIGINT) AS req_ts FROM logs)"


def x(key: str) -> str:
    """Oracle text of the strict extract."""
    return f"NULLIF(regexp_extract(queryStr, '(?:^|&){key}=([^&]+)', 1), '')"


def xt(key: str) -> str:
    """Oracle text of the tolerant extract."""
    return f"NULLIF(TRIM(regexp_extract(queryStr, '(?:^|[?&]){key}=([^&]*)', 1)), '')"


def day(ts: str = "req_ts", offset: int = 0) -> str:
    return f"CAST(DATE '1970-01-01' + CAST(FLOOR(({ts} + {offset}) / 86400.0) AS INTEGER) AS DATE)"


TOKENS = "|".join(PLATFORM_TOKENS)
# Device type of the first keyword, in this order, that an agent holds. A TV sign goes before them all.
AGENT_TYPES = ((1, "android", "Android"), (2, "iphone", "iPhone"), (3, "ipad", "iPad"), (4, "windows", "Windows"), (5, "mac", "Mac"))
# The hour from which a part of the day counts.
DAYPARTS = ((0, "Night"), (5, "Morning"), (12, "Afternoon"), (17, "Evening"), (22, "Night"))


def values(rows: tuple) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(repr(v) for v in r) + ")" for r in rows) + ")"


DEVICE_TYPE_SQL = (
    "IF(contains(lower(coalesce({p}, '')), 'android_tv') OR regexp_matches(lower(coalesce(UA, '')), '{tv}'), 'Smart TV', coalesce((SELECT arg_min(kind, place) FROM "
    + values(AGENT_TYPES) + " AS agent_types(place, keyword, kind) WHERE contains(lower(coalesce(UA, '')), keyword)), 'Other'))"
)
TV = r"smarttv|hismarttv|bravia|\btv\b"
TV_WIDE = r"smarttv|hismarttv|bravia|cloudtv|xstream|tata sky binge|\btv\b"
HOUR = "((req_ts % 86400) // 3600)"
DAYPART_SQL = f"(SELECT arg_max(label, from_hour) FROM {values(DAYPARTS)} AS dayparts(from_hour, label) WHERE from_hour <= {HOUR})"
STREAM_ID = r"NULLIF(regexp_extract(reqPath, '(vglive-sk-\d+)', 1), '')"
CHANNEL_RAW = f"COALESCE({x('channel')}, {x('channel_name')}, {STREAM_ID}, 'Unknown')"

# qv: typed rows with the values of the query-string keys that reports use
_QV = "qv AS (SELECT *, " + ", ".join(f"{x(k)} AS qs_{k}" for k in ("device_id", "session_id", "platform", "device", "category_name", "content_title", "channel", "channel_name")) + f", {STREAM_ID} AS stream FROM t)"
# b: behaviour events
_B0 = _QV + f""",
b0 AS (SELECT qv.*, qs_device_id AS device_id, qs_session_id AS session_id, qs_platform AS platform, qs_device AS device_name, qs_category_name AS category_name,
  list_filter([qs_channel, qs_channel_name, stream], lambda v: v IS NOT NULL) AS found, {DAYPART_SQL} AS day_part, {day()} AS event_date
 FROM qv WHERE contains(queryStr, 'session_id=') AND req_ts IS NOT NULL AND qs_device_id IS NOT NULL AND qs_session_id IS NOT NULL),
b1 AS (SELECT *, coalesce(found[1], 'Unknown') AS channel_name_raw, coalesce(qs_content_title, found[1], reqPath) AS content_label FROM b0)"""
_B = f"""b AS (SELECT *, lower(regexp_replace(regexp_replace(channel_name_raw, '\\s*_\\s*', '_', 'g'), '_({TOKENS})$', '', 'i')) AS channel_name,
 {DEVICE_TYPE_SQL.format(p='platform', tv=TV)} AS device_type FROM b1)"""

# tl: distinct timeline rows
_HAS_KEY = lambda key: f"CAST(regexp_matches(COALESCE(queryStr, ''), '(^|&){key}=') AS INTEGER) AS has_{key}_key"
_TL0 = f"""tl0 AS (SELECT event_id, req_ts, state, reqHost, {day()} AS event_date, {x('platform')} AS platform, {xt('device_id')} AS device_id, {xt('session_id')} AS session_id,
 {_HAS_KEY('device_id')}, {_HAS_KEY('session_id')}, NULLIF(TRIM(cliIP), '') AS cliIP, NULLIF(TRIM(UA), '') AS UA,
 list_filter([{STREAM_ID}, regexp_extract(reqPath, '^([^/]+)/', 1), reqPath, '__unknown_stream__'], lambda v: v <> '')[1] AS stream_key FROM t WHERE req_ts IS NOT NULL)"""
# a device names its timeline, then a session with its viewer, then the viewer alone
_TL1 = """tl1 AS (SELECT *, 'device:' || device_id AS device_viewer, NULLIF(concat_ws('|', cliIP, UA), '') AS cliip_ua_viewer,
 IF(coalesce(device_id, session_id) IS NULL, 'no_id_estimated', 'id_sample') AS row_group,
 coalesce('id|device:' || device_id || '|' || coalesce('sid:' || session_id, 'no_sid'), 'id|sid:' || session_id || '|viewer:' || cliIP || '|' || UA,
  'noid|' || NULLIF(concat_ws('|', cliIP, UA), '')) || '|stream:' || stream_key AS timeline_key FROM tl0)"""
_TLCOLS = """timeline_key, row_group, cliip_ua_viewer, device_viewer, device_id, session_id, has_device_id_key,
 has_session_id_key, cliIP, UA, stream_key, event_date, req_ts"""
_TL = f"tl AS (SELECT DISTINCT {_TLCOLS} FROM tl1 WHERE timeline_key IS NOT NULL)"
# cw: capped watch rows
_CW = """cw AS (SELECT *, LEAST(GREATEST(next_ts - req_ts, 0), 60) AS watch_sec FROM
 (SELECT *, LEAD(req_ts) OVER (PARTITION BY timeline_key ORDER BY req_ts, cliip_ua_viewer NULLS FIRST, UA NULLS FIRST) AS next_ts FROM tl) WHERE next_ts IS NOT NULL)"""


def on_logs(body: str, *ctes: str) -> str:
    return with_ctes(body, _LOGS, _T, *ctes)


def on_behaviour(body: str, *ctes: str) -> str:
    return with_ctes(body, _LOGS, _T, _B0, _B, *ctes)


def on_timelines(body: str, *ctes: str) -> str:
    return with_ctes(body, _LOGS, _T, _TL0, _TL1, _TL, _CW, *ctes)
